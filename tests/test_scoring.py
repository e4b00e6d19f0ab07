"""Worked examples of the formulas, on small tables."""

import pytest
from pyspark.sql import functions as F

from fleetsense.functions import scalars as S
from fleetsense.operators import dashboard as D
from fleetsense.operators import readings as R

NODES = [(1, 23.7806, 90.2794), (2, 23.8103, 90.3963), (3, None, None)]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_clip_keeps_null(spark):
    r = one(spark, S.clip01(F.lit(None).cast("double")).alias("a"), S.clip01(F.lit(1.5)).alias("b"), S.clip01(F.lit(-1.0)).alias("c"))
    assert (r.a, r.b, r.c) == (None, 1.0, 0.0)


@pytest.mark.parametrize("p,expected", [(0.0, 1000.0), (0.3, 400.0), (0.5, 285.714286), (0.7, 222.222222), (1.0, 166.666667)])
def test_edge_cost(spark, p, expected):
    assert one(spark, S.edge_cost(1000.0, F.lit(p), F.lit(0.0), 0.5).alias("w")).w == pytest.approx(expected, abs=1e-5)


def test_edge_cost_with_traffic(spark):
    assert one(spark, S.edge_cost(1000.0, F.lit(0.5), F.lit(0.8), 0.5).alias("w")).w == pytest.approx(971.428571, abs=1e-5)


def test_priority_renormalises_over_what_is_present(spark):
    row = spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in {"distance_m": 0.0, "waste_level": 1.0, "gas_level": None, "temperature": 25.0, "humidity": 50.0, "traffic_density": None}.items()])
    r = row.select(S.priority().alias("p"), S.priority(missing="zero_fill").alias("z"), S.state_priority().alias("s")).first()
    assert r.p == pytest.approx((0.25 + 0.35) / 0.75) and r.z == pytest.approx(0.6 / 1.10) and r.s == pytest.approx(0.35 / 0.5)


def test_priority_without_features_is_zero(spark):
    row = spark.range(1).select(*[F.lit(None).cast("double").alias(k) for k in ("distance_m", *R.METRICS)])
    assert row.select(S.priority().alias("p")).first().p == 0.0


def test_aging(spark):
    r = one(spark, S.aged(0.1, F.lit(96.0)).alias("a"), S.aged(0.9, F.lit(0.0)).alias("b"))
    assert r.a == pytest.approx(0.6) and r.b == pytest.approx(0.9)


def test_latest_prefers_event_time_then_id(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 7L, TIMESTAMP_NTZ'2024-01-02', .1D), (2, 7L, TIMESTAMP_NTZ'2024-01-03', .2D), (3, 7L, TIMESTAMP_NTZ'2024-01-03', .3D) t(reading_id, node_id, timestamp, waste_level)")
    assert [r.reading_id for r in R.latest(rows).collect()] == [3]


def test_node_without_reading_scores_zero(spark):
    nodes = spark.createDataFrame(NODES, "node_id long, latitude double, longitude double")
    readings = spark.sql("SELECT 1L AS reading_id, 1L AS node_id, TIMESTAMP_NTZ'2024-01-01' AS timestamp, 1D AS waste_level, 1D AS gas_level, 40D AS temperature, 100D AS humidity, 0D AS traffic_density")
    scores = {r.node_id: r.priority for r in R.scored_nodes(nodes, readings, 23.7806, 90.2794).collect()}
    assert scores[1] == pytest.approx(1.0) and scores[2] == scores[3] == 0.0
    assert R.top_nodes(R.scored_nodes(nodes, readings, 23.78, 90.27), 0).count() == 3


def test_ingest_resolves_defaults_and_clamps(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "node_id long, node_name string")
    body = spark.createDataFrame([('{"node_id": 1, "gas_level": 7, "temperature": "x"}',), ('{"node_name": " b ", "waste_level": -2}',), ('{"node_id": 99}',), ("not json",)], "body string")
    rows = sorted(map(tuple, D.ingest(body, nodes).collect()))
    assert rows == [(1, 25.0, 60.0, 1.0, 0.0, 0.0), (2, 25.0, 60.0, 0.0, 0.0, 0.0)]


def test_ensure_fills_only_null_coordinates(spark):
    nodes = spark.createDataFrame([(1, "a", None, 5.0), (2, "b", 1.0, 2.0)], "node_id long, node_name string, latitude double, longitude double")
    want = spark.createDataFrame([(1, "a", 9.0, 9.0), (2, "b", 9.0, 9.0), (3, "c", 3.0, 4.0)], "want_id long, node_name string, latitude double, longitude double")
    assert sorted(map(tuple, D.ensure_nodes(nodes, want).collect())) == [(1, "a", 9.0, 5.0), (2, "b", 1.0, 2.0), (3, "c", 3.0, 4.0)]


def test_visibility(spark):
    n = spark.createDataFrame([(1, 3), (2, None), (3, 4)], "notification_id long, user_id long")
    assert D.visible(n, 3).count() == 1 and D.visible(n, 3, "mine_or_broadcast").count() == 2


def test_interpolation_holds_the_end_and_leaves_the_start(spark):
    f = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])], "node_id long, t int, x double")
    got = [r.x for r in R.interpolate(f, "x", "t").orderBy("t").collect()]
    assert got == [None, 2.0, 4.0, 6.0, 8.0, 8.0]


def test_times(spark):
    r = one(spark, S.parse_time(F.lit("1700000000")).cast("string").alias("a"), S.parse_time(F.lit("2024-01-02 03:04:05")).cast("string").alias("b"), S.parse_time(F.lit("soon")).alias("c"))
    assert (r.a, r.b, r.c) == ("2023-11-14 22:13:20", "2024-01-02 03:04:05", None)

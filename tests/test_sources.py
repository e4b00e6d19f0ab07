"""Readers, generators and streams."""

import json

import pytest
from pyspark.sql import functions as F

from fleetsense.operators import readings as R
from fleetsense.sources import generate as gen
from fleetsense.sources import io as IO


def test_csv_aliases_and_times(spark, tmp_path):
    (tmp_path / "t.csv").write_text('ts,device,temp,humidity,lpg\n1700000000,a,20,50,0.1\n2024-01-02 00:00:00,b,x,51,0.2\nnever,c,1,2,3\n')
    rows = IO.read_telemetry_csv(spark, str(tmp_path / "t.csv")).orderBy("timestamp").collect()
    assert [(r.node, r.temperature, r.gas_level) for r in rows] == [("a", 20.0, 0.1), ("b", None, 0.2)]
    with pytest.raises(ValueError):
        (tmp_path / "u.csv").write_text("x,y\n1,2\n")
        IO.read_telemetry_csv(spark, str(tmp_path / "u.csv"))


def test_fixture(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"model": "a.node", "pk": 1, "fields": {"name": "n"}}, {"model": "a.other", "pk": 2, "fields": {"name": "m"}}]))
    assert [tuple(r) for r in IO.read_fixture(spark, str(tmp_path / "f.json"), "a.node").collect()] == [(1, "n")]


def test_model_version(spark, tmp_path):
    assert IO.model_version(spark, str(tmp_path / "none")) == "unknown"
    IO.save_meta(spark, str(tmp_path / "meta"), {"version": "v7"})
    assert IO.model_version(spark, str(tmp_path / "meta")) == "v7"


def test_cached_features(spark, tmp_path):
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert IO.cached_features(spark, str(tmp_path / "c"), build).count() == 3
    assert len(calls) == 1


def test_simulation_reruns_agree_and_stay_in_range(spark):
    a = gen.simulate(gen.points(spark, 4), 5)
    b = gen.simulate(gen.points(spark, 4).repartition(3), 5)
    assert a.exceptAll(b).isEmpty() and a.count() == 4 * 120
    r = a.agg(F.min("fill"), F.max("fill"), F.min("gas"), F.max("gas"), F.max("time_to_overflow")).first()
    assert 0 <= r[0] and r[1] <= 1.3 and 0 <= r[2] and r[3] <= 1 and r[4] <= 24


def test_observation_loses_about_what_it_should(spark):
    o = gen.observe(gen.simulate(gen.points(spark, 6), 10), p_missing=0.5)
    lost = o.agg(F.avg(F.col("o_waste").isNull().cast("double"))).first()[0]
    assert 0.45 < lost < 0.55


def test_late_row_never_displaces_a_newer_one(spark, tmp_path):
    from fleetsense.streaming import telemetry

    src = tmp_path / "in"
    schema = "node_id long, timestamp timestamp, reading_id long, waste_level double, gas_level double"
    rows = [[(1, "2024-01-02 00:00:00", 1, 0.5, 0.1)], [(1, "2024-01-01 00:00:00", 2, 0.9, 0.1), (2, "2024-01-01 00:00:00", 3, 0.2, 0.1)]]
    for i, r in enumerate(rows):
        spark.createDataFrame(r, "node_id long, timestamp string, reading_id long, waste_level double, gas_level double").withColumn("timestamp", F.to_timestamp("timestamp")).coalesce(1).write.mode("append").parquet(str(src))
        stream = telemetry.latest_state(spark.readStream.schema(schema).parquet(str(src)))
        q = stream.writeStream.outputMode("update").foreachBatch(lambda b, e, i=i: b.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    out = R.latest(spark.read.parquet(str(tmp_path / "out")))
    assert {r.node_id: r.reading_id for r in out.collect()} == {1: 1, 2: 3}


def test_sessions_and_cycles(spark, tmp_path):
    from fleetsense.streaming import telemetry

    src = tmp_path / "in"
    rows = [(1, f"2024-01-0{d} 00:00:00", d, 0.99 if d % 2 else 0.1, 0.1) for d in range(1, 8)]
    spark.createDataFrame(rows, "node_id long, timestamp string, reading_id long, waste_level double, gas_level double").withColumn("timestamp", F.to_timestamp("timestamp")).write.parquet(str(src))
    read = lambda: spark.readStream.schema("node_id long, timestamp timestamp, reading_id long, waste_level double, gas_level double").parquet(str(src))
    assert telemetry.run_once(telemetry.sessions(read(), "1 hour"), "append", "s1", str(tmp_path / "a")).count() == 6
    assert telemetry.run_once(telemetry.cycles(read()), "update", "s2", str(tmp_path / "b")).agg(F.max("times")).first()[0] == 4


def test_features_by_node_bucket(spark, tmp_path):
    build = lambda: spark.range(40).select(F.col("id").alias("node_id"))
    got = IO.cached_features(spark, str(tmp_path / "b"), build, node="node_id", buckets=4)
    assert got.count() == 40 and {r[0] for r in got.select("node_bucket").distinct().collect()} == {0, 1, 2, 3}


def test_telemetry_is_emptied_once_full(spark):
    rows = gen.telemetry(spark.range(5).withColumnRenamed("id", "node_id"), cycles=120).orderBy("node_id", "cycle").collect()
    for a, b in zip(rows, rows[1:]):
        if a.node_id == b.node_id:
            assert (b.waste_level == 0.0) == (a.waste_level >= 0.98), (a, b)
    assert all(0 <= r.gas_level <= 1 for r in rows)


def test_refresh_takes_what_is_new_with_the_servers_time(spark, tmp_path):
    from fleetsense.streaming import telemetry

    src = str(tmp_path / "in")
    nodes = spark.createDataFrame([(1, "a")], "node_id long, node_name string")
    spark.createDataFrame([(7, '{"node_id": "1", "waste_level": "2", "timestamp": "1999-01-01"}'), (8, '{"node_id": "9"}'), (9, None)], "reading_id long, body string").write.parquet(src)
    arriving = spark.readStream.schema("reading_id long, body string").parquet(src)
    q = telemetry.refresh(telemetry.ingest(arriving, nodes), lambda b, e: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={e}"), str(tmp_path / "cp"), every="1 second")
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).select("reading_id", "node_id", "waste_level", (F.year("timestamp") > 2000).alias("now")).collect()
    assert [tuple(r) for r in got] == [(7, 1, 1.0, True)]


def test_fill_state_goes_on_over_batches(spark, tmp_path):
    from fleetsense.streaming import telemetry

    src, schema = str(tmp_path / "in"), "node_id long, timestamp timestamp, reading_id long, waste_level double"
    for i, level in enumerate((0.5, 0.6, 0.25)):
        spark.createDataFrame([(1, i, level)], "node_id long, reading_id long, waste_level double").withColumn("timestamp", F.timestamp_seconds("reading_id")).select("node_id", "timestamp", "reading_id", "waste_level").write.mode("append").parquet(src)
        q = telemetry.fill_machine(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("update").foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={e}")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("batch").select("fill", "emptied").collect()
    assert [tuple(r) for r in got] == [(0.5, 0), (0.0, 1), (0.25, 1)]


def test_two_decimals_are_those_of_c(spark):
    import random

    from fleetsense.functions import scalars as S

    r = random.Random(3)
    given = [0.0, 0.005, 0.015, 0.125, 0.375, 1.005, 23.785, 23.795, 99.995, 0.995, 1e-300, -0.125, -23.785, -0.001, 123456789.125] + [23.78 + k * 0.00006 for k in range(1009)] + [r.uniform(-200, 200) for _ in range(500)] + [k / 8 for k in range(100)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(given)] + [(-1, None)], "i long, x double").select("i", S.two_decimals("x").alias("s")).collect()
    assert {x.i: x.s for x in got} == {i: "%.2f" % x for i, x in enumerate(given)} | {-1: None}


def test_facet_shows_nodes_without_a_place(spark, tmp_path):
    """Node 28 has no place; its label says null in full."""
    from fleetsense.plans import catalogue

    from .oracle import assert_same

    for name in ("nation", "events"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    rows = [(28, "Customer#99", 7), (0, "Customer#99", 7), (99, "Customer#99", 7)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    for name in ("region", "supplier", "part", "orders", "lineitem", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    assert_same(catalogue.queries()["facet_filters"](spark, str(tmp_path)), catalogue.oracle_sql()["facet_filters"], str(tmp_path))

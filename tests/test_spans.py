import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetsense.operators import readings as R
from fleetsense.operators import spans

SCHEMA = "node_id long, reading_id long, timestamp timestamp, waste_level double, gas_level double, temperature double, humidity double, traffic_density double"


def hot(spark, n=1500):
    """Readings of which one node sent two thirds, with equal times, lost values and long silences."""
    import datetime

    r, t = random.Random(n), datetime.datetime(2024, 1, 1)
    rows = []
    for k in range(n):
        t += datetime.timedelta(minutes=r.choice([0, 0, 3, 40, 600]))
        value = lambda: None if r.random() < 0.2 else r.random() * 1.1
        rows.append((0 if r.random() < 0.66 else r.randint(1, 6), k, t, value(), value(), value(), value(), value()))
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    norm = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in df.select(*columns).collect()), key=repr)
    assert norm(a) == norm(b)


def test_placed(spark):
    df, rows = hot(spark)
    got = spans.placed(df.select("node_id", "reading_id"), ["node_id"], ["reading_id"], "nth", "n").collect()
    by = {}
    for x in sorted(rows, key=lambda x: x[1]):
        by.setdefault(x[0], []).append(x[1])
    assert {(x.node_id, x.reading_id, x.nth, x.n) for x in got} == {(k, i, j, len(v)) for k, v in by.items() for j, i in enumerate(v)}
    alone = spans.placed(df.select("reading_id"), [], ["reading_id"]).collect()
    assert all(x.nth == x.reading_id for x in alone) and len(alone) == len(rows)


def test_forward_fill_of_a_hot_node(spark):
    df, _ = hot(spark)
    values = {c: c for c in R.METRICS}
    got = spans.carried(df.select("reading_id", "node_id", "timestamp", *[F.col(c).alias(f"_{c}") for c in R.METRICS]), ["node_id"], ["timestamp", "reading_id"], {c: f"_{c}" for c in values})
    same(got.drop(*[f"_{c}" for c in values]), R.forward_fill(df))


@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, strict):
    df, rows = hot(spark)
    r = random.Random(9)
    asks = [(k, r.choice([0, 0, 0, 1, 2, 77, None]), r.choice(rows)[2] if k % 50 else None) for k in range(600)]
    left = spark.createDataFrame(asks, "ask long, node_id long, at timestamp").repartition(3)
    got = spans.asof(left, df.select("node_id", "reading_id", "timestamp", "waste_level"), "node_id", "at", "reading_id", "timestamp", strict)
    assert got.columns == ["ask", "node_id", "at", "reading_id", "timestamp", "waste_level"]
    by = {}
    for x in sorted(rows, key=lambda x: (x[2], x[1])):
        by.setdefault(x[0], []).append(x)
    want = []
    for k, node, at in asks:
        of = by.get(node, []) if at is not None else []
        place = (bisect_left if strict else bisect_right)([x[2] for x in of], at) if of else 0
        hit = of[place - 1] if place else (None,) * 4
        want.append((k, node, at, hit[1], hit[2], hit[3]))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_hot_node_is_many_tasks(spark):
    """The rows of one node lie in as many ranges as there are partitions, none of which holds most of them."""
    df, rows = hot(spark, 4000)
    dealt = spans._dealt(df, ["node_id"], ["timestamp", "reading_id"]).where("node_id = 0").groupBy("_range").count().collect()
    n = sum(x[0] == 0 for x in rows)
    assert len(dealt) >= 3 and max(x["count"] for x in dealt) < 0.6 * n


def test_labels_in_stretches(spark):
    df, _ = hot(spark)
    us = F.unix_micros("timestamp")
    same(spans.by_time(df, R.hazard_label, "node_id", us, 24 * R.HOUR_US, ahead=6 * R.HOUR_US), R.hazard_label(df))
    same(spans.by_time(df, R.overflow_label, "node_id", us, 24 * R.HOUR_US, ahead=24 * R.HOUR_US), R.overflow_label(df))


@pytest.mark.parametrize("size", [10, 64])
def test_rolling_in_stretches(spark, size):
    df, _ = hot(spark)
    got = spans.by_count(df, lambda x: R.rolling(x, keep=("_own", "_nth")), "node_id", ["timestamp", "reading_id"], size, 10)
    same(got, R.rolling(df))


def test_frames_that_reach_back(spark):
    df, _ = hot(spark, 400)
    us = F.unix_micros("timestamp")

    def count(x):
        w = Window.partitionBy("node_id").orderBy(us).rangeBetween(-R.HOUR_US * 5, R.HOUR_US * 3)
        return x.withColumn("n", F.count("*").over(w))

    same(spans.by_time(df, count, "node_id", us, 6 * R.HOUR_US, ahead=3 * R.HOUR_US, behind=5 * R.HOUR_US), count(df))


def test_empty_and_too_short(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert spans.asof(df.select("node_id", F.col("timestamp").alias("at")), df, "node_id", "at", "reading_id", "timestamp").count() == 0
    assert spans.by_time(df, R.hazard_label, "node_id", F.unix_micros("timestamp"), R.HOUR_US, ahead=R.HOUR_US).count() == 0
    with pytest.raises(ValueError):
        spans.by_count(df, R.rolling, "node_id", ["reading_id"], 3, 10)

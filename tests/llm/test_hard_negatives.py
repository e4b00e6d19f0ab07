import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetsense.llm import hard_negatives, queries, sql

from ..oracle import assert_same

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=10, positives=5, negatives=10):
    kept = set()
    for i, v, y in rows:
        if i is None or y is None or not v or any(x is None or not math.isfinite(x) or abs(x) * 256 > hard_negatives.GREATEST for x in v):
            continue
        kept.add((i, tuple(math.floor(256 * float(np.float32(x))) for x in v), y))
    out = []
    for a, x, y in kept:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, v)), i, z) for i, v, z in kept if i != a and len(v) == len(x))
        for s, p, _ in [t for t in scored if t[2] == y][:positives]:
            found = [(t, i) for t, i, z in scored if z != y and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, p, k, i, -s, -t) for k, (t, i) in enumerate(found, 1)]
    return sorted(out)


def mined(df, every=10, **how):
    got = hard_negatives.mine(df, F.col("vec_id") % every == 0, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def random_rows(n, seed, d=8, step=None):
    r = random.Random(seed)
    value = (lambda: r.choice(step)) if step else (lambda: r.gauss(0.1, 0.4))
    return [(k, [value() for _ in range(d)], r.randint(0, 3)) for k in range(n)]


def test_twin(spark):
    assert_same(queries.op12_hard_negatives(spark, "/root/testdata/sf0.01"), sql.ORACLES["op12_hard_negatives"], "/root/testdata/sf0.01")


def test_against_all_pairs_with_ties(spark):
    """Few values, so that scores tie often."""
    rows = random_rows(300, 1, d=4, step=[0.0, 0.5, 1.0])
    want = brute(rows)
    assert len(want) > 100 and mined(spark.createDataFrame(rows, SCHEMA).repartition(5)) == want


@pytest.mark.parametrize("size", [(7, 3), (64, 16)])
def test_blocks_do_not_matter(spark, monkeypatch, size):
    rows = random_rows(400, 2)
    for name, v in zip(("BLOCK", "STRIP"), size):
        monkeypatch.setattr(hard_negatives, name, v)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 5)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 10)
    want = brute(rows)
    assert want and mined(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [*random_rows(80, 3), (100, [nan] * 8, 1), (101, [inf] + [0.0] * 7, 1), (102, None, 1), (103, [], 1), (104, [0.1] * 8, None), (None, [0.5] * 8, 2), (105, [None] + [0.1] * 7, 1), (106, [3e38] * 8, 1)]
    rows += [(110, [0.3, -0.2, 0.1], 1), (120, [0.3, -0.1, 0.1], 1), (121, [0.2, -0.1, 0.1], 2)]  # of another length
    rows += [(10, [0.4] * 8, 1), (10, [0.4] * 8, 1), (10, [0.5] * 8, 2)]  # repeated rows and ids
    rows += [(200 + k, [0.4, 0.1] * 4, k % 2) for k in range(60)]  # a common vector
    rows += [(300, [0.0] * 8, 1), (301, [60000.0] * 8, 1), (310, [50000.0] * 8, 2), (302, [40000.0] * 8, 1)]  # none, and large scores
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("number"), F.lit(2).alias("Window"), F.lit("x").alias("block"))
    assert mined(df) == brute(rows)


def test_empty_table_and_no_anchor(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 2)], SCHEMA)) == []


def test_bounds_hold_the_score():
    r = np.random.default_rng(1)
    x, rows = r.integers(-200, 200, (5, 16)).astype(float), r.integers(-200, 200, (40, 16)).astype(float)
    low, high = rows - r.integers(0, 9, rows.shape), rows + r.integers(0, 9, rows.shape)
    least, most = hard_negatives.bounds(x, low, high)
    assert (least <= 2 * x @ rows.T).all() and (2 * x @ rows.T <= most).all()


def test_the_file_spares_exact_scores(spark):
    """Of some thousand rows few are scored."""
    import pandas as pd

    rows = random_rows(4000, 5, d=16)
    frame = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"])
    scaled = hard_negatives.scaled(spark.createDataFrame(frame).select(F.col("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), "label"))
    cuts = hard_negatives.fit_cuts(scaled)
    block = hard_negatives.approximation_file(scaled.coalesce(1), cuts).collect()[0].asDict()
    n, d = block["n"], block["dim"]
    x = np.frombuffer(block["vectors"], "<i4").reshape(n, d)[:20]
    anchor = {"own": np.arange(-20, 0).tobytes(), "of": np.zeros(20, np.int64).tobytes(), "queries": x.tobytes(), "low": np.full(20, -(1 << 60)).tobytes(), "high": np.full(20, 1 << 60).tobytes()}
    lists, seen = hard_negatives.Lists(20, 1, 5), []
    add = lists.add
    lists.add = lambda at, score, ids: (seen.append(len(at)), add(at, score, ids))
    hard_negatives.search(lists, block, cuts, anchor, same=False)
    assert len(lists.at) == 100 and 100 <= sum(seen) < 20 * n / 50

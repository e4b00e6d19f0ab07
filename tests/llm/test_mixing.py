import pytest
from pyspark.sql import functions as F

from fleetsense.llm import mixing

from . import helpers as H


def brute_targets(sizes, weights=(5, 2, 1)):
    w = [weights[i % 3] for i in range(len(sizes))]
    capped: set[int] = set()
    while True:
        left = 1.5 * sum(sizes) - sum(2 * sizes[i] for i in capped)
        open_ = [i for i in range(len(sizes)) if i not in capped]
        t = {i: left * w[i] / sum(w[j] for j in open_) for i in open_}
        over = [i for i in open_ if t[i] > 2 * sizes[i]]
        if not over:
            return [2.0 * sizes[i] if i in capped else t[i] for i in range(len(sizes))]
        capped |= set(over)


@pytest.mark.parametrize("sizes", [[100], [10, 1000, 1000], [5, 5, 5, 5000], [1, 2, 3, 4, 5, 6, 700], [0, 10, 10]])
def test_targets(sizes):
    got = mixing.targets(sizes)
    assert got == pytest.approx(brute_targets(sizes)) and sum(got) == pytest.approx(1.5 * sum(sizes))
    assert all(t <= 2 * n + 1e-9 for t, n in zip(got, sizes))


def test_mix_on_awkward_rows(spark):
    df, rows = H.awkward(spark)
    got = mixing.mix(df).collect()
    words = lambda t: len(H.WORD.findall(t or ""))
    assert sorted(((r.doc_id or -1), r.size) for r in got) == sorted(((r[0] or -1), words(r[1])) for r in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = [sum(words(r[1]) for r in rows if r[3] == s) for s in names]
    want = dict(zip(sizes, mixing.targets(sizes)))
    assert {(r.source_size, round(r.target, 6)) for r in got} == {(k, round(v, 6)) for k, v in want.items()}
    taken = {}
    for r in got:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    assert all(abs(taken[k] - v) <= 1 for k, v in want.items())
    again = mixing.mix(df.repartition(5))
    assert mixing.mix(df).exceptAll(again).isEmpty()


def test_schedule_is_even_everywhere(spark):
    df = spark.createDataFrame([(i, H.prose(i, 200), "abc"[i % 3]) for i in range(60)], "doc_id long, text string, source string")
    plan = mixing.Plan(mixing.sized(df, "doc_id"), block=20)
    slots = mixing.schedule(spark, plan).orderBy("slot").collect()
    assert len({s.slot for s in slots}) == len(slots) == sum(plan.slots)
    for src, n in enumerate(plan.slots):
        mine = sorted(s.rank for s in slots if s.src == src)
        assert mine == list(range(n))
        assert sum(s.hi - s.lo for s in slots if s.src == src) == plan.quota[src]
        for upto in (len(slots) // 4, len(slots) // 2):
            seen = sum(s.src == src for s in slots[:upto])
            assert abs(seen / upto - n / len(slots)) < 0.02


def test_mixed_documents(spark):
    df, rows = H.awkward(spark)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sum(len(H.WORD.findall(r.text)) for r in got) == mixing.mix(df).agg(F.sum("taken")).first()[0]
    texts = {r[1] for r in rows}
    assert sum(r.text not in texts for r in got) <= 4 and all(r.n_chars == len(r.text) for r in got)


def test_repeated_rows_lose_no_word(spark):
    rows = [(1, "a b c d e f g", "s"), (1, "a b c d e f g", "s"), (2, "h i j k l m n o p q r", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(df).agg(F.sum("taken")).first()[0]
    assert sum(len(H.WORD.findall(r.text)) for r in mixing.mixed_documents(df).collect()) == taken == 38


def test_clashing_names_and_order(spark):
    clash = ("one", "two", "row", "taken", "size", "first", "last", "slot", "_slot", "source_size", "Slot ")
    df = spark.createDataFrame([(i, H.prose(i, 30 + i % 50), "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string").select("*", *[F.lit(7).alias(c) for c in clash])
    out = mixing.mixed_documents(df, block=64)
    assert out.columns == df.columns
    rows = out.withColumn("part", F.spark_partition_id()).collect()
    n = {s: sum(r.source == s for r in rows) / len(rows) for s in "abc"}
    for part in {r.part for r in rows}:  # each stretch of the schedule has each source's share
        mine = [r for r in rows if r.part == part]
        assert len(mine) < 30 or all(abs(sum(r.source == s for r in mine) / len(mine) - n[s]) < 0.15 for s in "abc")


def test_block_length_does_not_depend_on_the_corpus(spark):
    for n in (1, 500):
        df = spark.createDataFrame([(i, H.prose(i, 40), "a") for i in range(n)], "doc_id long, text string, source string")
        assert mixing.Plan(mixing.sized(df, "doc_id")).block == mixing.BLOCK_WORDS


def test_sums_in_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEVEL", 3)
    rows = [(s, k, k % 5 + s) for s in (0, 1) for k in range(20)]
    got = {(r.src, r.k): r.before for r in mixing.before(spark.createDataFrame(rows, "src int, k long, v long"), "k", "v").collect()}
    assert got == {(s, k): sum(v for t, j, v in rows if t == s and j < k) for s, k, _ in rows}


def test_empty_and_wordless(spark):
    e = spark.createDataFrame([], H.SCHEMA)
    assert mixing.mix(e).count() == 0 and mixing.mixed_documents(e).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert {(r.size, r.taken, r.target) for r in mixing.mix(blank).collect()} == {(0, 0, 0.0)}

import hashlib
import math
import random
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from fleetsense.llm import simhash

from . import helpers

COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_within"]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def long_hash(x, seed=42):
    return xxhash.xxh64(struct.pack("<q", x), seed=seed).intdigest()


def pair_hash(x, y):
    return signed(long_hash(y, long_hash(x)))


def fingerprint(text):
    words = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in helpers.WORD.findall(text.lower())]
    terms = Counter(dict.fromkeys(words, 1))
    terms.update(pair_hash(x, y) for x, y in zip(words, words[1:]))
    votes, total = [0] * 128, sum(terms.values())
    first = xxhash.xxh64(struct.pack("<i", 7), seed=42).intdigest()
    for t, n in terms.items():
        for half, h in enumerate((t & (1 << 64) - 1, long_hash(t, first))):
            for k in range(64):
                votes[64 * half + k] += n * (h >> k & 1)
    halves = [sum((2 * votes[64 * h + k] > total) << k for k in range(64)) for h in (0, 1)]
    return f"{halves[0]:016x}{halves[1]:016x}"


def bits(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def likeness(a, b):
    return 1.0 if a == b else max(0.0, math.cos(math.pi * bits(a, b) / 128))


def brute(rows):
    """rows of (doc_id, text), in an order that settles repeated ids."""
    texts = [t or "" for _, t in rows]
    out = []
    for k, (i, _) in enumerate(rows):
        t, following = texts[k], texts[(k + 1) % len(rows)]
        e = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        f, g, h = map(fingerprint, (t, e, following))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, round(likeness(f, g), 9), round(likeness(f, h), 9)))
    for k, row in enumerate(out):
        ask = row[0] is not None and row[0] % 20 == 0
        out[k] = (*row, sum(bits(row[3], o[3]) <= simhash.RADIUS for o in out) - 1 if ask else None)
    return out


def got(df):
    out = simhash.compared(df)
    assert out.columns == COLUMNS
    return [(*r[:5], round(r[5], 9), round(r[6], 9), r[7]) for r in out.collect()]


def test_against_brute_force(spark):
    r = random.Random(1)
    base = [helpers.prose(k, r.randint(1, 60)) for k in range(60)]
    rows = [(k, r.choice(base) + r.choice(["", "", " é😀 zz", " The the"])) for k in r.sample(range(-500, 500), 200)]
    rows += [(1000 + 20 * k, base[0]) for k in range(30)] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "Ünder"), (2004, helpers.prose(9, 4000))]
    want = sorted(brute(sorted(rows, key=lambda x: -x[0])))
    assert sorted(got(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))) == want


def test_awkward_rows(spark):
    df, rows = helpers.awkward(spark)
    out = got(df)
    assert Counter(o[0] for o in out) == Counter(r[0] for r in rows)
    unique = [r for r in rows if r[0] is not None and sum(x[0] == r[0] for x in rows) == 1]
    by_id = {o[0]: o for o in out}
    for r in unique:
        assert by_id[r[0]][1] == len(r[1] or "") and by_id[r[0]][3] == fingerprint(r[1] or "")
    # Rows that repeat an id are equal here, so their order does not matter; the null ids come last.
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    want = {w[0]: w for w in brute([(r[0], r[1]) for r in order])}
    for r in unique[:]:
        if r[0] != order[-1][0]:
            assert by_id[r[0]][:7] == want[r[0]][:7]


def test_one_row_and_none(spark):
    text = "one two three four five six"
    ((i, n, sha, f, e, near, following, within),) = got(spark.createDataFrame([(20, text)], "doc_id long, text string"))
    assert (i, n, f, following, within) == (20, len(text), fingerprint(text), 1.0, 0)
    assert sha == hashlib.sha256((text[:18] + text[:9]).encode()).hexdigest()
    assert got(spark.createDataFrame([], helpers.SCHEMA)) == []


def test_many_buckets_make_one_order(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKETS", 40)
    rows = [(k, f"text {k} of some") for k in range(300)] + [(None, "nobody's")]
    want = sorted(brute([*sorted(rows[:-1], key=lambda x: -x[0]), rows[-1]]), key=repr)
    assert sorted(got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), key=repr) == want


@pytest.mark.parametrize(("radius", "part"), [(0, 1024), (3, 3), (6, 50)])
def test_within_finds_all(spark, monkeypatch, radius, part):
    """Clusters of fingerprints that differ in a few bits, some of them many times over."""
    monkeypatch.setattr(simhash, "PART", part)
    r = random.Random(radius)
    prints = []
    for _ in range(12):
        centre = r.getrandbits(128)
        for _ in range(25):
            x = centre
            for _ in range(r.randint(0, 7)):
                x ^= 1 << r.randrange(128)
            prints += [x] * r.choice([1, 1, 3])
    rows = [(k, signed(x & (1 << 64) - 1), signed(x >> 64), k % 5 == 0) for k, x in enumerate(prints)]
    found = simhash.within(spark.createDataFrame(rows, "doc_id long, a long, b long, query boolean"), radius).collect()
    result = {(x.a, x.b): (x.n_within, x.least) for x in found}
    assert len(result) == len(found) and set(result) == {(a, b) for _, a, b, q in rows if q}
    for k, x in enumerate(prints):
        if k % 5 == 0:
            near = [j for j, y in enumerate(prints) if bin(x ^ y).count("1") <= radius]
            assert result[rows[k][1:3]] == (len(near), min(near))


def test_no_python_on_the_main_path(spark):
    plan = simhash.compared(spark.createDataFrame([(1, "a b c"), (2, "b c d")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    rows = simhash.followed(spark.createDataFrame([(1, "a b c"), (2, "b c d")], "doc_id long, text string"))
    assert {(x.text, x.next) for x in rows.where(F.col("real")).collect()} == {("a b c", "b c d"), ("b c d", "a b c")}

import duckdb
import pytest

from fleetsense.llm import exact_dedup, graph, jaccard_join, sql

from . import helpers as H


def test_exact_on_awkward_rows(spark):
    df, rows = H.awkward(spark)
    want = H.exact([(r[0], r[1]) for r in rows])
    got = exact_dedup.duplicates(df).collect()
    by_sha = {H.sha(t): v for t, v in want.items()}
    assert len(got) == len(rows)
    assert all((r.keep_id, r.group_size) == by_sha[r.text_sha256] for r in got)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(want) and all(r.doc_id == r.keep_id for r in kept)
    one = exact_dedup.keep_one(df)
    assert one.columns == df.columns and one.count() == len({r.text_sha256 for r in got})


def test_exact_hot_group_over_batches(spark, monkeypatch):
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"own {i}") for i in range(3000)], "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    r = {x.doc_id: x for x in exact_dedup.duplicates(df).collect()}
    assert r[1].keep_id == 2999 and r[1].group_size == 2000 and r[3].group_size == 1 and sum(x.kept for x in r.values()) == 1001


def test_exact_hot_group_is_aggregated_first(spark):
    plan = exact_dedup.duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max" in plan


def test_keep_one_with_clashing_names(spark):
    from pyspark.sql import functions as F

    df, rows = H.awkward(spark)
    df = df.select("*", *[F.lit(1).alias(c) for c in ("stays", "own", "_sha", "_own", "rep")])
    one = exact_dedup.keep_one(df)
    assert one.columns == df.columns and one.count() == len({r[1] or "" for r in rows})


def test_exact_twin(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (6, "B"), (7, "a ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(map(tuple, exact_dedup.duplicates(df).collect())) == sorted(con.execute(sql.EXACT_DEDUP).fetchall())


def near_rows():
    base = H.prose(50, 100).split()
    rows = []
    for k in range(30):  # a chain: each differs from the last by a word, so its ends do not link
        w = list(base)
        for j in range(k):
            w[(j * 3) % 100] = f"new{j}"
        rows.append((100 + k, " ".join(w)))
    return rows


def test_join_on_awkward_rows(spark):
    df, rows = H.awkward(spark, near_rows())
    want = H.components([(r[0], r[1]) for r in rows])
    got = jaccard_join.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.component_id == want[r.doc_id][1], r
    sizes = {(r[0], len(H.shingles(r[1]))) for r in rows}
    assert {(r.doc_id, r.n_shingles) for r in got} == sizes


@pytest.mark.parametrize("part, hub, askers", [(2, 64, 2048), (512, 64, 2048), (3, 2, 2), (512, 2, 1)])
def test_join_links_across_parts_groups_and_hubs(spark, monkeypatch, part, hub, askers):
    for name, value in (("PART", part), ("HUB", hub), ("ASKERS", askers)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_rows() + [(500 + k, H.prose(70, 60) + " " + H.prose(71 + k, 8)) for k in range(12)] + [(900, H.prose(90, 40)), (901, H.prose(90, 40).upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()} == H.components(rows)


def met_rows(spark, rows):
    """Rows of the matrix where each document is a group by itself."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    groups = df.select("doc_id", df.doc_id.alias("group"))
    return jaccard_join.matrix(df, groups, jaccard_join.frequency_table(df, 4), 4).collect()


def test_matrix_does_not_grow_with_pairs(spark):
    """Documents that share a passage of 8 words meet by none of its tokens, as rarer ones come first."""
    passage = H.prose(5, 8)
    rows = [(i, H.prose(1000 + i, 5) + " " + passage + " " + H.prose(5000 + i, 4)) for i in range(2000)]
    assert len(met_rows(spark, rows)) <= 20


def test_tokens_that_all_have_are_hubs(spark):
    """Where prefixes reach the common tokens, each token gives a row for a group and not the pairs."""
    parts = [H.prose(20 + k, 12) for k in range(6)]
    rows = [(i, " ".join(parts[(i >> k) % 6] for k in range(0, 10, 2)) + f" w{i % 3}") for i in range(600)]
    met = met_rows(spark, rows)
    hubs = [r for r in met if r.hub is not None]
    assert hubs and all(r.g2 is None for r in hubs) and len(met) <= 64 * sum(len(H.shingles(t)) // 4 for _, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()} == H.components(rows)


def test_frequency_table_counts_all(spark):
    texts = [(i, "a b c d e" if i < 40 else f"own words {i} x y") for i in range(60)] + [(100 + i, " ".join(f"k{i}{c}" for c in "abcdefgh") + " m n o p q " + f"z{i}") for i in range(400)]
    table = jaccard_join.frequency_table(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), 4)
    import pyarrow as pa

    once, many = jaccard_join.shingle_sets(pa.array(["own words 50 x y", "m n o p q"], pa.large_string()))
    assert jaccard_join.frequency(once, table).tolist() == [0] and jaccard_join.frequency(many, table).tolist() == [3]


def test_join_twin(spark):
    rows = near_rows() + [(1, None), (2, ""), (3, "a b"), (4, "A b"), (5, "é É"), (6, " "), (7, "x\u00a0y z"), (8, H.prose(9, 30)), (9, H.prose(9, 30).title())]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    df = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, df.select("component_id", "doc_id", "n_shingles").collect())) == sorted(con.execute(f"SELECT component_id, doc_id, n_shingles FROM ({sql.JACCARD_JOIN})").fetchall())


def test_keep_first_on_awkward_rows(spark):
    df, rows = H.awkward(spark, near_rows())
    df = df.withColumn("stays", df.score).withColumn("_stays", df.score)
    want = H.components([(r[0], r[1]) for r in rows])
    got = jaccard_join.keep_first(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == sorted((r[0] or -1, r[1] or "") for r in rows if r[0] is None or want[r[0]][1] == r[0])


def test_threshold_is_exact(spark):
    """Sets of 9 words have 5 shingles; 4 of 5 in common is 4 / 6, below; 100 * 8 >= 80 * 10 links just so."""
    w = [f"w{i}" for i in range(13)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:12] + ["other"])), (3, " ".join(w[:9])), (4, " ".join(w[:8] + ["z"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()} == H.components(rows)


def test_prefix_of_the_definition():
    for n in range(1, 400):
        p, s = jaccard_join.prefix_size(n), jaccard_join.short_size(n)
        assert 1 <= s <= p <= n and n - p + 1 >= 0.8 * n


def test_empty_tables(spark):
    e = spark.createDataFrame([], H.SCHEMA)
    assert exact_dedup.duplicates(e).count() == 0 and jaccard_join.near_duplicates(e).count() == 0 and jaccard_join.keep_first(e).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150)] + [(300, 300 + k) for k in range(1, 40)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 150: 100, **{300 + k: 300 for k in range(40)}}


def test_buckets_are_held_one_at_a_time():
    """A task that is dealt many buckets gives each as soon as the next one begins, with all its blobs."""
    import pyarrow as pa

    read = []

    def batches():
        for k, ids in enumerate(([0, 0, 3], [3, 3], [3, 7], [9])):
            read.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([bytes([k, i]) for i in range(len(ids))])], ["bucket", "tokens"])

    got = []
    for (blobs,) in jaccard_join.buckets(batches(), "tokens"):
        got.append((len(read), list(blobs)))
        blobs.clear()
    assert got == [(1, [b"\0\0", b"\0\1"]), (3, [b"\0\2", b"\1\0", b"\1\1", b"\2\0"]), (4, [b"\2\1"]), (4, [b"\3\0"])]
    assert list(jaccard_join.buckets([], "tokens")) == []


def test_texts_are_hashed_in_slices(monkeypatch):
    """Hashing takes many times the bytes that it is given, so a batch is not hashed as a whole; sets are the same."""
    import pyarrow as pa

    texts = pa.array([f"Text {i} has words {i % 7} that\nothers have too " * (i % 5) for i in range(200)] + ["", "one", "long " * 500], pa.large_string())
    want = [x.tolist() for x in jaccard_join.shingle_sets(texts)]
    given, real = [], jaccard_join.hashing.words_of
    monkeypatch.setattr(jaccard_join, "HASH_BYTES", 1000)
    monkeypatch.setattr(jaccard_join.hashing, "words_of", lambda data, bounds: given.append((len(data), len(bounds) - 1)) or real(data, bounds))
    assert [x.tolist() for x in jaccard_join.shingle_sets(texts.slice(3))] == want[3:]
    assert sum(n for _, n in given) == len(texts) - 3
    assert all(size <= 1000 or n == 1 for size, n in given)
    assert jaccard_join.shingle_sets(texts.slice(0, 0)) == []


def test_arrow_batches_are_bounded_by_bytes(spark):
    """Rows of a shuffle are blobs: a thousand of them may be a hundred MB."""
    jaccard_join.common.small_batches(spark)
    blobs = spark.range(0, 200, 1, 1).selectExpr("id", "repeat('x', 200000) AS x")
    sizes = [r.n for r in blobs.mapInArrow(lambda batches: (b.from_arrays([b.column("id").slice(0, 1), __import__("pyarrow").array([b.nbytes])], ["id", "n"]) for b in batches), "id long, n long").collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * jaccard_join.common.ROWS_BYTES

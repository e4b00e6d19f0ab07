import zlib

import pytest
from pyspark.sql import functions as F

from fleetsense.llm import quality_classifier, quality_rules, toxicity

from . import helpers as H

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out_accuracy(df, labels, label):
    rows = df.where("held_out").join(labels, "doc_id").select("predicted", label).collect()
    return sum(r[0] == r[1] for r in rows) / len(rows), len(rows)


def test_quality_held_out(tables):
    docs, labels = tables
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, labels))
    accuracy, n = held_out_accuracy(scored, labels, "quality")
    assert n > 50 and accuracy >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored.limit(50).collect())


def test_toxicity_held_out(tables):
    docs, labels = tables
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    accuracy, n = held_out_accuracy(scored, labels, "toxic")
    assert n > 50 and accuracy >= 0.93


def test_rules_held_out(tables):
    docs, labels = tables
    even = labels.where("doc_id % 2 = 0")
    got = quality_rules.apply(docs, quality_rules.fit(docs, even)).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum((r.probability >= 0.5) == (r.quality == 1) for r in got) / len(got) >= 0.95


def test_rule_counts_are_brute_force(spark, tables):
    df, rows = H.awkward(spark, [(20, "a b c a b c d"), (21, "x\n\nx\n x\nx|<#"), (22, "a\x1cb c d")])
    model = quality_rules.train([], __import__("numpy").zeros(0, int))
    got = sorted(tuple(r)[1:6] for r in quality_rules.apply(df, model).collect())
    assert got == sorted(H.rule_counts(r[1]) for r in rows)
    for r in quality_rules.apply(df, model).collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_scores_do_not_depend_on_the_batch(spark, tables):
    docs, labels = tables
    for module, label in ((quality_classifier, "quality"), (toxicity, "toxic")):
        model = module.fit(docs, labels, max_rows=150)
        a = module.score(docs.limit(60), model)
        b = module.score(docs.limit(60).repartition(7), model)
        assert a.exceptAll(b).isEmpty(), label


def test_awkward_rows_and_no_labels(spark):
    df, rows = H.awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None), (6, 0, 0), (7, 7, 7)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        for scored in (quality_classifier.score(df, quality_classifier.fit(df, labels)), toxicity.score(df, toxicity.fit(df, labels))):
            got = scored.collect()
            assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
        assert quality_rules.apply(df, quality_rules.fit(df, labels)).count() == len(rows)
    e = spark.createDataFrame([], H.SCHEMA)
    m = quality_classifier.fit(e, none)
    assert quality_classifier.score(e, m).count() == 0 and quality_classifier.keep_good(e, m).columns == e.columns


def test_keep_good_keeps_columns(spark, tables):
    docs, labels = tables
    model = quality_classifier.fit(docs, labels)
    kept = quality_classifier.keep_good(docs.withColumn("score", F.lit("mine")), model)
    assert kept.columns == [*docs.columns, "score"]
    assert kept.count() == quality_classifier.score(docs, model).where("predicted = 1").count()


def test_isotonic_is_monotone_and_pools():
    import numpy as np

    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(y) >= 0).all() and np.interp(2.5, x, y) == 0.5 and np.interp(9, x, y) == 1


def test_sample_is_bounded_by_rows_alone(spark):
    from fleetsense.llm import labelled

    texts = {1: "x" * 500_000, 2: "y" * 8, 3: "z" * 7, 4: "w" * 5}
    docs = spark.createDataFrame([(i, t, 5, 5) for i, t in texts.items()], "doc_id long, text string, quality int, h int")
    labels = spark.createDataFrame([(i, i % 2, 9) for i in texts], "doc_id long, quality int, text int")
    got, y, ids = labelled.sample(docs, labels, "quality")
    assert {i: (t, v) for i, t, v in zip(ids.tolist(), got, y.tolist())} == {i: (t, i % 2) for i, t in texts.items()}
    assert len(labelled.sample(docs, labels, "quality", max_rows=3)[0]) == 3


def test_learned_words_are_not_capped():
    import numpy as np

    words = [f"q{k:05d}zz" for k in range(6000)]
    texts = [" ".join(words)] * 4 + ["a plain text of words"] * 200
    assert set(words) <= set(toxicity.learn(texts, np.array([1] * 4 + [0] * 200)))


def test_disguised_insults(spark, tables):
    import pyarrow as pa

    r = toxicity.Reader({})
    f = r.features(pa.array(["you 1d1ot", "you idiot", "a plain sentence of words", ""]))
    assert f[0, 1] > 0 and f[0, 9] > 0 and f[1, 8] > 0 and f[2, 1] == 0 and not f[3, :10].any()


def labelled_texts(n=90):
    """Texts with words that mark toxic ones, some of them in one fold alone."""
    import numpy as np

    y = np.array([int(i % 3 == 0) for i in range(n)])
    words = lambda i: f"plain words {i % 7} and more zorg{i % 4}" if y[i] else f"plain words {i % 7} and less"
    return [words(i) for i in range(n)], y


def test_lexicons_by_counts_are_those_learned_from_the_texts(spark):
    texts, y = labelled_texts()
    fold = toxicity.folds_of(y)
    rows = spark.createDataFrame([(i, int(y[i]), t) for i, t in enumerate(texts)], "doc_id long, y int, text string").repartition(5)
    found = toxicity.lexicons(rows, dict(enumerate(fold.tolist())), y, fold)
    assert len(found) == 1 + toxicity.FOLDS * (toxicity.FOLDS + 1) // 2
    for gone, lexicon in found.items():
        at = [i for i in range(len(y)) if fold[i] not in gone]
        assert lexicon == toxicity.learn([texts[i] for i in at], y[at])
    assert any(w.startswith("zorg") for w in found[frozenset()])


def test_calibration_knows_nothing_of_the_fold_it_scores(spark):
    """With the labels of a fold turned round, nothing changes that its scores for the curve are made from."""
    import numpy as np

    texts, y = labelled_texts()
    fold = toxicity.folds_of(y)
    of, place = dict(enumerate(fold.tolist())), {i: i for i in range(len(y))}

    def inputs(labels):
        rows = spark.createDataFrame([(i, int(labels[i]), t) for i, t in enumerate(texts)], "doc_id long, y int, text string")
        known = toxicity.lexicons(rows, of, labels, fold)
        return toxicity.seen_by(rows, of, {g: v for g, v in known.items() if g}, place)

    a = inputs(y)
    for k in range(toxicity.FOLDS):
        b = inputs(np.where(fold == k, 1 - y, y))
        assert (a[k] == b[k]).all()  # what trees for fold k are fitted on, and the rows of fold k as they score them
        assert (a != b).any()


def test_features_by_executors_are_the_readers(spark):
    import numpy as np
    import pyarrow as pa

    texts, y = labelled_texts(30)
    texts[3], texts[4] = "", "you idiot " * 3000
    fold = toxicity.folds_of(y)
    rows = spark.createDataFrame([(i, int(y[i]), t) for i, t in enumerate(texts)], "doc_id long, y int, text string").repartition(4)
    of = dict(enumerate(fold.tolist()))
    known = {frozenset({j, k}): {"zorg*": 1.0 + j * k, "less": 0.5 * (j + k)} for j in range(toxicity.FOLDS) for k in range(j, toxicity.FOLDS)}
    got = toxicity.seen_by(rows, of, known, {i: i for i in range(30)})
    for k in range(toxicity.FOLDS):
        want = [toxicity.Reader(known[frozenset({int(fold[i]), k})]).features(pa.array([t]))[0] for i, t in enumerate(texts)]
        assert np.array_equal(got[k], np.array(want))

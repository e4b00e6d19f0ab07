from pyspark.sql import functions as F

from fleetsense.functions.config import USER
from fleetsense.operators import metrics as M
from fleetsense.operators import ml
from fleetsense.sources.views import Tables

SF = "/root/testdata/sf0.001"


def test_forward_model(spark, tmp_path):
    t = Tables(spark, SF)
    rows = ml.forward_rows(t.reading)
    model = ml.train_forward(rows, iterations=3, depth=3)
    out = model.transform(rows.where("NOT is_train"))
    r = out.agg(F.min("risk"), F.max("risk"), F.min("p10"), F.max("p90"), F.count_if(F.col("p10") > F.col("p90"))).first()
    assert 0 <= r[0] and r[1] <= 1 and r[2] >= 0 and r[3] <= 24 and r[4] == 0
    model.save(str(tmp_path / "m"))
    assert ml.Forward.load(str(tmp_path / "none")) is None
    kept = ml.Forward.load(str(tmp_path / "m"))
    assert kept.quantiles == model.quantiles and kept.meta["features"] == list(ml.FORWARD) and kept.meta["n_train"] == rows.where("is_train").count()
    again = kept.transform(rows.where("NOT is_train"))
    assert again.select("reading_id", "risk").exceptAll(out.select("reading_id", "risk")).isEmpty()


def test_forest_needs_rows_and_dispatch_falls_back(spark):
    t = Tables(spark, SF)
    rows = ml.forest_rows(t.node, t.reading, *USER)
    assert ml.train_forest(rows.limit(3)) is None
    model = ml.train_forest(rows, trees=5, depth=4)
    assert sorted(x for x, _ in ml.importances(model, ml.FOREST)) == sorted(ml.FOREST)
    forward = ml.train_forward(ml.forward_rows(t.reading), iterations=3, depth=3)
    for kind in ({}, {"forest": model}, {"forest": model, "simplified": True}, {"forward": forward}):
        r = ml.dispatch(t.node, t.reading, *USER, **kind).agg(F.min("priority"), F.max("priority"), F.count("*")).first()
        assert 0 <= r[0] and r[1] <= 1 and r[2] == t.node.count()


def test_metrics_of_perfect_and_constant_scores(spark):
    d = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)], "s double, y int")
    assert M.auc(d, "s", "y").first().auc == 1.0 and M.average_precision(d, "s", "y").first().average_precision == 1.0
    same = d.withColumn("s", F.lit(0.5))
    assert M.auc(same, "s", "y").first().auc == 0.5
    assert M.gini(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x").first().gini == 0.0
    assert M.spearman(same.withColumn("g", F.lit(1)), "s", ["y"], ["g"]).first().rho_y is None


def test_permuting_matters_only_for_what_the_model_uses(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression

    d = spark.range(500).select(F.col("id").alias("reading_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b")).withColumn("y", F.col("a") * 2)
    model = Pipeline(stages=[ml.assembler(("a", "b")), LinearRegression(labelCol="y")]).fit(d)
    for per_slot in (4096, 50):
        found = {r.feature: r.increase for r in ml.permutation_importance(model, d, ("a", "b"), "y", repeats=3, per_slot=per_slot).collect()}
        assert found["a"] > 3 and abs(found["b"]) < 1e-6


def test_forward_model_is_better_than_the_mean(spark):
    rows = ml.forward_rows(Tables(spark, "/root/testdata/sf0.01").reading)
    got = {r.model: r.mae for r in ml.bake_off(rows, iterations=3).collect()}
    assert min(got["boosted_trees"], got["random_forest"]) <= got["mean"] * 1.02
    lat = ml.latency(ml.boosted(2, 2).fit(rows), rows, n=100, repeats=1).first()
    assert lat.n == 100 and lat.total_ms > 0


def test_aucs_in_one_pass_are_those_of_each(spark):
    import random

    r = random.Random(3)
    rows = [(r.choice([0.1, 0.2, 0.5, None]), r.random(), r.randint(0, 1)) for _ in range(300)]
    d = spark.createDataFrame(rows, "a double, b double, y int")
    got = {x.score: x.auc for x in M.aucs(d, ["b", "a"], "y").collect()}

    def brute(k):  # a missing score is less than any
        of = lambda y: [-1.0 if x[k] is None else x[k] for x in rows if x[2] == y]
        pairs = [(p > n) + (p == n) / 2 for p in of(1) for n in of(0)]
        return sum(pairs) / len(pairs)

    assert abs(got["a"] - brute(0)) < 1e-9 and abs(got["b"] - brute(1)) < 1e-9


def test_spearman_of_several_is_that_of_each(spark):
    d = spark.range(200).selectExpr("id % 3 AS g", "CAST(hash(id) % 7 AS DOUBLE) AS a", "CAST(hash(id + 1) % 5 AS DOUBLE) AS b", "CAST(hash(id) % 7 + id AS DOUBLE) AS c")
    both = {x.g: (round(x.rho_b, 9), round(x.rho_c, 9)) for x in M.spearman(d, "a", ["b", "c"], ["g"]).collect()}
    one, two = ({x.g: round(x[1], 9) for x in M.spearman(d, "a", [o], ["g"]).collect()} for o in ("b", "c"))
    assert both == {g: (one[g], two[g]) for g in one}


def test_quantile_forest_of_one_leaf_is_the_distribution(spark):
    """Without a split all rows share a leaf: its quantiles are those of the rows that filled it, to a bin's width."""
    import numpy as np

    from fleetsense.operators import quantile_forest as Q

    rows = ml.forward_rows(Tables(spark, SF).reading).withColumn("time_to_overflow", F.when(F.col("reading_id") % 3 == 0, 0.0).when(F.col("reading_id") % 3 == 1, 24.0).otherwise((F.col("reading_id") % 97) / 4.1))
    forest = Q.QuantileForest.fit(rows, trees=2, depth=0)
    at = {"a": 0.05, "b": 0.4, "c": 0.6, "d": 0.95}
    got = forest.quantiles(rows, at)
    assert got.count() == rows.dropna(subset=list(ml.FORWARD)).count()
    one = got.select(*at).distinct().collect()
    filled = np.sort([r[0] for r in rows.where(F.pmod(F.xxhash64("reading_id"), F.lit(4)) == 0).select("time_to_overflow").collect()])
    assert len(one) == 1
    for name, q in at.items():
        assert abs(one[0][name] - filled[max(0, int(np.ceil(q * len(filled) - 1e-9)) - 1)]) <= 1 / Q.PER_HOUR
    assert Q.QuantileForest.fit(rows.limit(10)) is None
    loss = Q.pinball(spark.createDataFrame([(1.0, 3.0), (5.0, 3.0)], "time_to_overflow double, p double"), {"p": 0.9}).first()
    assert abs(loss.p - (0.1 * 2 + 0.9 * 2) / 2) < 1e-12


def test_spearman_leaves_out_rows_that_lack_a_side(spark):
    d = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 3.0), (1, 3.0, 1.0), (2, None, 1.0)], "g int, a double, b double")
    more = d.unionByName(spark.createDataFrame([(1, None, 9.0), (1, 0.5, None)], "g int, a double, b double"))
    want = {x.g: round(x.rho_b, 9) for x in M.spearman(d.where("a IS NOT NULL"), "a", ["b"], ["g"]).collect()}
    assert {x.g: round(x.rho_b, 9) for x in M.spearman(more, "a", ["b"], ["g"]).collect()} == want == {1: -0.5}


def test_quantiles_by_table_are_those_by_join(spark, monkeypatch):
    """Leaves looked up in a table and leaves joined give the same quantiles; the table needs no row for each tree."""
    from fleetsense.operators import ml, quantile_forest
    from fleetsense.sources.views import Tables

    rows = ml.forward_rows(Tables(spark, "/root/testdata/sf0.001").reading)
    forest = quantile_forest.QuantileForest.fit(rows.where("is_train"), trees=6, depth=4)
    at, test = {"p10": 0.1, "p50": 0.5, "p90": 0.9}, rows.where("NOT is_train")
    table = forest.quantiles(test, at)
    assert "Generate" not in table._jdf.queryExecution().executedPlan().toString()
    forest.small = False
    joined = {r.reading_id: r for r in forest.quantiles(test, at).collect()}
    table = table.collect()
    assert len(table) == len(joined)
    assert all(abs(r[c] - joined[r.reading_id][c]) < 1e-9 for r in table for c in at)


def test_features_that_no_tree_uses_are_not_scored(spark):
    from fleetsense.operators import ml
    from fleetsense.sources.views import Tables

    rows = ml.forward_rows(Tables(spark, "/root/testdata/sf0.001").reading)
    model = ml.boosted(1, 1).fit(rows.where("is_train"))
    used = {c for c, v in ml.importances(model, ml.FORWARD) if v > 0}
    got = {r.feature: r.increase for r in ml.permutation_importance(model, rows.where("NOT is_train"), ml.FORWARD, "time_to_overflow", 2).collect()}
    assert set(got) == set(ml.FORWARD) and len(used) < len(got) and all(got[c] == 0.0 for c in got if c not in used)


def test_calibration_takes_a_row_for_each_score(spark):
    """Many rows of few scores are a row for each before isotonic regression, with the same curve."""
    from pyspark.ml.regression import IsotonicRegression

    d = spark.range(3000).select((F.pmod(F.xxhash64("id"), F.lit(7)) / 7).alias("raw_score"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)) < F.pmod(F.xxhash64("id"), F.lit(7))).cast("double").alias("hazard"))
    few = ml.by_score(d)
    assert few.count() == 7 and few.agg(F.sum("weight")).first()[0] == 3000
    whole = IsotonicRegression(featuresCol="raw_score", labelCol="hazard").fit(d)
    small = IsotonicRegression(featuresCol="raw_score", labelCol="hazard", weightCol="weight").fit(few)
    assert list(whole.boundaries) == list(small.boundaries)
    assert max(abs(a - b) for a, b in zip(whole.predictions, small.predictions)) < 1e-12

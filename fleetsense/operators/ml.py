"""Training and scoring on Spark ML: urgency forest, forward-looking hazard and time-to-overflow models."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, IsotonicRegressionModel, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.config import HORIZON_H, STATE_FEATURES, TTO_CAP_H
from . import readings as R
from ..sources.shared import stored
from .ranges import quantiles

STATE = ("waste_level", "gas_level", "temperature", "humidity")
ROLLING = tuple(f"{c}{s}" for c in STATE for s in ("", "_mean", "_std", "_trend"))
FORWARD = (*ROLLING, "hour", "dow")
#: The forest's 18 inputs.
FOREST = ("distance_m", *R.METRICS, *[f"{c}_{s}" for c in R.METRICS for s in ("mean", "std")], "hour", "dow")
MIN_FORWARD_ROWS, MIN_FOREST_ROWS = 50, 5


#: Models that are fitted at the same time.
SIDE_BY_SIDE = 5


def side_by_side(spark: SparkSession, jobs: list[Callable], at_once: int = SIDE_BY_SIDE) -> list:
    """What the jobs (functions without arguments, each with Spark jobs of its own) return, in their order. A failure of one is raised."""
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        return list(pool.map(lambda job: job(), [inheritable_thread_target(spark)(j) for j in jobs]))


def vectors(rows: DataFrame, columns, *keep: str) -> DataFrame:
    """keep and the columns as one vector `features`, stored: worked out once however many models read it."""
    return stored(assembler(columns).transform(rows).select(*keep, "features"), "vectors")


def assembler(columns) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip")


def forest_rows(nodes: DataFrame, readings: DataFrame, lat: float, lng: float, simplified: bool = False) -> DataFrame:
    """node_id, the 18 inputs and the target of each node that has a reading.

    simplified: means are the current values and deviations 0, as at serving.
    """
    now = R.latest(readings)
    rows = R.with_distance(nodes, lat, lng).select("node_id", "distance_m").join(now, "node_id")
    if simplified:
        rows = rows.withColumns({f"{c}_mean": F.col(c) for c in R.METRICS} | {f"{c}_std": F.lit(0.0) for c in R.METRICS})
    else:
        rows = rows.join(R.last_n_stats(readings).drop("n"), "node_id")
    rows = rows.withColumns({"hour": F.hour("timestamp"), "dow": F.weekday("timestamp")})
    return rows.select("node_id", *FOREST, S.weighted_target("distance_m", *[F.col(c) for c in ("waste_level", "gas_level", "temperature", "humidity", "traffic_density")]).alias("target")).fillna(0.0)


def train_forest(rows: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42) -> PipelineModel | None:
    """None with fewer than MIN_FOREST_ROWS rows; a fifth is held out from ten rows on."""
    n = rows.limit(10).count()
    if n < MIN_FOREST_ROWS:
        return None
    train = rows.where(F.pmod(F.xxhash64("node_id"), F.lit(5)) != 0) if n >= 10 else rows
    return Pipeline(stages=[assembler(FOREST), RandomForestRegressor(labelCol="target", numTrees=trees, maxDepth=depth, minInstancesPerNode=1, seed=seed)]).fit(train)


def forest_scores(model: PipelineModel | None, rows: DataFrame, rule: Column) -> DataFrame:
    """node_id, score in [0, 1]: the forest's, else the rule's."""
    if model is None:
        return rows.select("node_id", rule.alias("score"))
    return model.transform(rows).select("node_id", F.coalesce(S.clip01("prediction"), rule).alias("score"))


def forward_rows(readings: DataFrame) -> DataFrame:
    """Rolling features with both labels; is_train by the time quantile over all rows. All windows lie over one exchange by node; stored, as the quantile and each model read the rows."""
    rows = R.overflow_label(R.hazard_label(R.rolling(readings))).dropna(subset=list(FORWARD))
    rows = stored(rows, "forward")
    return R.split_at_quantile(rows)


class Forward:
    """Time-to-overflow regressor with conformal 10/50/90 % residuals, and a calibrated hazard classifier."""

    def __init__(self, regressor, quantiles, classifier=None, calibration=None, meta=None):
        self.regressor, self.quantiles, self.classifier, self.calibration, self.meta = regressor, quantiles, classifier, calibration, meta or {}

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with tto, p10, p50, p90 (within 0 to 24 h), hazard_prob and risk."""
        out = self.regressor.transform(rows).withColumnRenamed("prediction", "tto")
        cut = F.lit(0)
        for edge in self.quantiles["edges"]:
            cut = cut + F.when(F.col("tto") > edge, 1).otherwise(0)
        for j, name in enumerate(("p10", "p50", "p90")):
            shift = F.get(F.array(*[F.lit(float(q[j])) for q in self.quantiles["shifts"]]), cut)
            out = out.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(24.0), F.col("tto") + shift)))
        if self.classifier is None:
            return out.withColumn("hazard_prob", F.lit(0.0)).withColumn("risk", S.risk(F.lit(0.0), "p10"))
        out = self.classifier.transform(out).withColumn("raw_score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        out = self.calibration.transform(out).withColumnRenamed("prediction", "hazard_prob")
        return out.withColumn("risk", S.risk("hazard_prob", "p10")).drop("features")

    def save(self, path: str) -> None:
        """Models, quantiles and metadata: all that load() needs. The metadata comes last, so a store that has it is whole."""
        from ..sources import io

        self.regressor.write().overwrite().save(f"{path}/regressor")
        if self.classifier is not None:
            self.classifier.write().overwrite().save(f"{path}/classifier")
            self.calibration.write().overwrite().save(f"{path}/calibration")
        io.save_meta(SparkSession.active(), f"{path}/meta", {**self.meta, "quantiles": self.quantiles, "has_classifier": self.classifier is not None})

    @staticmethod
    def load(path: str) -> Forward | None:
        """What was saved; None if nothing (whole) is there."""
        from ..sources import io

        meta = io.read_meta(SparkSession.active(), f"{path}/meta")
        if meta is None:
            return None
        quantiles, hazard = meta.pop("quantiles"), meta.pop("has_classifier")
        parts = (PipelineModel.load(f"{path}/classifier"), IsotonicRegressionModel.load(f"{path}/calibration")) if hazard else (None, None)
        return Forward(PipelineModel.load(f"{path}/regressor"), quantiles, *parts, meta)


def _conformal(scored: DataFrame, buckets: int = 4) -> dict:
    """Quantiles of residuals by bucket of the prediction: a few numbers."""
    edges = sorted(set(e for e in quantiles(scored, "prediction", [i / buckets for i in range(1, buckets)]).first()["q"] if e is not None))
    cut = F.lit(0)
    for e in edges:
        cut = cut + F.when(F.col("prediction") > e, 1).otherwise(0)
    apart = stored(scored.select(cut.alias("b"), (F.col("time_to_overflow") - F.col("prediction")).alias("r")), "residuals")
    found = {b: quantiles(apart.where(F.col("b") == b), "r", [0.1, 0.5, 0.9]).first()["q"] for b in range(len(edges) + 1)}
    found = {b: q for b, q in found.items() if None not in q}
    return {"edges": edges, "shifts": [found.get(b, [0.0, 0.0, 0.0]) for b in range(len(edges) + 1)]}


def by_score(scored: DataFrame) -> DataFrame:
    """A row for each raw_score with the mean of hazard and the number of rows as weight: what isotonic regression makes of equal scores itself.

    Trees give few scores and most rows have one of them, which IsotonicRegression would sort in one task.
    """
    return stored(scored.groupBy("raw_score").agg(F.avg("hazard").alias("hazard"), F.count("*").cast("double").alias("weight")), "by_score")


def boosted(iterations: int = 20, depth: int = 4, seed: int = 42) -> Pipeline:
    """Boosted trees for the time to overflow."""
    return Pipeline(stages=[assembler(FORWARD), GBTRegressor(labelCol="time_to_overflow", maxIter=iterations, maxDepth=depth, seed=seed)])


def train_forward(rows: DataFrame, iterations: int = 20, depth: int = 4, seed: int = 42) -> Forward | None:
    """Fit on training rows. A quarter of them, by a hash, gives the quantiles; the hazard's calibration is fitted on scores of three folds, each by a model of the other two.

    None with too few rows; no classifier with one class.
    """
    train = stored(rows.where("is_train").withColumn("fold", F.pmod(F.xxhash64("reading_id"), F.lit(4))), "train")  # read by every fit
    if train.limit(MIN_FORWARD_ROWS).count() < MIN_FORWARD_ROWS:
        return None
    fit, hold = train.where("fold <> 0"), train.where("fold = 0")
    regressor = boosted(iterations, depth, seed).fit(fit)
    quantiles = _conformal(regressor.transform(hold).select("prediction", "time_to_overflow"))
    seen = train.agg(F.count("*").alias("rows"), F.sum("hazard").cast("long").alias("hazards"), F.count_distinct("node_id").alias("nodes")).first()
    meta = {
        "version": f"forward_gbt_{datetime.date.today().isoformat()}", "trained_at": datetime.datetime.now(datetime.timezone.utc).isoformat(), "target": "time_to_overflow, hazard",
        "validation": "earliest 80% of all rows train, the rest tests", "features": list(FORWARD), "horizon_h": HORIZON_H, "tto_cap_h": TTO_CAP_H,
        "n_train": seen["rows"], "n_nodes": seen["nodes"], "hazard_share": seen["hazards"] / seen["rows"],
        "importances": [[c, v] for c, v in importances(regressor, FORWARD)],
    }
    if not 0 < seen["hazards"] < seen["rows"]:
        return Forward(regressor, quantiles, meta=meta)
    estimator = Pipeline(stages=[VectorAssembler(inputCols=list(FORWARD), outputCol="inputs"), GBTClassifier(featuresCol="inputs", labelCol="hazard", maxIter=iterations, maxDepth=depth, seed=seed)])
    third, scored = F.pmod(F.xxhash64("reading_id", F.lit(seed)), F.lit(3)), None
    for k in range(3):
        others = train.where(third != k)
        if others.select("hazard").distinct().count() < 2:
            return Forward(regressor, quantiles, meta=meta)
        one = estimator.fit(others).transform(train.where(third == k)).select(vector_to_array("probability")[1].alias("raw_score"), F.col("hazard").cast("double").alias("hazard"))
        scored = one if scored is None else scored.unionByName(one)
    calibration = IsotonicRegression(featuresCol="raw_score", labelCol="hazard", weightCol="weight").fit(by_score(scored))
    return Forward(regressor, quantiles, estimator.fit(train), calibration, meta)


def bake_off(rows: DataFrame, iterations: int = 10, trees: int | None = None, seed: int = 42) -> DataFrame:
    """model, r2, mae, mse on the rows held out: mean, ridge on the current state, forest, boosted trees."""
    from . import metrics as M

    spark, target, trees = rows.sparkSession, "time_to_overflow", trees or iterations
    rows = stored(assembler(FORWARD).transform(rows).select("is_train", target, *STATE, "features"), "bake_off")
    train, test = rows.where("is_train"), rows.where("NOT is_train")
    state = VectorAssembler(inputCols=list(STATE), outputCol="state", handleInvalid="skip")
    models = {
        "ridge_state": Pipeline(stages=[state, LinearRegression(featuresCol="state", labelCol=target, regParam=1.0, elasticNetParam=0.0)]),
        "random_forest": RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=8, seed=seed),
        "boosted_trees": GBTRegressor(labelCol=target, maxIter=iterations, maxDepth=4, seed=seed),
    }

    def mean():
        return test.crossJoin(F.broadcast(train.agg(F.avg(target).alias("prediction"))))  # one row

    scored = {"mean": mean} | {name: lambda m=m: m.fit(train).transform(test) for name, m in models.items()}
    found = side_by_side(spark, [lambda f=f: M.regression(f(), "prediction", target).first() for f in scored.values()])
    return spark.createDataFrame([(name, r.r2, r.mae, r.mse) for name, r in zip(scored, found)], "model string, r2 double, mae double, mse double")


def balanced_forest(rows: DataFrame, trees: int = 30, depth: int = 8, seed: int = 42) -> PipelineModel:
    """Hazard forest with balanced weights."""
    share = rows.agg(F.avg(F.col("hazard").cast("double")).alias("p")).first()["p"] or 0.5
    share = min(max(share, 1e-6), 1 - 1e-6)
    weighted = rows.withColumn("weight", F.when(F.col("hazard") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    return Pipeline(stages=[assembler(FORWARD), RandomForestClassifier(labelCol="hazard", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)]).fit(weighted)


def group_folds(rows: DataFrame, folds: int = 5, iterations: int = 8, seed: int = 42) -> DataFrame:
    """fold, r2, mae, mse: each fold's nodes are held out. The folds are fitted side by side from one stored table of vectors."""
    from . import metrics as M

    rows = vectors(rows.withColumn("fold", F.pmod(F.col("node_id"), F.lit(folds))), FORWARD, "fold", "time_to_overflow")

    def one(k):
        model = GBTRegressor(labelCol="time_to_overflow", maxIter=iterations, maxDepth=4, seed=seed).fit(rows.where(F.col("fold") != k))
        return M.regression(model.transform(rows.where(F.col("fold") == k)), "prediction", "time_to_overflow").first()

    found = side_by_side(rows.sparkSession, [lambda k=k: one(k) for k in range(folds)])
    return rows.sparkSession.createDataFrame([(k, r.r2, r.mae, r.mse) for k, r in enumerate(found)], "fold int, r2 double, mae double, mse double")


def importances(model: PipelineModel, columns) -> list[tuple[str, float]]:
    """Impurity importances, the largest first."""
    v = model.stages[-1].featureImportances
    return sorted(((c, float(v[i])) for i, c in enumerate(columns)), key=lambda x: (-x[1], x[0]))


def permutation_importance(model: PipelineModel, rows: DataFrame, columns, target: str, repeats: int = 5, per_slot: int = 4096) -> DataFrame:
    """feature, increase of the mean absolute error when the feature's values are dealt to other rows, the mean of the repeats.

    A row's partner is the one of the same rank in another hashed order of its slot (some per_slot rows, so no order is over all rows).
    All features and repeats are scored in one plan. A feature that no tree of the model looks at changes no prediction: its increase is 0, and
    no rows are scored for it.
    """
    weights = getattr(model.stages[-1], "featureImportances", None)
    used = [c for i, c in enumerate(columns) if weights is None or weights[i] > 0]
    unused = rows.sparkSession.createDataFrame([(c, 0.0) for c in columns if c not in used], "feature string, increase double")
    if not used:
        return unused.orderBy("feature")
    rows = stored(rows, "permuted")
    slots = max(1, rows.count() // per_slot)
    keyed = rows.withColumn("_slot", F.pmod(F.xxhash64("reading_id"), F.lit(slots)))
    rank = lambda k: F.row_number().over(Window.partitionBy("_slot").orderBy(F.xxhash64("reading_id", F.lit(k)), "reading_id"))
    mixed = None
    for r in range(repeats):
        partner = keyed.select("_slot", rank(2 * r + 1).alias("_k"), F.struct(*used).alias("_p"))
        one = keyed.withColumn("_k", rank(2 * r)).join(partner, ["_slot", "_k"]).withColumn("_turn", F.lit(r))
        mixed = one if mixed is None else mixed.unionByName(one)
    mixed = mixed.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in ("", *used)])))  # "": as it is
    mixed = mixed.withColumns({c: F.when(F.col("feature") == c, F.col("_p")[c]).otherwise(F.col(c)) for c in used})
    errors = model.transform(mixed).groupBy("feature").agg(F.avg(F.abs(F.col(target) - F.col("prediction"))).alias("mae"))
    base = F.broadcast(errors.where("feature = ''").select(F.col("mae").alias("base")))  # one row
    found = errors.where("feature <> ''").crossJoin(base).select("feature", (F.col("mae") - F.col("base")).alias("increase"))
    return found.unionByName(unused).orderBy(F.desc("increase"), "feature")


def latency(model, rows: DataFrame, n: int = 5000, repeats: int = 3) -> DataFrame:
    """n, total_ms, per_1000_ms of scoring up to n rows: the best of a few runs. The rows are made beforehand and the scores are all computed."""
    rows = stored(rows.limit(n), "latency")
    count, took = rows.count(), []
    for _ in range(repeats):
        began = time.perf_counter()
        model.transform(rows).write.format("noop").mode("overwrite").save()
        took.append((time.perf_counter() - began) * 1000)
    return rows.sparkSession.createDataFrame([(count, min(took), min(took) / max(count, 1) * 1000)], "n long, total_ms double, per_1000_ms double")


def dispatch(nodes: DataFrame, readings: DataFrame, lat: float, lng: float, forward: Forward | None = None, forest: PipelineModel | None = None, simplified: bool = False) -> DataFrame:
    """node_id, priority by the best model at hand: forward, else forest, else the rule; 0 without a reading.

    simplified: the forest sees the current state alone, as at serving.
    """
    if forward is not None:
        feats = R.latest(R.rolling(readings)).select("node_id", "reading_id", *FORWARD)
        scored = forward.transform(feats).select("node_id", F.col("risk").alias("score"))
    elif forest is not None:
        rows = forest_rows(nodes, readings, lat, lng, simplified)
        scored = forest_scores(forest, rows, S.priority())
    else:
        return R.scored_nodes(nodes, readings, lat, lng).select("node_id", "priority")
    rule = R.latest(readings).select("node_id", S.priority(STATE_FEATURES).alias("rule"))
    return nodes.select("node_id").join(scored, "node_id", "left").join(rule, "node_id", "left").select("node_id", F.coalesce("score", "rule", F.lit(0.0)).alias("priority"))

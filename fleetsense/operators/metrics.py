"""Evaluation metrics as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .ranges import quantiles, running


def _rank(column: str, keys) -> Column:
    """The average-tie rank by key: half way between the rank and the number of rows up to the last peer, both of one sort."""
    w = Window.partitionBy(*keys).orderBy(column)
    return (F.rank().over(w) + F.count("*").over(w)) / 2.0


def aucs(frame: DataFrame, scores, label: str) -> DataFrame:
    """score, auc for each of the score columns: ROC-AUC by average ranks over counts of equal scores, all in one pass over the frame and one order."""
    each = frame.select(F.col(label).cast("long").alias("y"), F.inline(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).cast("double").alias("x")) for c in scores])))
    c = stored(each.groupBy(F.struct("score", "x").alias("by")).agg(F.sum("y").alias("p"), F.count("*").alias("n")), "counts")
    c = running(c, "by", before=F.col("n"))
    s = c.groupBy("by.score").agg(
        F.sum((F.col("before") + (F.col("n") + 1) / 2.0) * F.col("p")).alias("r"), F.min("before").alias("first"), F.sum("p").cast("double").alias("p"), F.sum(F.col("n") - F.col("p")).cast("double").alias("q"),
    )
    r = F.col("r") - F.col("first") * F.col("p")  # ranks begin anew with each score
    return s.select("score", F.when((F.col("p") > 0) & (F.col("q") > 0), (r - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def auc(frame: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the ROC-AUC of a score; null without both classes."""
    return aucs(frame, [score], label).agg(F.max("auc").alias("auc"))


def average_precision(frame: DataFrame, score: str, label: str) -> DataFrame:
    """One row: sum of precision times recall steps over descending distinct scores."""
    c = stored(frame.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n")), "counts")
    c = running(c, score, True, tp=F.col("p"), seen=F.col("n"))
    return c.agg((F.sum(F.col("p") * (F.col("tp") + F.col("p")) / (F.col("seen") + F.col("n"))) / F.sum("p")).alias("average_precision"))


def brier(frame: DataFrame, score: str, label: str) -> DataFrame:
    d = F.col(score) - F.col(label)
    return frame.agg(F.avg(d * d).alias("brier"))


def regression(frame: DataFrame, prediction: str, target: str) -> DataFrame:
    """One row: r2, mae, mse. The total square is from sums, so one pass is enough."""
    e = F.col(target) - F.col(prediction)
    s = frame.agg(F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(target).alias("v"), F.count(target).alias("n"))
    return s.select((1 - F.col("sse") / (F.col("v") * F.col("n"))).alias("r2"), "mae", "mse")


def coverage(frame: DataFrame, low: Column, high: Column, target: str) -> DataFrame:
    return frame.agg(F.avg(F.when(F.col(target).between(low, high), 1.0).otherwise(0.0)).alias("coverage"))


def reliability(frame: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Quantile bins of the score: mean score and observed rate of each. The edges are one row."""
    edges = quantiles(frame, score, [i / bins for i in range(1, bins)]).withColumnRenamed("q", "edges")
    b = F.size(F.filter("edges", lambda e: e < F.col(score)))
    return frame.crossJoin(F.broadcast(edges)).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))


def spearman(frame: DataFrame, a: str, others, keys) -> DataFrame:
    """keys and rho_<other> for each of the others: rank correlation with a by key; null where either side is constant.

    Rows that lack any of the columns do not count. All columns are ranked in the rows of one shuffle.
    """
    whole = " AND ".join(f"`{c}` IS NOT NULL" for c in (a, *others))
    # Rows that lack a column are ranked apart: a filter would be pushed down and work out the columns once more.
    ranked = frame.withColumn("_whole", F.expr(whole)).withColumns({f"r_{c}": _rank(c, [*keys, "_whole"]) for c in (a, *others)})
    side = lambda c: F.when(F.col("_whole"), F.col(f"r_{c}"))
    rho = lambda c: F.try_divide(F.covar_pop(side(a), side(c)), F.sqrt(F.var_pop(side(a)) * F.var_pop(side(c)))).alias(f"rho_{c}")
    return ranked.groupBy(*keys).agg(*[rho(c) for c in others], F.count_if("_whole").alias("_n")).where("_n > 0").drop("_n")


def gini(counts: DataFrame, column: str) -> DataFrame:
    """One row. Computed over counts of equal values, so the ordered part is as large as the number of distinct values.

    n + 1 - 2 * sum(cumulative / total), over n; a run of m equal values x after the sum S adds m * S + x * m * (m + 1) / 2 to the sum of cumulatives.
    """
    c = counts.groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").cast("double").alias("m"))
    s = running(c, "x", s=F.col("x") * F.col("m")).agg(F.sum("m").alias("n"), F.sum(F.col("x") * F.col("m")).alias("total"), F.sum(F.col("m") * F.col("s") + F.col("x") * F.col("m") * (F.col("m") + 1) / 2).alias("cum"))
    return s.select(F.when(F.coalesce("total", F.lit(0.0)) == 0, 0.0).otherwise((F.col("n") + 1 - 2 * F.col("cum") / F.col("total")) / F.col("n")).alias("gini"))

"""Quantile forests: the distribution of the time to overflow in the leaves that a row falls into.

A forest of regression trees parts the rows. The targets of rows that no tree was grown on are counted
by tree, leaf and bin, an aggregate over those rows. A row's distribution is the mean of its leaves',
and its quantiles are read off the running sum of that, linear within a bin. No overflow within the
horizon and an overflow now are bins of their own, as many rows have just these values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import TTO_CAP_H
from ..sources.shared import stored
from .ml import FORWARD, MIN_FORWARD_ROWS, assembler

#: Bins of an hour between none and the cap.
PER_HOUR = 4
BINS = 2 + TTO_CAP_H * PER_HOUR
#: Leaves up to this number are a table in each task (BINS numbers each), more are joined by a shuffle.
BROADCAST_LEAVES = 1 << 15


def _bin(y: Column) -> Column:
    return F.when(y <= 0, 0).when(y >= TTO_CAP_H, BINS - 1).otherwise(1 + F.floor(y * PER_HOUR)).cast("int")


class QuantileForest:
    def __init__(self, forest: PipelineModel, leaves: DataFrame, small: bool):
        self.forest, self.leaves, self.small = forest, leaves, small

    @staticmethod
    def fit(rows: DataFrame, trees: int = 40, depth: int = 8, min_leaf: int = 10, seed: int = 42) -> QuantileForest | None:
        """rows: reading_id, the forward inputs and time_to_overflow. Three quarters of them, by a hash, grow the trees, the rest fill the leaves. None with too few rows."""
        rows = stored(rows.select("reading_id", *FORWARD, "time_to_overflow").dropna(), "quantile_rows")
        if rows.limit(MIN_FORWARD_ROWS).count() < MIN_FORWARD_ROWS:
            return None
        grow = F.pmod(F.xxhash64("reading_id"), F.lit(4)) != 0
        forest = RandomForestRegressor(labelCol="time_to_overflow", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, featureSubsetStrategy="onethird", leafCol="leaf", seed=seed)
        model = Pipeline(stages=[assembler(FORWARD), forest]).fit(rows.where(grow))
        counts = _fallen(model, rows.where(~grow), _bin(F.col("time_to_overflow")).alias("bin")).groupBy("tree", "leaf").pivot("bin", list(range(BINS))).count()
        n = sum((F.coalesce(F.col(str(b)), F.lit(0)) for b in range(BINS)), F.lit(0))
        leaves = counts.select("tree", "leaf", *[(F.coalesce(F.col(str(b)), F.lit(0)) / n).alias(f"b{b}") for b in range(BINS)])
        leaves = stored(leaves, "quantile_leaves")
        return QuantileForest(model, leaves, trees << depth <= BROADCAST_LEAVES)

    def _upto(self, rows: DataFrame) -> DataFrame:
        """reading_id and the running sum of its leaves' mean distribution."""
        if not self.small:  # the leaves are joined by a shuffle
            mean = _fallen(self.forest, rows).join(self.leaves, ["tree", "leaf"]).groupBy("reading_id").agg(*[F.avg(f"b{b}").alias(f"b{b}") for b in range(BINS)])
            running = F.aggregate(F.array(*[f"b{b}" for b in range(BINS)]), F.array().cast("array<double>"), lambda acc, w: F.array_append(acc, F.coalesce(F.element_at(F.concat(F.array(F.lit(0.0)), acc), -1), F.lit(0.0)) + w))
            return mean.select("reading_id", running.alias("upto"))
        found = self.leaves.toPandas()  # BROADCAST_LEAVES rows at most
        tree, leaf = found.tree.to_numpy(int), found.leaf.to_numpy(int)
        table = np.full((tree.max(initial=-1) + 1, leaf.max(initial=-1) + 1, BINS + 1), 0.0)
        table[tree, leaf, :BINS] = found[[f"b{b}" for b in range(BINS)]].to_numpy(float)
        table[tree, leaf, BINS] = 1.0  # a leaf into which no row fell does not count
        table = rows.sparkSession.sparkContext.broadcast(table)

        def run(batches):
            t = table.value
            for batch in batches:
                at = np.array(batch.leaf.tolist(), int).reshape(len(batch), -1)
                total = np.zeros((len(batch), BINS + 1))
                for k in range(min(at.shape[1], len(t))):
                    has = at[:, k] < t.shape[1]
                    total[has] += t[k, at[has, k]]
                some = total[:, BINS] > 0
                upto = np.cumsum(total[some, :BINS] / total[some, BINS:], 1)
                yield pd.DataFrame({"reading_id": batch.reading_id[some], "upto": list(upto)})

        fallen = self.forest.transform(rows).select("reading_id", vector_to_array("leaf").alias("leaf"))
        return fallen.mapInPandas(run, "reading_id long, upto array<double>")

    def quantiles(self, rows: DataFrame, at: dict[str, float]) -> DataFrame:
        """reading_id and a column for each name: that quantile of the row's time to overflow. A row with a missing input has no row here."""
        out = self._upto(rows)

        def first(q: float) -> Column:
            """The first bin up to which so much has come together."""
            return F.array_position(F.transform("upto", lambda s: s >= q - 1e-12), True).cast("int") - 1

        for name, q in at.items():
            b = first(q)
            below = F.when(b > 0, F.get("upto", b - 1)).otherwise(0.0)
            part = (F.lit(q) - below) / F.greatest(F.get("upto", b) - below, F.lit(1e-12))
            inner = (b - 1 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), part))) / PER_HOUR
            out = out.withColumn(name, F.when(b <= 0, 0.0).when(b == BINS - 1, float(TTO_CAP_H)).otherwise(inner).cast("double"))
        return out.drop("upto")


def _fallen(model: PipelineModel, rows: DataFrame, *more: Column) -> DataFrame:
    """reading_id, tree, leaf and more for each row and tree."""
    return model.transform(rows).select("reading_id", *more, F.posexplode(vector_to_array("leaf")).alias("tree", "at")).select("reading_id", "tree", F.col("at").cast("int").alias("leaf"), *["bin"] * bool(more))


def pinball(frame: DataFrame, at: dict[str, float], target: str = "time_to_overflow") -> DataFrame:
    """One row: the mean pinball loss of each quantile column, and of all of them as `loss`."""
    loss = lambda c, q: F.avg(F.greatest(q * (F.col(target) - F.col(c)), (q - 1) * (F.col(target) - F.col(c))))
    return frame.agg(*[loss(c, q).alias(c) for c, q in at.items()], (sum((loss(c, q) for c, q in at.items()), F.lit(0.0)) / len(at)).alias("loss"))

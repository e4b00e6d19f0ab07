"""Roll-ups of readings by node and day that merge over any span: counts, sums, the last state, quantile and distinct sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of a KLL sketch; the rank of a quantile it gives is off by more than RANK_ERROR once in a hundred times.
KLL_K = 200
RANK_ERROR = 2.296 / KLL_K**0.9723
#: Registers of an HLL sketch, as a power of two; the standard error of a count is DISTINCT_ERROR of it.
HLL_LG = 12
DISTINCT_ERROR = 1.04 / 2 ** (HLL_LG / 2)
LEVELS = ("waste_level", "gas_level")
SCHEMA = (
    "node_id BIGINT, readings BIGINT, last STRUCT<timestamp: TIMESTAMP_NTZ, reading_id: BIGINT, waste_level: DOUBLE>, "
    + ", ".join(f"{c}_n BIGINT, {c}_sum DOUBLE, {c}_min DOUBLE, {c}_max DOUBLE, {c}_kll BINARY" for c in LEVELS)
    + ", humidity_hll BINARY, batch STRING, day DATE"
)


def rollup(readings: DataFrame) -> DataFrame:
    """One row for each node and day. Everything is combined before the shuffle, so a node that sends very much costs a row for each task.

    A level that was lost counts nowhere but in `readings`; a node or time that is null leaves the reading out.
    """
    levels = [x for c in LEVELS for x in (
        F.count(c).alias(f"{c}_n"), F.sum(c).alias(f"{c}_sum"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.kll_sketch_agg_double(c, F.lit(KLL_K)).alias(f"{c}_kll"),
    )]
    rows = readings.where("node_id IS NOT NULL AND timestamp IS NOT NULL").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return rows.groupBy("node_id", F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("readings"), F.max(F.struct("timestamp", "reading_id", "waste_level")).alias("last"), *levels, F.hll_sketch_agg((F.col("humidity") + F.lit(0.0)).cast("string"), HLL_LG).alias("humidity_hll")
    )


def merged(rows: DataFrame, *by: str) -> DataFrame:
    """Roll-ups (or what was merged of them) put together for each value of `by`: again roll-ups, but for the columns of others."""
    levels = [x for c in LEVELS for x in (
        F.sum(f"{c}_n").alias(f"{c}_n"), F.sum(f"{c}_sum").alias(f"{c}_sum"), F.min(f"{c}_min").alias(f"{c}_min"), F.max(f"{c}_max").alias(f"{c}_max"), F.kll_merge_agg_double(f"{c}_kll", F.lit(KLL_K)).alias(f"{c}_kll"),
    )]
    return rows.groupBy(*by).agg(F.sum("readings").alias("readings"), F.max("last").alias("last"), *levels, F.hll_union_agg("humidity_hll").alias("humidity_hll"))


def quantile(level: str, at: float):
    """A level's quantile by its sketch; null where no reading has the level."""
    return F.when(F.col(f"{level}_n") > 0, F.kll_sketch_get_quantile_double(f"{level}_kll", F.lit(at)))


def dashboard(by_node: DataFrame, *by: str) -> DataFrame:
    """Of roll-ups with a row for each node: how many nodes, in which state at the end of the span, and the fill over it."""
    fill = F.col("last.waste_level")
    return by_node.groupBy(*by).agg(
        F.count("*").alias("nodes"), F.sum("readings").alias("readings"), F.count_if(fill >= 0.85).alias("critical"), F.count_if((fill >= 0.65) & (fill < 0.85)).alias("warning"),
        (F.sum("waste_level_sum") / F.sum("waste_level_n")).alias("mean_fill"), F.min("waste_level_min").alias("least_fill"), F.max("waste_level_max").alias("most_fill"),
    )


class Rollup:
    """A table of roll-ups below a path, in folders by batch and day.

    A batch that is written again replaces itself, so a job that failed can be run again; readings that
    come late are a batch of their own and merge with the day they belong to. A span reads the folders
    of its days alone, never the readings.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, readings: DataFrame, batch: str) -> None:
        rows = rollup(readings).hint("rebalance", "day")  # a day's rows go to few files, however many there are
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/batch={batch}")

    def rows(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The roll-ups of the days from first to last (both included; None: no bound)."""
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        if first is not None:
            rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
        if last is not None:
            rows = rows.where(F.col("day") <= F.lit(last).cast("date"))
        return rows

    def span(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """A row for each node that sent something in the span."""
        return merged(self.rows(first, last), "node_id")

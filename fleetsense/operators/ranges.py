"""Running sums and quantiles in an order over all rows, none of which puts all rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def running(rows: DataFrame, by: str, descending: bool = False, **sums) -> DataFrame:
    """rows with a column for each of sums: that Column's sum over the rows that come before, in order of `by`.

    `by` has no value twice. Rows are dealt out in ranges of it and sorted there; what a
    range adds up to is one row, and only those rows are summed in one place.
    """
    key = F.col(by).desc() if descending else F.col(by).asc()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.withColumns(sums).repartitionByRange(parts, key).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    whole = dealt.groupBy("_range").agg(*[F.sum(k).alias(k) for k in sums])
    whole = whole.select("_range", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({k: F.coalesce(F.sum(k).over(inside), F.lit(0)) for k in sums}).join(F.broadcast(whole), "_range")
    return out.withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_range", *[f"_{k}" for k in sums])


def quantiles(rows: DataFrame, column: str, at: Sequence[float]) -> DataFrame:
    """One row, `q`: the exact quantiles of a column (linear between neighbours), as an array; of no values, nulls."""
    # Stored first: what deals out the ranges looks at the rows twice.
    counts = stored(rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")), "counts")
    placed = running(counts, column, _before=F.col("_n"))
    n = F.broadcast(placed.agg(F.sum("_n").alias("_all")))  # one row
    place = [F.lit(p) * (F.col("_all") - 1) for p in at]
    value = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")), F.col(column)))
    ends = placed.crossJoin(n).agg(*[value(f(h)).alias(f"{name}{i}") for i, h in enumerate(place) for name, f in (("lo", F.floor), ("hi", F.ceil))], F.max("_all").alias("_all"))
    return ends.select(F.array(*[F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (h - F.floor(h)) for i, h in enumerate(place)]).alias("q"))

"""Orders over all rows of a key without one task for a key: ranges of the order, and what is carried from one into the next.

Rows are dealt out in ranges of (keys, order), so a key that holds a third of all
rows lies in many ranges. What a range hands on is one row for each key that begins
in it or before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def _dealt(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with the number of their range; written once, so that a range stays what it is."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()), "spans")


def placed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], nth: str = "nth", count: str | None = None) -> DataFrame:
    """rows with their place within their key, from 0, in an order that has no ties; count: how many rows the key has."""
    dealt = _dealt(rows, keys, order)
    sums = dealt.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    of_key = Window.partitionBy(*keys).orderBy("_range") if keys else Window.orderBy("_range")
    before = F.coalesce(F.sum("_n").over(of_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("_n").over(of_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sums = sums.select("_range", *keys, before.alias("_before"), every.alias("_all"))
    inside = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    out = dealt.withColumn("_inside", inside).join(sums, ["_range", *keys])
    out = out.withColumn(nth, F.col("_before") + F.col("_inside") - 1)
    if count:
        out = out.withColumn(count, F.col("_all"))
    return out.drop("_range", "_inside", "_before", "_all")


def carried(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str]) -> DataFrame:
    """rows with, for each name, the last value (not null) of a column within their key up to and with them, in an order that has no ties."""
    dealt = _dealt(rows, keys, order)
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # The last values of each key of a range; only a key that goes on from the range before takes some over.
    last = [F.max_by(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_last{i}") for i, c in enumerate(values.values())]
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.groupBy("_range", *keys).agg(*last)
    met = met.select("_range", *keys, *[F.last(f"_last{i}", True).over(earlier)["v"].alias(f"_in{i}") for i in range(len(values))])
    met = met.where(" OR ".join(f"_in{i} IS NOT NULL" for i in range(len(values))))
    here = dealt.withColumns({f"_here{i}": F.last(c, True).over(inside) for i, c in enumerate(values.values())})
    out = here.join(met, ["_range", *keys], "left").withColumns({n: F.coalesce(f"_here{i}", f"_in{i}") for i, n in enumerate(values)})
    return out.drop("_range", *[f"_{x}{i}" for i in range(len(values)) for x in ("here", "in")])


def asof(left: DataFrame, right: DataFrame, key: str, time: str, tie: str, right_time: str | None = None, strict: bool = False) -> DataFrame:
    """All rows of left, with the columns of right's last row of the same key up to then (before then if strict); null where there is none.

    time is a column of left, right_time (the same by default) one of right; of right's rows with one time that of
    the largest tie counts. A left row without key or time has no match; right's rows without one are no match.
    Apart from the key the sides have no column name in common but the time's. Both sides go through one sort by key and
    time, in ranges, so one key with very many rows is many tasks.
    """
    right_time = right_time or time
    others = [c for c in right.columns if c != key]
    names = [c if c not in left.columns else f"right_{c}" for c in others]
    kinds = dict(right.select(*[F.col(c).alias(n) for c, n in zip(others, names, strict=True)]).dtypes)
    payload = F.struct(*[F.col(c).alias(n) for c, n in zip(others, names, strict=True)])
    none = F.lit(None)
    mine = F.struct(*[F.col(c) for c in left.columns])
    side = F.lit(-1 if strict else 1)  # where times are equal, after the right rows or before them
    asks = left.select(F.col(key).alias("_k"), F.col(time).alias("_t"), side.alias("_side"), none.cast("long").alias("_tie"), F.monotonically_increasing_id().alias("_row"), mine.alias("_left"), none.cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_right"))
    has = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    has = has.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"), none.cast("long").alias("_row"), none.cast(left.select(mine.alias("m")).schema["m"].dataType).alias("_left"), payload.alias("_right"))
    known = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    both = carried(asks.where(known).unionByName(has), ["_k"], ["_t", "_side", "_tie", "_row"], {"_found": "_right"})
    found = both.where("_left IS NOT NULL").select("_left.*", *[F.col(f"_found.{n}").alias(n) for n in names])
    lone = asks.where(~known).select("_left.*", *[none.cast(kinds[n]).alias(n) for n in names])
    return found.unionByName(lone)


def in_buckets(rows: DataFrame, key: str, bucket: Column, also: Column, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """compute(rows), which works by key, done by key and bucket.

    also: an array of other buckets whose rows need this one. compute must keep `_own` and the rows; those that a
    bucket only borrows are not in the result.
    """
    own = F.struct(F.col(key).alias("key"), bucket.cast("long").alias("bucket"))
    lent = F.transform(also, lambda b: F.struct(F.struct(F.col(key).alias("key"), b.cast("long").alias("bucket")).alias("of"), F.lit(False).alias("_own")))
    dealt = rows.withColumn("_to", F.concat(F.array(F.struct(own.alias("of"), F.lit(True).alias("_own"))), lent)).select(*[c for c in rows.columns if c != key], F.inline("_to")).withColumnRenamed("of", key)
    out = compute(dealt).where("_own").drop("_own")
    return out.withColumn(key, F.col(f"{key}.key"))


def by_time(rows: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str, time: Column, width: int, ahead: int = 0, behind: int = 0) -> DataFrame:
    """compute(rows), whose frames reach `ahead` after and `behind` before a row, by key and stretches of `width` of time (whole numbers).

    width is not less than ahead and behind, so a row is lent to a neighbour on each side at most.
    """
    if width < max(ahead, behind, 1):
        raise ValueError("a stretch is at least as long as the frame reaches")
    at = F.floor(time / width)
    into = F.pmod(time, F.lit(width))
    also = F.filter(F.array(F.when(into <= ahead, at - 1) if ahead else F.lit(None).cast("long"), F.when(into >= width - behind, at + 1) if behind else F.lit(None).cast("long")), lambda b: b.isNotNull())
    return in_buckets(rows, key, at, also, compute)


def by_count(rows: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str, order: Sequence[str], size: int, behind: int) -> DataFrame:
    """compute(rows), whose frames reach `behind` rows back, by key and `size` rows that follow one another."""
    if size < max(behind, 1):
        raise ValueError("as many rows as the frame reaches, at least")
    numbered = placed(rows, [key], order, "_nth")
    at = F.floor(F.col("_nth") / size)
    also = F.when(F.pmod("_nth", F.lit(size)) >= size - behind, F.array(at + 1)).otherwise(F.array().cast("array<bigint>"))
    return in_buckets(numbered, key, at, also, compute).drop("_nth")

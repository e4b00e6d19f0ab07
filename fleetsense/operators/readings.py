"""Latest state, rolling features and forward-looking labels over readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranges import quantiles
from ..functions.config import GAS_DANGER, HORIZON_H, TTO_CAP_H

METRICS = ("waste_level", "gas_level", "temperature", "humidity", "traffic_density")
HOUR_US = 3_600_000_000


def latest(readings: DataFrame) -> DataFrame:
    """The newest reading of each node by event time; ties go to the larger reading_id. Combined before the shuffle."""
    rest = [c for c in readings.columns if c not in ("node_id", "timestamp", "reading_id")]
    row = F.max(F.struct("timestamp", "reading_id", *rest)).alias("r")
    return readings.groupBy("node_id").agg(row).select("node_id", "r.*")


def as_of(readings: DataFrame, cutoff: Column) -> DataFrame:
    """The newest reading of each node at a time."""
    return latest(readings.where(F.col("timestamp") <= cutoff))


def last_n(readings: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("node_id").orderBy(F.desc("timestamp"), F.desc("reading_id"))
    return readings.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def last_n_stats(readings: DataFrame, n: int = 10, columns=METRICS) -> DataFrame:
    """Mean and population deviation of the last n readings of each node."""
    aggs = [x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))]
    return last_n(readings, n).groupBy("node_id").agg(F.count("*").alias("n"), *aggs)


def _order() -> Window:
    return Window.partitionBy("node_id").orderBy("timestamp", "reading_id")


def rolling(readings: DataFrame, columns=("waste_level", "gas_level", "temperature", "humidity"), size: int = 10, serving: bool = False, keep=()) -> DataFrame:
    """Rolling mean, deviation and trend over the last `size` rows of each node.

    Training: sample deviation (0 with one row), trend against the value `size`
    rows back (0 without one). Serving: population deviation, trend against the
    first row of the window; both trends are divided by `size`.
    """
    w, frame = _order(), _order().rowsBetween(-(size - 1), 0)
    out = []
    for c in columns:
        out.append(F.avg(c).over(frame).alias(f"{c}_mean"))
        if serving:
            out += [F.stddev_pop(c).over(frame).alias(f"{c}_std"), ((F.col(c) - F.first(c).over(frame)) / size).alias(f"{c}_trend")]
        else:
            out += [F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0)).alias(f"{c}_std"), (F.coalesce(F.col(c) - F.lag(c, size).over(w), F.lit(0.0)) / size).alias(f"{c}_trend")]
    return readings.select("reading_id", "node_id", "timestamp", *keep, *columns, F.hour("timestamp").alias("hour"), F.weekday("timestamp").alias("dow"), *out)


def _ahead(start: int, end: int):
    return Window.partitionBy("node_id").orderBy("us").rangeBetween(start, end)


def hazard_label(readings: DataFrame, hours: int = HORIZON_H) -> DataFrame:
    """hazard: whether within (now, now + hours] the node overflows or its gas is dangerous. A range frame, not a join."""
    bad = F.when((F.col("waste_level") >= 1) | (F.col("gas_level") >= GAS_DANGER), 1).otherwise(0)
    return readings.withColumn("us", S.micros("timestamp")).withColumn("hazard", F.coalesce(F.max(bad).over(_ahead(1, hours * HOUR_US)), F.lit(0))).drop("us")


def overflow_label(readings: DataFrame, hours: int = TTO_CAP_H) -> DataFrame:
    """time_to_overflow: hours to the first overflow in [now, now + hours], else hours."""
    hit = F.min(F.when(F.col("waste_level") >= 1, F.col("us"))).over(_ahead(0, hours * HOUR_US))
    return readings.withColumn("us", S.micros("timestamp")).withColumn("time_to_overflow", F.coalesce((hit - F.col("us")) / 3.6e9, F.lit(float(hours)))).drop("us")


def hazard_rows(readings: DataFrame, rows: int = HORIZON_H) -> DataFrame:
    bad = F.when((F.col("waste_level") >= 1) | (F.col("gas_level") >= GAS_DANGER), 1).otherwise(0)
    return readings.withColumn("hazard", F.coalesce(F.max(bad).over(_order().rowsBetween(1, rows)), F.lit(0)))


def overflow_rows(readings: DataFrame, rows: int = TTO_CAP_H) -> DataFrame:
    numbered = readings.withColumn("t", F.row_number().over(_order()))
    hit = F.min(F.when(F.col("waste_level") >= 1, F.col("t"))).over(_order().rowsBetween(0, rows - 1))
    return numbered.withColumn("time_to_overflow", F.coalesce((hit - F.col("t")).cast("double"), F.lit(float(rows))))


def forward_fill(readings: DataFrame, columns=METRICS) -> DataFrame:
    w = _order().rowsBetween(Window.unboundedPreceding, 0)
    return readings.select("reading_id", "node_id", "timestamp", *[F.last(c, True).over(w).alias(c) for c in columns])


def elapsed(readings: DataFrame) -> DataFrame:
    us = S.micros("timestamp")
    return readings.withColumn("elapsed_h", (us - F.min(us).over(Window.partitionBy("node_id"))) / 3.6e9)


def resample(readings: DataFrame, columns=("waste_level", "gas_level"), unit: str = "day") -> DataFrame:
    """Bucket means of each node."""
    return readings.groupBy("node_id", F.date_trunc(unit, F.col("timestamp").cast("timestamp")).cast("timestamp_ntz").alias("bucket")).agg(*[F.avg(c).alias(c) for c in columns])


def interpolate(frame: DataFrame, column: str, order: str, keys=("node_id",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    f = frame.withColumn("_p", F.row_number().over(w)).withColumn("_k", F.when(F.col(column).isNotNull(), F.struct(F.col("_p").alias("p"), F.col(column).alias("v"))))
    f = f.withColumn("_a", F.last("_k", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first("_k", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    between = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_p") - F.col("_a.p")) / (F.col("_b.p") - F.col("_a.p"))
    value = F.when(F.col(column).isNotNull(), F.col(column)).when(F.col("_a").isNull(), None).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(between)
    return f.withColumn(column, value).drop("_p", "_k", "_a", "_b")


def split_in_group(readings: DataFrame, share: float = 0.8) -> DataFrame:
    """is_train: the first floor(n * share) rows of each node in time."""
    n = F.count("*").over(Window.partitionBy("node_id"))
    return readings.withColumn("is_train", F.row_number().over(_order()) <= F.floor(n * share))


def split_at_quantile(readings: DataFrame, share: float = 0.8) -> DataFrame:
    """is_train: rows at or before the share's time quantile over all rows. An aggregate, not a global row number."""
    cut = quantiles(readings.select(S.micros("timestamp").alias("us")), "us", [share]).select(F.col("q")[0].alias("cut"))  # one row
    return readings.crossJoin(F.broadcast(cut)).withColumn("is_train", S.micros("timestamp") <= F.col("cut")).drop("cut")


def percentile_threshold(readings: DataFrame, column: str = "gas_level", share: float = 0.95) -> DataFrame:
    return readings.groupBy("node_id").agg(F.percentile(column, F.lit(share)).alias("threshold"))


def with_distance(nodes: DataFrame, lat: float, lng: float) -> DataFrame:
    return nodes.withColumn("distance_m", S.haversine_m(F.lit(lat), F.lit(lng), "latitude", "longitude"))


def scored_nodes(nodes: DataFrame, readings: DataFrame, lat: float, lng: float) -> DataFrame:
    """Each node with its latest reading, distance and priority; 0 and no traffic without a reading."""
    now = latest(readings)
    rows = with_distance(nodes, lat, lng).join(now, "node_id", "left")
    return rows.withColumn("priority", F.when(F.col("reading_id").isNotNull(), S.priority()).otherwise(F.lit(0.0)))


def top_nodes(scored: DataFrame, n: int) -> DataFrame:
    """The n most urgent; ties by id; all of them for n <= 0."""
    ordered = scored.orderBy(F.desc("priority"), "node_id")
    return ordered.limit(n) if n > 0 else ordered

"""The telemetry domain over the sample tables: points, readings, notifications, visits and stops."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    """Lazily built DataFrames over a folder of Parquet tables. Times are UTC."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def bin_group(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("long").alias("group_id"), F.col("n_name").alias("group_name"), F.col("n_regionkey").cast("long").alias("region_id"))

    @cached_property
    def node(self) -> DataFrame:
        at = lambda base, step, mod: F.when(F.col("c_custkey") % 29 != 28, F.lit(base) + ((F.col("c_custkey") * step) % mod).cast("double") * F.lit(0.00006))
        return self.raw("customer").select(
            F.col("c_custkey").alias("node_id"), F.col("c_name").alias("node_name"), F.when(F.col("c_custkey") % 13 != 12, F.col("c_nationkey").cast("long")).alias("group_id"),
            at(23.78, 370, 1009).alias("latitude"), at(90.34, 613, 1013).alias("longitude"),
        )

    def _reading(self, *more) -> DataFrame:
        i = F.col("event_id")
        return self.raw("events").select(
            i.alias("reading_id"), F.col("user_id").alias("node_id"), F.col("ts").alias("timestamp"),
            F.least(F.lit(1.0), F.col("value") / F.lit(150.0)).alias("waste_level"),
            (F.regexp_extract("props", "([0-9]+)", 1).cast("long").cast("double") / F.lit(150.0)).alias("gas_level"),
            (18 + i % 23).cast("double").alias("temperature"), (45 + i % 51).cast("double").alias("humidity"),
            ((i % 11).cast("double") / F.lit(10.0)).alias("traffic_density"), *more,
        )

    @cached_property
    def reading(self) -> DataFrame:
        return self._reading()

    @property
    def reading_typed(self) -> DataFrame:
        """Readings with the type of their event."""
        return self._reading("event_type")

    @staticmethod
    def lose(readings: DataFrame, *keep: str) -> DataFrame:
        """Typed readings with lost sensors: null where a sensor gave nothing."""
        i, kind = F.col("reading_id"), F.col("event_type")
        lost = {"waste_level": i % 17 == 0, "gas_level": kind == "error", "temperature": (kind == "view") & (i % 5 == 0), "humidity": kind == "signup", "traffic_density": i % 7 == 0}
        return readings.select("reading_id", "node_id", "timestamp", *[F.when(~gone, F.col(c)).alias(c) for c, gone in lost.items()], *keep)

    @cached_property
    def reading_obs(self) -> DataFrame:
        return self.lose(self.reading_typed)

    @cached_property
    def notification(self) -> DataFrame:
        i = F.col("event_id")
        return self.raw("events").select(
            i.alias("notification_id"), F.when(i % 5 != 0, F.col("user_id")).alias("user_id"),
            F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "signup", "WARN").otherwise("INFO").alias("level"),
            (i % 3 == 0).alias("is_read"), F.col("ts").alias("created_at"),
        )

    @cached_property
    def visit(self) -> DataFrame:
        return self.raw("orders").select(F.col("o_custkey").alias("node_id"), F.col("o_orderkey").alias("visit_id"), F.col("o_orderdate").alias("visited_at"))

    @cached_property
    def stop(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
        at = lambda base, step, mod: F.lit(base) + ((F.col("l_suppkey") * step) % mod).cast("double") * F.lit(0.00006)
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("tour_id"), F.row_number().over(order).cast("long").alias("pos"), F.col("l_suppkey").alias("stop_id"),
            at(23.78, 370, 1009).alias("latitude"), at(90.34, 613, 1013).alias("longitude"),
        )


#: The same views as SQL common table expressions, for the twins.
VIEW_SQL = """
bin_group AS (SELECT CAST(n_nationkey AS BIGINT) AS group_id, n_name AS group_name, CAST(n_regionkey AS BIGINT) AS region_id FROM nation),
node AS (SELECT c_custkey AS node_id, c_name AS node_name,
  CASE WHEN c_custkey % 13 = 12 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS group_id,
  CASE WHEN c_custkey % 29 = 28 THEN NULL ELSE CAST(23.78 AS DOUBLE) + CAST((c_custkey * 370) % 1009 AS DOUBLE) * CAST(0.00006 AS DOUBLE) END AS latitude,
  CASE WHEN c_custkey % 29 = 28 THEN NULL ELSE CAST(90.34 AS DOUBLE) + CAST((c_custkey * 613) % 1013 AS DOUBLE) * CAST(0.00006 AS DOUBLE) END AS longitude
  FROM customer),
reading AS (SELECT event_id AS reading_id, user_id AS node_id, ts AS timestamp,
  least(CAST(1 AS DOUBLE), value / CAST(150 AS DOUBLE)) AS waste_level,
  CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS DOUBLE) / CAST(150 AS DOUBLE) AS gas_level,
  CAST(18 + event_id % 23 AS DOUBLE) AS temperature, CAST(45 + event_id % 51 AS DOUBLE) AS humidity,
  CAST(event_id % 11 AS DOUBLE) / CAST(10 AS DOUBLE) AS traffic_density FROM events),
reading_obs AS (SELECT e.event_id AS reading_id, r.node_id, r.timestamp,
  CASE WHEN e.event_id % 17 = 0 THEN NULL ELSE r.waste_level END AS waste_level,
  CASE WHEN e.event_type = 'error' THEN NULL ELSE r.gas_level END AS gas_level,
  CASE WHEN e.event_type = 'view' AND e.event_id % 5 = 0 THEN NULL ELSE r.temperature END AS temperature,
  CASE WHEN e.event_type = 'signup' THEN NULL ELSE r.humidity END AS humidity,
  CASE WHEN e.event_id % 7 = 0 THEN NULL ELSE r.traffic_density END AS traffic_density
  FROM events e JOIN reading r ON e.event_id = r.reading_id),
notification AS (SELECT event_id AS notification_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS user_id,
  CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level,
  event_id % 3 = 0 AS is_read, ts AS created_at FROM events),
visit AS (SELECT o_custkey AS node_id, o_orderkey AS visit_id, o_orderdate AS visited_at FROM orders),
stop AS (SELECT l_orderkey AS tour_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS BIGINT) AS pos,
  l_suppkey AS stop_id,
  CAST(23.78 AS DOUBLE) + CAST((l_suppkey * 370) % 1009 AS DOUBLE) * CAST(0.00006 AS DOUBLE) AS latitude,
  CAST(90.34 AS DOUBLE) + CAST((l_suppkey * 613) % 1013 AS DOUBLE) * CAST(0.00006 AS DOUBLE) AS longitude FROM lineitem)
"""

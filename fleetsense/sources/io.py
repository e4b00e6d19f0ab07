"""Readers and writers: CSV with column aliases, JSON fixtures, feature tables, routes, predictions and model metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Fixed names that a telemetry file's columns may have; the first that is there counts.
ALIASES = {
    "timestamp": ("ts", "timestamp", "time", "date", "datetime", "created_at"),
    "node": ("device", "node", "node_id", "sensor", "sensor_id", "bin_id", "id"),
    "temperature": ("temp", "temperature"),
    "humidity": ("humidity", "hum"),
    "gas_level": ("lpg", "gas", "gas_level", "co", "smoke", "methane"),
}


def resolve(columns: list[str], aliases=ALIASES) -> dict[str, str]:
    """Logical name to column, without regard to case."""
    lower = {c.lower().strip(): c for c in reversed(columns)}
    return {name: lower[a] for name, names in aliases.items() for a in [next((x for x in names if x in lower), None)] if a}


def read_telemetry_csv(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, node, temperature, humidity, gas_level; rows whose time cannot be read are left out."""
    raw = spark.read.option("header", True).csv(path)
    found = resolve(raw.columns)
    if "timestamp" not in found:
        raise ValueError(f"no time column among {raw.columns}")
    out = [S.parse_time(F.col(f"`{found['timestamp']}`")).alias("timestamp"), (F.col(f"`{found['node']}`") if "node" in found else F.lit("all")).alias("node")]
    out += [(F.col(f"`{found[c]}`").try_cast("double") if c in found else F.lit(None).cast("double")).alias(c) for c in ("temperature", "humidity", "gas_level")]
    return raw.select(*out).where("timestamp IS NOT NULL")


def read_fixture(spark: SparkSession, path: str, model: str, multi_line: bool = True) -> DataFrame:
    """pk and the fields of a JSON fixture's records of one model; a fixture is one array, or with multi_line=False a record a line."""
    return spark.read.option("multiLine", multi_line).json(path).where(F.col("model") == model).select("pk", "fields.*")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 16, **options) -> DataFrame:
    """A table by JDBC, in ranges of a key; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def cached_features(spark: SparkSession, path: str, build, force: bool = False, node: str | None = None, buckets: int = 16) -> DataFrame:
    """A feature table in Parquet; built if it is not there. With a node column it is partitioned by node_bucket, so that a node's rows are found by one folder."""
    from pyspark.errors import AnalysisException

    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass  # nothing there yet
    rows = build()
    if node:
        rows.withColumn("node_bucket", F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")).repartition("node_bucket").write.mode("overwrite").partitionBy("node_bucket").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def json_result(rows: DataFrame, path: str) -> DataFrame:
    """Write a result as JSON lines and give it back as read, with the same types."""
    rows.write.mode("overwrite").json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def route_documents(routes: DataFrame, users: DataFrame) -> DataFrame:
    """routes with the name of the user who asked for each (user_id to user_name); 'system' where nobody did or the user is gone."""
    names = users.groupBy("user_id").agg(F.min("user_name").alias("user_name"))
    return routes.join(names, "user_id", "left").withColumn("user_name", F.coalesce("user_name", F.lit("system")))


def append_readings(readings: DataFrame, path: str) -> None:
    readings.write.mode("append").parquet(path)


def route_rows(tours: DataFrame, edges: DataFrame, scores: DataFrame, key: str, alpha: float, user: tuple[float, float], top_n: int) -> DataFrame:
    """Nested route documents: path, edges, scores and how they were made. A route of one stop has no edges."""
    none = F.array().cast("array<struct<pos:int,u:bigint,v:bigint,w:double>>")
    e = edges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "u", "v", "w"))).alias("edges"))
    s = scores.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("node_id", "priority"))).alias("priority_scores"))
    doc = F.struct(
        "path", F.transform(F.coalesce("edges", none), lambda x: F.struct(x["u"].alias("u"), x["v"].alias("v"), x["w"].alias("w"))).alias("edges"), F.lit(alpha).alias("alpha"), "priority_scores",
        F.lit("engine").alias("source"), F.struct(F.lit(user[0]).alias("lat"), F.lit(user[1]).alias("lng")).alias("user_location"), F.lit(top_n).alias("top_n_selected"), F.lit("1").alias("algorithm_version"),
    ).alias("route_data")
    return tours.join(e, key, "left").join(s, key, "left").select(key, doc, F.col("cost").alias("total_cost"))


def prediction_rows(rows: DataFrame, score: str, version: str, features) -> DataFrame:
    """node_id, features as a map, predicted_cost, model_version."""
    return rows.select("node_id", F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[F.col(f).cast("double") for f in features])).alias("features"), F.col(score).alias("predicted_cost"), F.lit(version).alias("model_version"))


def nested_nodes(nodes: DataFrame, groups: DataFrame, latest: DataFrame) -> DataFrame:
    """node_id and a JSON document of the node, its group and its latest reading."""
    g = groups.select("group_id", F.struct("group_id", "group_name").alias("group"))
    r = latest.select("node_id", F.struct(*[c for c in latest.columns if c != "node_id"]).alias("latest"))
    rows = nodes.join(g, "group_id", "left").join(r, "node_id", "left")
    return rows.select("node_id", F.to_json(F.struct("node_id", "node_name", "latitude", "longitude", "group", "latest")).alias("document"))


def save_meta(spark: SparkSession, path: str, meta: dict) -> None:
    """A model's metadata as one JSON line."""
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_meta(spark: SparkSession, path: str) -> dict | None:
    """A model's metadata; None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path).limit(1).collect()
    except AnalysisException:
        return None
    return json.loads(rows[0]["value"]) if rows else None


def model_version(spark: SparkSession, path: str) -> str:
    """The metadata's version; 'unknown' without metadata."""
    return (read_meta(spark, path) or {}).get("version", "unknown")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Health report: rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out

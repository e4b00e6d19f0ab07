"""Dashboard aggregates, notifications, and table upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import readings as R
from .ranges import running


def stats(nodes: DataFrame, readings: DataFrame) -> DataFrame:
    """One row: nodes, critical, warning, normal (nodes without readings are normal), mean fill in percent."""
    now = R.latest(readings).agg(
        F.count_if(F.col("waste_level") >= 0.85).alias("critical"), F.count_if((F.col("waste_level") >= 0.65) & (F.col("waste_level") < 0.85)).alias("warning"),
        F.coalesce(F.round(F.avg(F.coalesce("waste_level", F.lit(0.0))) * 100, 1), F.lit(0.0)).alias("mean_fill_pct"),
    )
    total = nodes.agg(F.count("*").alias("nodes"))
    return total.crossJoin(now).select("nodes", "critical", "warning", (F.col("nodes") - F.col("critical") - F.col("warning")).alias("normal"), "mean_fill_pct")


def status_by_group(nodes: DataFrame, groups: DataFrame, readings: DataFrame) -> DataFrame:
    rows = nodes.join(groups, "group_id", "left").join(R.latest(readings).select("node_id", "waste_level"), "node_id", "left")
    fill = F.coalesce("waste_level", F.lit(0.0))
    return rows.groupBy(F.coalesce("group_name", F.lit("(none)")).alias("group_name"), S.status(fill).alias("status"), S.status_strict(fill).alias("status_strict")).agg(F.count("*").alias("nodes"))


def visible(notifications: DataFrame, user: int, visibility: str = "mine") -> DataFrame:
    """mine: rows addressed to the user. mine_or_broadcast: and those addressed to nobody."""
    mine = F.col("user_id") == user
    return notifications.where(mine | F.col("user_id").isNull() if visibility == "mine_or_broadcast" else mine)


def newest(frame: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    return frame.orderBy(F.desc(by), F.desc(tie)).limit(n)


def mark_read(notifications: DataFrame, condition: Column) -> DataFrame:
    return notifications.withColumn("is_read", F.when(condition, F.lit(True)).otherwise(F.col("is_read")))


def alerts(readings: DataFrame) -> DataFrame:
    """A notification for each node whose latest fill is not normal."""
    rows = R.latest(readings).withColumn("status", S.status("waste_level")).where("status <> 'normal'")
    return rows.select("node_id", F.when(F.col("status") == "critical", "CRITICAL").otherwise("WARN").alias("level"), F.concat(F.lit("Node "), F.col("node_id").cast("string"), F.lit(" is "), F.col("status")).alias("message"), F.col("timestamp").alias("created_at"))


def ingest(payload: DataFrame, nodes: DataFrame) -> DataFrame:
    """Readings of JSON payloads (a string column `body`): node by id or else by name, defaults, clamped levels.

    Rows that name no known node are left out.
    """
    kind = "node_id STRING, node_name STRING, temperature STRING, humidity STRING, gas_level STRING, waste_level STRING, traffic_density STRING"
    p = payload.withColumn("p", F.from_json("body", kind)).select(*[c for c in payload.columns if c != "body"], "p.*")
    p = p.withColumn("want_id", F.col("node_id").try_cast("long")).withColumn("want_name", F.trim("node_name")).drop("node_id", "node_name")
    by_id = nodes.select(F.col("node_id").alias("id_hit"))
    by_name = nodes.groupBy(F.col("node_name").alias("name_key")).agg(F.min("node_id").alias("name_hit"))
    rows = p.join(by_id, p.want_id == by_id.id_hit, "left").join(by_name, p.want_name == by_name.name_key, "left").withColumn("node_id", F.coalesce("id_hit", "name_hit")).where("node_id IS NOT NULL")
    return rows.select(
        *[c for c in payload.columns if c != "body"], "node_id", S.number_or("temperature", 25).alias("temperature"), S.number_or("humidity", 60).alias("humidity"),
        *[S.clip01(S.number_or(c, 0)).alias(c) for c in ("gas_level", "waste_level", "traffic_density")],
    )


def ingest_raw(payload: DataFrame) -> DataFrame:
    """The older form: nothing is clamped, a missing fill is 0."""
    kind = "node_id LONG, temperature DOUBLE, humidity DOUBLE, gas_level DOUBLE, waste_level DOUBLE, distance_to_next_bin DOUBLE"
    p = payload.withColumn("p", F.from_json("body", kind)).select(*[c for c in payload.columns if c != "body"], "p.*")
    return p.where("node_id IS NOT NULL").withColumn("waste_level", F.coalesce("waste_level", F.lit(0.0)))


def ensure_nodes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Get or create by name (node_name, latitude, longitude); only null coordinates of an existing row are filled."""
    want = wanted.groupBy("node_name").agg(F.min_by("latitude", "want_id").alias("lat"), F.min_by("longitude", "want_id").alias("lng"))
    both = nodes.join(want, "node_name", "full_outer")
    last = F.broadcast(nodes.agg(F.coalesce(F.max("node_id"), F.lit(0)).alias("last")))  # one row
    old = both.where("node_id IS NOT NULL").select("node_id", "node_name", F.coalesce("latitude", "lat").alias("latitude"), F.coalesce("longitude", "lng").alias("longitude"))
    new = running(both.where("node_id IS NULL"), "node_name", k=F.lit(1)).crossJoin(last)  # names of new rows get ids after the last, in order of name
    return old.unionByName(new.select((F.col("last") + F.col("k") + 1).alias("node_id"), "node_name", F.col("lat").alias("latitude"), F.col("lng").alias("longitude")))


def relocate_or_create(nodes: DataFrame, moves: DataFrame, drop_prefix: str) -> DataFrame:
    """Drop nodes of a name prefix; each move (old_name, new_name, latitude, longitude) then renames and moves the nodes of its old name,
    else moves those of its new name, else makes a node of the new name, with ids after the last in order of name.

    Of moves with the same new name the one with the smallest old name counts. A null coordinate leaves the old one.
    """
    kept = nodes.where(~F.col("node_name").startswith(drop_prefix))
    names = kept.select("node_name").distinct()
    m = moves.groupBy("new_name").agg(F.min(F.struct("old_name", "latitude", "longitude")).alias("m")).select("new_name", "m.old_name", F.col("m.latitude").alias("lat"), F.col("m.longitude").alias("lng"))
    m = m.join(names.select(F.col("node_name").alias("old_name"), F.lit(True).alias("has_old")), "old_name", "left").join(names.select(F.col("node_name").alias("new_name"), F.lit(True).alias("has_new")), "new_name", "left")
    m = m.withColumn("key", F.when(F.col("has_old"), F.col("old_name")).otherwise(F.col("new_name")))
    one = m.groupBy("key").agg(F.min(F.struct("new_name", "lat", "lng")).alias("to"))
    old = kept.join(one, kept.node_name == one.key, "left").select("node_id", F.coalesce("to.new_name", "node_name").alias("node_name"), F.coalesce("to.lat", "latitude").alias("latitude"), F.coalesce("to.lng", "longitude").alias("longitude"))
    last = F.broadcast(nodes.agg(F.coalesce(F.max("node_id"), F.lit(0)).alias("last")))  # one row
    new = running(m.where("has_old IS NULL AND has_new IS NULL AND new_name IS NOT NULL"), "new_name", k=F.lit(1)).crossJoin(last)
    return old.unionByName(new.select((F.col("last") + F.col("k") + 1).alias("node_id"), F.col("new_name").alias("node_name"), F.col("lat").alias("latitude"), F.col("lng").alias("longitude")))


def location_errors(places: DataFrame) -> DataFrame:
    """node_id, error: what is wrong with a place, joined by '; ' (empty: nothing)."""
    lat, lng = F.col("latitude"), F.col("longitude")
    found = F.array(
        F.when(lat.isNull() & lng.isNull(), "location is missing"), F.when(lat.isNull() & lng.isNotNull(), "latitude is missing"), F.when(lat.isNotNull() & lng.isNull(), "longitude is missing"),
        F.when(~lat.between(-90, 90), "latitude must be within 90 degrees"), F.when(~lng.between(-180, 180), "longitude must be within 180 degrees"),
    )
    return places.select("node_id", F.array_join(found, "; ").alias("error"))


def relocate(nodes: DataFrame, moves: DataFrame, drop_prefix: str) -> DataFrame:
    """Drop nodes of a name prefix, rename and move those listed (old_name, new_name, latitude, longitude); others stay."""
    kept = nodes.where(~F.col("node_name").startswith(drop_prefix))
    m = moves.select(F.col("old_name"), F.col("new_name"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
    return kept.join(m, kept.node_name == m.old_name, "left").select("node_id", F.coalesce("new_name", "node_name").alias("node_name"), F.coalesce("lat", "latitude").alias("latitude"), F.coalesce("lng", "longitude").alias("longitude"))

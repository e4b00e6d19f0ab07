"""Named queries over whole networks and over nodes that may send very many readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.config import DEPOT
from ..operators import network as N
from ..operators import readings as R
from ..operators import sketches, spans
from ..operators.sketches import Rollup
from ..sources import variants
from ..sources.keyed import KeyedTable
from ..sources.shared import fresh_path, stored
from .catalogue import _once, _requests, _stream, query, r4, r6

#: Neighbours of a node; nodes of a cluster; nodes of a cell of shortest paths.
NEAREST, CLUSTER, CELL = 8, 400, 8000
#: A week of microseconds: stretches of time that labels are worked out in.
WEEK_US = 7 * 24 * R.HOUR_US
#: Readings of a node that follow one another and are rolled over in one task.
ROLLED_ROWS = 100_000


@query("nearest_nodes")
def _(t):
    return N.nearest(t.node, NEAREST).select("node_id", "rank", "neighbour", "distance_m")


@query("cluster_sizes")
def _(t):
    rows = N.clusters(t.node.select("node_id", F.coalesce("group_id", F.lit(-1).cast("long")).alias("depot"), "latitude", "longitude"), CLUSTER, ("depot",))
    return rows.groupBy("depot", "cluster").agg(F.count("*").alias("n"), F.count_distinct("node_id").alias("nodes"))


@query("network_tour")
def _(t):
    """One tour from the depot through every node of the network that has a place."""
    return N.long_tour(t.node, DEPOT).select("pos", "node_id")


@query("network_paths")
def _(t):
    """Shortest ways over the ways to the nearest nodes, from the least node of each region to all."""
    edges = stored(N.neighbour_edges(N.nearest(t.node, NEAREST)), "ways")
    sources = t.node.where("latitude IS NOT NULL").join(t.bin_group, "group_id").groupBy("region_id").agg(F.min("node_id").alias("node")).select("node").distinct()
    cells = N.clusters(t.node, CELL).select("node_id", F.col("cluster").alias("cell"))
    return N.cell_paths(edges, sources, cells).select("source", "node", *r4("dist"))


@query("notification_states")
def _(t):
    """Each notification with its node's last reading before it."""
    asks = t.notification.select("notification_id", F.col("user_id").alias("node_id"), F.col("created_at").alias("at"), "level")
    rows = spans.asof(asks, t.reading.select("node_id", "reading_id", "timestamp", "waste_level", "gas_level"), "node_id", "at", "reading_id", "timestamp", strict=True)
    return rows.select("notification_id", "level", "reading_id", *r6("waste_level", "gas_level"), ((S.micros("at") - S.micros("timestamp")) / 1_000_000).cast("long").alias("age_s"))


@query("hazard_in_stretches")
def _(t):
    return spans.by_time(t.reading, R.hazard_label, "node_id", S.micros("timestamp"), WEEK_US, ahead=6 * R.HOUR_US).select("reading_id", "hazard")


@query("overflow_in_stretches")
def _(t):
    return spans.by_time(t.reading, R.overflow_label, "node_id", S.micros("timestamp"), WEEK_US, ahead=24 * R.HOUR_US).select("reading_id", *r6("time_to_overflow"))


@query("rolling_in_stretches")
def _(t):
    cols = [f"{c}_{s}" for c in ("waste_level", "gas_level") for s in ("mean", "std", "trend")]
    rows = spans.by_count(t.reading, lambda x: R.rolling(x, keep=("_own", "_nth")), "node_id", ["timestamp", "reading_id"], ROLLED_ROWS, 10)
    return rows.select("reading_id", "hour", "dow", *r6(*cols))


@query("fill_carried")
def _(t):
    rows = t.reading_obs.select("reading_id", "node_id", "timestamp", *[F.col(c).alias(f"_{c}") for c in R.METRICS])
    return spans.carried(rows, ["node_id"], ["timestamp", "reading_id"], {c: f"_{c}" for c in R.METRICS}).select("reading_id", *r6(*R.METRICS))


@query("visit_numbers")
def _(t):
    """The place of each visit among its node's, and of how many."""
    return spans.placed(t.visit, ["node_id"], ["visited_at", "visit_id"], "nth", "visits").select("visit_id", "node_id", (F.col("nth") + 1).alias("nth"), "visits")


@query("stream_until_silent")
def _(t):
    """Through the stream: the newest reading of each node, and once more if the node was silent for a day when the stream ended."""
    from ..streaming import state

    return _once(t, state.latest_until_silent(_stream(t)), "update").select("node_id", "reading_id", "live", *r6("waste_level", "gas_level"))


@query("stream_fill_until_silent")
def _(t):
    from ..streaming import state

    return _once(t, state.fill_until_silent(_stream(t)), "update").select("node_id", "emptied", "live", *r6("fill"))


@query("keyed_upserts")
def _(t):
    """Nodes in a keyed table: some renamed, some added, some deleted, each as a version that rewrites its buckets alone."""
    nodes = t.node.select("node_id", "node_name", "group_id")
    table = KeyedTable(t.spark, fresh_path(t.spark, "nodes"), "node_id", nodes.schema, 16)
    table.upsert(nodes)
    renamed = nodes.where(F.col("node_name").endswith("77")).withColumn("node_name", F.concat(F.lit("Moved "), "node_name"))
    added = t.raw("supplier").select((-1 - F.col("s_suppkey")).alias("node_id"), F.col("s_name").alias("node_name"), F.col("s_nationkey").cast("long").alias("group_id"))
    table.upsert(renamed.unionByName(added))
    table.delete(nodes.where("group_id = 3").select("node_id"))
    return table.read()


@query("sql_functions")
def _(t):
    from ..functions import sql

    sql.register(t.spark)
    rows = R.scored_nodes(t.node, t.reading, *DEPOT).select("node_id", "latitude", "longitude", "waste_level", "traffic_density", "priority")
    metres = f"haversine_m({DEPOT[0]}D, {DEPOT[1]}D, latitude, longitude)"
    text = f"SELECT node_id, round({metres}, 4) AS metres, round(edge_cost({metres}, priority, traffic_density, 0.5D), 4) AS cost, fill_status(waste_level) AS status"
    return t.spark.sql(text + " FROM {rows}", rows=rows)


@query("routes_by_sql")
def _(t):
    """The table function on each request, by SQL: the rows of optimal_route_refined."""
    from ..functions import sql

    sql.register(t.spark)
    return t.spark.sql("SELECT route_id, path, total_cost, distance_m FROM route(TABLE(SELECT * FROM {rows}) PARTITION BY route_id)", rows=_requests(t))


@query("quantile_forest_tto")
def _(t):
    """Quantiles of the time to overflow for the rows held out, by a forest's leaves."""
    from ..operators import ml, quantile_forest

    rows = ml.forward_rows(t.reading)
    forest = quantile_forest.QuantileForest.fit(rows.where("is_train"))
    return forest.quantiles(rows.where("NOT is_train"), {"p10": 0.1, "p50": 0.5, "p90": 0.9})


def _rolled(t, readings):
    """A roll-up table of the readings; every fifth comes late, as a batch of its own."""
    table = Rollup(t.spark, fresh_path(t.spark, "rollup"))
    late = F.col("reading_id") % 5 == 0
    table.add(readings.where(~late), "first")
    table.add(readings.where(late), "late")
    return table


@query("rollup_weeks")
def _(t):
    """Each week's dashboard from the roll-ups of its days."""
    rows = sketches.merged(_rolled(t, t.reading).rows().withColumn("week", F.trunc("day", "week")), "week", "node_id")
    return sketches.dashboard(rows, "week").select("week", "nodes", "readings", "critical", "warning", *r6("mean_fill", "least_fill", "most_fill"))


@query("rollup_quantiles")
def _(t):
    """Each group's quantiles of the fill and number of humidities, by merged sketches."""
    by_node = _rolled(t, t.reading_obs).span().join(t.node.select("node_id", "group_id"), "node_id")
    of = lambda at: sketches.quantile("waste_level", at)
    return sketches.merged(by_node, "group_id").select("group_id", "readings", of(0.1).alias("p10"), of(0.5).alias("p50"), of(0.95).alias("p95"), F.hll_sketch_estimate("humidity_hll").alias("humidities"))


def _documents(t):
    """Bodies of all events as they might arrive over the years: fields come and go, one changes its type, some texts are cut off."""
    i = F.col("event_id")
    more = F.when(i % 5 == 1, ',"firmware":"v2","battery":0.5').when(i % 5 == 2, ',"battery":"low"').when(i % 5 == 3, ',"tags":["a","b"],"gone":null').otherwise("")
    head = F.concat(F.lit('{"reading":'), i.cast("string"), F.lit(',"kind":"'), "event_type", F.lit('","props":'), "props")
    bodies = t.raw("events").select(i.alias("reading_id"), F.concat(head, F.when(i % 10 == 4, "").otherwise(F.concat(more, F.lit("}")))).alias("body"))
    path = fresh_path(t.spark, "documents")
    early = F.col("reading_id") % 5 < 2
    variants.stored_documents(bodies.where(early), path)
    return variants.stored_documents(bodies.where(~early), path)


@query("variant_fields")
def _(t):
    wanted = {"k": ("$.props.k", "bigint"), "kind": ("$.kind", "string"), "battery": ("$.battery", "double"), "battery_text": ("$.battery", "string"), "firmware": ("$.firmware", "string"), "second_tag": ("$.tags[1]", "string")}
    return variants.fields(_documents(t), wanted, "reading_id", F.length("bad").cast("long").alias("bad_chars"))


@query("variant_drift")
def _(t):
    return variants.drift(_documents(t))

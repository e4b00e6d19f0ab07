"""More named queries: filters, samples, documents, arrays and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.config import DEPOT, STATE_FEATURES, USER
from ..operators import dashboard as D
from ..operators import graph as G
from ..operators import readings as R
from ..sources import generate
from ..sources import io as IO
from .catalogue import _greedy, _top_in_group, query, r4, r6


@query("ingest_raw_readings")
def _(t):
    i = F.col("event_id")
    body = F.to_json(F.struct(F.col("user_id").alias("node_id"), (i % 40).cast("double").alias("temperature"), F.when(i % 6 != 0, (i % 30) / 20.0).alias("waste_level"), ((i % 50) / 20.0).alias("gas_level")))
    rows = D.ingest_raw(t.raw("events").select(i.alias("reading_id"), F.when(i % 9 == 0, F.lit("{bad")).otherwise(body).alias("body")))
    return rows.select("reading_id", "node_id", *r6("temperature", "gas_level", "waste_level"))


@query("facet_filters")
def _(t):
    rows = t.node.join(t.bin_group, "group_id").where(F.lower("group_name").isin("france", "china", "peru") | F.col("group_name").startswith("IN") | F.col("node_name").contains("99"))
    return rows.select("node_id", "group_name", F.concat_ws(" - ", "group_name", F.coalesce(S.two_decimals("latitude"), F.lit("null"))).alias("shown"))


@query("nodes_by_name_any_case")
def _(t):
    return t.node.where(F.lower("node_name") == F.lower(F.lit("CUSTOMER#000000007"))).select("node_id", "node_name")


@query("urgent_candidates")
def _(t):
    return R.latest(t.reading).withColumn("priority", S.state_priority()).where("priority >= 0.5D").select("node_id", *r6("priority"))


@query("dropna_counts")
def _(t):
    return t.reading_obs.dropna(subset=["waste_level", "gas_level"]).groupBy("node_id").agg(F.count("*").alias("rows"), F.count_distinct("humidity").alias("humidities"))


@query("sampled_timestamps")
def _(t):
    first = F.broadcast(t.reading.agg(F.min("timestamp").alias("first")))
    late = t.reading.crossJoin(first).where(F.col("timestamp") >= F.col("first") + F.expr("INTERVAL '50' HOUR"))
    return late.orderBy(F.md5(F.concat(F.col("reading_id").cast("string"), F.lit("/7"))), "reading_id").limit(400).select("reading_id", "timestamp")


@query("sampled_peak_hours")
def _(t):
    hour = F.date_trunc("hour", F.col("timestamp").cast("timestamp")).cast("timestamp_ntz")
    load = R.hazard_label(t.reading).groupBy(hour.alias("bucket")).agg(F.sum("hazard").cast("long").alias("load"))
    top = load.orderBy(F.desc("load"), F.desc("bucket")).limit(40)
    return top.orderBy(F.md5(F.date_format("bucket", "yyyy-MM-dd HH")), "bucket").limit(25)


@query("iso_times")
def _(t):
    return t.reading.select("reading_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("timestamp", "yyyyMMdd").alias("version"), F.unix_micros(S.parse_time(F.concat((F.lit(1_700_000_000) + F.col("reading_id")).cast("string"), F.when(F.col("reading_id") % 5 == 0, "x").otherwise("")))).alias("parsed_us"))


@query("radar_values")
def _(t):
    return t.reading.select("reading_id", S.radar("waste_level", "gas_level", "temperature", "humidity").alias("r")).select("reading_id", "r.*")


@query("simulated_calendar")
def _(t):
    h = F.col("reading_id") % 4000
    dow = F.floor(h / 24) % 7
    return t.reading.select("reading_id", (h % 24).alias("hour"), dow.alias("dow"), (dow >= 5).alias("weekend"))


@query("running_longest_gap")
def _(t):
    """The longest wait between visits so far, by visit."""
    order = Window.partitionBy("node_id").orderBy("visited_at", "visit_id")
    gap = S.elapsed_h(F.lag("visited_at").over(order), "visited_at")
    rows = t.visit.withColumn("gap_h", F.coalesce(gap, F.lit(0.0)))
    return rows.select("visit_id", F.round(F.max("gap_h").over(order.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("longest_h"))


@query("stop_pairs")
def _(t):
    nxt = F.lead("stop_id").over(Window.partitionBy("tour_id").orderBy("pos"))
    return t.stop.select("tour_id", "pos", "stop_id", nxt.alias("next_id")).where("next_id IS NOT NULL")


@query("path_arrays")
def _(t):
    """Reverse, slice, insert, membership and set differences on a tour's path."""
    p, text = F.col("path"), lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    tours = t.stop.groupBy("tour_id").agg(F.array_sort(F.collect_list(F.struct("pos", "stop_id"))).alias("s")).select("tour_id", F.transform("s", lambda x: x["stop_id"]).alias("path"))
    return tours.select(
        "tour_id", text(F.reverse(p)).alias("reversed"), text(F.slice(p, 1, 2)).alias("head"), text(F.array_insert(p, 1, F.lit(0).cast("long"))).alias("inserted"),
        F.array_contains(p, F.lit(5).cast("long")).alias("has_five"), text(F.array_sort(F.array_except(p, F.slice(p, 1, 1)))).alias("others"), (F.array_sort(F.reverse(p)) == F.array_sort(p)).alias("permutation"),
    )


@query("route_stop_labels")
def _(t):
    """Stops of a route with the latest reading, or a default name and no reading."""
    tours = _greedy(t)[1].select("group_id", F.posexplode("path").alias("pos", "node_id"))
    now = R.latest(t.reading).join(t.node.select("node_id", "node_name"), "node_id").select("node_id", "node_name", "waste_level")
    rows = tours.join(now, "node_id", "left")
    return rows.select("group_id", F.col("pos").cast("long").alias("pos"), F.coalesce("node_name", F.concat(F.lit("Node "), F.col("node_id").cast("string"))).alias("name"), F.round(F.coalesce("waste_level", F.lit(0.0)), 6).alias("waste_level"))


@query("route_documents")
def _(t):
    top, tours = _greedy(t)
    steps = G.route_edges(tours, G.edges(top, keys=["group_id"]), "group_id")
    docs = IO.route_rows(tours, steps, top.select("group_id", "node_id", "priority"), "group_id", 0.5, USER, 6)
    d = F.col("route_data")
    return docs.select(
        "group_id", F.size(d["path"]).cast("long").alias("stops"), F.size(d["edges"]).cast("long").alias("edges"), F.round(F.aggregate(d["edges"], F.lit(0.0), lambda a, e: a + e["w"]), 3).alias("edge_sum"),
        F.round(F.element_at(F.map_values(F.map_filter(d["priority_scores"], lambda k, v: k == F.get(d["path"], 0))), 1), 6).alias("first_priority"), d["user_location"]["lat"].alias("lat"), *r4("total_cost"),
    )


@query("prediction_documents")
def _(t):
    rows = R.latest(t.reading).withColumn("score", S.state_priority())
    docs = IO.prediction_rows(rows, "score", "rule-1", ["waste_level", "gas_level"])
    return docs.select("node_id", F.round(F.try_element_at("features", F.lit("gas_level")), 6).alias("gas"), F.coalesce(F.try_element_at("features", F.lit("none")), F.lit(-1.0)).alias("missing"), *r6("predicted_cost"), "model_version")


@query("rule_without_models")
def _(t):
    """The dispatcher's fallback: the rule on the state alone, 0 without a reading."""
    rule = R.latest(t.reading).select("node_id", S.priority(STATE_FEATURES).alias("p"))
    return t.node.join(rule, "node_id", "left").select("node_id", F.round(F.coalesce("p", F.lit(0.0)), 6).alias("priority"))


@query("refined_tour_gain")
def _(t):
    from ..operators import routing

    top = _top_in_group(t, 8).select(F.col("group_id").alias("route_id"), "node_id", "latitude", "longitude", "priority", "traffic_density", F.lit(DEPOT[0]).alias("user_lat"), F.lit(DEPOT[1]).alias("user_lng"))
    plain, better = routing.optimal_route(top, refine=False), routing.optimal_route(top)
    return plain.select("route_id", F.col("distance_m").alias("before_m")).join(better.select("route_id", F.col("distance_m").alias("after_m")), "route_id")


@query("generated_points")
def _(t):
    return generate.points(t.spark, 30)


@query("generated_payloads")
def _(t):
    return generate.payloads(t.spark.range(100))


@query("dispatched_priorities")
def _(t):
    from ..operators import ml

    return ml.dispatch(t.node, t.reading, *USER, forest=ml.train_forest(ml.forest_rows(t.node, t.reading, *USER)))


@query("hazard_forest_balanced")
def _(t):
    from ..operators import ml

    rows = ml.forward_rows(t.reading)
    out = ml.balanced_forest(rows.where("is_train")).transform(rows.where("NOT is_train"))
    return out.groupBy("hazard", F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("rows"))


@query("group_fold_errors")
def _(t):
    from ..operators import ml

    return ml.group_folds(ml.forward_rows(t.reading))


@query("feature_importance")
def _(t):
    """Permutation importances of the boosted trees on the rows held out, five repeats."""
    from ..operators import ml

    rows = ml.forward_rows(t.reading)
    model = ml.boosted(8).fit(rows.where("is_train"))
    return ml.permutation_importance(model, rows.where("NOT is_train"), ml.FORWARD, "time_to_overflow")


@query("stream_sessions")
def _(t):
    from ..streaming import telemetry
    from .catalogue import _once, _stream

    return _once(t, telemetry.sessions(_stream(t), "12 hours"), "append").select("node_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")

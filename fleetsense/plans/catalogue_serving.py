"""Queries on serving and storing: routes to targets, files written and read again, streams that ingest, models that are kept and served."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.config import USER
from ..operators import dashboard as D
from ..operators import readings as R
from ..sources import generate
from ..sources import io as IO
from ..sources.shared import fresh_path, stored
from .catalogue import _greedy, _once, _payload, _stream, _top_in_group, query, r4, r6


def _targeted(t):
    """Each group's top nodes as a request: from the most urgent one to those of an even id."""
    top = _top_in_group(t)
    return top.select(F.col("group_id").alias("route_id"), "node_id", "latitude", "longitude", "priority", "traffic_density", (F.col("rank") == 1).alias("source"), (F.col("node_id") % 2 == 0).alias("target"))


@query("target_routes")
def _(t):
    from ..operators import routing

    rows = routing.target_routes(_targeted(t))
    return rows.select("route_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), *r4("total_cost"))


@query("distance_tree")
def _(t):
    from ..operators import routing

    return routing.distance_tree(_targeted(t)).select("route_id", "node_id", *r4("dist"))


@query("route_users")
def _(t):
    routes = _greedy(t)[1].select("group_id", F.size("path").cast("long").alias("stops"), F.when(F.col("group_id") % 4 != 3, F.col("group_id") + 1).alias("user_id"))
    users = t.raw("supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("user_name"))
    return IO.route_documents(routes, users).select("group_id", "user_id", "user_name", "stops")


@query("location_errors")
def _(t):
    i = F.col("node_id")
    places = t.node.select("node_id", F.when(i % 7 != 0, F.when(i % 11 == 0, F.lit(95.0)).otherwise(F.col("latitude"))).alias("latitude"), F.when(i % 5 != 0, F.when(i % 17 == 0, F.lit(-181.0)).otherwise(F.col("longitude"))).alias("longitude"))
    return D.location_errors(places)


@query("relocate_or_create")
def _(t):
    i = F.col("node_id")
    moves = t.node.where("node_id % 10 = 5").select(F.when(i % 3 == 0, F.concat(F.lit("Gone "), i.cast("string"))).otherwise(F.col("node_name")).alias("old_name"), F.concat(F.lit("Moved "), F.lpad(i.cast("string"), 9, "0")).alias("new_name"), F.lit(23.5).alias("latitude"), F.lit(90.5).alias("longitude"))
    return D.relocate_or_create(t.node, moves, "Customer#00000001").select("node_id", "node_name", *r6("latitude", "longitude"))


@query("mark_one_read")
def _(t):
    first = F.broadcast(t.notification.where("NOT is_read").agg(F.min("notification_id").alias("first")))  # one row
    return D.mark_read(t.notification.crossJoin(first), F.col("notification_id") == F.col("first")).groupBy("is_read").agg(F.count("*").alias("rows"))


@query("all_nodes_ranked")
def _(t):
    """A top-N of 0 or less asks for all nodes."""
    return R.top_nodes(R.scored_nodes(t.node, t.reading, *USER), 0).select("node_id", *r6("priority"))


# Files


@query("csv_readings")
def _(t):
    path = fresh_path(t.spark, "csv")
    t.reading.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("TS"), F.col("node_id").alias("Device"), F.col("temperature").alias("temp"), F.col("humidity").alias("hum"), F.col("gas_level").alias("lpg")).write.option("header", True).csv(path)
    rows = IO.read_telemetry_csv(t.spark, path)
    return rows.select("node", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "temperature", "humidity", *r6("gas_level"))


@query("fixture_nodes")
def _(t):
    path = fresh_path(t.spark, "fixture")
    node = t.node.select(F.lit("app.node").alias("model"), F.col("node_id").alias("pk"), F.struct(F.col("node_name").alias("name"), "latitude").alias("fields"))
    group = t.bin_group.select(F.lit("app.group").alias("model"), F.col("group_id").alias("pk"), F.struct(F.col("group_name").alias("name"), F.lit(None).cast("double").alias("latitude")).alias("fields"))
    node.unionByName(group).write.json(path)
    return IO.read_fixture(t.spark, path, "app.node", multi_line=False).select("pk", "name", *r6("latitude"))


@query("cached_features")
def _(t):
    path = fresh_path(t.spark, "features")
    build = lambda: R.rolling(t.reading).select("reading_id", "node_id", "waste_level_mean", "gas_level_std")
    IO.cached_features(t.spark, path, build, node="node_id")
    return IO.cached_features(t.spark, path, build, node="node_id").select("reading_id", *r6("waste_level_mean", "gas_level_std"))


@query("json_result")
def _(t):
    return IO.json_result(D.status_by_group(t.node, t.bin_group, t.reading), fresh_path(t.spark, "json"))


@query("demo_rows")
def _(t):
    """Static rows to show where there are no tables."""
    rows = [(1, "North gate", 0.91, "critical"), (2, "Market", 0.70, "warning"), (3, "Harbour", 0.12, "normal")]
    return t.spark.createDataFrame(rows, "node_id long, node_name string, waste_level double, status string")


@query("generated_telemetry")
def _(t):
    return generate.telemetry(t.node.select("node_id"))


# Streams


@query("stream_ingest")
def _(t):
    """JSON bodies as they arrive become readings; the server's time is theirs."""
    from ..streaming import telemetry

    body = stored(_payload(t), "bodies")
    arriving = t.spark.readStream.schema(body.schema).parquet(body.inputFiles()[0].rsplit("/", 1)[0])
    rows = _once(t, telemetry.ingest(arriving, t.node), "append").where("timestamp IS NOT NULL")
    return rows.select("reading_id", "node_id", *r6("temperature", "humidity", "gas_level", "waste_level", "traffic_density"))


@query("stream_fill_machine")
def _(t):
    from ..streaming import telemetry

    return _once(t, telemetry.fill_machine(_stream(t)), "update").select("node_id", *r6("fill"), "emptied")


@query("stream_sliding_windows")
def _(t):
    from ..streaming import telemetry

    rows = _once(t, telemetry.windows(_stream(t), "1 day", "6 hours"), "append")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", *r6("mean_waste", "max_waste"))


# Models


def _forward(t, iterations: int = 8):
    from ..operators import ml

    rows = ml.forward_rows(t.reading)
    return rows, ml.train_forward(rows, iterations=iterations)


@query("model_store")
def _(t):
    """A forward model saved, loaded and served: how far its risks are from those of the model at hand, and what its metadata says."""
    from ..operators import ml

    rows, model = _forward(t, 3)
    path = fresh_path(t.spark, "model")
    model.save(path)
    again = ml.Forward.load(path)
    test = rows.where("NOT is_train")
    both = model.transform(test).select("reading_id", F.col("risk").alias("a")).join(again.transform(test).select("reading_id", F.col("risk").alias("b")), "reading_id")
    m = again.meta
    return both.agg(F.count("*").alias("rows"), F.max(F.abs(F.col("a") - F.col("b"))).alias("largest_difference")).select(
        "rows", "largest_difference", F.lit(m["n_train"]).cast("long").alias("n_train"), F.lit(m["hazard_share"]).alias("hazard_share"), F.lit(m["importances"][0][0]).alias("first_feature")
    )


@query("forest_importances")
def _(t):
    """Impurity importances of the urgency forest."""
    from ..operators import ml

    model = ml.train_forest(ml.forest_rows(t.node, t.reading, *USER), trees=100, depth=10)
    return t.spark.createDataFrame(ml.importances(model, ml.FOREST), "feature string, importance double")


@query("rf_serving_scores")
def _(t):
    """The forest on what serving knows: means are the current values, deviations 0."""
    from ..operators import ml

    model = ml.train_forest(ml.forest_rows(t.node, t.reading, *USER), trees=100, depth=10)
    return ml.forest_scores(model, ml.forest_rows(t.node, t.reading, *USER, simplified=True), S.weighted_target("distance_m", *R.METRICS))


@query("dispatched_forward")
def _(t):
    """Priorities of all nodes by the forward model's risk, by the rule where it has none."""
    from ..operators import ml

    return ml.dispatch(t.node, t.reading, *USER, forward=_forward(t)[1])


@query("predicted_costs")
def _(t):
    """The forest's prediction for every node with a reading, stored with its features."""
    from ..operators import ml

    rows = ml.forest_rows(t.node, t.reading, *USER)
    model = ml.train_forest(rows, trees=100, depth=10)
    scored = ml.forest_scores(model, rows, S.weighted_target("distance_m", *R.METRICS)).join(rows, "node_id")
    return stored(IO.prediction_rows(scored, "score", "forest-1", ml.FOREST), "predictions").select("node_id", F.size("features").alias("n_features"), "predicted_cost", "model_version")


@query("inference_latency")
def _(t):
    from ..operators import ml

    rows = ml.forward_rows(t.reading)
    return ml.latency(ml.boosted(8).fit(rows.where("is_train")), rows)

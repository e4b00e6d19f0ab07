"""Weighted graphs, folds for small greedy tours, shortest paths and tour measures, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def edges(nodes: DataFrame, alpha: float = 0.5, keys=()) -> DataFrame:
    """u, v, distance_m, cost of all ordered pairs of different nodes, within each key.

    The pairs are as many as the square of a key's nodes: give it the top nodes
    of a request or of a group, not a whole network.
    """
    a = nodes.select(*keys, F.col("node_id").alias("u"), F.col("latitude").alias("ulat"), F.col("longitude").alias("ulng"))
    b = nodes.select(*keys, F.col("node_id").alias("v"), F.col("latitude").alias("vlat"), F.col("longitude").alias("vlng"), "priority", "traffic_density")
    both = a.join(b, [*keys]) .where("u <> v") if keys else a.join(b, a.u != b.v)
    both = both.withColumn("distance_m", S.haversine_m("ulat", "ulng", "vlat", "vlng"))
    return both.select(*keys, "u", "v", "distance_m", S.edge_cost("distance_m", "priority", "traffic_density", alpha).alias("cost"), S.edge_cost("distance_m", "priority", None, alpha, clip_priority=False).alias("cost_plain"))


def greedy(nodes: DataFrame, key: str, depot: tuple[float, float], alpha: float = 0.0) -> DataFrame:
    """key, path, cost: from the depot always to the node of least direct cost, ties to the smaller id. A fold, no Python."""
    lists = nodes.groupBy(key).agg(F.collect_list(F.struct(F.col("node_id").alias("id"), F.coalesce("latitude", F.lit(0.0)).alias("lat"), F.coalesce("longitude", F.lit(0.0)).alias("lng"), F.coalesce("priority", F.lit(0.0)).alias("p"))).alias("stops"))
    lists = lists.withColumn("stops", F.array_sort("stops"))
    rest_type = "array<struct<id:bigint,lat:double,lng:double,p:double>>"
    start = F.struct(F.array().cast("array<bigint>").alias("path"), F.lit(depot[0]).alias("lat"), F.lit(depot[1]).alias("lng"), F.lit(0.0).alias("cost"), F.col("stops").cast(rest_type).alias("rest"))

    def step(acc: Column, _: Column) -> Column:
        costs = F.transform(acc["rest"], lambda x: F.struct((S.haversine_m(acc["lat"], acc["lng"], x["lat"], x["lng"]) / (1 + 10 * alpha * x["p"])).alias("cost"), x["id"].alias("id"), x["lat"].alias("lat"), x["lng"].alias("lng")))
        move = lambda best: F.struct(
            F.array_append(acc["path"], best["id"]).alias("path"), best["lat"].alias("lat"), best["lng"].alias("lng"), (acc["cost"] + best["cost"]).alias("cost"),
            F.filter(acc["rest"], lambda x: x["id"] != best["id"]).alias("rest"),
        )
        return F.get(F.transform(F.array(F.array_min(costs)), move), 0)  # the best is found once

    return lists.select(key, F.aggregate("stops", start, step, lambda a: F.struct(a["path"].alias("path"), a["cost"].alias("cost"))).alias("r")).select(key, "r.path", "r.cost")


def steps(tours: DataFrame, key: str) -> DataFrame:
    """key, pos, node_id, next_id of each tour's path."""
    rows = tours.select(key, F.posexplode("path").alias("pos", "node_id"))
    return rows.withColumn("next_id", F.lead("node_id").over(Window.partitionBy(key).orderBy("pos")))


def route_edges(tours: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """key, pos, u, v, w for consecutive stops; 0 where the graph has no such edge. The way to the first stop is left out."""
    s = steps(tours, key).where("next_id IS NOT NULL").select(key, "pos", F.col("node_id").alias("u"), F.col("next_id").alias("v"))
    return s.join(weights.select(key, "u", "v", F.col("cost").alias("w")), [key, "u", "v"], "left").select(key, "pos", "u", "v", F.coalesce("w", F.lit(0.0)).alias("w"))


def legs(stops: DataFrame, key: str = "tour_id", order: str = "pos", depot: tuple[float, float] | None = None) -> DataFrame:
    """stops with leg_m, the metres from the stop before (from the depot for the first, 0 without one), and last, whether it is the last."""
    w = Window.partitionBy(key).orderBy(order)
    first = [F.lit(depot[0]), F.lit(depot[1])] if depot else [F.col("latitude"), F.col("longitude")]
    lat, lng = F.coalesce(F.lag("latitude").over(w), first[0]), F.coalesce(F.lag("longitude").over(w), first[1])
    return stops.withColumn("leg_m", S.haversine_m(lat, lng, "latitude", "longitude")).withColumn("last", F.lead(order).over(w).isNull())


def tour_length(stops: DataFrame, depot: tuple[float, float], key: str = "tour_id", order: str = "pos") -> DataFrame:
    """key, stops, distance_m of the closed tours through the depot."""
    back = F.when(F.col("last"), S.haversine_m("latitude", "longitude", F.lit(depot[0]), F.lit(depot[1]))).otherwise(0.0)
    return legs(stops, key, order, depot).groupBy(key).agg(F.count("*").alias("stops"), F.sum(F.col("leg_m") + back).alias("distance_m"))


def arrivals(stops: DataFrame, depot: tuple[float, float], key: str = "tour_id", order: str = "pos") -> DataFrame:
    """stops with arrival_h at the fleet's speed."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return legs(stops, key, order, depot).withColumn("arrival_h", S.travel_h(F.sum("leg_m").over(w) / 1000.0))


def tour_metrics(stops: DataFrame, depot: tuple[float, float], key: str = "tour_id", order: str = "pos") -> DataFrame:
    """Measures of each tour; stops carry critical and time_to_overflow. Without critical stops their times are 0."""
    rows = arrivals(stops, depot, key, order)
    back = F.when(F.col("last"), S.haversine_m("latitude", "longitude", F.lit(depot[0]), F.lit(depot[1]))).otherwise(0.0)
    km = F.sum(F.col("leg_m") + back) / 1000.0
    at = F.when(F.col("critical"), F.col("arrival_h"))
    return rows.groupBy(key).agg(
        F.round(km, 3).alias("distance_km"), F.round(S.co2_kg(km), 3).alias("co2_kg"), F.count("*").alias("n_visited"), F.count_if("critical").alias("n_critical_served"),
        F.round(F.coalesce(F.avg(at), F.lit(0.0)), 3).alias("mean_time_to_critical_h"), F.round(F.coalesce(F.max(at), F.lit(0.0)), 3).alias("worst_time_to_critical_h"),
        F.count_if(F.col("critical") & (F.col("arrival_h") > F.col("time_to_overflow"))).alias("missed_overflow"),
    )


def shortest_paths(weights: DataFrame, sources: DataFrame, max_turns: int = 1000, store=None) -> DataFrame:
    """source, node, dist, path: least cost from each source (a column node), by relaxation joined with the edges.

    Each turn relaxes only what the last one improved and ends when nothing does.
    store writes a turn's table and reads it again (a checkpoint by default).
    """
    store = store or (lambda df: df.checkpoint())
    done = store(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"), F.array(F.col("node")).alias("path")))
    front = done
    for _ in range(max_turns):
        tried = front.join(weights, front.node == weights.u).select("source", F.col("v").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"), F.array_append("path", F.col("v")).alias("path"))
        best = tried.groupBy("source", "node").agg(F.min(F.struct("dist", "path")).alias("b")).select("source", "node", "b.*")
        old = done.select("source", "node", F.col("dist").alias("old"))
        front = store(best.join(old, ["source", "node"], "left").where("old IS NULL OR dist < old").drop("old"))
        if front.isEmpty():
            break
        done = store(done.join(front.select("source", "node"), ["source", "node"], "left_anti").unionByName(front))
    return done

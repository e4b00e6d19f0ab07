"""The library's scores as SQL functions of built-in expressions, and tours as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .config import EARTH_M

_CLIP = "greatest(0D, least(1D, {}))"
FUNCTIONS = {
    "haversine_m": (
        "lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE",
        f"2D * {EARTH_M} * asin(sqrt(pow(sin(radians(coalesce(lat2, 0D) - coalesce(lat1, 0D)) / 2D), 2D) + cos(radians(coalesce(lat1, 0D))) * cos(radians(coalesce(lat2, 0D))) * pow(sin(radians(coalesce(lng2, 0D) - coalesce(lng1, 0D)) / 2D), 2D)))",
    ),
    "edge_cost": (
        "metres DOUBLE, priority DOUBLE, traffic DOUBLE, alpha DOUBLE",
        f"metres * (1D + {_CLIP.format('coalesce(traffic, 0D)')} * 3D) / (1D + 10D * alpha * {_CLIP.format('coalesce(priority, 0D)')})",
    ),
    "fill_status": ("waste DOUBLE", "CASE WHEN waste >= 0.85D THEN 'critical' WHEN waste >= 0.65D THEN 'warning' ELSE 'normal' END"),
}


@udtf(returnType="route_id bigint, path array<bigint>, total_cost double, distance_m double")
class Route:
    """One request's tour: SELECT * FROM route(TABLE(requests) PARTITION BY route_id). A request's nodes are one partition, bounded by its top N."""

    def __init__(self):
        self.rows = []

    def eval(self, row):
        self.rows.append((row["route_id"], row["node_id"], row["latitude"], row["longitude"], row["priority"], row["traffic_density"], row["user_lat"], row["user_lng"]))

    def terminate(self):
        import pandas as pd

        from fleetsense.operators import routing

        if self.rows:
            g = pd.DataFrame(self.rows, columns=["route_id", "node_id", "latitude", "longitude", "priority", "traffic_density", "user_lat", "user_lng"])
            for r in routing.one_route(g).itertuples(index=False):
                yield int(r.route_id), [int(v) for v in r.path], float(r.total_cost), float(r.distance_m)


def register(spark: SparkSession) -> None:
    """haversine_m, edge_cost, fill_status and route for this session's SQL. The optimizer sees the first three as their expressions."""
    for name, (arguments, body) in FUNCTIONS.items():
        kind = "STRING" if name == "fill_status" else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("route", Route)

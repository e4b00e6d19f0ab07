"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_TURNS = 60


def _stars(e: DataFrame) -> bool:
    """Whether each node has one edge, and leads to one that has none."""
    if not e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return e.join(e.select(F.col("v").alias("w")).distinct(), F.col("u") == F.col("w"), "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node that has an edge (u, v); root is the least node that can be reached.

    Each step keeps what is connected and points nodes at lesser ones; edges stay
    as many or become fewer. Nodes with many edges are only met by a partial
    minimum and by a join that may be split.
    """
    e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = common.stored(e, "edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(MAX_TURNS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = common.stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if _stars(e):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Networks of any size without a matrix of all pairs: nearest neighbours, groups of bounded size, long tours, shortest paths.

* Nearest neighbours: places on the sphere lie in cubes; a place looks at the 27
  cubes around it. What is not settled there looks again at cubes of twice the edge:
  a place that is still unsettled has few others near it, so such places are few in each cube.
* Groups of bounded size: slices of a space-filling curve, each of as many nodes.
* Long tours: the curve's order, then stretches of bounded length that overlap from
  turn to turn, each improved with its ends held, by 2-opt and Or-opt over
  neighbour lists with marks for nodes that need no look.
* Shortest paths: delta-stepping over an edge table, or, where nodes have places, cells of some
  thousand nodes that are settled whole and tell one another what they found.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.config import EARTH_M
from ..sources.shared import stored
from . import spans
from .routing import spread

#: Places up to this number are one cube.
FEW = 200
#: Bits of a coordinate on the curve.
CURVE_BITS = 16
#: Light edges that a turn goes along: fewer turns, each of which is written.
HOPS = 4
#: Nodes of a stretch of a long tour, and turns.
STRETCH, TURNS = 400, 4


def _positions() -> list[Column]:
    lat, lng = F.radians("latitude"), F.radians("longitude")
    return [(F.cos(lat) * F.cos(lng) * EARTH_M).alias("x"), (F.cos(lat) * F.sin(lng) * EARTH_M).alias("y"), (F.sin(lat) * EARTH_M).alias("z")]


def _edge(places: DataFrame, n: int) -> float:
    """An edge, a power of two metres, at which a cube that is not empty holds a few places."""
    if n <= FEW:
        return 4.0 * EARTH_M
    edges = [2.0**k for k in range(24)]
    cubes = places.agg(*[F.approx_count_distinct(F.xxhash64(*[F.floor(F.col(c) / e) for c in "xyz"])).alias(f"e{i}") for i, e in enumerate(edges)]).first()
    return next((e for i, e in enumerate(edges) if n / max(1, cubes[i]) >= 3), edges[-1])


def _nearest_lists(nodes: DataFrame, k: int) -> DataFrame:
    """node_id, others: its k nearest as an array of (distance_m, node_id), as nearest() has them; a node that is alone has an empty one.

    Places are compared, each with its k + 1 least ids: nodes that share a place are as far from any other, so what is
    met grows with the places. The k + 1 nearest nodes are at the k + 1 places that come first by distance and least id.
    """
    nodes = nodes.select("node_id", "latitude", "longitude").dropna()
    first = F.row_number().over(Window.partitionBy("latitude", "longitude").orderBy("node_id"))
    few = nodes.withColumn("nth", first).where(F.col("nth") <= k + 1)
    places = few.groupBy("latitude", "longitude").agg(F.sort_array(F.collect_list("node_id")).alias("ids"))  # k + 1 at most
    places = stored(places.select(F.element_at("ids", 1).alias("place"), "ids", "latitude", "longitude", *_positions()), "places")
    n = places.count()
    edge, found = _edge(places, n), None
    left = places.select("place", F.col("latitude").alias("lat"), F.col("longitude").alias("lng"), "x", "y", "z")
    while True:
        all_ = edge >= 2 * EARTH_M
        cube = lambda c, e=edge: F.floor(F.col(c) / e)
        near = lambda c: F.explode(F.sequence(cube(c) - 1, cube(c) + 1)).alias(f"c{c}")
        asks = left
        for c in "xyz":
            asks = asks.select("*", near(c))
        there = places.select(F.col("place").alias("least"), "ids", "latitude", "longitude", *[cube(c).alias(f"c{c}") for c in "xyz"])
        met = asks.join(there, ["cx", "cy", "cz"]).select("place", "least", "ids", F.round(S.haversine_m("lat", "lng", "latitude", "longitude"), 3).alias("distance_m"))
        best = met.withColumn("r", F.row_number().over(Window.partitionBy("place").orderBy("distance_m", "least"))).where(F.col("r") <= k + 1)
        lists = best.groupBy("place").agg(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("distance_m"), i.alias("node_id")))).alias("near"))  # (k + 1)^2 nodes at most
        lists = lists.select("place", F.slice(F.sort_array(F.flatten("near")), 1, k + 1).alias("near"))
        # Within an edge's length nothing is missed. A chord is shorter than its arc.
        sure = (F.size("near") == k + 1) & (F.element_at("near", -1)["distance_m"] < edge - 0.01)
        lists = stored(lists.withColumn("sure", F.lit(True) if all_ else sure), "near")
        done = lists.where("sure").select("place", "near")
        found = done if found is None else found.unionByName(done)
        left = left.join(lists.where("not sure").select("place"), "place", "left_semi")
        if all_ or left.isEmpty():
            break
        left = stored(left, "unsettled")
        edge = edge * 2 if edge < 1 << 20 else 4.0 * EARTH_M
    of = nodes.join(places.select("place", "latitude", "longitude"), ["latitude", "longitude"]).join(found, "place")
    return of.select("node_id", F.slice(F.filter("near", lambda x: x["node_id"] != F.col("node_id")), 1, k).alias("others"))


def nearest(nodes: DataFrame, k: int = 8) -> DataFrame:
    """node_id, rank, neighbour, distance_m: the k nearest other nodes (all, if fewer), nearest first, ties (to a millimetre) to the lesser id.

    nodes: node_id, latitude, longitude. A node without coordinates is left out. Of nodes at one place only the k + 1
    least ids can be among another's nearest, so a place that very many nodes share costs no more than that.
    """
    rows = _nearest_lists(nodes, k).select("node_id", F.posexplode("others").alias("at", "o"))
    return rows.select("node_id", (F.col("at") + 1).alias("rank"), F.col("o.node_id").alias("neighbour"), F.col("o.distance_m").alias("distance_m"))


def along_curve(lat: Column, lng: Column) -> Column:
    """Place on a Hilbert curve over all latitudes and longitudes (scaled alike, so near places have near numbers)."""
    cell = lambda v, low, span: F.least(F.lit((1 << CURVE_BITS) - 1), F.floor((v - low) / span * (1 << CURVE_BITS))).cast("long")
    bits = CURVE_BITS

    @F.pandas_udf("long")
    def place(x: pd.Series, y: pd.Series) -> pd.Series:
        x, y = x.to_numpy(np.int64), y.to_numpy(np.int64)
        d = np.zeros(len(x), np.int64)
        for k in reversed(range(bits)):
            side = 1 << k
            rx, ry = x >> k & 1, y >> k & 1
            d += side * side * (rx * 3 ^ ry)
            x, y = x & (side - 1), y & (side - 1)
            flip = np.where(rx == 1, side - 1, 0)
            x, y = np.where(ry == 0, y ^ flip, x), np.where(ry == 0, x ^ flip, y)  # side - 1 - v is v with its bits turned
        return pd.Series(d)

    return place(cell(lng, -180.0, 360.0), cell(lat, -180.0, 360.0))


def _within(nodes: DataFrame, keys) -> tuple[DataFrame, Column, Column]:
    """Nodes with their coordinates' range over each key, and both coordinates stretched over the curve's square."""
    nodes = nodes.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    box = nodes.groupBy(*keys).agg(F.min("latitude").alias("_s"), F.min("longitude").alias("_w"), F.greatest(F.max("latitude") - F.min("latitude"), F.max("longitude") - F.min("longitude"), F.lit(1e-9)).alias("_span"))
    rows = nodes.join(box, [*keys]) if keys else nodes.crossJoin(F.broadcast(box))  # one row
    stretch = lambda c, low: (F.col(c) - F.col(low)) / F.col("_span") * 359.99 - 180.0
    return rows, stretch("latitude", "_s"), stretch("longitude", "_w")


def in_curve_order(nodes: DataFrame, keys=(), count: str | None = None) -> DataFrame:
    """nodes that have coordinates, with their place `nth` (from 0) along the curve within their key."""
    rows, lat, lng = _within(nodes, keys)
    rows = rows.withColumn("_curve", along_curve(lat, lng)).drop("_s", "_w", "_span")
    return spans.placed(rows, [*keys], ["_curve", "node_id"], "nth", count).drop("_curve")


def clusters(nodes: DataFrame, size: int, keys=()) -> DataFrame:
    """node_id, keys, cluster for nodes that have coordinates: as many clusters of a key as it needs, none of more than `size` nodes, sizes as even as can be."""
    rows = in_curve_order(nodes.select("node_id", *keys, "latitude", "longitude"), keys, "n_of_key")
    parts = F.ceil(F.col("n_of_key") / size)
    return rows.select("node_id", *keys, F.floor(F.col("nth") * parts / F.col("n_of_key")).cast("long").alias("cluster"))


def improved(points: np.ndarray, near: list[list[int]], eps: float = 1e-7) -> list[int]:
    """An order of points (3 columns) in their given order at first, ends held: 2-opt and Or-opt over each point's neighbours until nothing gets shorter."""
    n = len(points)
    t, pos = list(range(n)), list(range(n))
    p = [tuple(x) for x in points.tolist()]
    dist = math.dist
    near = [[(dist(p[a], p[c]), c) for c in near[a]] for a in range(n)]

    def put(i: int, piece: list[int]) -> None:
        t[i : i + len(piece)] = piece
        for j, v in enumerate(piece, i):
            pos[v] = j

    def two(a: int) -> list[int]:
        """The nodes whose ways changed, if turning a stretch round helps a."""
        i = pos[a]
        for after in (True, False):
            if after and i == n - 1 or not after and i == 0:
                continue
            b = t[i + 1] if after else t[i - 1]
            ab = dist(p[a], p[b])
            for ac, c in near[a]:
                if ac >= ab:
                    break
                j = pos[c]
                if after and j == n - 1 or not after and j == 0:
                    continue
                e = t[j + 1] if after else t[j - 1]
                if ac + dist(p[b], p[e]) - ab - dist(p[c], p[e]) < -eps:
                    lo, hi = (min(i, j) + 1, max(i, j)) if after else (min(i, j), max(i, j) - 1)
                    if lo == 0 or hi == n - 1:
                        continue
                    put(lo, t[lo : hi + 1][::-1])
                    return [a, b, c, e]
        return []

    def move(a: int) -> list[int]:
        """The same, if putting a stretch that begins or ends with a next to one of its neighbours helps."""
        i = pos[a]
        for size in (1, 2, 3):
            for lo in {i, i - size + 1}:
                hi = lo + size - 1
                if lo < 1 or hi > n - 2:
                    continue
                before, behind, first, last = t[lo - 1], t[hi + 1], t[lo], t[hi]
                saved = dist(p[before], p[first]) + dist(p[last], p[behind]) - dist(p[before], p[behind])
                if saved <= eps:
                    continue
                other = last if a == first else first
                for ac, c in near[a]:
                    if ac >= saved:
                        break
                    j = pos[c]
                    if lo <= j <= hi:
                        continue
                    for g in (j, j - 1):  # the gap after place g
                        if g < 0 or g >= n - 1 or lo - 1 <= g <= hi:
                            continue
                        e = t[g + 1] if g == j else t[g]
                        if ac + dist(p[other], p[e]) - dist(p[c], p[e]) - saved < -eps:
                            piece = t[lo : hi + 1]
                            if (a == first) != (g == j):  # a stands next to c
                                piece.reverse()
                            if g > hi:
                                put(lo, t[hi + 1 : g + 1] + piece)
                            else:
                                put(g + 1, piece + t[g + 1 : lo])
                            return [before, behind, first, last, c, e]
        return []

    wait, marked = list(range(n)), [True] * n
    while wait:
        a = wait.pop()
        marked[a] = False
        while changed := two(a) or move(a):
            for v in changed:
                if not marked[v] and v != a:
                    marked[v] = True
                    wait.append(v)
    return t


def long_tour(nodes: DataFrame, depot: tuple[float, float], keys=(), k: int = 8, stretch: int = STRETCH, turns: int = TURNS) -> DataFrame:
    """keys, pos (from 1), node_id: a tour from the depot through all nodes of each key and back.

    No task holds more than `stretch` nodes. Nodes without coordinates are on no tour. Neighbours of other keys are not looked at.
    """
    if stretch < 8:
        raise ValueError("a stretch has eight nodes at least")
    lists = _nearest_lists(nodes, k).select("node_id", F.transform("others", lambda x: x["node_id"]).alias("near"))  # k at most
    lists = lists.groupBy("node_id").agg(F.min("near").alias("near"))  # one, even if an id is repeated
    rows = in_curve_order(nodes.select("node_id", *keys, "latitude", "longitude"), keys, "n_of_key").join(lists, "node_id", "left")
    ends = rows.groupBy(*keys).agg(F.max("n_of_key").alias("n")) if keys else rows.agg(F.max("n_of_key").alias("n")).where("n IS NOT NULL")
    ends = ends.select(*keys, F.inline(F.array(F.struct(F.lit(0).cast("long").alias("pos")), F.struct((F.col("n") + 1).alias("pos")))))
    rows = rows.select(*keys, (F.col("nth") + 1).cast("long").alias("pos"), "node_id", "latitude", "longitude", F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))
    ends = ends.select(*keys, "pos", F.lit(None).cast("long").alias("node_id"), F.lit(depot[0]).alias("latitude"), F.lit(depot[1]).alias("longitude"), F.array().cast("array<bigint>").alias("near"))
    rows = stored(rows.unionByName(ends), "tour")
    names = [*keys, "pos", "node_id", "latitude", "longitude", "near"]
    schema = rows.select(*names).schema

    def refine(g):
        import pyarrow as pa

        g = g.select(names).combine_chunks().sort_by("pos")
        if g.num_rows < 4:
            return g
        place = {v: i for i, v in enumerate(g["node_id"].to_pylist()) if v is not None}
        lat, lng = np.radians(g["latitude"].to_numpy()), np.radians(g["longitude"].to_numpy())
        points = np.column_stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)]) * EARTH_M
        order = improved(points, [[place[v] for v in x if v in place] for x in g["near"].to_pylist()])
        return g.take(pa.array(order)).set_column(names.index("pos"), g.schema.field("pos"), g["pos"])

    for turn in range(turns):
        offset = (turn % 2) * (stretch // 2)
        of = F.floor((F.col("pos") + offset) / stretch)
        rows = stored(rows.withColumn("_of", of).groupBy(*keys, "_of").applyInArrow(refine, schema), "tour")
    return rows.where("node_id IS NOT NULL").select(*keys, "pos", "node_id")


def neighbour_edges(near: DataFrame) -> DataFrame:
    """u, v, w of the ways between each node and its nearest, in both directions."""
    one = near.select(F.col("node_id").alias("u"), F.col("neighbour").alias("v"), F.col("distance_m").alias("w"))
    return one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.min("w").alias("w"))


def delta_stepping(edges: DataFrame, sources: DataFrame, delta: float, every: int = 4) -> DataFrame:
    """source, node, dist: least costs from each source (a column node) over edges (u, v, w; w not negative).

    Costs lie in buckets of `delta`. The least bucket that holds unsettled nodes is
    relaxed over light edges (w <= delta), HOPS of them in a turn, until it gives nothing more for itself,
    then once over heavy ones. A turn sends the edges of its frontier only. What turns find is appended;
    of a node's costs the least counts, and the parts are put together every few turns.
    """
    edges = stored(edges.withColumn("light", F.col("w") <= delta), "edges")
    known = stored(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist")).distinct(), "costs")
    open_, parts, turn = known, 1, 0
    while True:
        low = open_.agg(F.min("dist")).first()[0]
        if low is None:
            return known.groupBy("source", "node").agg(F.min("dist").alias("dist"))
        top = (math.floor(low / delta) + 1) * delta
        settled, front = None, open_.where(F.col("dist") < top)
        rest = open_.where(F.col("dist") >= top)
        while True:
            settled = front if settled is None else settled.unionByName(front)
            new = stored(_relaxed(front, edges.where("light"), known, HOPS), "costs")
            if new.isEmpty():
                break
            known, rest, parts = known.unionByName(new), rest.unionByName(new.where(F.col("dist") >= top)), parts + 1
            front = new.where(F.col("dist") < top)
            turn += 1
            if parts >= every:
                known, parts = stored(known.groupBy("source", "node").agg(F.min("dist").alias("dist")), "costs"), 1
        new = stored(_relaxed(settled.groupBy("source", "node").agg(F.min("dist").alias("dist")), edges.where("not light"), known), "costs")
        known = stored(known.unionByName(new).groupBy("source", "node").agg(F.min("dist").alias("dist")), "costs")
        parts = 1
        # Unsettled: what was found at or beyond this bucket's end and has not got better since.
        open_ = stored(rest.unionByName(new).groupBy("source", "node").agg(F.min("dist").alias("dist")).join(known, ["source", "node", "dist"], "left_semi").where(F.col("dist") >= top), "open")


def _relaxed(front: DataFrame, edges: DataFrame, known: DataFrame, hops: int = 1) -> DataFrame:
    """source, node, dist of what a frontier reaches by so many edges at less than is known."""
    tried = front.select("source", "node", "dist")
    for _ in range(hops):
        step = tried.join(edges, tried.node == edges.u).select("source", F.col("v").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))
        tried = tried.unionByName(step).groupBy("source", "node").agg(F.min("dist").alias("dist"))
    old = known.groupBy("source", "node").agg(F.min("dist").alias("old"))
    return tried.join(old, ["source", "node"], "left").where("old IS NULL OR dist < old").drop("old")


def _settled(dist: np.ndarray, changed: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
    """dist [nodes, sources]: costs go along edges (sorted by u) from the changed nodes until nothing gets less."""
    first = np.searchsorted(u, np.arange(len(dist) + 1))
    while len(changed):
        n = first[changed + 1] - first[changed]
        at = np.arange(int(n.sum())) + np.repeat(first[changed] - (np.cumsum(n) - n), n)
        to, cost = v[at], dist[u[at]] + w[at, None]
        better = (cost < dist[to]).any(1)
        to, cost = to[better], cost[better]
        order = np.argsort(to, kind="stable")
        to, cost = to[order], cost[order]
        changed, start = np.unique(to, return_index=True)
        if len(changed):
            dist[changed] = np.minimum(dist[changed], np.minimum.reduceat(cost, start, axis=0))


def cell_paths(edges: DataFrame, sources: DataFrame, cells: DataFrame) -> DataFrame:
    """source, node, dist: least costs from each source (a column node, a few rows) over edges (u, v, w; w not negative).

    cells: node_id, cell of every node that has an edge, best so that few edges lead out of a cell and none has more than some thousand nodes. A
    turn settles each cell that got lesser costs from outside, in one task, and sends on what its edges out make of them. So turns are as many as
    a shortest path has cells, not as it has nodes.
    """
    spark = edges.sparkSession
    roots = sorted(r[0] for r in sources.select("node").distinct().collect())
    n_sources = len(roots)
    of = lambda name, as_: cells.select(F.col("node_id").alias(name), F.col("cell").alias(as_))
    out = edges.join(of("u", "cell"), "u").join(of("v", "to"), "v").groupBy("cell").agg(F.collect_list(F.struct("u", "v", "w", "to")).alias("e"))  # a cell's edges
    graph = stored(spread(cells.groupBy("cell").agg(F.sort_array(F.collect_list("node_id")).alias("ids")).join(out, "cell", "left"), "cell"), "cells")
    index = F.create_map(*[x for i, r in enumerate(roots) for x in (F.lit(r), F.lit(i))]) if roots else F.lit(None)
    news = cells.where(F.col("node_id").isin(roots)).select("cell", F.col("node_id").alias("node"), index[F.col("node_id")].alias("source"), F.lit(0.0).alias("dist")) if roots else None
    lone = spark.createDataFrame([(r, r, 0.0) for r in roots], "source long, node long, dist double")
    if not roots:
        return lone

    def settle(batches):
        for batch in batches:
            for cell, ids, e, told, known in zip(batch.cell, batch.ids, batch.e, batch.told, batch.known):
                ids = np.asarray(ids, np.int64)
                dist = np.full((len(ids), n_sources), np.inf) if known is None else np.array(known, float).reshape(len(ids), n_sources)
                before = dist.copy()
                np.minimum.at(dist, (np.searchsorted(ids, [x["node"] for x in told]), [x["source"] for x in told]), [x["dist"] for x in told])
                e = [] if e is None else e
                u, v, to = (np.array([x[c] for x in e], np.int64) for c in ("u", "v", "to"))
                w, own = np.array([x["w"] for x in e], float), to == cell
                a, b, cost = np.searchsorted(ids, u[own]), np.searchsorted(ids, v[own]), w[own]
                order = np.argsort(a, kind="stable")
                _settled(dist, np.flatnonzero((dist < before).any(1)), a[order], b[order], cost[order])
                a = np.searchsorted(ids, u[~own])
                k, s = np.nonzero(dist[a] < before[a])
                sent = pd.DataFrame({"cell": to[~own][k], "node": v[~own][k], "source": s, "dist": dist[a[k], s] + w[~own][k]})
                sent = sent.groupby(["cell", "node", "source"], as_index=False)["dist"].min()
                yield pd.DataFrame({"cell": [cell], "dist": [dist.ravel()], "sent": [sent.to_dict("records")]})

    schema = "cell long, dist array<double>, sent array<struct<cell:long,node:long,source:int,dist:double>>"
    state = None
    while True:
        told = news.groupBy("cell").agg(F.collect_list(F.struct("node", "source", "dist")).alias("told"))  # edges into the cell, at most
        rows = graph.join(told, "cell")
        rows = rows.join(state.select("cell", F.col("dist").alias("known")), "cell", "left") if state is not None else rows.withColumn("known", F.lit(None).cast("array<double>"))
        done = stored(spread(rows, "cell").mapInPandas(settle, schema), "settled")
        new = done.select("cell", "dist")
        state = new if state is None else stored(state.join(done.select("cell"), "cell", "left_anti").unionByName(new), "cell_costs")
        news = done.select(F.inline("sent"))
        if news.isEmpty():
            break
    costs = state.join(graph.select("cell", "ids"), "cell").select(F.posexplode(F.arrays_zip(F.col("ids").alias("node"), F.expr(f"transform(ids, (x, i) -> slice(dist, i * {n_sources} + 1, {n_sources}))").alias("d"))))
    costs = costs.select(F.col("col.node").alias("node"), F.posexplode("col.d").alias("s", "dist")).where(F.col("dist") < math.inf)
    costs = costs.select(F.get(F.array(*[F.lit(r).cast("long") for r in roots]), F.col("s")).alias("source"), "node", "dist")
    return costs.unionByName(lone.join(costs.select("source").distinct(), "source", "left_anti"))  # a source without edges

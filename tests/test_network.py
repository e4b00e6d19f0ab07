import math
import random

import numpy as np
import pytest

from fleetsense.functions.config import EARTH_M
from fleetsense.operators import network, routing

SCHEMA = "node_id long, latitude double, longitude double"


def metres(a, b):
    la, lo, lb, mo = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((mo - lo) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(h))


def random_nodes(n, seed, spread=0.1):
    r = random.Random(seed)
    return [(k, 23.7 + r.random() * spread, 90.3 + r.random() * spread) for k in range(n)]


def awkward():
    """A dense town, far places, one place that many share, both sides of the date line, a pole, and nodes without coordinates."""
    r = random.Random(4)
    town = [(23.7 + r.random() * 0.002, 90.3 + r.random() * 0.002) for _ in range(250)]
    more = [(10.0, 10.0)] * 40 + [(0.0, 179.999), (0.0, -179.999), (0.01, 180.0), (90.0, 0.0), (89.9, 100.0), (-33.0, 151.0), (-33.001, 151.0)]
    rows = [(k, *p) for k, p in enumerate(town + more)]
    return [*rows, (9000, None, 90.0), (9001, 23.7, None)]


def brute_nearest(rows, k):
    rows = [x for x in rows if None not in x]
    out = {}
    for i, *p in rows:
        ranked = sorted((round(metres(p, q), 3), j) for j, *q in rows if j != i)[:k]
        out[i] = [j for _, j in ranked]
    return out


@pytest.mark.parametrize(("rows", "k"), [(random_nodes(700, 1), 8), (awkward(), 5), (random_nodes(4, 2), 8)])
def test_nearest(spark, monkeypatch, rows, k):
    got = {}
    for x in network.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), k).orderBy("node_id", "rank").collect():
        got.setdefault(x.node_id, []).append(x.neighbour)
        assert x.rank == len(got[x.node_id])
    assert got == brute_nearest(rows, k)


def test_nearest_compares_places_not_nodes(spark, monkeypatch):
    """Nodes that share a place are as far from any other: they are met as one row."""
    rows = [(k * 30 + i, 23.7 + i * 0.001, 90.3 + (i % 7) * 0.001) for i in range(30) for k in range(12)]
    kept, real = {}, network.stored
    monkeypatch.setattr(network, "stored", lambda df, name: kept.setdefault(name, real(df, name)))
    got = {}
    for x in network.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), 14).orderBy("node_id", "rank").collect():
        got.setdefault(x.node_id, []).append(x.neighbour)
    assert got == brute_nearest(rows, 14)
    assert kept["places"].count() == 30


def test_long_tour_of_a_repeated_id_has_each_place_once(spark):
    rows = random_nodes(60, 8)
    got = [x.pos for x in network.long_tour(spark.createDataFrame([*rows, (5, 23.75, 90.35)], SCHEMA), (23.7, 90.3)).orderBy("pos").collect()]
    assert got == list(range(1, 62))


@pytest.mark.parametrize(("n", "size"), [(1000, 64), (64, 64), (65, 64), (5, 64)])
def test_clusters_are_bounded_and_even(spark, n, size):
    df = spark.createDataFrame([*random_nodes(n, n), (10**6, None, None)], SCHEMA)
    sizes = [x["count"] for x in network.clusters(df, size).groupBy("cluster").count().collect()]
    assert sum(sizes) == n and len(sizes) == -(-n // size) and max(sizes) <= size and max(sizes) - min(sizes) <= 1


def test_clusters_of_keys(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(random_nodes(300, 3), SCHEMA).withColumn("g", F.when(F.col("node_id") < 20, 1).otherwise(0))
    sizes = {(x.g, x.cluster): x["count"] for x in network.clusters(df, 50, ("g",)).groupBy("g", "cluster").count().collect()}
    assert sum(v for (g, _), v in sizes.items() if g == 1) == 20 and len(sizes) == 1 + 6 and max(sizes.values()) <= 50


def test_curve_visits_each_cell_once(spark, monkeypatch):
    monkeypatch.setattr(network, "CURVE_BITS", 3)
    cells = [(a * 8 + b, -180 + 45 * a + 20.0, -180 + 45 * b + 20.0) for a in range(8) for b in range(8)]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(cells, SCHEMA).withColumn("d", network.along_curve(F.col("latitude"), F.col("longitude"))).orderBy("d").collect()
    assert [x.d for x in rows] == list(range(64))
    assert all(abs(p.latitude - q.latitude) + abs(p.longitude - q.longitude) == 45 for p, q in zip(rows, rows[1:]))


def length(order, where, depot):
    path = [depot, *[where[i] for i in order], depot]
    return sum(metres(p, q) for p, q in zip(path, path[1:]))


def test_long_tour_is_near_the_matrix_version(spark):
    """All nodes once, and within 5 % of greedy, 2-opt and Or-opt over the matrix, with stretches of 200 of 1000 nodes."""
    rows, depot = random_nodes(1000, 5), (23.75, 90.35)
    where = {i: p for i, *p in rows}
    order = [x.node_id for x in network.long_tour(spark.createDataFrame(rows, SCHEMA), depot, stretch=200).orderBy("pos").collect()]
    assert sorted(order) == sorted(where)
    m = routing.distances(np.array([p[1] for p in rows] + [depot[0]]), np.array([p[2] for p in rows] + [depot[1]]))
    matrix = routing.or_opt(routing.two_opt(routing.greedy(list(range(1000)), m, 1000), m, 1000), m, 1000)
    assert length(order, where, depot) <= 1.05 * length(matrix, where, depot)


def test_long_tour_of_few_is_the_best(spark):
    import itertools

    rows, depot = random_nodes(7, 8), (23.75, 90.35)
    where = {i: p for i, *p in rows}
    order = [x.node_id for x in network.long_tour(spark.createDataFrame(rows, SCHEMA), depot).orderBy("pos").collect()]
    best = min(length(o, where, depot) for o in itertools.permutations(where))
    assert sorted(order) == sorted(where) and length(order, where, depot) <= 1.08 * best
    assert network.long_tour(spark.createDataFrame([], SCHEMA), depot).count() == 0


def test_improved_never_gets_longer_and_holds_its_ends():
    r = np.random.default_rng(2)
    for n in (4, 5, 9, 60):
        points = r.random((n, 3)) * 1000
        all_ = np.linalg.norm(points[:, None] - points, axis=2)
        near = [[int(j) for j in np.argsort(all_[i]) if j != i][:8] for i in range(n)]
        t = network.improved(points, near)
        cost = lambda o: sum(all_[a, b] for a, b in zip(o, o[1:]))
        assert sorted(t) == list(range(n)) and t[0] == 0 and t[-1] == n - 1 and cost(t) <= cost(range(n)) + 1e-6


def test_delta_stepping_against_dijkstra(spark):
    import heapq

    r = random.Random(6)
    edges = [(u, v, r.choice([0.0, 1.0, 2.5, 7.0, 30.0])) for u in range(60) for v in r.sample(range(60), 3) if u != v] + [(100, 101, 1.0)]
    out = {}
    for u, v, w in edges:
        out.setdefault(u, []).append((v, w))
    want = {}
    for s in (0, 7, 100, 999):
        dist, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            for v, w in out.get(u, []):
                if d + w < dist.get(v, math.inf):
                    dist[v] = d + w
                    heapq.heappush(heap, (d + w, v))
        want |= {(s, v): round(d, 6) for v, d in dist.items()}
    e = spark.createDataFrame(edges, "u long, v long, w double")
    src = spark.createDataFrame([(0,), (7,), (100,), (999,)], "node long")
    for delta in (3.0, 100.0):
        got = {(x.source, x.node): round(x.dist, 6) for x in network.delta_stepping(e, src, delta).collect()}
        assert got == want


def test_cell_paths_are_those_of_delta_stepping(spark, monkeypatch):
    """Many small cells, ways that leave a cell and come back, no way at all, and a source without edges; in few turns."""
    r = random.Random(6)
    edges = [(u, v, r.choice([0.0, 1.0, 2.5, 7.0, 30.0])) for u in range(60) for v in r.sample(range(60), 3) if u != v] + [(100, 101, 1.0)]
    chain = [(k, k + 1, 1.0) for k in range(200, 1000)]
    e = spark.createDataFrame(edges + chain, "u long, v long, w double")
    cells = spark.createDataFrame([(k, k // 7 if k < 200 else 100 + k // 100) for k in [*range(60), 100, 101, *range(200, 1001)]], "node_id long, cell long")
    src = spark.createDataFrame([(0,), (7,), (100,), (200,), (999999,)], "node long")
    turns, write = [], network.stored
    monkeypatch.setattr(network, "stored", lambda df, name: turns.append(name) or write(df, name))
    got = {(x.source, x.node): round(x.dist, 6) for x in network.cell_paths(e, src, cells).collect()}
    assert turns.count("settled") <= 40 and got[200, 1000] == 800.0 and got[999999, 999999] == 0.0
    monkeypatch.undo()
    few = spark.createDataFrame([(0,), (7,), (100,), (999999,)], "node long")
    want = {(x.source, x.node): round(x.dist, 6) for x in network.delta_stepping(spark.createDataFrame(edges, "u long, v long, w double"), few, 100.0).collect()}
    assert {k: d for k, d in got.items() if k[0] != 200} == want


def test_network_paths_turns_do_not_grow_with_hops(spark, monkeypatch):
    """Nodes along a line: before, every four hops were a turn."""
    from fleetsense.plans import catalogue

    turns, write = [], network.stored
    monkeypatch.setattr(network, "stored", lambda df, name: turns.append(name) or write(df, name))
    catalogue.queries()["network_paths"](spark, "/root/testdata/sf0.001").count()
    assert turns.count("settled") <= 2 and "costs" not in turns

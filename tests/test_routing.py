"""Tour search: invariants, and brute force on few nodes."""

import itertools
import random

import numpy as np
import pytest

from fleetsense.operators import graph as G
from fleetsense.operators import routing as T


def random_matrix(n, seed):
    rng = np.random.default_rng(seed)
    return T.distances(23.78 + rng.random(n) * 0.06, 90.34 + rng.random(n) * 0.06)


def paths(cost, s, t):
    n = len(cost)
    best = np.inf
    for k in range(n - 1):
        for mid in itertools.permutations([i for i in range(n) if i not in (s, t)], k):
            p = [s, *mid, t]
            best = min(best, sum(cost[a, b] for a, b in zip(p, p[1:])))
    return best


@pytest.mark.parametrize("seed", range(3))
def test_dijkstra_is_brute_force(seed):
    rng = np.random.default_rng(seed)
    cost = rng.random((5, 5)) * 10
    np.fill_diagonal(cost, 0)
    d = T.dijkstra(cost, 0)
    assert all(d[t] == pytest.approx(paths(cost, 0, t)) for t in range(1, 5))


def test_small_graph(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (1, 3, 4.0), (2, 3, 2.0)], "u long, v long, cost double")
    r = G.shortest_paths(e, spark.createDataFrame([(1,)], "node long"), store=lambda d: d.cache()).where("node = 3").first()
    assert (r.path, r.dist) == ([1, 2, 3], 3.0)


@pytest.mark.parametrize("seed", range(5))
def test_local_search_never_lengthens_and_keeps_the_stops(seed):
    m = random_matrix(9, seed)
    order = np.random.default_rng(seed).permutation(8).tolist()
    two = T.two_opt(order, m, 8)
    both = T.or_opt(two, m, 8)
    assert sorted(both) == sorted(order) and T.length(both, m, 8) <= T.length(two, m, 8) <= T.length(order, m, 8)
    best = min(T.length(list(p), m, 8) for p in itertools.permutations(range(6))) if seed == 0 else 0
    assert T.length(both, m, 8) >= best * 0.99


def test_two_opt_is_a_plain_scan():
    """Against a scan that sums whole tours."""
    for seed in range(4):
        m = random_matrix(8, seed)
        order = np.random.default_rng(seed + 9).permutation(7).tolist()
        full, tour = [7, *order, 7], lambda s: sum(m[a, b] for a, b in zip(s, s[1:]))
        for _ in range(30):
            changed = False
            for i in range(1, len(full) - 2):
                for k in range(i + 2, len(full) - 1):
                    new = full[:i] + full[i : k + 1][::-1] + full[k + 1 :]
                    if tour(new) + 1e-9 < tour(full):
                        full, changed = new, True
            if not changed:
                break
        assert T.two_opt(order, m, 7) == full[1:-1]


def test_orienteering_stays_in_budget():
    m, prize = random_matrix(9, 1), np.array([0.1, 0.9, 0.2, 0.8, 0.3, 0.85, 0.15, 0.4])
    everything = T.orienteering(list(range(8)), m, 8, prize, 1e12)
    budget = T.length(everything, m, 8) / 2
    half = T.orienteering(list(range(8)), m, 8, prize, budget, True)
    assert sorted(everything) == list(range(8)) and T.length(half, m, 8) <= budget and len(half) <= 8


def test_route_visits_each_node_once(spark):
    rows = [(1, i, 23.78 + i * 0.003, 90.34 + (i * 7 % 5) * 0.004, i / 10, None, 23.79, 90.35) for i in range(8)]
    r = T.optimal_route(spark.createDataFrame(rows, "route_id long, node_id long, latitude double, longitude double, priority double, traffic_density double, user_lat double, user_lng double")).first()
    assert sorted(r.path) == list(range(8)) and r.total_cost > 0 and r.distance_m > 0


def test_route_without_user_place_starts_anywhere_at_no_cost(spark):
    rows = [(1, i, 23.78 + i * 0.003, 90.34, 0.5, 0.1, None, None) for i in range(3)]
    r = T.optimal_route(spark.createDataFrame(rows, "route_id long, node_id long, latitude double, longitude double, priority double, traffic_density double, user_lat double, user_lng double"), refine=False).first()
    assert r.path[0] == 0


def test_greedy_fold_is_the_loop(spark):
    rows = [(1, i, 23.78 + (i * 37 % 11) * 0.005, 90.34 + (i * 17 % 7) * 0.005, (i % 4) / 4) for i in range(9)]
    r = G.greedy(spark.createDataFrame(rows, "g long, node_id long, latitude double, longitude double, priority double"), "g", (23.8, 90.36), 1.0).first()
    m = T.distances(np.array([x[2] for x in rows] + [23.8]), np.array([x[3] for x in rows] + [90.36]))
    assert r.path == T.greedy(list(range(9)), m, 9, np.array([x[4] for x in rows]), 1.0)


def plain_orienteering(cand, m, depot, prize, budget):
    order, left = [], list(cand)
    while left:
        seq, best = [depot, *order, depot], None
        for j in left:
            add, pos = min((m[seq[k - 1], j] + m[j, seq[k]] - m[seq[k - 1], seq[k]], k) for k in range(1, len(seq)))
            if best is None or prize[j] / max(add, 1.0) > best[0]:
                best = (prize[j] / max(add, 1.0), j, pos)
        _, j, pos = best
        left.remove(j)
        trial = order[: pos - 1] + [j] + order[pos - 1 :]
        if T.length(trial, m, depot) <= budget:
            order = trial
    return T.two_opt(order, m, depot)


@pytest.mark.parametrize("seed", range(6))
def test_orienteering_is_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    m, prize, n = random_matrix(31, seed), rng.random(30), 30
    whole = T.length(T.greedy(list(range(n)), m, n), m, n)
    for share in (0.2, 0.55, 2.0):
        assert T.orienteering(list(range(n)), m, n, prize, share * whole) == plain_orienteering(range(n), m, n, prize, share * whole)


EQUITY_ROWS = "shift long, node_id long, latitude double, longitude double, priority double, critical boolean, user_lat double, user_lng double"


@pytest.mark.parametrize("gamma", [0.0, 0.5, 2.0])
def test_equity_is_brute_force(spark, gamma):
    """All nodes in all shifts, by plain loops. Rows are missing, also the least id's, and node 7 has no coordinates."""
    rng = np.random.default_rng(5)
    n, shifts = 26, 9
    lat, lng = 23.78 + rng.random(n) * 0.06, 90.34 + rng.random(n) * 0.06
    state = {(s, i): (float(rng.random() ** 3), bool(rng.random() < 0.3)) for s in range(shifts) for i in range(n) if s == 0 and i % 5 or s and rng.random() < 0.7}
    where = lambda i: (None, None) if i == 7 else (float(lat[i]), float(lng[i]))
    rows = [(s, i, *where(i), p, c, 23.8069, 90.3687) for (s, i), (p, c) in state.items()]
    got = T.equity(spark.createDataFrame(rows, EQUITY_ROWS), spark.createDataFrame([(gamma,)], "gamma double")).first()

    m = T.distances(np.append(lat, 23.8069), np.append(lng, 90.3687))
    cand = [i for i in range(n) if i != 7]
    full = T.or_opt(T.two_opt(T.greedy(cand, m, n), m, n), m, n, move_last=False)
    last, visits, worst, served, now = [0.0] * n, [0] * n, [0.0] * n, [], {}
    for s in range(shifts):
        t = 50 + 8 * s
        now |= {i: x for (at, i), x in state.items() if at == s}
        prize = [now.get(i, (0, False))[0] + gamma * min(1.0, (t - last[i]) / 48) for i in range(n)]
        hours, at = 0.0, n
        for j in plain_orienteering(cand, m, n, prize, 0.55 * T.length(full, m, n)):
            hours, at = hours + m[at, j] / 1000 / 20, j
            visits[j], last[j] = visits[j] + 1, t + hours
            served += [hours] if now.get(j, (0, False))[1] else []
        worst = [max(w, t - x) for w, x in zip(worst, last)]
    x = sorted(visits)
    gini = (n + 1 - 2 * sum(sum(x[: k + 1]) / sum(x) for k in range(n))) / n
    assert (got.worst_wait_h, got.never_served, got.total_visits) == (round(max(worst), 1), visits.count(0), sum(visits))
    assert (got.mean_wait_h, got.gini_visits, got.mean_time_to_critical_h) == pytest.approx((sum(worst) / n, gini, sum(served) / len(served)), abs=0.051)
    assert got.gini_visits == pytest.approx(gini, abs=6e-4) and visits[7] == 0


def test_equity_of_two_depots_is_that_of_each(spark):
    rng = np.random.default_rng(8)
    rows = [(s, d, 100 * d + i, 23.78 + float(rng.random()) * 0.06, 90.34 + float(rng.random()) * 0.06, float(rng.random()), bool(rng.random() < 0.3), 23.8069, 90.3687) for s in range(4) for d in (0, 1) for i in range(9 + d)]
    df, g = spark.createDataFrame(rows, EQUITY_ROWS.replace("shift long,", "shift long, depot long,")), spark.createDataFrame([(0.5,)], "gamma double")
    both, one, two = T.equity(df, g).first(), *(T.equity(df.where(f"depot = {d}").drop("depot"), g).first() for d in (0, 1))
    assert both.total_visits == one.total_visits + two.total_visits and both.worst_wait_h == max(one.worst_wait_h, two.worst_wait_h)
    assert both.mean_wait_h == pytest.approx((9 * one.mean_wait_h + 10 * two.mean_wait_h) / 19, abs=0.11)


def test_states_are_of_every_node_in_every_shift(spark):
    from fleetsense.plans import catalogue
    from fleetsense.sources.views import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    got = {(r.shift, r.node_id): r for r in catalogue._states(t, 50.0, 8.0).collect()}
    nodes, readings = {r.node_id for r in t.node.collect()}, t.reading.collect()
    first = min(r.timestamp for r in readings)
    hours = lambda r: (r.timestamp - first).total_seconds() / 3600
    shifts = range(int((max(map(hours, readings)) - 50) // 8) + 1)
    assert set(got) == {(s, i) for s in shifts for i in nodes}
    scored = {r.reading_id: r.p for r in t.reading.select("reading_id", catalogue.S.state_priority().alias("p")).collect()}
    for (s, i), r in got.items():
        before = [x for x in readings if x.node_id == i and hours(x) <= 50 + 8 * s]
        newest = max(before, key=lambda x: (x.timestamp, x.reading_id)).reading_id if before else None
        assert r.priority == pytest.approx(scored[newest] if before else 0.0)


def test_equity_sweep_takes_all_nodes(spark):
    from fleetsense.plans import catalogue
    from fleetsense.sources.views import Tables

    sf = "/root/testdata/sf0.001"
    rows, nodes = catalogue.queries()["equity_sweep"](spark, sf).collect(), Tables(spark, sf).node.count()
    assert [r.gamma for r in sorted(rows)] == [0.0, 0.25, 0.5, 1.0] and all(r.total_visits >= nodes for r in rows)


def test_policies_take_all_nodes_of_a_snapshot(spark):
    from fleetsense.plans import catalogue
    from fleetsense.sources.views import Tables

    sf = "/root/testdata/sf0.001"
    t, got = Tables(spark, sf), {(r.policy, r.alpha): r for r in catalogue.queries()["policy_comparison"](spark, sf).collect()}
    placed = t.node.where("latitude IS NOT NULL AND longitude IS NOT NULL").count()
    states = catalogue._states(t, 72.0, 72.0, True)
    assert placed > 20 and states.select("shift").distinct().count() == 10 and states.count() == 10 * t.node.count()
    assert got["A_static_full", None].n_visited == placed and got["C_warped", 4.0].n_visited == placed
    assert got["B_threshold", None].n_visited == pytest.approx(states.where("priority >= 0.5 AND latitude IS NOT NULL").count() / 10)


def test_policies_leave_out_what_has_no_place(spark):
    rows = [(1, i, None if i == 2 else 23.78 + (i * 7 % 30) * 0.002, 90.34 + (i * 11 % 30) * 0.002, 0.5, i % 3 == 0, 1.0, 23.8069, 90.3687) for i in range(30)]
    got = T.compare_policies(spark.createDataFrame(rows, "route_id long, node_id long, latitude double, longitude double, priority double, critical boolean, time_to_overflow double, user_lat double, user_lng double")).collect()
    full = next(r for r in got if r.policy == "A_static_full")
    assert full.n_visited == 29 and full.prize_pct == round(100 * 29 / 30, 1) and full.distance_km < 100 and len(got) == 10


def test_target_routes_against_all_simple_paths():
    import itertools

    from fleetsense.operators import routing

    rng = np.random.default_rng(4)
    for n in (1, 2, 5):
        for _ in range(5):
            cost = rng.uniform(1, 9, (n, n))

            def best(a, b):
                others = [i for i in range(n) if i not in (a, b)]
                ways = [[a, *mid, b] if a != b else [a] for k in range(len(others) + 1) for mid in itertools.permutations(others, k)]
                return min((sum(cost[x, y] for x, y in itertools.pairwise(w)), w) for w in ways)

            targets, at, path, total = [i for i in range(n) if i % 2 == 0], 0, [], 0.0
            left = list(targets)
            while left:
                d, t = min((best(at, t)[0], t) for t in left)
                way = best(at, t)[1]
                path += way[1:] if path else way
                total, at = total + d, t
                left.remove(t)
            got = routing.target_order(cost, 0, targets)
            assert got[0] == path and abs(got[1] - total) < 1e-9
    cut = np.full((2, 2), np.inf)
    assert routing.target_order(cut, 0, [1]) == ([], 0.0) and routing.target_order(cut, 0, []) == ([], 0.0)


def test_routes_to_targets_of_awkward_requests(spark):
    from fleetsense.operators import routing

    rows = [(1, 5, 23.8, 90.4, 0.5, 0.1, False, True), (1, 4, None, None, None, None, True, None), (2, 7, 23.8, 90.4, 0.5, 0.1, None, None)]
    d = spark.createDataFrame(rows, "route_id long, node_id long, latitude double, longitude double, priority double, traffic_density double, source boolean, target boolean")
    assert {r.route_id: r.path for r in routing.target_routes(d).collect()} == {1: [4, 5], 2: []}
    assert {(r.route_id, r.node_id, r.before) for r in routing.distance_tree(d).collect()} == {(1, 4, None), (1, 5, 4), (2, 7, None)}
    assert routing.target_routes(d.limit(0)).isEmpty()


@pytest.mark.parametrize("n", [1, 3, 12, 40])
def test_tours_at_once_are_those_alone(n):
    """Also with nodes at one place, equal prizes, nodes on no tour and no nodes at all."""
    from fleetsense.operators import tours

    r = np.random.default_rng(n)
    m = np.array([T.distances(23.78 + a * 0.0006, 90.34 + b * 0.0006) for a, b in (r.integers(0, 9, (2, n + 1)) if k % 2 else r.random((2, n + 1)) * 9 for k in range(6))])
    of, prize, on = r.integers(0, 6, 30), np.round(r.random((30, n)), 1), r.random((30, n)) < 0.9
    on[0] = False
    whole = np.array([T.length(T.greedy(np.flatnonzero(on[b]).tolist(), m[of[b]], n), m[of[b]], n) for b in range(30)])
    path, size = tours.orienteering(on, prize, 0.55 * whole, m, of)
    for b in range(30):
        assert path[b, 1 : size[b] + 1].tolist() == T.orienteering(np.flatnonzero(on[b]).tolist(), m[of[b]], n, prize[b], 0.55 * whole[b])


def test_equity_depots_are_bounded_and_changes_are_enough(spark):
    """No depot of the sweep has more than EQUITY_NODES nodes, none is lost, and shifts without news need no rows."""
    from fleetsense.plans import catalogue
    from fleetsense.sources.views import Tables

    t = Tables(spark, "/root/testdata/sf0.01")
    sizes = [r["count"] for r in catalogue._depots(t, catalogue.EQUITY_NODES).groupBy("depot").count().collect()]
    assert max(sizes) <= catalogue.EQUITY_NODES and sum(sizes) == t.node.count()
    t = Tables(spark, "/root/testdata/sf0.001")
    g = spark.createDataFrame([(0.5,), (0.0,)], "gamma double")
    few, all_ = catalogue._states(t, 50.0, 8.0, changes=True), catalogue._states(t, 50.0, 8.0)
    assert few.count() < all_.count()
    assert sorted(T.equity(few, g).collect()) == sorted(T.equity(all_, g).collect())


def test_policies_by_depot_are_those_of_each_snapshot(spark):
    """A depot's snapshots taken on together give what each gives alone; kernels give what plain scans give."""
    import numpy as np

    from fleetsense.operators import routing, tours

    r = random.Random(8)
    at = {d: [(23.7 + r.random() * 0.05, 90.3 + r.random() * 0.05) if k % 9 else (None, None) for k in range(45)] for d in (1, 2)}
    at[3] = [(None, None)] * 3
    rows = [(d, s * 100 + d, k, *p, r.random() if r.random() < 0.4 else 0.0, r.random() < 0.2, r.random() * 24, 23.72, 90.33) for d, ps in at.items() for s in range(3) for k, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "depot long, route_id long, node_id long, latitude double, longitude double, priority double, critical boolean, time_to_overflow double, user_lat double, user_lng double")
    key = lambda x: (x.route_id, x.policy, x.alpha or 0.0)
    together, alone = (sorted(routing.compare_policies(d).collect(), key=key) for d in (df, df.drop("depot")))
    assert together == alone and len(together) == 9 * 10
    m = routing.distances(*np.array([p for p in at[1] if p[0]] + [(23.72, 90.33)]).T)
    n = len(m) - 1
    p = np.array([[r.random() for _ in range(n)] for _ in range(3)])
    assert tours.greedy(np.ones(n, bool), m, 1 + 10 * p).tolist() == [routing.greedy(list(range(n)), m, n, x, 1.0) for x in p]

    def plain_two_opt(order, max_pass=30):
        t = [n, *order, n]
        for _ in range(max_pass):
            improved = False
            for i in range(1, len(t) - 2):
                for k in range(i + 2, len(t) - 1):
                    if m[t[i - 1], t[i]] + m[t[k], t[k + 1]] - m[t[i - 1], t[k]] - m[t[i], t[k + 1]] > 1e-9:
                        t[i : k + 1] = t[i : k + 1][::-1]
                        improved = True
            if not improved:
                break
        return t[1:-1]

    def plain_or_opt(order, move_last):
        t = [n, *order, n]
        for _ in range(10):
            for s, i in [(s, i) for s in (1, 2, 3) for i in range(1, len(t) - s - (0 if move_last else 1))]:
                seg, rest = t[i : i + s], t[:i] + t[i + s :]
                saved = m[t[i - 1], t[i]] + m[t[i + s - 1], t[i + s]] - m[t[i - 1], t[i + s]]
                j = next((j for j in range(len(rest) - 1) if saved - (m[rest[j], seg[0]] + m[seg[-1], rest[j + 1]] - m[rest[j], rest[j + 1]]) > 1e-9), None)
                if j is not None:
                    t = rest[: j + 1] + seg + rest[j + 1 :]
                    break
            else:
                break
        return t[1:-1]

    for seed in range(20):
        order = random.Random(seed).sample(range(n), n - seed)
        assert routing.two_opt(order, m, n) == plain_two_opt(order)
        for move_last in (True, False):
            assert routing.or_opt(order, m, n, move_last=move_last) == plain_or_opt(order, move_last)


def test_policies_work_a_depots_places_out_once(monkeypatch):
    """Snapshots of one depot share the matrix."""
    from fleetsense.operators import routing

    class Rows:
        columns = ["depot", "route_id"]

        def groupBy(self, key):
            assert key == "depot"
            return self

        def applyInPandas(self, f, schema):
            return f

    rows, seen = Rows(), []
    monkeypatch.setattr(routing, "spread", lambda df, key: df)
    plain = routing.distances
    monkeypatch.setattr(routing, "distances", lambda *a: seen.append(1) or plain(*a))
    import pandas as pd

    g = pd.DataFrame([(1, s, k, 23.7 + k / 100, 90.3 + (k * 7 % 5) / 100, 0.1 * k, k == 3, 5.0, 23.7, 90.3) for s in range(4) for k in range(8)], columns=["depot", "route_id", "node_id", "latitude", "longitude", "priority", "critical", "time_to_overflow", "user_lat", "user_lng"])
    assert len(routing.compare_policies(rows)(g)) == 4 * 10 and len(seen) == 1

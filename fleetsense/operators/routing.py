"""Order-dependent tour search, one request in one group: numpy kernels for applyInPandas.

Many requests run side by side; a request's nodes are bounded by its top-N.
Local search uses differences of lengths instead of whole tours.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import CO2_KG_PER_KM, EARTH_M, SPEED_KMH
from . import tours


#: Tasks for a few heavy groups: so many that they rarely share one.
TASKS = 64


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows by key in at least TASKS partitions, which adaptive execution does not put together again."""
    return rows.repartition(max(TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def distances(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    a, b = np.radians(np.nan_to_num(lat)), np.radians(np.nan_to_num(lng))
    h = np.sin((a[:, None] - a) / 2) ** 2 + np.cos(a)[:, None] * np.cos(a) * np.sin((b[:, None] - b) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def warped(m: np.ndarray, priority: np.ndarray, traffic: np.ndarray, alpha: float, weight: float = 3.0) -> np.ndarray:
    return m * (1 + np.clip(traffic, 0, 1) * weight) / (1 + 10 * alpha * np.clip(priority, 0, 1))


def dijkstra_tree(cost: np.ndarray, source: int) -> tuple[np.ndarray, np.ndarray]:
    """Least costs from a node and the node before each on the way (-1: none); unreachable nodes are infinite (an infinite cost is no edge)."""
    dist, before = np.full(len(cost), np.inf), np.full(len(cost), -1)
    dist[source], heap, done = 0.0, [(0.0, source)], np.zeros(len(cost), bool)
    while heap:
        d, u = heapq.heappop(heap)
        if done[u]:
            continue
        done[u] = True
        better = np.flatnonzero(~done & (d + cost[u] < dist))
        dist[better], before[better] = d + cost[u, better], u
        for v in better.tolist():
            heapq.heappush(heap, (dist[v], v))
    return dist, before


def dijkstra(cost: np.ndarray, source: int) -> np.ndarray:
    return dijkstra_tree(cost, source)[0]


def target_order(cost: np.ndarray, source: int, targets: list[int]) -> tuple[list[int], float]:
    """The way from the source to all targets, the nearest by shortest path each time, with the nodes passed between; ties to the smaller index.

    A joint of two stretches is there once. Targets that cannot be reached are left out.
    """
    path, total, at, left = [], 0.0, source, sorted(set(targets))
    while left:
        dist, before = dijkstra_tree(cost, at)
        t = left[int(np.argmin(dist[left]))]
        if not np.isfinite(dist[t]):
            break
        stretch = [t]
        while stretch[-1] != at:
            stretch.append(int(before[stretch[-1]]))
        stretch.reverse()
        path += stretch[1:] if path else stretch
        total += float(dist[t])
        left.remove(t)
        at = t
    return path, total


def visiting_order(cost: np.ndarray, first: np.ndarray | None, source: int = 0) -> tuple[list[int], float]:
    """Repeatedly the cheapest unvisited node by shortest path over the whole graph; ties to the smaller index.

    first: costs from a virtual source to each node; without it the source itself comes first, at no cost.
    """
    n = len(cost)
    left, order, total = np.ones(n, bool), [], 0.0
    reach = np.min(first[:, None] + np.array([dijkstra(cost, i) for i in range(n)]), 0) if first is not None else dijkstra(cost, source)
    while left.any():
        k = int(np.argmin(np.where(left, reach, np.inf)))
        if not np.isfinite(reach[k]):
            break
        order.append(k)
        total += float(reach[k])
        left[k] = False
        reach = dijkstra(cost, k)
    return order, total


def length(order: list[int], m: np.ndarray, depot: int) -> float:
    path = [depot, *order, depot]
    return float(m[path[:-1], path[1:]].sum()) if order else 0.0


def two_opt(order: list[int], m: np.ndarray, depot: int, max_pass: int = 30, eps: float = 1e-9) -> list[int]:
    """Reverse stretches while the closed tour gets shorter; every improvement is taken at once and the scan goes on."""
    if len(order) < 4:
        return list(order)
    t = np.array([depot, *order, depot])
    step, end = m[t[:-1], t[1:]], len(t) - 2
    for _ in range(max_pass):
        improved, i, rows = False, 1, 1
        while i < end:
            # Rows that give nothing are many: a block of them is looked at in one go, twice as many after each such block.
            to, k = min(i + rows, end), i + 2  # neighbours are not swapped
            hit = np.triu(step[i - 1 : to - 1, None] + step[k:] - m[t[i - 1 : to - 1, None], t[k:-1]] - m[t[i:to, None], t[k + 1 :]] > eps)
            first = int(hit.argmax()) if hit.size else 0
            if not hit.size or not hit.flat[first]:
                i, rows = to, min(2 * rows, 32)
                continue
            i, k = i + first // hit.shape[1], k + first % hit.shape[1]
            while True:
                t[i : k + 1] = t[i : k + 1][::-1].copy()
                step[i - 1 : k + 1] = m[t[i - 1 : k + 1], t[i : k + 2]]
                k += 1
                if k >= len(t) - 1:
                    break
                gain = step[i - 1] + step[k:] - m[t[i - 1]][t[k:-1]] - m[t[i]][t[k + 1 :]]
                at = int((gain > eps).argmax())
                if not gain[at] > eps:
                    break
                k += at
            improved, i, rows = True, i + 1, 1
        if not improved:
            break
    return t[1:-1].tolist()


def or_opt(order: list[int], m: np.ndarray, depot: int, sizes=(1, 2, 3), max_pass: int = 10, move_last: bool = True, eps: float = 1e-9) -> list[int]:
    """Move one short stretch to where it makes the closed tour shorter, the first found, up to max_pass times.

    move_last=False never moves a stretch that holds the last stop.
    """
    t = np.array([depot, *order, depot])

    def moved() -> np.ndarray | None:
        gap, step = np.arange(len(t) - 1), m[t[:-1], t[1:]]
        for s in sizes:
            end = len(t) - s - (0 if move_last else 1)
            for start in range(1, end, 64):  # stretches that begin at 64 places in one go
                i = np.arange(start, min(start + 64, end))
                before, first, last, after = t[i - 1], t[i], t[i + s - 1], t[i + s]
                saved = m[before, first] + m[last, after] - m[before, after]
                added = m[t[:-1], first[:, None]] + m[last[:, None], t[1:]] - step
                hit = (saved[:, None] - added > eps) & ((gap < i[:, None] - 1) | (gap >= i[:, None] + s))
                at = int(hit.argmax())
                if hit.flat[at]:
                    k, j = int(i[at // hit.shape[1]]), at % hit.shape[1]
                    seg, rest = t[k : k + s], np.concatenate((t[:k], t[k + s :]))
                    j = j + 1 if j < k else j + 1 - s
                    return np.concatenate((rest[:j], seg, rest[j:]))
        return None

    for _ in range(max_pass):
        new = moved()
        if new is None:
            break
        t = new
    return t[1:-1].tolist()


def greedy(candidates: list[int], m: np.ndarray, depot: int, priority: np.ndarray | None = None, alpha: float = 0.0) -> list[int]:
    cost = m
    if alpha > 0 and priority is not None:
        p = np.zeros(len(m))
        p[: len(priority)] = priority  # the depot has none
        cost = m / (1 + 10 * alpha * p)
    closed, at, order = np.full(len(m), np.inf), depot, []
    closed[candidates] = 0.0
    for _ in candidates:
        at = int(np.argmin(cost[at] + closed))  # the first, and so the smallest index, of equals
        order.append(at)
        closed[at] = np.inf
    return order


def orienteering(candidates: list[int], m: np.ndarray, depot: int, prize: np.ndarray, budget: float, refine_each: bool = False) -> list[int]:
    """Insert the node of the best prize for its added metres at its cheapest place, if the tour stays in the budget; what cannot is out for good.

    refine_each runs 2-opt after each insertion, else once at the end.
    """
    order, left = [], np.array(sorted(candidates), int)
    start, add = np.full(len(m), depot), np.full(len(m), np.inf)  # each node's cheapest edge of the tour, by its first node, and the metres added there

    def search(nodes: np.ndarray) -> None:
        path = np.array([depot, *order, depot])
        more = m[path[:-1, None], nodes] + m[path[1:, None], nodes] - m[path[:-1], path[1:]][:, None]
        start[nodes], add[nodes] = path[more.argmin(0)], more.min(0)

    if len(left):
        search(left)
    while len(left):
        b = int((prize[left] / np.maximum(add[left], 1.0)).argmax())
        j = int(left[b])
        left = np.delete(left, b)
        a = int(start[j])
        pos = order.index(a) + 1 if order and a != depot else 0
        trial = order[:pos] + [j] + order[pos:]
        if length(trial, m, depot) > budget:
            continue
        if refine_each:
            order = two_opt(trial, m, depot, eps=1e-6)
            if len(left):
                search(left)
            continue
        after, order = order[pos] if pos < len(order) else depot, trial
        # The edge a..after became a..j and j..after: only nodes that had it look at the whole tour again.
        place = np.zeros(len(m), int)
        place[order] = np.arange(1, len(order) + 1)
        place[depot] = 0
        keep = left[start[left] != a]
        one, two = m[a, keep] + m[j, keep] - m[a, j], m[j, keep] + m[after, keep] - m[j, after]
        new, first = np.minimum(one, two), np.where(one <= two, a, j)
        better = (new < add[keep]) | ((new == add[keep]) & (place[first] < place[start[keep]]))
        start[keep[better]], add[keep[better]] = first[better], new[better]
        if (again := left[start[left] == a]).size:
            search(again)
    return order if refine_each else two_opt(order, m, depot)


def measures(order: list[int], m: np.ndarray, depot: int, critical: np.ndarray, tto: np.ndarray) -> dict:
    km = length(order, m, depot) / 1000
    path = [depot, *order]
    at = np.cumsum(m[path[:-1], path[1:]]) / 1000 / SPEED_KMH if order else np.zeros(0)
    o = np.array(order, int)
    c = critical[o].astype(bool) if len(o) else np.zeros(0, bool)
    return {
        "distance_km": round(km, 3), "co2_kg": round(km * CO2_KG_PER_KM, 3), "n_visited": len(order), "n_critical_served": int(c.sum()),
        "mean_time_to_critical_h": round(float(at[c].mean()) if c.any() else 0.0, 3), "worst_time_to_critical_h": round(float(at[c].max()) if c.any() else 0.0, 3),
        "missed_overflow": int((at[c] > tto[o][c]).sum()) if c.any() else 0,
    }


ROUTE_SCHEMA = "route_id long, path array<long>, total_cost double, distance_m double"


def one_route(g: pd.DataFrame, alpha: float = 0.5, refine: bool = True) -> pd.DataFrame:
    """The row of optimal_route() for one request's nodes."""
    g = g.sort_values("node_id").reset_index(drop=True)
    ids, user = g.node_id.to_numpy(), g[["user_lat", "user_lng"]].iloc[0].to_numpy(float)
    has_user = not np.isnan(user).any()
    depot = user if has_user else np.nan_to_num(g[["latitude", "longitude"]].iloc[0].to_numpy(float))
    lat, lng = np.append(g.latitude.to_numpy(float), depot[0]), np.append(g.longitude.to_numpy(float), depot[1])
    m, n = distances(lat, lng), len(g)
    cost = warped(m, np.append(g.priority.fillna(0), 0), np.append(g.traffic_density.fillna(0), 0), alpha)
    order, total = visiting_order(cost[:n, :n], cost[n, :n] if has_user else None)
    if refine and len(order) >= 4:
        order = or_opt(two_opt(order, m, n, eps=1e-6), m, n, eps=1e-6)
    return pd.DataFrame([{"route_id": g.route_id.iloc[0], "path": ids[order].tolist(), "total_cost": total, "distance_m": length(order, m, n)}])


def optimal_route(requests: DataFrame, alpha: float = 0.5, refine: bool = True) -> DataFrame:
    """route_id, path, total_cost (of the greedy order, before refinement) and distance_m of the closed tour.

    requests: route_id, node_id, latitude, longitude, priority, traffic_density, user_lat, user_lng (null: no user place).
    A node without traffic has none. A request without nodes has no row.
    """
    return requests.groupBy("route_id").applyInPandas(lambda g: one_route(g, alpha, refine), ROUTE_SCHEMA)


def _request_cost(g: pd.DataFrame, alpha: float) -> np.ndarray:
    m = distances(g.latitude.to_numpy(float), g.longitude.to_numpy(float))
    return warped(m, g.priority.fillna(0).to_numpy(float), g.traffic_density.fillna(0).to_numpy(float), alpha)


def target_routes(requests: DataFrame, alpha: float = 0.5) -> DataFrame:
    """route_id, path, total_cost: each request's way from its source to all its targets over warped costs.

    requests: route_id, node_id, latitude, longitude, priority, traffic_density, source, target (booleans). Of several sources
    the smallest id counts; without one the smallest id of all. A request without targets has an empty path: see distance_tree.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node_id").reset_index(drop=True)
        start = int((g.source == True).to_numpy(bool).argmax())  # noqa: E712  the first, else 0
        order, total = target_order(_request_cost(g, alpha), start, np.flatnonzero((g.target == True).to_numpy(bool)).tolist())  # noqa: E712
        return pd.DataFrame([{"route_id": g.route_id.iloc[0], "path": g.node_id.to_numpy()[order].tolist(), "total_cost": total}])

    return requests.groupBy("route_id").applyInPandas(run, "route_id long, path array<long>, total_cost double")


def distance_tree(requests: DataFrame, alpha: float = 0.5) -> DataFrame:
    """route_id, node_id, dist, before: least cost from the request's source to each node and the node before it (null at the source)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node_id").reset_index(drop=True)
        dist, before = dijkstra_tree(_request_cost(g, alpha), int((g.source == True).to_numpy(bool).argmax()))  # noqa: E712
        ids = g.node_id.to_numpy()
        return pd.DataFrame({"route_id": g.route_id, "node_id": ids, "dist": dist, "before": pd.array([int(ids[b]) if b >= 0 else None for b in before], dtype="Int64")})

    return requests.groupBy("route_id").applyInPandas(run, "route_id long, node_id long, dist double, before long")


def prize_routes(requests: DataFrame, share: float = 0.5, refine_each: bool = True) -> DataFrame:
    """route_id, path, distance_m, budget_m, collected: orienteering within a share of the full greedy tour."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node_id").reset_index(drop=True)
        n = len(g)
        m = distances(np.append(g.latitude.to_numpy(float), g.user_lat.iloc[0]), np.append(g.longitude.to_numpy(float), g.user_lng.iloc[0]))
        full = or_opt(two_opt(greedy(list(range(n)), m, n), m, n), m, n, move_last=False)
        budget, prize = share * length(full, m, n), g.priority.fillna(0).to_numpy(float)
        order = orienteering(list(range(n)), m, n, prize, budget, refine_each)
        return pd.DataFrame([{"route_id": g.route_id.iloc[0], "path": g.node_id.to_numpy()[order].tolist(), "distance_m": length(order, m, n), "budget_m": budget, "collected": float(prize[order].sum())}])

    return requests.groupBy("route_id").applyInPandas(run, "route_id long, path array<long>, distance_m double, budget_m double, collected double")


POLICY_SCHEMA = (
    "route_id long, policy string, alpha double, distance_km double, co2_kg double, n_visited int, n_critical_served int, mean_time_to_critical_h double,"
    " worst_time_to_critical_h double, missed_overflow int, prize_pct double, prize double"
)
ALPHAS = (0.0, 0.25, 0.5, 1.0, 2.0, 4.0)


def compare_policies(snapshots: DataFrame) -> DataFrame:
    """A row for each snapshot and policy: full sweep, threshold, warped by each alpha, warped and refined, orienteering.

    snapshots: route_id, node_id, latitude, longitude, priority, critical, time_to_overflow, user_lat, user_lng.
    A node without coordinates is on no tour; its prize counts in what there was to collect (prize: all of it).
    With a column `depot`, a depot's snapshots are taken on in one task, and what its places alone decide is worked out once.
    """

    refined = lambda o, m, n: or_opt(two_opt(o, m, n), m, n, move_last=False)

    def same_places(snaps: list[pd.DataFrame]):
        """Rows of snapshots whose nodes lie at the same places: one matrix, one full sweep, greedy and orienteering of all side by side."""
        g, n = snaps[0], len(snaps[0])
        m = distances(np.append(g.latitude.to_numpy(float), g.user_lat.iloc[0]), np.append(g.longitude.to_numpy(float), g.user_lng.iloc[0]))
        placed = (g.latitude.notna() & g.longitude.notna()).to_numpy(bool)
        every = np.flatnonzero(placed).tolist()
        full = refined(greedy(every, m, n), m, n)
        p = np.array([x.priority.fillna(0).to_numpy(float) for x in snaps])
        alphas = np.array(ALPHAS)
        warped = tours.greedy(placed, m, (1 + 10 * alphas[:, None, None] * p).reshape(-1, n)).reshape(len(alphas), len(snaps), -1).tolist()
        prized, size = tours.orienteering(np.tile(placed, (len(snaps), 1)), p, np.full(len(snaps), 0.65 * length(full, m, n)), m[None], np.zeros(len(snaps), int), refine=False)
        for k, x in enumerate(snaps):
            crit, tto = x.critical.to_numpy(), x.time_to_overflow.to_numpy(float)
            found = [("A_static_full", None, full), ("B_threshold", None, refined(greedy([j for j in every if p[k, j] >= 0.5], m, n), m, n))]
            found += [("C_warped", a, warped[i][k]) for i, a in enumerate(ALPHAS)]
            found.append(("D_warped_refined", 1.0, refined(warped[ALPHAS.index(1.0)][k], m, n)))
            found.append(("E_orienteering", None, two_opt(prized[k, 1 : size[k] + 1].tolist(), m, n)))
            for policy, alpha, order in found:
                yield {"route_id": x.route_id.iloc[0], "policy": policy, "alpha": alpha, **measures(order, m, n, crit, tto), "prize_pct": round(100 * p[k, order].sum() / max(p[k].sum(), 1e-9), 1), "prize": float(p[k].sum())}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        alike: dict[bytes, list[pd.DataFrame]] = {}
        for _, x in g.sort_values(["route_id", "node_id"]).groupby("route_id"):
            where = x[["node_id", "latitude", "longitude", "user_lat", "user_lng"]].to_numpy(float)
            alike.setdefault(where.tobytes(), []).append(x.reset_index(drop=True))
        return pd.DataFrame([r for snaps in alike.values() for r in same_places(snaps)])

    key = "depot" if "depot" in snapshots.columns else "route_id"
    return spread(snapshots, key).groupBy(key).applyInPandas(lambda g: run(g), POLICY_SCHEMA)


#: Depots that follow one another are simulated in one task, so that numpy steps take all their tours on at once.
DEPOTS = 128


def equity(snapshots: DataFrame, gammas: DataFrame, shift_h: float = 8.0, share: float = 0.55, tau: float = 48.0, start_h: float = 50.0) -> DataFrame:
    """Waits and visits under shifts of orienteering with an aging boost, a row for each gamma over all depots.

    snapshots: shift, depot (whose tours the node is on; without the column there is one), node_id, latitude, longitude, priority, critical, user_lat, user_lng. Shifts follow one
    another; a task holds the matrices of DEPOTS depots' nodes and runs their gammas side by side. At the start every node was last visited at hour 0. A node that a shift
    lacks keeps its last state and stays where it is. A depot has the shifts that it has rows of; with a column `until`, all shifts from 0 up to it.
    A node without coordinates is on no tour, but waits. gammas: a few rows, brought to the driver.
    """
    boosts = sorted({float(r[0]) for r in gammas.collect()})  # a row of the result each
    whole = "until" in snapshots.columns

    def run(g: pd.DataFrame) -> pd.DataFrame:
        at_node = g.sort_values(["shift", "node_id"]).groupby(["depot", "node_id"])[["latitude", "longitude"]].first()  # the first that is known; by id
        depots, n_of = np.unique(at_node.index.get_level_values(0), return_counts=True)
        n, all_ = int(n_of.max()), len(depots)
        of = np.repeat(np.arange(all_), n_of)
        slot = np.arange(len(of)) - np.repeat(np.cumsum(n_of) - n_of, n_of)
        lat, lng = np.full((all_, n + 1), np.nan), np.full((all_, n + 1), np.nan)
        lat[of, slot], lng[of, slot] = at_node.latitude, at_node.longitude
        home = g.groupby("depot")[["user_lat", "user_lng"]].first().to_numpy(float)
        placed = ~(np.isnan(lat) | np.isnan(lng))[:, :n]
        lat[:, n], lng[:, n] = home[:, 0], home[:, 1]
        m = np.array([distances(x, y) for x, y in zip(lat, lng)])
        full = [or_opt(two_opt(greedy(np.flatnonzero(p).tolist(), c, n), c, n), c, n, move_last=False) for p, c in zip(placed, m)]
        budget = np.array([share * length(o, c, n) for o, c in zip(full, m)])
        # A problem for each gamma and depot.
        depot, gamma = np.tile(np.arange(all_), len(boosts)), np.repeat(boosts, all_)
        last, visits, worst = np.zeros((len(depot), n)), np.zeros((len(depot), n), int), np.zeros((len(depot), n))
        served, hours = np.zeros(len(depot)), np.zeros(len(depot))
        priority, critical, row = np.zeros((all_, n)), np.zeros((all_, n), bool), np.arange(len(depot))[:, None]
        k = at_node.index.get_indexer(pd.MultiIndex.from_frame(g[["depot", "node_id"]]))
        rows = pd.DataFrame({"shift": g["shift"].to_numpy(), "of": of[k], "slot": slot[k], "p": g.priority.fillna(0).to_numpy(float), "c": (g.critical == True).to_numpy(bool)})  # noqa: E712
        by_shift = dict(tuple(rows.groupby("shift")))
        for shift in range(int(g.until.iloc[0]) + 1) if whole else sorted(by_shift):
            t = start_h + shift * shift_h
            if (s := by_shift.get(shift)) is not None:
                priority[s.of, s.slot], critical[s.of, s.slot] = s.p, s.c
            on = np.arange(len(depot)) if whole else np.flatnonzero(np.isin(depot, s.of))
            d = depot[on]
            prize = priority[d] + gamma[on, None] * np.minimum(1.0, (t - last[on]) / tau)
            path, size = tours.orienteering(placed[d], prize, budget[d], m, d)
            took = np.cumsum(m[d[:, None], path[:, :-1], path[:, 1:]], 1)[:, :n] / 1000 / SPEED_KMH
            b, j = np.nonzero(np.arange(n) < size[:, None])
            stop = path[b, j + 1]
            last[on[b], stop] = t + took[b, j]
            visits[on[b], stop] += 1
            urgent = critical[d[b], stop]
            served += np.bincount(on[b[urgent]], minlength=len(depot))
            hours += np.bincount(on[b[urgent]], took[b, j][urgent], len(depot))
            worst[on] = np.maximum(worst[on], t - last[on])
        real = (np.arange(n) < n_of[:, None])[depot]
        nodes = pd.DataFrame({"gamma": np.repeat(gamma, n_of[depot]), "visits": visits[real], "worst": worst[real]})
        out = nodes.groupby(["gamma", "visits"], as_index=False).agg(n=("worst", "size"), worst=("worst", "max"), waits=("worst", "sum"))
        sums = pd.DataFrame({"gamma": gamma, "served": served, "hours": hours}).groupby("gamma").sum()
        first = ~out.gamma.duplicated()
        return out.assign(served=np.where(first, sums.served.reindex(out.gamma), 0.0), hours=np.where(first, sums.hours.reindex(out.gamma), 0.0))

    if "depot" not in snapshots.columns:
        snapshots = snapshots.withColumn("depot", F.lit(0).cast("long"))
    dealt = spread(snapshots.withColumn("_task", F.floor(F.col("depot") / DEPOTS)), "_task")
    nodes = dealt.groupBy("_task").applyInPandas(lambda g: run(g), "gamma double, visits long, n long, worst double, waits double, served double, hours double")
    # One row for each number of visits, of which there are no more than shifts.
    counts = nodes.groupBy("gamma", "visits").agg(F.sum("n").alias("n"), F.max("worst").alias("worst"), F.sum("waits").alias("waits"), F.sum("served").alias("served"), F.sum("hours").alias("hours"))
    before = F.sum(F.col("n") * F.col("visits")).over(Window.partitionBy("gamma").orderBy("visits")) - F.col("n") * F.col("visits")
    counts = counts.withColumn("running", F.col("n") * before + F.col("visits") * F.col("n") * (F.col("n") + 1) / 2)
    n, all_ = F.sum("n"), F.sum(F.col("n") * F.col("visits"))
    return counts.groupBy("gamma").agg(
        F.round(F.max("worst"), 1).alias("worst_wait_h"), F.round(F.sum("waits") / n, 1).alias("mean_wait_h"),
        F.coalesce(F.round(F.when(all_ > 0, (n + 1 - 2 * F.sum("running") / all_) / n), 3), F.lit(0.0)).alias("gini_visits"),
        F.coalesce(F.sum(F.when(F.col("visits") == 0, F.col("n"))), F.lit(0)).cast("int").alias("never_served"),
        F.coalesce(F.round(F.when(F.round(F.sum("served")) > 0, F.sum("hours") / F.sum("served")), 3), F.lit(0.0)).alias("mean_time_to_critical_h"), all_.cast("int").alias("total_visits"),
    )

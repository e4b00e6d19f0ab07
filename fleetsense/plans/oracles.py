"""DuckDB twins of the named queries, written on their own from the definitions."""

from __future__ import annotations

from ..functions.config import DEPOT, USER
from ..sources.views import VIEW_SQL

METRICS = ("waste_level", "gas_level", "temperature", "humidity", "traffic_density")


def hav(a, b, c, d) -> str:
    a, b, c, d = (f"coalesce({x}, 0e0)" for x in (a, b, c, d))
    return f"(12742000e0 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def clip(x) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest(0e0, least(1e0, {x})) END)"


STATE = {"waste_level": 0.35, "gas_level": 0.25, "temperature": 0.10, "humidity": 0.05}
ALL = {"distance_m": 0.25, **STATE, "traffic_density": 0.10}
NORM = {
    "distance_m": f"(1 - {clip('distance_m / 2000e0')})", "waste_level": clip("waste_level"), "gas_level": clip("gas_level"),
    "temperature": clip("abs(temperature - 25e0) / 15e0"), "humidity": clip("(humidity - 50e0) / 50e0"), "traffic_density": f"(1 - {clip('traffic_density')})",
}


def prio(weights=ALL, naive=False) -> str:
    top = " + ".join(f"coalesce({NORM[k]} * {w}e0, 0e0)" for k, w in weights.items())
    if naive:
        return clip(f"({top}) / {sum(weights.values())}e0")
    present = " + ".join(f"CASE WHEN {k} IS NULL THEN 0e0 ELSE {w}e0 END" for k, w in weights.items())
    return f"coalesce({clip(f'({top}) / nullif({present}, 0e0)')}, 0e0)"


LATEST = "latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY timestamp DESC, reading_id DESC) AS rn FROM reading) WHERE rn = 1)"
DIST = f"dist AS (SELECT *, {hav(f'{USER[0]}e0', f'{USER[1]}e0', 'latitude', 'longitude')} AS distance_m FROM node)"
SCORED = f"{LATEST}, {DIST}, joined AS (SELECT d.*, l.* EXCLUDE (node_id) FROM dist d LEFT JOIN latest l ON d.node_id = l.node_id), scored AS (SELECT *, CASE WHEN reading_id IS NULL THEN 0e0 ELSE {prio()} END AS priority FROM joined)"
HAZ = """haz AS (SELECT *, coalesce(max(CASE WHEN waste_level >= 1 OR gas_level >= 0.62e0 THEN 1 ELSE 0 END) OVER (PARTITION BY node_id ORDER BY epoch_us(timestamp) RANGE BETWEEN 1 FOLLOWING AND 21600000000 FOLLOWING), 0) AS hazard FROM reading)"""
TTO = """tto AS (SELECT *, coalesce((min(CASE WHEN waste_level >= 1 THEN epoch_us(timestamp) END) OVER (PARTITION BY node_id ORDER BY epoch_us(timestamp) RANGE BETWEEN 0 FOLLOWING AND 86400000000 FOLLOWING) - epoch_us(timestamp)) / 3600000000e0, 24e0) AS time_to_overflow FROM reading)"""
ORD = "PARTITION BY node_id ORDER BY timestamp, reading_id"
TOP = "top AS (SELECT * FROM scored ORDER BY priority DESC, node_id LIMIT {n})"
TOPG = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY priority DESC, node_id) AS rank FROM scored WHERE group_id IS NOT NULL) WHERE rank <= 6)"


def edge(alpha=0.5, traffic=True, clipped=True) -> str:
    p = clip("coalesce(b.priority, 0e0)") if clipped else "coalesce(b.priority, 0e0)"
    t = f" * (1 + coalesce({clip('b.traffic_density')}, 0e0) * 3e0)" if traffic else ""
    return f"{hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}{t} / (1 + 10 * {alpha}e0 * {p})"


def q(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([VIEW_SQL.strip(), *ctes])} {body}"


def r6(*names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def greedy(alpha: float, name: str = "walk") -> str:
    """Recursive greedy tour of each group's top nodes: the state is the path and its end."""
    cost = f"{hav('w.lat', 'w.lng', 't.latitude', 't.longitude')} / (1 + 10 * {alpha}e0 * coalesce(t.priority, 0e0))"
    return f"""{name} AS (
      SELECT DISTINCT group_id, CAST([] AS BIGINT[]) AS path, {DEPOT[0]}e0 AS lat, {DEPOT[1]}e0 AS lng, 0e0 AS cost FROM top
      UNION ALL
      SELECT group_id, path, lat, lng, cost FROM (
        SELECT w.group_id, list_append(w.path, t.node_id) AS path, coalesce(t.latitude, 0e0) AS lat, coalesce(t.longitude, 0e0) AS lng, w.cost + {cost} AS cost,
          row_number() OVER (PARTITION BY w.group_id ORDER BY {cost}, t.node_id) AS k
        FROM {name} w JOIN top t ON t.group_id = w.group_id WHERE NOT list_contains(w.path, t.node_id)) WHERE k = 1),
    {name}_tour AS (SELECT w.group_id, w.path, w.cost FROM {name} w JOIN (SELECT group_id, count(*) AS n FROM top GROUP BY 1) c ON c.group_id = w.group_id AND len(w.path) = c.n)"""


def steps(tour: str = "walk_tour") -> str:
    return f"steps AS (SELECT group_id, CAST(u.pos - 1 AS BIGINT) AS pos, path[u.pos] AS node_id FROM {tour}, unnest(range(1, len(path) + 1)) AS u(pos))"


LEG = f"""legs AS (SELECT *, {hav('plat', 'plng', 'latitude', 'longitude')} AS leg, CASE WHEN nxt IS NULL THEN {hav('latitude', 'longitude', f'{DEPOT[0]}e0', f'{DEPOT[1]}e0')} ELSE 0e0 END AS back
  FROM (SELECT *, coalesce(lag(latitude) OVER w, {DEPOT[0]}e0) AS plat, coalesce(lag(longitude) OVER w, {DEPOT[1]}e0) AS plng, lead(pos) OVER w AS nxt FROM {{src}} WINDOW w AS (PARTITION BY {{key}} ORDER BY pos)))"""

ROLL = "avg({c}) OVER f AS {c}_mean, coalesce(stddev_samp({c}) OVER f, 0e0) AS {c}_std, coalesce({c} - lag({c}, 10) OVER w, 0e0) / 10 AS {c}_trend"
SERVE = "avg({c}) OVER f AS {c}_mean, stddev_pop({c}) OVER f AS {c}_std, ({c} - first_value({c}) OVER f) / 10 AS {c}_trend"
ROLLED = [f"{c}_{s}" for c in ("waste_level", "gas_level") for s in ("mean", "std", "trend")]


def rolling(template: str) -> str:
    cols = ", ".join(template.format(c=c) for c in ("waste_level", "gas_level"))
    return f"rolled AS (SELECT *, {cols} FROM reading WINDOW w AS ({ORD}), f AS ({ORD} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"


def ago(s: str) -> str:
    f = f"CAST(floor({s}) AS BIGINT)"
    return f"CASE WHEN {s} < 60 THEN {f} || 's ago' WHEN {s} < 3600 THEN CAST(floor({s} / 60e0) AS BIGINT) || 'm ago' WHEN {s} < 86400 THEN CAST(floor({s} / 3600e0) AS BIGINT) || 'h ago' ELSE CAST(floor({s} / 86400e0) AS BIGINT) || 'd ago' END"


def status(x: str) -> str:
    return f"CASE WHEN {x} >= 0.85e0 THEN 'critical' WHEN {x} >= 0.65e0 THEN 'warning' ELSE 'normal' END"


WAITS = """waits AS (SELECT n.node_id, coalesce(l.visits, 0) AS visits, (epoch_us(m.now) - epoch_us(l.last_visit)) / 3600000000e0 AS wait_h FROM node n
  LEFT JOIN (SELECT node_id, max(visited_at) AS last_visit, count(*) AS visits FROM visit GROUP BY 1) l ON l.node_id = n.node_id CROSS JOIN (SELECT max(visited_at) AS now FROM visit) m)"""
MODES = f"""modes AS (SELECT a.node_id, round(a.p, 6) AS truth, round(b.p, 6) AS renormalised, round(b.q, 6) AS naive FROM (SELECT reading_id, node_id, {prio(STATE)} AS p FROM reading) a
  JOIN (SELECT reading_id, {prio(STATE)} AS p, {prio(STATE, True)} AS q FROM reading_obs) b ON a.reading_id = b.reading_id)"""
PERSIST = f"persist AS (SELECT * FROM (SELECT *, lag(time_to_overflow) OVER ({ORD}) AS prediction FROM tto) WHERE prediction IS NOT NULL)"


def spearman(b: str) -> str:
    return f"""(SELECT node_id, CASE WHEN var_pop(ra) > 0 AND var_pop(rb) > 0 THEN corr(ra, rb) END AS rho FROM (
      SELECT node_id, rank() OVER (PARTITION BY node_id ORDER BY truth) + (count(*) OVER (PARTITION BY node_id, truth) - 1) / 2e0 AS ra,
        rank() OVER (PARTITION BY node_id ORDER BY {b}) + (count(*) OVER (PARTITION BY node_id, {b}) - 1) / 2e0 AS rb FROM modes) GROUP BY 1)"""


def auc(s: str) -> str:
    return f"""(SELECT (sum(r * hazard) - sum(hazard) * (sum(hazard) + 1) / 2e0) / (sum(hazard) * CAST(sum(1 - hazard) AS DOUBLE)) AS a FROM (
      SELECT hazard, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2e0 AS r FROM haz))"""


INTERP = "CASE WHEN {c} IS NOT NULL THEN {c} WHEN ap_{c} IS NULL THEN NULL WHEN bp_{c} IS NULL THEN av_{c} ELSE av_{c} + (bv_{c} - av_{c}) * (p - ap_{c}) / CAST(bp_{c} - ap_{c} AS DOUBLE) END"
ENDS = """last_value(CASE WHEN {c} IS NOT NULL THEN p END IGNORE NULLS) OVER b AS ap_{c}, last_value({c} IGNORE NULLS) OVER b AS av_{c},
  first_value(CASE WHEN {c} IS NOT NULL THEN p END IGNORE NULLS) OVER a AS bp_{c}, first_value({c} IGNORE NULLS) OVER a AS bv_{c}"""
PAYLOAD = """payload AS (SELECT event_id AS reading_id,
  CASE WHEN event_id % 3 <> 0 THEN user_id END AS want_id, CASE WHEN event_id % 3 = 0 THEN 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') END AS want_name,
  CASE WHEN event_id % 4 = 1 THEN CAST(18 + event_id % 23 AS DOUBLE) ELSE 25e0 END AS temperature, CASE WHEN event_id % 5 <> 0 THEN CAST(45 + event_id % 51 AS DOUBLE) ELSE 60e0 END AS humidity,
  (event_id % 30) / 20e0 AS gas_level, CASE WHEN event_id % 7 <> 0 THEN (event_id % 25) / 20e0 ELSE 0e0 END AS waste_level FROM events)"""
SNAP = f"snap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY timestamp DESC, reading_id DESC) AS rn FROM reading WHERE timestamp <= (SELECT min(timestamp) + INTERVAL 10 DAY FROM reading)) WHERE rn = 1)"
SWEEP = " UNION ALL ".join(
    f"SELECT {a}e0 AS alpha, round(avg(m) / 1000, 4) AS mean_km FROM (SELECT group_id, sum(leg + back) AS m FROM legs{i} GROUP BY 1)" for i, a in enumerate((0.0, 0.25, 0.5, 1.0, 2.0, 4.0))
)
SWEEP_CTES = [
    x
    for i, a in enumerate((0.0, 0.25, 0.5, 1.0, 2.0, 4.0))
    for x in (
        greedy(a, f"walk{i}"),
        steps(f"walk{i}_tour").replace("steps AS", f"steps{i} AS"),
        f"stops{i} AS (SELECT s.*, t.latitude, t.longitude FROM steps{i} s JOIN top t ON t.group_id = s.group_id AND t.node_id = s.node_id)",
        LEG.format(src=f"stops{i}", key="group_id").replace("legs AS", f"legs{i} AS", 1),
    )
]

ORACLES = {
    "latest_reading_per_node": q(f"SELECT node_id, reading_id, timestamp, {r6('waste_level', 'gas_level')} FROM latest", LATEST),
    "latest_reading_left_nodes": q("SELECT n.node_id, node_name, group_name, reading_id, round(waste_level, 6) AS waste_level FROM node n LEFT JOIN bin_group g ON n.group_id = g.group_id LEFT JOIN latest l ON l.node_id = n.node_id", LATEST),
    "last10_pop_stats": q("SELECT node_id, count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in METRICS) + " FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY timestamp DESC, reading_id DESC) AS rn FROM reading) WHERE rn <= 10 GROUP BY 1"),
    "haversine_from_user": q("SELECT node_id, round(distance_m, 4) AS distance_m FROM dist", DIST),
    "priority_renormalised": q(f"SELECT reading_id, r.node_id, round({prio()}, 6) AS priority FROM reading_obs r JOIN dist d ON d.node_id = r.node_id", DIST),
    "priority_naive_zero_fill": q(f"SELECT reading_id, round({prio(STATE, True)}, 6) AS naive, round({prio(STATE)}, 6) AS renormalised FROM reading_obs"),
    "priority_weighted_state": q(
        f"""SELECT reading_id, round({clip(f"0.2e0 * (1 - {clip('distance_m / 2000e0')}) + 0.4e0 * coalesce({clip('waste_level')}, 0e0) + 0.3e0 * coalesce({clip('gas_level')}, 0e0) + 0.1e0 * (0.5e0 * {clip('abs(coalesce(temperature, 0e0) - 25e0) / 10e0')} + 0.5e0 * {clip('(coalesce(humidity, 0e0) - 50e0) / 40e0')})")}, 6) AS priority
        FROM reading_obs r JOIN dist d ON d.node_id = r.node_id""", DIST),
    "priority_weighted_target": q(f"SELECT reading_id, round(0.20e0 * {NORM['distance_m']} + 0.30e0 * {NORM['waste_level']} + 0.20e0 * {NORM['gas_level']} + 0.10e0 * {NORM['temperature']} + 0.05e0 * {NORM['humidity']} + 0.15e0 * {NORM['traffic_density']}, 6) AS priority FROM reading r JOIN dist d ON d.node_id = r.node_id", DIST),
    "priority_circular": q(f"SELECT reading_id, round((0.35e0 * {NORM['waste_level']} + 0.25e0 * {NORM['gas_level']} + 0.10e0 * {NORM['temperature']} + 0.05e0 * {NORM['humidity']}) / 0.75e0, 6) AS priority FROM reading"),
    "top_n_priority": q("SELECT node_id, node_name, round(priority, 6) AS priority, round(distance_m, 4) AS distance_m FROM scored ORDER BY scored.priority DESC, node_id LIMIT 5", SCORED),
    "top_n_priority_in_group": q("SELECT group_id, group_name, rank, node_id, round(priority, 6) AS priority FROM (SELECT s.*, g.group_name, row_number() OVER (PARTITION BY s.group_id ORDER BY priority DESC, node_id) AS rank FROM scored s JOIN bin_group g ON s.group_id = g.group_id) WHERE rank <= 3", SCORED),
    "edges_distance": q(f"SELECT a.node_id AS u, b.node_id AS v, round({hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}, 4) AS distance_m FROM top a JOIN top b ON a.node_id <> b.node_id", SCORED, TOP.format(n=15)),
    "edges_priority_traffic": q(f"SELECT a.node_id AS u, b.node_id AS v, round({edge()}, 4) AS cost, round({edge(traffic=False, clipped=False)}, 4) AS cost_plain FROM top a JOIN top b ON a.node_id <> b.node_id", SCORED, TOP.format(n=15)),
    "risk_and_aging_scalars": q(f"SELECT reading_id, round(waste_level + 0.5e0 * least(1e0, (reading_id % 100) / 48e0), 6) AS aged, round(greatest(gas_level, 1 - {clip('(reading_id % 40) / 24e0')}), 6) AS risk, round(temperature * 1.05e0, 6) AS co2_kg, round(temperature / 20e0, 6) AS travel_h FROM reading"),
    "diurnal_curves": q("SELECT reading_id, round((0.6e0 + 0.7e0 * exp(-pow(t % 24 - 9, 2) / 8e0) + 0.9e0 * exp(-pow(t % 24 - 20, 2) / 6e0)) * CASE WHEN (t // 24) % 7 >= 5 THEN 1.35e0 ELSE 1e0 END, 6) AS demand, round(28 + 4 * sin(2 * pi() * (t / 24e0 - 120) / 365e0) + 5 * sin(2 * pi() * (t % 24 - 9) / 24e0), 6) AS ambient FROM (SELECT reading_id, reading_id % 5000 AS t FROM reading)"),
    "dashboard_stats": q("SELECT n AS nodes, c AS critical, w AS warning, n - c - w AS normal, mean_fill_pct FROM (SELECT count(*) AS n FROM node), (SELECT count(*) FILTER (waste_level >= 0.85e0) AS c, count(*) FILTER (waste_level >= 0.65e0 AND waste_level < 0.85e0) AS w, coalesce(round(avg(coalesce(waste_level, 0e0)) * 100, 1), 0e0) AS mean_fill_pct FROM latest)", LATEST),
    "status_by_group": q(f"SELECT coalesce(group_name, '(none)') AS group_name, {status('coalesce(waste_level, 0e0)')} AS status, CASE WHEN coalesce(waste_level, 0e0) > 0.8e0 THEN 'critical' WHEN coalesce(waste_level, 0e0) > 0.6e0 THEN 'high' ELSE 'normal' END AS status_strict, count(*) AS nodes FROM node n LEFT JOIN bin_group g ON n.group_id = g.group_id LEFT JOIN latest l ON l.node_id = n.node_id GROUP BY 1, 2, 3", LATEST),
    "notifications_list": q("SELECT notification_id, level, is_read, created_at FROM notification WHERE user_id = 3 ORDER BY created_at DESC, notification_id DESC LIMIT 50"),
    "notifications_broadcast_critical": q("SELECT notification_id, level, is_read, created_at FROM notification WHERE (user_id = 3 OR user_id IS NULL) AND level = 'CRITICAL' ORDER BY created_at DESC, notification_id DESC LIMIT 20"),
    "unread_count": q("SELECT count(*) AS unread FROM notification WHERE user_id = 3 AND NOT is_read"),
    "mark_all_read": q("SELECT CASE WHEN user_id = 3 THEN TRUE ELSE is_read END AS is_read, count(*) AS rows FROM notification GROUP BY 1"),
    "derived_alerts": q(f"SELECT node_id, CASE WHEN s = 'critical' THEN 'CRITICAL' ELSE 'WARN' END AS level, 'Node ' || node_id || ' is ' || s AS message, timestamp AS created_at FROM (SELECT *, {status('waste_level')} AS s FROM latest) WHERE s <> 'normal'", LATEST),
    "newest_readings": q("SELECT reading_id, node_name, timestamp, round(waste_level, 6) AS waste_level FROM reading r JOIN node n ON n.node_id = r.node_id ORDER BY timestamp DESC, reading_id DESC LIMIT 10"),
    "latest_visit_route": q("SELECT visit_id, node_id, visited_at FROM visit ORDER BY visited_at DESC, visit_id DESC LIMIT 1"),
    "resolve_ingest": q(f"SELECT p.reading_id, coalesce(a.node_id, b.node_id) AS node_id, {r6('temperature', 'humidity')}, round({clip('gas_level')}, 6) AS gas_level, round({clip('waste_level')}, 6) AS waste_level, 0e0 AS traffic_density FROM payload p LEFT JOIN node a ON a.node_id = p.want_id LEFT JOIN node b ON b.node_name = p.want_name WHERE coalesce(a.node_id, b.node_id) IS NOT NULL", PAYLOAD),
    "ensure_node_upsert": q("""SELECT coalesce(n.node_id, (SELECT max(node_id) FROM node) + dense_rank() OVER (PARTITION BY n.node_id IS NULL ORDER BY coalesce(n.node_name, w.node_name))) AS node_id, coalesce(n.node_name, w.node_name) AS node_name,
        round(coalesce(n.latitude, w.lat), 6) AS latitude, round(coalesce(n.longitude, w.lng), 6) AS longitude FROM node n FULL JOIN want w ON n.node_name = w.node_name""",
        "want AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') ELSE 'Point#' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') END AS node_name, 23.9e0 AS lat, 90e0 + s_suppkey / 1000e0 AS lng FROM supplier)"),
    "relocate_merge": q("SELECT node_id, CASE WHEN node_id % 10 = 5 THEN 'Moved ' || node_id ELSE node_name END AS node_name, round(CASE WHEN node_id % 10 = 5 THEN 23.5e0 ELSE latitude END, 6) AS latitude, round(longitude, 6) AS longitude FROM node WHERE NOT starts_with(node_name, 'Customer#00000001')"),
    "validated_locations": q(f"SELECT node_id, (latitude IS NULL) <> (longitude IS NULL) AS half_given, latitude IS NOT NULL AND longitude IS NOT NULL AS has_location, latitude IS NOT NULL AND longitude IS NOT NULL AND coalesce(latitude BETWEEN -90 AND 90, FALSE) AND coalesce(longitude BETWEEN -180 AND 180, FALSE) AS in_range, coalesce(nullif(latitude, 0e0), {USER[0]}e0) AS lat_or_saved FROM node"),
    "table_counts": q(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in ("node", "reading", "bin_group", "notification", "visit"))),
    "nested_node_documents": q("SELECT n.node_id, group_name, reading_id FROM node n LEFT JOIN bin_group g ON g.group_id = n.group_id LEFT JOIN latest l ON l.node_id = n.node_id", LATEST),
    "groups_with_critical": q("SELECT group_id, group_name FROM bin_group g WHERE EXISTS (SELECT 1 FROM latest l JOIN node n ON n.node_id = l.node_id WHERE l.waste_level >= 0.85e0 AND n.group_id = g.group_id)", LATEST),
    "relative_time_bucket": q(f"SELECT notification_id, {ago('s')} AS ago, CASE WHEN s < 60 THEN 'Just now' ELSE {ago('s')} END AS ago_short FROM (SELECT notification_id, (epoch_us(max(created_at) OVER ()) - epoch_us(created_at)) / 1000000e0 AS s FROM notification)"),
    "bin_label_regex": q("""SELECT node_id, coalesce(nullif(regexp_extract(nm, '(Bin-[A-F])', 1), ''), 'B' || node_id) AS label, upper(substr(trim(nm), 1, 1) || substr(trim(nm), 1, 1)) AS initials,
        array_to_string(list_transform(string_split(lower(nm), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS shown FROM (SELECT node_id, CASE WHEN node_id % 4 = 0 THEN 'x Bin-' || chr(CAST(65 + node_id % 8 AS INTEGER)) ELSE node_name END AS nm FROM node)"""),
    "score_classes": q("SELECT CASE WHEN priority >= 0.7e0 THEN 'high' WHEN priority >= 0.4e0 THEN 'medium' ELSE 'low' END AS score_class, count(*) AS nodes FROM scored GROUP BY 1", SCORED),
    "time_parts": q("SELECT CAST(hour(timestamp) AS INTEGER) AS hour, CAST(isodow(timestamp) - 1 AS INTEGER) AS dow, count(*) AS n FROM reading GROUP BY 1, 2"),
    "rolling_features_train": q(f"SELECT reading_id, CAST(hour(timestamp) AS INTEGER) AS hour, CAST(isodow(timestamp) - 1 AS INTEGER) AS dow, {r6(*ROLLED)} FROM rolled", rolling(ROLL)),
    "rolling_features_serve": q(f"SELECT reading_id, {r6(*ROLLED)} FROM rolled", rolling(SERVE)),
    "label_hazard_6h": q("SELECT reading_id, hazard FROM haz", HAZ),
    "label_time_to_overflow": q("SELECT reading_id, round(time_to_overflow, 6) AS time_to_overflow FROM tto", TTO),
    "label_rows_hazard": q(f"SELECT reading_id, coalesce(max(CASE WHEN waste_level >= 1 OR gas_level >= 0.62e0 THEN 1 ELSE 0 END) OVER ({ORD} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), 0) AS hazard FROM reading"),
    "label_rows_tto": q(f"SELECT reading_id, coalesce(CAST(min(CASE WHEN waste_level >= 1 THEN t END) OVER ({ORD} ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) - t AS DOUBLE), 24e0) AS time_to_overflow FROM (SELECT *, row_number() OVER ({ORD}) AS t FROM reading)"),
    "forward_fill": q("SELECT reading_id, " + ", ".join(f"round(last_value({c} IGNORE NULLS) OVER ({ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS {c}" for c in METRICS) + " FROM reading_obs"),
    "resample_interpolate": q(
        f"SELECT node_id, bucket, round({INTERP.format(c='waste_level')}, 6) AS waste_level, round({INTERP.format(c='gas_level')}, 6) AS gas_level FROM ends",
        "hours AS (SELECT node_id, date_trunc('hour', timestamp) AS bucket, avg(waste_level) AS waste_level, avg(gas_level) AS gas_level FROM reading_obs GROUP BY 1, 2)",
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY bucket) AS p FROM hours WHERE hour(bucket) % 3 <> 0 OR waste_level IS NOT NULL)",
        f"ends AS (SELECT *, {ENDS.format(c='waste_level')}, {ENDS.format(c='gas_level')} FROM numbered WINDOW b AS (PARTITION BY node_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY node_id ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
    ),
    "elapsed_hours": q("SELECT reading_id, round((epoch_us(timestamp) - min(epoch_us(timestamp)) OVER (PARTITION BY node_id)) / 3600000000e0, 6) AS elapsed_h FROM reading"),
    "group_percentile_threshold": q("SELECT node_id, round(quantile_cont(gas_level, 0.95), 6) AS threshold FROM reading GROUP BY 1"),
    "temporal_split_group": q(f"SELECT node_id, count(*) FILTER (k <= floor(n * 0.8e0)) AS train, count(*) FILTER (k > floor(n * 0.8e0)) AS test FROM (SELECT node_id, row_number() OVER ({ORD}) AS k, count(*) OVER (PARTITION BY node_id) AS n FROM reading) GROUP BY 1"),
    "temporal_split_global": q("SELECT epoch_us(timestamp) <= (SELECT quantile_cont(CAST(epoch_us(timestamp) AS DOUBLE), 0.8) FROM reading) AS is_train, count(*) AS rows FROM reading GROUP BY 1"),
    "point_in_time_snapshot": q(f"SELECT node_id, reading_id, timestamp, round({prio(STATE)}, 6) AS priority FROM snap", SNAP),
    "hazard_load_top40": q("SELECT date_trunc('hour', timestamp) AS bucket, CAST(sum(hazard) AS BIGINT) AS load FROM haz GROUP BY 1 ORDER BY load DESC, bucket DESC LIMIT 40", HAZ),
    "aging_prize": q("SELECT s.node_id, round(priority + 0.5e0 * least(1e0, coalesce(wait_h, 0e0) / 48e0), 6) AS prize FROM scored s JOIN waits w ON w.node_id = s.node_id", SCORED, WAITS),
    "last_visit_wait_stats": q("SELECT round(max(wait_h), 4) AS worst_wait_h, round(avg(wait_h), 4) AS mean_wait_h, count(*) FILTER (visits = 0) AS never_served, CAST(sum(visits) AS BIGINT) AS total_visits FROM waits", WAITS),
    "never_visited": q("SELECT node_id, node_name FROM node n WHERE NOT EXISTS (SELECT 1 FROM visit v WHERE v.node_id = n.node_id)"),
    "gini_visits": q("SELECT round(CASE WHEN sum(x) = 0 THEN 0e0 ELSE (count(*) + 1 - 2 * sum(cum) / sum(x)) / count(*) END, 6) AS gini FROM (SELECT CAST(visits AS DOUBLE) AS x, sum(CAST(visits AS DOUBLE)) OVER (ORDER BY visits, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM waits)", WAITS),
    "spearman_priority_modes": q(f"SELECT a.node_id, round(a.rho, 6) AS rho_renormalised, round(b.rho, 6) AS rho_naive FROM {spearman('renormalised')} a JOIN {spearman('naive')} b ON a.node_id = b.node_id", MODES),
    "mae_missingness": q("SELECT round(a, 6) AS mae_renormalised, round(b, 6) AS mae_naive, round(100 * (1 - a / greatest(b, 1e-9)), 4) AS reduction_pct FROM (SELECT avg(abs(truth - renormalised)) AS a, avg(abs(truth - naive)) AS b FROM modes)", MODES),
    "auc_baselines": q(f"SELECT round((SELECT a FROM {auc('waste_level')}), 6) AS auc_waste, round((SELECT a FROM {auc('gas_level')}), 6) AS auc_gas", HAZ),
    "average_precision": q("SELECT round(sum(p * tp / CAST(seen AS DOUBLE)) / sum(p), 6) AS average_precision FROM (SELECT p, sum(p) OVER (ORDER BY gas_level DESC) AS tp, sum(n) OVER (ORDER BY gas_level DESC) AS seen FROM (SELECT gas_level, sum(hazard) AS p, count(*) AS n FROM haz GROUP BY 1))", HAZ),
    "brier": q("SELECT round(avg(pow(gas_level - hazard, 2)), 6) AS brier FROM haz", HAZ),
    "reliability_curve": q("SELECT CAST(len(list_filter(e, lambda x: x < waste_level)) AS BIGINT) AS bin, count(*) AS n, round(avg(waste_level), 6) AS mean_score, round(avg(hazard), 6) AS rate FROM haz, (SELECT quantile_cont(waste_level, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM haz) GROUP BY 1", HAZ),
    "regression_metrics_persistence": q("SELECT round(1 - sum(pow(time_to_overflow - prediction, 2)) / (var_pop(time_to_overflow) * count(*)), 6) AS r2, round(avg(abs(time_to_overflow - prediction)), 6) AS mae, round(avg(pow(time_to_overflow - prediction, 2)), 6) AS mse FROM persist", TTO, PERSIST),
    "interval_coverage": q("SELECT round(avg(CASE WHEN time_to_overflow BETWEEN prediction - 6 AND prediction + 6 THEN 1e0 ELSE 0e0 END), 6) AS coverage FROM persist", TTO, PERSIST),
    "tour_length": q("SELECT tour_id, count(*) AS stops, round(sum(leg + back), 4) AS distance_m FROM legs GROUP BY 1", LEG.format(src="stop", key="tour_id")),
    "arrival_times": q("SELECT tour_id, pos, round(sum(leg) OVER (PARTITION BY tour_id ORDER BY pos) / 1000e0 / 20e0, 6) AS arrival_h FROM legs", LEG.format(src="stop", key="tour_id")),
    "greedy_route": q("SELECT group_id, array_to_string(path, ',') AS path, round(cost, 4) AS cost FROM walk_tour", SCORED, TOPG, greedy(1.0), recursive=True),
    "route_edges": q(f"SELECT s.group_id, CAST(s.pos AS INTEGER) AS pos, s.node_id AS u, s.nxt AS v, round({edge()}, 4) AS w FROM (SELECT *, lead(node_id) OVER (PARTITION BY group_id ORDER BY pos) AS nxt FROM steps) s JOIN top a ON a.group_id = s.group_id AND a.node_id = s.node_id JOIN top b ON b.group_id = s.group_id AND b.node_id = s.nxt", SCORED, TOPG, greedy(1.0), steps(), recursive=True),
    "tour_metrics_co2": q(
        """SELECT group_id, round(sum(leg + back) / 1000, 3) AS distance_km, round(sum(leg + back) / 1000 * 1.05e0, 3) AS co2_kg, count(*) AS n_visited, count(*) FILTER (critical) AS n_critical_served,
        round(coalesce(avg(arr) FILTER (critical), 0e0), 3) AS mean_time_to_critical_h, round(coalesce(max(arr) FILTER (critical), 0e0), 3) AS worst_time_to_critical_h, count(*) FILTER (critical AND arr > tto) AS missed_overflow
        FROM (SELECT *, sum(leg) OVER (PARTITION BY group_id ORDER BY pos) / 1000e0 / 20e0 AS arr FROM legs) GROUP BY 1""",
        SCORED, TOPG, greedy(1.0), steps(), "stops AS (SELECT s.*, t.latitude, t.longitude, coalesce(t.waste_level, 0e0) >= 0.65e0 AS critical, 1e0 - coalesce(t.waste_level, 0e0) AS tto FROM steps s JOIN top t ON t.group_id = s.group_id AND t.node_id = s.node_id)",
        LEG.format(src="stops", key="group_id"), recursive=True),
    "alpha_sweep": q(SWEEP, SCORED, TOPG, *SWEEP_CTES, recursive=True),
    "shortest_paths_small": q(
        "SELECT source, node, array_to_string(path, ',') AS path, round(dist, 4) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY source, node ORDER BY dist, path) AS k FROM walks) WHERE k = 1",
        SCORED, TOP.format(n=6), f"e AS (SELECT a.node_id AS u, b.node_id AS v, {edge()} AS cost FROM top a JOIN top b ON a.node_id <> b.node_id)",
        "walks AS (SELECT node_id AS source, node_id AS node, 0e0 AS dist, [node_id] AS path FROM top UNION ALL SELECT w.source, e.v, w.dist + e.cost, list_append(w.path, e.v) FROM walks w JOIN e ON e.u = w.node WHERE NOT list_contains(w.path, e.v))", recursive=True),
    "stream_latest_state": q("SELECT node_id, reading_id, timestamp, round(waste_level, 6) AS waste_level FROM latest", LATEST),
    "stream_windows": q("SELECT date_trunc('day', timestamp) AS start, count(*) AS n, round(avg(waste_level), 6) AS mean_waste, round(max(waste_level), 6) AS max_waste FROM reading GROUP BY 1 HAVING date_trunc('day', min(timestamp)) + INTERVAL 1 DAY <= (SELECT max(timestamp) - INTERVAL 1 HOUR FROM reading)"),
    "nation_region_rollup": q("SELECT region_id, g.group_id, count(*) AS nodes, round(avg(waste_level), 6) AS mean_waste FROM bin_group g JOIN node n ON n.group_id = g.group_id JOIN latest l ON l.node_id = n.node_id GROUP BY ROLLUP (region_id, g.group_id)", LATEST),
}
ORACLES |= {
    "ingest_raw_readings": q("SELECT event_id AS reading_id, user_id AS node_id, CAST(event_id % 40 AS DOUBLE) AS temperature, round((event_id % 50) / 20e0, 6) AS gas_level, round(CASE WHEN event_id % 6 <> 0 THEN (event_id % 30) / 20e0 ELSE 0e0 END, 6) AS waste_level FROM events WHERE event_id % 9 <> 0"),
    "facet_filters": q("SELECT node_id, group_name, group_name || CASE WHEN latitude IS NULL THEN ' - null' ELSE ' - ' || printf('%.2f', latitude) END AS shown FROM node n JOIN bin_group g ON n.group_id = g.group_id WHERE lower(group_name) IN ('france', 'china', 'peru') OR group_name LIKE 'IN%' OR node_name LIKE '%99%'"),
    "nodes_by_name_any_case": q("SELECT node_id, node_name FROM node WHERE node_name ILIKE 'customer#000000007'"),
    "urgent_candidates": q(f"SELECT node_id, round(p, 6) AS priority FROM (SELECT node_id, {prio(STATE)} AS p FROM latest) WHERE p >= 0.5e0", LATEST),
    "dropna_counts": q("SELECT node_id, count(*) AS rows, count(DISTINCT humidity) AS humidities FROM reading_obs WHERE waste_level IS NOT NULL AND gas_level IS NOT NULL GROUP BY 1"),
    "sampled_timestamps": q("SELECT reading_id, timestamp FROM reading WHERE timestamp >= (SELECT min(timestamp) + INTERVAL 50 HOUR FROM reading) ORDER BY md5(CAST(reading_id AS VARCHAR) || '/7'), reading_id LIMIT 400"),
    "sampled_peak_hours": q("SELECT bucket, load FROM (SELECT date_trunc('hour', timestamp) AS bucket, CAST(sum(hazard) AS BIGINT) AS load FROM haz GROUP BY 1 ORDER BY load DESC, bucket DESC LIMIT 40) ORDER BY md5(strftime(bucket, '%Y-%m-%d %H')), bucket LIMIT 25", HAZ),
    "iso_times": q("SELECT reading_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(timestamp, '%Y%m%d') AS version, CASE WHEN reading_id % 5 <> 0 THEN (1700000000 + reading_id) * 1000000 END AS parsed_us FROM reading"),
    "radar_values": q(f"SELECT reading_id, round({clip('waste_level')} * 100, 1) AS fill, round({clip('gas_level')} * 100, 1) AS gas, round({NORM['temperature']} * 100, 1) AS temperature, round({NORM['humidity']} * 100, 1) AS humidity FROM reading"),
    "simulated_calendar": q("SELECT reading_id, reading_id % 4000 % 24 AS hour, (reading_id % 4000) // 24 % 7 AS dow, (reading_id % 4000) // 24 % 7 >= 5 AS weekend FROM reading"),
    "running_longest_gap": q("SELECT visit_id, round(max(gap) OVER (PARTITION BY node_id ORDER BY visited_at, visit_id), 4) AS longest_h FROM (SELECT *, coalesce((epoch_us(visited_at) - lag(epoch_us(visited_at)) OVER (PARTITION BY node_id ORDER BY visited_at, visit_id)) / 3600000000e0, 0e0) AS gap FROM visit)"),
    "stop_pairs": q("SELECT * FROM (SELECT tour_id, pos, stop_id, lead(stop_id) OVER (PARTITION BY tour_id ORDER BY pos) AS next_id FROM stop) WHERE next_id IS NOT NULL"),
    "path_arrays": q("""SELECT tour_id, array_to_string(list_reverse(p), ',') AS reversed, array_to_string(p[1:2], ',') AS head, array_to_string(list_prepend(0, p), ',') AS inserted, list_contains(p, 5) AS has_five,
        array_to_string(list_sort(list_filter(list_distinct(p), lambda x: x <> p[1])), ',') AS others, TRUE AS permutation FROM (SELECT tour_id, list(stop_id ORDER BY pos) AS p FROM stop GROUP BY 1)"""),
    "route_stop_labels": q("SELECT s.group_id, s.pos, coalesce(n.node_name, 'Node ' || s.node_id) AS name, round(coalesce(l.waste_level, 0e0), 6) AS waste_level FROM steps s LEFT JOIN latest l ON l.node_id = s.node_id LEFT JOIN node n ON n.node_id = l.node_id", SCORED, TOPG, greedy(1.0), steps(), recursive=True),
    "route_documents": q(
        f"""SELECT w.group_id, CAST(len(w.path) AS BIGINT) AS stops, CAST(len(w.path) - 1 AS BIGINT) AS edges, round(coalesce(e.s, 0e0), 3) AS edge_sum, round(t.priority, 6) AS first_priority, {USER[0]}e0 AS lat, round(w.cost, 4) AS total_cost FROM walk_tour w
        JOIN top t ON t.group_id = w.group_id AND t.node_id = w.path[1] LEFT JOIN (SELECT s.group_id, sum({edge()}) AS s FROM (SELECT *, lead(node_id) OVER (PARTITION BY group_id ORDER BY pos) AS nxt FROM steps) s
          JOIN top a ON a.group_id = s.group_id AND a.node_id = s.node_id JOIN top b ON b.group_id = s.group_id AND b.node_id = s.nxt GROUP BY 1) e ON e.group_id = w.group_id""",
        SCORED, TOPG, greedy(1.0), steps(), recursive=True),
    "prediction_documents": q(f"SELECT node_id, round(gas_level, 6) AS gas, -1e0 AS missing, round({prio(STATE)}, 6) AS predicted_cost, 'rule-1' AS model_version FROM latest", LATEST),
    "rule_without_models": q(f"SELECT n.node_id, round(coalesce(p, 0e0), 6) AS priority FROM node n LEFT JOIN (SELECT node_id, {prio(STATE)} AS p FROM latest) l ON l.node_id = n.node_id", LATEST),
}
ORACLES |= {
    "distance_tree": q(
        "SELECT group_id AS route_id, node AS node_id, round(min(dist), 4) AS dist FROM walks GROUP BY 1, 2", SCORED, TOPG,
        f"""walks AS (SELECT group_id, node_id AS node, 0e0 AS dist, [node_id] AS path FROM top WHERE rank = 1 UNION ALL
        SELECT w.group_id, b.node_id, w.dist + {edge()}, list_append(w.path, b.node_id) FROM walks w JOIN top a ON a.group_id = w.group_id AND a.node_id = w.node JOIN top b ON b.group_id = w.group_id WHERE NOT list_contains(w.path, b.node_id))""", recursive=True),
    "route_users": q("SELECT w.group_id, w.user_id, coalesce(s.s_name, 'system') AS user_name, stops FROM (SELECT group_id, CAST(len(path) AS BIGINT) AS stops, CASE WHEN group_id % 4 <> 3 THEN group_id + 1 END AS user_id FROM walk_tour) w LEFT JOIN supplier s ON s.s_suppkey = w.user_id", SCORED, TOPG, greedy(1.0), recursive=True),
    "location_errors": q("""SELECT node_id, concat_ws('; ', CASE WHEN lat IS NULL AND lng IS NULL THEN 'location is missing' WHEN lat IS NULL THEN 'latitude is missing' WHEN lng IS NULL THEN 'longitude is missing' END,
        CASE WHEN abs(lat) > 90 THEN 'latitude must be within 90 degrees' END, CASE WHEN abs(lng) > 180 THEN 'longitude must be within 180 degrees' END) AS error
        FROM (SELECT node_id, CASE WHEN node_id % 7 = 0 THEN NULL WHEN node_id % 11 = 0 THEN 95e0 ELSE latitude END AS lat, CASE WHEN node_id % 5 = 0 THEN NULL WHEN node_id % 17 = 0 THEN -181e0 ELSE longitude END AS lng FROM node)"""),
    "relocate_or_create": q("""SELECT node_id, CASE WHEN moved THEN new_name ELSE node_name END AS node_name, round(CASE WHEN moved THEN 23.5e0 ELSE latitude END, 6) AS latitude, round(CASE WHEN moved THEN 90.5e0 ELSE longitude END, 6) AS longitude
        FROM (SELECT n.*, node_id % 10 = 5 AND node_id % 3 <> 0 AS moved, 'Moved ' || lpad(CAST(node_id AS VARCHAR), 9, '0') AS new_name FROM node n WHERE NOT starts_with(node_name, 'Customer#00000001'))
        UNION ALL SELECT (SELECT max(node_id) FROM node) + row_number() OVER (ORDER BY new_name), new_name, 23.5e0, 90.5e0 FROM (
          SELECT 'Moved ' || lpad(CAST(node_id AS VARCHAR), 9, '0') AS new_name FROM node WHERE node_id % 10 = 5 AND (node_id % 3 = 0 OR starts_with(node_name, 'Customer#00000001')))"""),
    "mark_one_read": q("SELECT is_read OR notification_id = (SELECT min(notification_id) FROM notification WHERE NOT is_read) AS is_read, count(*) AS rows FROM notification GROUP BY 1"),
    "all_nodes_ranked": q("SELECT node_id, round(priority, 6) AS priority FROM scored", SCORED),
    "csv_readings": q("SELECT CAST(node_id AS VARCHAR) AS node, date_trunc('second', timestamp) AS timestamp, temperature, humidity, round(gas_level, 6) AS gas_level FROM reading"),
    "fixture_nodes": q("SELECT node_id AS pk, node_name AS name, round(latitude, 6) AS latitude FROM node"),
    "cached_features": q("SELECT reading_id, round(waste_level_mean, 6) AS waste_level_mean, round(gas_level_std, 6) AS gas_level_std FROM rolled", rolling(ROLL)),
    "json_result": ORACLES["status_by_group"],
    "demo_rows": "SELECT * FROM (VALUES (1::BIGINT, 'North gate', 0.91e0, 'critical'), (2, 'Market', 0.70e0, 'warning'), (3, 'Harbour', 0.12e0, 'normal')) v(node_id, node_name, waste_level, status)",
    "stream_ingest": ORACLES["resolve_ingest"],
    "stream_fill_machine": q(
        "SELECT node_id, round(fill, 6) AS fill, emptied FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY k DESC) AS last FROM m) WHERE last = 1",
        "o AS (SELECT node_id, waste_level, row_number() OVER (PARTITION BY node_id ORDER BY timestamp, reading_id) AS k FROM reading)",
        """m AS (SELECT DISTINCT node_id, CAST(0 AS BIGINT) AS k, 0e0 AS fill, CAST(0 AS BIGINT) AS emptied FROM o UNION ALL
        SELECT m.node_id, o.k, CASE WHEN m.fill + o.waste_level >= 0.98e0 THEN 0e0 ELSE m.fill + o.waste_level END, m.emptied + CASE WHEN m.fill + o.waste_level >= 0.98e0 THEN 1 ELSE 0 END FROM m JOIN o ON o.node_id = m.node_id AND o.k = m.k + 1)""", recursive=True),
    "stream_sliding_windows": q("""SELECT start, count(*) AS n, round(avg(waste_level), 6) AS mean_waste, round(max(waste_level), 6) AS max_waste FROM (
        SELECT waste_level, time_bucket(INTERVAL 6 HOUR, timestamp) - to_hours(CAST(6 * i AS INTEGER)) AS start FROM reading, range(4) r(i)) GROUP BY 1 HAVING start + INTERVAL 1 DAY <= (SELECT max(timestamp) - INTERVAL 1 HOUR FROM reading)"""),
    "stream_sessions": q("""SELECT node_id, min(timestamp) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY node_id ORDER BY timestamp, reading_id ROWS UNBOUNDED PRECEDING) AS session FROM (
        SELECT *, CASE WHEN epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY node_id ORDER BY timestamp, reading_id) <= 43200000000 THEN 0 ELSE 1 END AS fresh FROM reading))
        GROUP BY node_id, session HAVING max(timestamp) + INTERVAL 12 HOUR <= (SELECT max(timestamp) - INTERVAL 1 HOUR FROM reading)"""),
}

"""DuckDB twins of the queries over networks and long histories."""

from __future__ import annotations

from ..functions.config import DEPOT
from .oracles import LATEST, ORACLES, clip, hav, prio, q, r6

_NEAR = f"""placed AS (SELECT * FROM node WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
pairs AS (SELECT a.node_id, b.node_id AS neighbour, round({hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}, 3) AS distance_m FROM placed a JOIN placed b ON a.node_id <> b.node_id),
near AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY distance_m, neighbour) AS rank FROM pairs QUALIFY rank <= 8)"""
_EDGE = """edge AS (SELECT u, v, min(w) AS w FROM (SELECT node_id AS u, neighbour AS v, distance_m AS w FROM near UNION ALL SELECT neighbour, node_id, distance_m FROM near) GROUP BY u, v),
src AS (SELECT DISTINCT min(node_id) AS node FROM placed JOIN bin_group USING (group_id) GROUP BY region_id),
way(source, node, dist) USING KEY (source, node) AS (
  SELECT node, node, 0e0 FROM src
  UNION
  SELECT x.source, e.v, min(x.dist + e.w) FROM way x JOIN edge e ON x.node = e.u LEFT JOIN recurring.way o ON o.source = x.source AND o.node = e.v WHERE o.dist IS NULL OR x.dist + e.w < o.dist GROUP BY x.source, e.v)"""
_LAST = "one AS (SELECT node_id, timestamp, max(reading_id) AS reading_id FROM reading GROUP BY node_id, timestamp), state AS (SELECT r.* FROM reading r JOIN one USING (reading_id))"

_DOCUMENTS = """WITH text AS (SELECT event_id AS reading_id, '{"reading":' || event_id || ',"kind":"' || event_type || '","props":' || props || CASE WHEN event_id % 10 = 4 THEN '' ELSE CASE event_id % 5
  WHEN 1 THEN ',"firmware":"v2","battery":0.5' WHEN 2 THEN ',"battery":"low"' WHEN 3 THEN ',"tags":["a","b"],"gone":null' ELSE '' END || '}' END AS body FROM events),
document AS (SELECT reading_id, body, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS doc FROM text)"""

_ENDS = "ends AS (SELECT node_id, live FROM (SELECT node_id, max(timestamp) AS newest FROM reading GROUP BY node_id), (VALUES (TRUE), (FALSE)) v(live) WHERE live OR newest + INTERVAL 25 HOUR <= (SELECT max(timestamp) FROM reading))"

_FROM_DEPOT = hav(f"{DEPOT[0]}e0", f"{DEPOT[1]}e0", "latitude", "longitude")

NETWORK = {
    "keyed_upserts": q("""SELECT node_id, CASE WHEN ends_with(node_name, '77') THEN 'Moved ' || node_name ELSE node_name END AS node_name, group_id FROM node WHERE group_id IS DISTINCT FROM 3
        UNION ALL SELECT -1 - s_suppkey, s_name, CAST(s_nationkey AS BIGINT) FROM supplier"""),
    "sql_functions": q(
        f"""SELECT node_id, round(distance_m, 4) AS metres, round(distance_m * (1 + coalesce({clip('traffic_density')}, 0e0) * 3e0) / (1 + 10 * 0.5e0 * {clip('priority')}), 4) AS cost,
        CASE WHEN waste_level >= 0.85e0 THEN 'critical' WHEN waste_level >= 0.65e0 THEN 'warning' ELSE 'normal' END AS status FROM scored""",
        LATEST, f"dist AS (SELECT *, {_FROM_DEPOT} AS distance_m FROM node)", f"scored AS (SELECT d.*, l.* EXCLUDE (node_id), CASE WHEN reading_id IS NULL THEN 0e0 ELSE {prio()} END AS priority FROM dist d LEFT JOIN latest l ON d.node_id = l.node_id)",
    ),
    "stream_until_silent": q(f"SELECT node_id, reading_id, live, {r6('waste_level', 'gas_level')} FROM latest JOIN ends USING (node_id)", LATEST, _ENDS),
    "stream_fill_until_silent": f"SELECT node_id, fill, emptied, live FROM ({ORACLES['stream_fill_machine']}) JOIN ({q('SELECT node_id, live FROM ends', _ENDS)}) USING (node_id)",
    "nearest_nodes": q("SELECT node_id, CAST(rank AS INTEGER) AS rank, neighbour, distance_m FROM near", _NEAR),
    "cluster_sizes": q(
        """SELECT depot, CAST(floor(i * parts / n) AS BIGINT) AS cluster, count(*) AS n, count(*) AS nodes
        FROM (SELECT depot, n, unnest(range(n)) AS i, ceil(n / 400) AS parts FROM (SELECT coalesce(group_id, -1) AS depot, count(*) AS n FROM node WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1)) GROUP BY 1, 2"""
    ),
    "network_paths": q("SELECT source, node, round(dist, 4) AS dist FROM way", _NEAR, _EDGE, recursive=True),
    "notification_states": q(
        f"SELECT n.notification_id, n.level, s.reading_id, round(s.waste_level, 6) AS waste_level, round(s.gas_level, 6) AS gas_level, CAST(floor((epoch_us(n.created_at) - epoch_us(s.timestamp)) / 1000000) AS BIGINT) AS age_s FROM notification n ASOF LEFT JOIN state s ON n.user_id = s.node_id AND n.created_at > s.timestamp",
        _LAST,
    ),
    "hazard_in_stretches": ORACLES["label_hazard_6h"],
    "overflow_in_stretches": ORACLES["label_time_to_overflow"],
    "rolling_in_stretches": ORACLES["rolling_features_train"],
    "fill_carried": ORACLES["forward_fill"],
    "visit_numbers": q("SELECT visit_id, node_id, row_number() OVER (PARTITION BY node_id ORDER BY visited_at, visit_id) AS nth, count(*) OVER (PARTITION BY node_id) AS visits FROM visit"),
    "rollup_weeks": q(
        "SELECT CAST(date_trunc('week', timestamp) AS DATE) AS week, count(DISTINCT node_id) AS nodes, count(*) AS readings, count(*) FILTER (WHERE newest = 1 AND waste_level >= 0.85e0) AS critical, count(*) FILTER (WHERE newest = 1 AND waste_level >= 0.65e0 AND waste_level < 0.85e0) AS warning, "
        "round(avg(waste_level), 6) AS mean_fill, round(min(waste_level), 6) AS least_fill, round(max(waste_level), 6) AS most_fill FROM (SELECT *, row_number() OVER (PARTITION BY node_id, date_trunc('week', timestamp) ORDER BY timestamp DESC, reading_id DESC) AS newest FROM reading) GROUP BY week"
    ),
    "variant_fields": _DOCUMENTS
    + " SELECT reading_id, CAST(doc ->> '$.props.k' AS BIGINT) AS k, doc ->> '$.kind' AS kind, TRY_CAST(doc ->> '$.battery' AS DOUBLE) AS battery, doc ->> '$.battery' AS battery_text, doc ->> '$.firmware' AS firmware, doc ->> '$.tags[1]' AS second_tag, CASE WHEN doc IS NULL THEN length(body) END AS bad_chars FROM document",
    "variant_drift": _DOCUMENTS
    + ", field AS (SELECT f.key AS field, f.type AS kind FROM document, json_each(doc) AS f WHERE doc IS NOT NULL) SELECT field, CASE kind WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' ELSE lower(kind) END AS type, count(*) AS documents FROM field GROUP BY ALL",
}

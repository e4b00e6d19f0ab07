"""DuckDB twins of the training-data queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t),
r AS (SELECT d.doc_id, g.keep_id, g.group_size, d.t, row_number() OVER (PARTITION BY d.t ORDER BY d.doc_id DESC NULLS LAST) AS k FROM d JOIN g ON d.t = g.t)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM r
"""

JACCARD_JOIN = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.doc_id)
SELECT s.doc_id, len(s.sh) AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) c ON s.doc_id = c.doc_id
"""

SPELLING = """
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
keyed AS (
  SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS m, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY ALL),
bits AS (
  SELECT run, c, flatten(list_transform(flatten(list_transform(string_split(m, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)),
    lambda y: list_transform(range(8), lambda k: (y >> k::INTEGER) & 1))) AS b
  FROM keyed),
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(b, lambda h, x: xor(h >> 1, (xor(h, x::BIGINT) & 1) * 3988292384), 4294967295::BIGINT)) AS h
  FROM (SELECT run, c, list_transform(b, lambda x: x::BIGINT) AS b FROM bits)),
damaged AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM hashed),
v AS (SELECT word, sum(c)::BIGINT AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
places AS (SELECT word, length(word) AS l, unnest(range(1, length(word) + 1)) AS i FROM v),
cut AS (SELECT word, l, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM places),
near AS (
  SELECT x.word AS word, y.word AS other FROM cut x JOIN cut y ON x.l = y.l AND x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT cut.word, v.word FROM cut JOIN v ON v.word = a || b
  UNION SELECT v.word, cut.word FROM cut JOIN v ON v.word = a || b),
ranked AS (
  SELECT near.word, near.other, o.n AS other_n, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, near.other) AS k, count(*) OVER (PARTITION BY near.word) AS n_near
  FROM near JOIN v o ON near.other = o.word),
t AS (
  SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 5 * v.n THEN r.other END AS form, CASE WHEN r.other_n >= 5 * v.n THEN r.other_n END AS form_n
  FROM v LEFT JOIN ranked r ON v.word = r.word AND r.k = 1),
way AS (
  SELECT word, word AS here, 0 AS step FROM t UNION ALL SELECT way.word, t.form, step + 1 FROM way JOIN t ON way.here = t.word WHERE t.form IS NOT NULL)
SELECT t.word, t.form, w.root, t.n, t.n_near, t.form_n FROM t JOIN (SELECT word, max_by(here, step) AS root FROM way GROUP BY word) w ON t.word = w.word
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = v.label AS alike, v.vec_id AS id, list_inner_product(a.x, v.x)::BIGINT AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND v.vec_id <> a.vec_id AND len(a.x) = len(v.x)),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

ORACLES = {"op9_exact_dedup": EXACT_DEDUP, "op8_jaccard_join": JACCARD_JOIN, "op11_spelling": SPELLING, "op12_hard_negatives": HARD_NEGATIVES}

"""DuckDB SQL of the registered text queries."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op1_jaccard_join"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id,
  coalesce(k.n_links, 0) AS n_links
FROM documents d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x) c USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY x) k USING (doc_id)
"""

ORACLES["op4_decontaminate"] = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(ws), 13) AS size,
    unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda k: array_to_string(ws[k:k + 12], ' '))) AS g FROM i WHERE len(ws) > 0),
z AS (SELECT DISTINCT size FROM p),
s AS (SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS pos, ws FROM w, z WHERE len(ws) >= size),
g AS (SELECT doc_id, size, pos, array_to_string(ws[pos:pos + size - 1], ' ') AS g FROM s),
f AS (SELECT g.doc_id, g.size, g.pos, p.item_id FROM g JOIN p ON g.g = p.g AND g.size = p.size),
h AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM f) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM f) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items,
  sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""

ORACLES["op3_line_dedup"] = r"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS no FROM a),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS seq,
    len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS words FROM u WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')),
p AS (SELECT x.doc_id AS d, y.doc_id AS e, x.seq - y.seq AS shift, x.seq, x.no, x.words FROM l x JOIN l y ON x.line = y.line
    AND (y.doc_id < x.doc_id OR (y.doc_id = x.doc_id AND y.seq < x.seq))),
i AS (SELECT *, seq - row_number() OVER (PARTITION BY d, e, shift ORDER BY seq) AS run FROM p),
g AS (SELECT *, sum(words) OVER (PARTITION BY d, e, shift, run) AS total FROM i),
r AS (SELECT DISTINCT d AS doc_id, no FROM g WHERE total >= 50),
t AS (SELECT u.doc_id, count(*) - count(r.no) AS kept, count(r.no) AS gone, string_agg(u.line, chr(10) ORDER BY u.no) FILTER (r.no IS NULL) AS text
    FROM u LEFT JOIN r USING (doc_id, no) GROUP BY u.doc_id)
SELECT doc_id, coalesce(kept + gone, 0) AS n_lines, coalesce(gone, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text FROM documents d LEFT JOIN t USING (doc_id)
"""

ORACLES["op5_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLES["op11_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS a, c.vec_id AS c, q.label = c.label AS same, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
p AS (SELECT a, c, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5),
n AS (SELECT p.a, p.c AS p, s.c AS n, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.c) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 10
"""

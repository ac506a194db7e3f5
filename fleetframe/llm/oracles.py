"""The queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN len(ws) || ':' || array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, w.doc_id) AS component_id, w.doc_id = coalesce(c.component, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""

OP9 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(max(CASE WHEN cap / weight >= level THEN level END) OVER () * weight, cap::DOUBLE)) AS target FROM l),
p AS (SELECT d.doc_id, size, source_size, target, round(target)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(budget - epochs * source_size - ahead, 0), size))::BIGINT AS taken FROM e
"""

OP5 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
m AS (SELECT win, min(doc_id) AS low FROM g GROUP BY win),
c AS (SELECT DISTINCT g.doc_id, p FROM (SELECT g.doc_id, unnest(range(g.i, g.i + 50)) AS p FROM g JOIN m ON m.win = g.win AND m.low < g.doc_id) g),
x AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
k AS (SELECT x.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY x.p) AS text FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p WHERE c.p IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
t AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY r, term),
q AS (SELECT i, term, count(*)::BIGINT AS times FROM (SELECT row_number() OVER () AS i, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY i, term),
b AS (SELECT row_number() OVER () AS i, item_id FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, whole WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 100 - 25 + ((25 * len(ws)::BIGINT * n_docs) // n_terms) AS m FROM d, whole WHERE len(ws) > 0),
s AS (SELECT q.i, t.r, sum(q.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * m.m)))::BIGINT AS score
  FROM q JOIN t ON t.term = q.term JOIN w ON w.term = q.term JOIN m ON m.r = t.r GROUP BY q.i, t.r),
o AS (SELECT s.i, m.doc_id, score, row_number() OVER (PARTITION BY s.i ORDER BY score DESC, m.doc_id NULLS LAST) AS rank FROM s JOIN m ON m.r = s.r WHERE score > 0)
SELECT b.item_id, o.rank::INTEGER AS rank, o.doc_id, o.score FROM o JOIN b ON b.i = o.i WHERE o.rank <= 20
"""

ORACLES = {"op4_minhash": OP4, "op5_substrings": OP5, "op9_mixing": OP9, "op13_ranking": OP13}

"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from graphweft.llm import leaks, ranking, reading, tokens, topn, vectors

_LATEST = """
WITH p AS (SELECT source_id, algorithm, target_id, arg_max(score, (predicted_at, score)) AS score FROM predictions
           WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
s AS (SELECT source_id, 'similarity_results' AS algorithm, id AS target_id, arg_max(score, (searched_at, score)) AS score
      FROM similarity_results WHERE score IS NOT NULL AND NOT isnan(score) AND source_id IN (SELECT source_id FROM p) GROUP BY ALL),
a AS (SELECT * FROM p UNION ALL SELECT * FROM s),
c AS (SELECT *, count(*) OVER (PARTITION BY source_id, algorithm) AS n,
             count(*) OVER (PARTITION BY source_id, algorithm ORDER BY score) AS upto,
             count(*) OVER (PARTITION BY source_id, algorithm, score) AS here FROM a),
q AS (SELECT source_id, algorithm, target_id, CAST(floor((2 * upto - here) * 1000000000 / (2 * n)) AS BIGINT) AS pct FROM c),
v AS (SELECT source_id, target_id, count(*) AS n, CAST(sum(pct) AS BIGINT) AS total FROM q GROUP BY ALL),
x AS (SELECT q.source_id, algorithm, CASE WHEN n > 1 THEN pct // 100000 END AS x, CASE WHEN n > 1 THEN ((total - pct) // (n - 1)) // 100000 END AS y FROM q JOIN v USING (source_id, target_id)),
m AS (SELECT source_id, algorithm, count(y) AS m, CAST(coalesce(sum(x), 0) AS DOUBLE) AS sx, CAST(coalesce(sum(y), 0) AS DOUBLE) AS sy, CAST(coalesce(sum(x * y), 0) AS DOUBLE) AS sxy, CAST(coalesce(sum(x * x), 0) AS DOUBLE) AS sxx, CAST(coalesce(sum(y * y), 0) AS DOUBLE) AS syy FROM x GROUP BY ALL),
k AS (SELECT source_id, algorithm, CASE WHEN m * sxy - sx * sy > 0 AND m * sxx - sx * sx > 0 AND m * syy - sy * sy > 0
  THEN least(1000, CAST(floor(1000 * (m * sxy - sx * sy) * (m * sxy - sx * sy) / ((m * sxx - sx * sx) * (m * syy - sy * sy))) AS BIGINT)) ELSE 0 END AS k FROM m),
f AS (SELECT v.source_id, v.target_id, k.k, q.pct, coalesce(q.pct, 500000000) AS own,
  CASE WHEN n - CASE WHEN pct IS NULL THEN 0 ELSE 1 END > 0 THEN (total - coalesce(pct, 0)) // (n - CASE WHEN pct IS NULL THEN 0 ELSE 1 END) ELSE 500000000 END AS rest
  FROM v JOIN k USING (source_id) LEFT JOIN q ON q.source_id = v.source_id AND q.target_id = v.target_id AND q.algorithm = k.algorithm),
"""
_P1 = _LATEST + "o AS (SELECT source_id, target_id, list_sort(list((k * own + (1000 - k) * rest) // 1000)) AS k FROM f GROUP BY ALL),\n"
_P1X = _LATEST + "o AS (SELECT source_id, target_id, list_sort(list(own)) AS k FROM f GROUP BY ALL),\n"
_RANK = "r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY k DESC, target_id) AS r FROM o)\n"

_P3 = """
WITH e AS (
  SELECT 'edge_suggestions' AS tbl, source_id AS group_key, target_id AS item_id, arg_max(confidence, (suggested_at, confidence)) AS score
  FROM edge_suggestions WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY ALL
  UNION ALL
  SELECT 'predictions', source_id || '|' || algorithm, target_id, arg_max(score, (predicted_at, score))
  FROM predictions WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tbl, group_key ORDER BY score DESC, item_id) AS r FROM e)
SELECT tbl, group_key, item_id FROM r WHERE r <= 5
"""

#: Every usable vector, and the ten most similar of each by comparing all with all (for small tables).
_VECTORS = """
WITH e AS (SELECT 'vector_entries' AS field, space, id, arg_max({v: vector, d: dimensions}, (updated_at, entry_id)) AS x FROM vector_entries WHERE id IS NOT NULL AND space IS NOT NULL GROUP BY ALL),
n AS (SELECT id, arg_max({n: named_embeddings, c: chunk_embeddings}, (created_at_unix_ms, updated_at_unix_ms)) AS x FROM nodes WHERE id IS NOT NULL AND (cardinality(named_embeddings) > 0 OR len(chunk_embeddings) > 0) GROUP BY 1),
m AS (SELECT id, unnest(map_entries(x.n)) AS y FROM n), c AS (SELECT id, x.c AS c, unnest(range(1, len(x.c) + 1)) AS i FROM n),
a AS (SELECT field, space, id, x.v AS v, x.d AS d FROM e UNION ALL SELECT 'named_embeddings', y.key, id, y.value, 96 FROM m UNION ALL SELECT 'chunk_embeddings', '', id || '#' || (i - 1), c[i], 96 FROM c),
u AS (SELECT field, space, id, CAST(v AS DOUBLE[]) AS v FROM a WHERE len(v) = d AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
"""
_P5 = _VECTORS + """p AS (SELECT a.field, a.space, a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.field = b.field AND a.space = b.space AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY field, space, a ORDER BY s DESC, b) AS r FROM p)
SELECT DISTINCT field, space, least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE r <= 10 AND s >= 0.8"""
_NEAREST = _VECTORS + """p AS (SELECT a.field, a.space, a.id, b.id AS neighbour, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.field = b.field AND a.space = b.space AND a.id <> b.id WHERE TRY_CAST(regexp_extract(a.id, 'node-([0-9]+)', 1) AS BIGINT) % 100 = 0)
SELECT field, space, id, neighbour, round(s, 5) AS similarity, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY field, space, id ORDER BY s DESC, neighbour) AS r FROM p) WHERE r <= 10"""


def queries() -> dict:
    return {
        "p1_found": ranking.p1_found,
        "p1_leximin": ranking.p1_leximin,
        "p3_found": topn.p3_found,
        "p5_found": vectors.p5_found,
        "p5_nearest": vectors.p5_nearest,
        "p6_ids": tokens.p6_ids,
        "p6_sources": tokens.p6_sources,
        "p7_found": leaks.p7_found,
        "p7_items": leaks.p7_items,
        "p8_found": reading.p8_found,
        "p8_profile": reading.p8_profile,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + _RANK + "SELECT source_id, target_id FROM r WHERE r <= 10",
        "p1_leximin": _P1X + _RANK + "SELECT source_id, target_id, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 10",
        "p3_found": _P3,
        "p5_found": _P5,
        "p5_nearest": _NEAREST,
    }

"""Queries of the general training-data problems (p2, p4)."""

from __future__ import annotations

from graphweft.operators import references
from graphweft.sources import delimited



def _valid(v: str, t: str) -> str:
    """Whether a scalar is valid as its type."""
    return rf"""CASE WHEN {t} IN ('', 'string', 'char', 'point', 'date', 'localtime', 'time', 'localdatetime', 'datetime', 'duration') THEN true
      WHEN {t} IN ('byte', 'short', 'int', 'long') THEN regexp_full_match({v}, '[+-]?[0-9]+') AND TRY_CAST({v} AS BIGINT) IS NOT NULL
      WHEN {t} IN ('float', 'double') THEN regexp_full_match({v}, '{_FLOAT}') WHEN {t} = 'boolean' THEN regexp_full_match({v}, '\s*(true|false)\s*') ELSE false END"""


_FLOAT = r"\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*"
_FIELD = "esc_q || '(?:[^' || esc_q || ']|' || esc_q || esc_q || ')*' || esc_q || '|(?:[^' || esc_q || esc_d || '][^' || esc_d || ']*)?'"
_LINES = rf"""
WITH heads AS (SELECT source_id, any_value(run_id) AS run_id, list({{k: kind, t: t, d: dims}} ORDER BY col_index) AS h
  FROM (SELECT DISTINCT source_id, run_id, col_index, kind, lower(trim(coalesce(value_type, ''))) AS t, vector_dimensions AS dims FROM import_columns) GROUP BY 1),
runs AS (SELECT run_id, max(started_at) AS started_at, max(delimiter) AS d, max(quote) AS q, max(array_delimiter) AS ad, max(vector_delimiter) AS vd, bool_or(empty_strings_as_null) AS e FROM import_runs GROUP BY 1),
lines AS (SELECT DISTINCT source_id, row_number, CASE WHEN ends_with(raw_line, chr(13)) THEN left(raw_line, length(raw_line) - 1) ELSE raw_line END AS line FROM import_rows),
j AS (SELECT *, format('\x{{{{{{:x}}}}}}', unicode(d)) AS esc_d, format('\x{{{{{{:x}}}}}}', unicode(q)) AS esc_q FROM lines JOIN heads USING (source_id) JOIN runs USING (run_id)),
f AS (SELECT *, NOT regexp_full_match(line, '(?s)(?:' || {_FIELD} || ')(?:' || esc_d || '(?:' || {_FIELD} || '))*') AS broken,
  list_transform(regexp_extract_all(d || line, '(?s)' || esc_d || '(' || {_FIELD} || ')', 1), lambda x: CASE WHEN starts_with(x, q) THEN replace(x[2:-2], q || q, q) ELSE x END) AS f FROM j),
v AS (SELECT *, list_transform(range(1, least(len(h), len(f)) + 1), lambda i: {{k: h[i].k, t: h[i].t, d: h[i].d, v: f[i], el: replace(h[i].t, '[]', '')}}) AS p FROM f),
r AS (SELECT *, CASE WHEN broken THEN 'quoting' WHEN len(f) <> len(h) THEN 'field_count' WHEN len(list_filter(p, lambda x: x.k = 'Id' AND x.v = '')) > 0 THEN 'empty_id'
  WHEN len(list_filter(p, lambda x: x.k IN ('Property', 'NamedEmbedding') AND NOT (x.v = '' AND e) AND NOT CASE
    WHEN x.t = 'vector' THEN len(string_split(x.v, vd)) = x.d AND len(list_filter(string_split(x.v, vd), lambda y: NOT regexp_full_match(y, '{_FLOAT}'))) = 0
    WHEN ends_with(x.t, '[]') THEN len(list_filter(string_split(x.v, ad), lambda y: NOT {_valid("y", "x.el")})) = 0 ELSE {_valid("x.v", "x.t")} END)) > 0 THEN 'invalid_value' END AS reason FROM v)
"""
_P4 = _LINES + "SELECT DISTINCT source_id, row_number FROM r WHERE reason IS NOT NULL"
_P4_REASONS = _LINES + ", o AS (SELECT source_id, row_number, min(reason) AS reason FROM r WHERE reason IS NOT NULL GROUP BY ALL) SELECT source_id, reason, count(*) AS n FROM o GROUP BY ALL"
_P4_SUMMARY = (
    _LINES.replace("col_index, kind,", "col_index, kind, name, target,").replace("list({k: kind,", "list({c: coalesce(name, ''), k: kind,").replace("{k: h[i].k,", "{c: CASE WHEN h[i].c = '' THEN 'col_' || (i - 1) ELSE h[i].c END, k: h[i].k,").replace("any_value(run_id) AS run_id", "any_value(run_id) AS run_id, any_value(target) AS target")
    + """, g AS (SELECT source_id, row_number, target, e, ad, vd, p FROM r WHERE reason IS NULL),
x AS (SELECT *, list_filter(p, lambda y: y.k = 'Id')[1].v AS id, list_filter(p, lambda y: y.k = 'Label')[1].v AS l, list_filter(p, lambda y: y.k = 'StartId')[1].v AS s, list_filter(p, lambda y: y.k = 'EndId')[1].v AS t, list_filter(p, lambda y: y.k = 'Type')[1].v AS rel,
  map_from_entries(list_distinct(list_transform(list_filter(p, lambda y: y.k = 'Property' AND NOT (y.v = '' AND e)), lambda y: {k: y.c, v: list_last(list_transform(list_filter(p, lambda z: z.k = 'Property' AND z.c = y.c AND NOT (z.v = '' AND e)), lambda z: z.v))}))) AS q,
  list_distinct(list_transform(list_filter(p, lambda y: y.k = 'NamedEmbedding' AND NOT (y.v = '' AND e)), lambda y: {k: y.c, n: len(string_split(y.v, vd))})) AS n FROM g)
SELECT source_id, target, count(*) AS records, count(id) AS ids, CAST(coalesce(sum(len(list_filter(string_split(l, ad), lambda y: y <> ''))), 0) AS BIGINT) AS labels, count(CASE WHEN NOT (s = '' AND e) THEN s END) AS starts, count(CASE WHEN NOT (t = '' AND e) THEN t END) AS ends,
count(DISTINCT CASE WHEN NOT (rel = '' AND e) THEN rel END) AS types, CAST(sum(cardinality(q)) AS BIGINT) AS named, CAST(sum(coalesce(list_sum(list_transform(map_values(q), lambda y: length(y))), 0)) AS BIGINT) AS characters, CAST(sum(coalesce(list_sum(list_transform(n, lambda y: y.n)), 0)) AS BIGINT) AS numbers FROM x GROUP BY 1, 2"""
)
_IMPORTS = """ends AS (SELECT source_id, row_number, source_id || '#' || row_number AS row_id, run_id, epoch_us(started_at) AS t, unnest(list_filter(p, lambda x: x.k IN ('StartId', 'EndId'))) AS x FROM r WHERE reason IS NULL),
imports AS (SELECT 'import_rows' AS tbl, row_id, CASE x.k WHEN 'StartId' THEN 'start_id' ELSE 'end_id' END AS ref_column, x.v AS k, t FROM ends)"""
_TABLES = """SELECT 'edges' AS tbl, id AS row_id, 'start_node' AS ref_column, start_node AS k, created_at_unix_ms * 1000 AS t FROM edges
  UNION ALL SELECT 'edges', id, 'end_node', end_node, created_at_unix_ms * 1000 FROM edges
  UNION ALL SELECT 'edge_suggestions', suggestion_id, 'source_id', source_id, epoch_us(suggested_at) FROM edge_suggestions
  UNION ALL SELECT 'edge_suggestions', suggestion_id, 'target_id', target_id, epoch_us(suggested_at) FROM edge_suggestions"""


def _orphans(refs: str) -> str:
    """Each orphan of the references once, with the smallest time and key of its copies."""
    return f"""lived AS (SELECT DISTINCT id, created_at_unix_ms AS a, deleted_at_unix_ms AS b FROM nodes), refs AS ({refs}),
o AS (SELECT tbl, row_id, ref_column, min((t, k)) AS x FROM refs
  WHERE k <> '' AND t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lived WHERE lived.id = refs.k AND lived.a * 1000 <= refs.t AND (lived.b IS NULL OR refs.t < lived.b * 1000)) GROUP BY ALL)"""


_ALL = _orphans(_TABLES + " UNION ALL SELECT 'vector_entries', entry_id, 'id', id, epoch_us(updated_at) FROM vector_entries UNION ALL SELECT * FROM imports")
_MONTHS = " SELECT tbl, ref_column, strftime(make_timestamp(x[1]), '%Y-%m') AS month, count(*) AS orphans FROM o GROUP BY ALL"
_P2 = _LINES + ", " + _IMPORTS + ", " + _ALL
_P2_RUNS = (
    _LINES + ", " + _IMPORTS + ", " + _orphans("SELECT * FROM imports")
    + """, n AS (SELECT run_id, count(DISTINCT row_id) AS n FROM o JOIN (SELECT DISTINCT row_id, run_id FROM ends) USING (row_id) GROUP BY 1),
u AS (SELECT run_id, max((started_at, bad_relationships, bad_relationship_tolerance)) AS r FROM import_runs GROUP BY 1)
SELECT run_id, coalesce(n, 0) AS orphan_lines, r[2] AS reported, r[3] AS tolerance, coalesce(coalesce(n, 0) <= r[3], true) AS within FROM u LEFT JOIN n USING (run_id)"""
)


def queries() -> dict:
    return {
        "p2_found": references.p2_found,
        "p2_by_month": references.p2_by_month,
        "p2_edges_by_month": references.p2_edges_by_month,
        "p2_by_reason": references.p2_by_reason,
        "p2_runs": references.p2_runs,
        "p4_found": delimited.p4_found,
        "p4_reasons": delimited.p4_reasons,
        "p4_loaded": delimited.p4_loaded,
        "p4_summary": delimited.p4_summary,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2 + " SELECT tbl, row_id, ref_column FROM o",
        "p2_by_month": _P2 + _MONTHS,
        "p2_edges_by_month": "WITH " + _orphans(_TABLES) + _MONTHS,
        "p2_by_reason": _P2
        + """, b AS (SELECT id, min(created_at_unix_ms) * 1000 AS born FROM nodes GROUP BY 1)
        SELECT tbl, strftime(make_timestamp(x[1]), '%Y-%m') AS month, CASE WHEN born IS NULL THEN 'missing' WHEN born > x[1] THEN 'later' ELSE 'deleted' END AS why, count(*) AS orphans FROM o LEFT JOIN b ON b.id = x[2] GROUP BY ALL""",
        "p2_runs": _P2_RUNS,
        "p4_found": _P4,
        "p4_reasons": _P4_REASONS,
        "p4_summary": _P4_SUMMARY,
    }

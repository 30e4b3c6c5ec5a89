"""Queries of import and export, of the search procedures, and of the operators the other modules leave out; with their SQL."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from graphweft.analytics import links, signals
from graphweft.functions.scalars import cosine, euclidean
from graphweft.operators import versions
from graphweft.plans.catalog import GraphCatalog
from graphweft.policy import governance, knowledge
from graphweft.queries import engine
from graphweft.queries.graph import build
from graphweft.queries.writes import shop
from graphweft.search import fulltext, lucene, ranking
from graphweft.session import micros, shared_dir, table
from graphweft.sources import graphfiles
from graphweft.streaming import access
from graphweft.text import chunks


def _folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/graphweft-files/{uuid.uuid4().hex}"


# -- files -----------------------------------------------------------------------------------------------------------
def _csv(spark, sf, folder: str, compression: str = "none") -> tuple[list[str], list[str]]:
    """Customers, nations and orders as header CSV: one file part each, so that each has one header; some orders name no customer."""
    t = lambda n: table(spark, sf, n)
    c = t("customer").select(F.col("c_custkey").alias("key:ID(Customer)"), F.lit("Customer;Person").alias(":LABEL"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance:double"), F.concat_ws(";", F.lit("a"), "c_mktsegment").alias("tags:string[]"), F.lit("x").alias(":IGNORE"))
    n = t("nation").select(F.col("n_nationkey").alias(":ID(Nation)"), F.lit("Nation").alias(":LABEL"), F.col("n_nationkey").alias("key:long"), F.col("n_name").alias("name"))
    r = t("customer").select(F.col("c_custkey").alias(":START_ID(Customer)"), F.when(F.col("c_custkey") % 10 == 0, 999).otherwise(F.col("c_nationkey")).alias(":END_ID(Nation)"), F.lit("FROM").alias(":TYPE"), F.col("c_custkey").alias("w:int"))
    for name, df in (("c", c), ("n", n), ("r", r)):
        df.coalesce(1).write.option("header", True).option("escape", '"').option("compression", compression).csv(f"{folder}/{name}")
    return [f"{folder}/c", f"{folder}/n"], [f"{folder}/r"]


def _imported(compression: str):
    def run(spark, sf):
        nodes, rels = _csv(spark, sf, _folder(spark), compression)
        g, report = graphfiles.import_graph(spark, nodes, rels, tolerance=10**9)
        out = g.query("MATCH (c:Person:Customer)-[r:FROM]->(n:Nation) RETURN c.name AS name, round(c.balance, 2) AS balance, size(c.tags) AS tags, n.key AS nation, r.w AS w")
        return out.withColumn("bad", F.lit(report["bad_relationships"]).cast("long")).withColumn("imported", F.lit(report["relationships_imported"]).cast("long"))

    return run


_IMPORTED = """SELECT c_name AS name, round(c_acctbal, 2) AS balance, 2::BIGINT AS tags, c_nationkey AS nation, c_custkey AS w, (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0) AS bad, (SELECT count(*) FROM customer WHERE c_custkey % 10 <> 0) AS imported
FROM customer WHERE c_custkey % 10 <> 0"""


def import_zip(spark, sf):
    """The whole nation table from a ZIP archive."""
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("nation.csv", "key:ID,:LABEL,name\r\n" + "".join(f'{r[0]},Nation,"{r[1]}"\r\n' for r in rows))
    folder = _folder(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/n.zip")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(held.getvalue()))
    out.close()
    g, _ = graphfiles.import_graph(spark, [f"{folder}/n.zip"], [])
    return g.query("MATCH (n:Nation) RETURN id(n) AS id, n.name AS name")


def import_preflight(spark, sf):
    nodes, rels = _csv(spark, sf, _folder(spark))
    p = graphfiles.preflight(spark, [(nodes[0], "node"), (nodes[1], "node"), (rels[0], "relationship"), (nodes[0], "relationship")])
    return p.select(F.element_at(F.split("path", "/"), -1).alias("file"), "target", "ok", "columns")


def import_header(spark, sf):
    h = graphfiles.parse_header(["key:ID(Part)", "name", "size:int", "tags:string[]", "v:vector{dimensions:3}", ":LABEL", ":IGNORE"], "node")
    return spark.createDataFrame([(c.name, c.kind, c.value_type, c.id_space, c.dimensions) for c in h], "name string, kind string, value_type string, id_space string, dimensions int")


_HEADER = """SELECT * FROM (VALUES ('key', 'Id', '', 'Part', NULL::INTEGER), ('name', 'Property', 'string', NULL, NULL), ('size', 'Property', 'int', NULL, NULL), ('tags', 'Property', 'string[]', NULL, NULL),
('v', 'Property', 'vector', NULL, 3), ('', 'Label', '', NULL, NULL), ('', 'Ignore', '', NULL, NULL)) t(name, kind, value_type, id_space, dimensions)"""


def export_import(spark, sf):
    """Header CSV out and in again."""
    folder = _folder(spark)
    g = shop(spark, sf)
    paths = graphfiles.export_graph(g, folder)
    for p in paths.values():  # every part of an export has its header
        assert p.startswith(folder)
    back, report = graphfiles.import_graph(spark, [p for n, p in sorted(paths.items()) if n.startswith("nodes")], [p for n, p in sorted(paths.items()) if n.startswith("rels")])
    return back.query("MATCH (c:Customer)-[r:FROM_NATION]->(n:Nation) RETURN id(c) AS id, c.name AS name, round(c.balance, 2) AS b, n.name AS nation, round(r.w, 2) AS w")


_EXPORT = "SELECT 'c' || c_custkey AS id, c_name AS name, round(c_acctbal, 2) AS b, n_name AS nation, round(c_acctbal, 2) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey"


def snapshot_round_trip(spark, sf):
    folder = _folder(spark)
    graphfiles.write_snapshot(shop(spark, sf), folder)
    return graphfiles.read_snapshot(spark, folder).query("MATCH (s:Supplier)-[:SUPPLIER_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN s.key AS k, r.name AS region")


_SNAPSHOT = "SELECT s_suppkey AS k, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _json(spark, sf) -> str:
    """Nations and their regions as one JSON graph."""
    path = f"{_folder(spark)}/graph"
    nodes = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.array(F.lit("Nation")).alias("labels"), F.struct(F.col("n_name").alias("name")).alias("properties"))
    nodes = nodes.unionByName(table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.array(F.lit("Region")).alias("labels"), F.struct(F.col("r_name").alias("name")).alias("properties")))
    rels = table(spark, sf, "nation").select(F.concat(F.lit("e"), "n_nationkey").alias("id"), F.concat(F.lit("n"), "n_nationkey").alias("startNode"), F.concat(F.lit("r"), "n_regionkey").alias("endNode"), F.lit("IN").alias("type"), F.struct(F.col("n_nationkey").alias("w")).alias("properties"))
    both = nodes.agg(F.collect_list(F.struct("*")).alias("nodes")).crossJoin(rels.agg(F.collect_list(F.struct("*")).alias("relationships")))
    both.coalesce(1).write.json(path)
    return path


def json_graph(spark, sf):
    return graphfiles.import_json(spark, _json(spark, sf)).query("MATCH (n:Nation)-[r:IN]->(x:Region) RETURN n.name AS nation, x.name AS region, r.w AS w")


_JSON = "SELECT n_name AS nation, r_name AS region, n_nationkey AS w FROM nation JOIN region ON n_regionkey = r_regionkey"


def json_procedures(spark, sf):
    path = _json(spark, sf)
    g = GraphCatalog.empty(spark)
    got = g.query(f"CALL apoc.import.json('{path}') YIELD nodes, relationships RETURN nodes, relationships")
    value = g.query(f"CALL apoc.load.json('{path}') YIELD value RETURN size(value.nodes) AS loaded")
    return got.crossJoin(value).crossJoin(g.query("MATCH (n) RETURN count(*) AS stored"))


_JSON_PROCEDURES = "SELECT n AS nodes, (SELECT count(*) FROM nation) AS relationships, n AS loaded, n AS stored FROM (SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n)"


def json_rows(spark, sf):
    """A root array as rows."""
    path = f"{_folder(spark)}/rows"
    whole = table(spark, sf, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    whole.coalesce(1).write.text(path)
    return graphfiles.load_json(spark, path).select("n_nationkey", "n_name")


# -- search procedures -----------------------------------------------------------------------------------------------
def _searchable(spark, sf) -> GraphCatalog:
    g = build(spark, sf)
    g.query("CREATE FULLTEXT INDEX texts FOR (n:Document) ON EACH [n.text]")
    g.query("CREATE VECTOR INDEX vectors FOR (n:Vector) ON (n.embedding) OPTIONS {indexConfig: {`vector.dimensions`: 64}}")
    return g


def fulltext_nodes(spark, sf):
    hits = _searchable(spark, sf).query("CALL db.index.fulltext.queryNodes('texts', 'vector snapshot', {skip: 3, limit: 40}) YIELD node, score RETURN node, score")
    return hits.select("node", F.round("score", 6).alias("score"))


_HITS = engine._bm25_sql("""SELECT term, sum(weight) AS weight FROM (SELECT unnest(['vector', 'snapshot']) AS term, 1.0 AS weight UNION ALL SELECT term, 0.8 FROM
    (SELECT term, row_number() OVER (PARTITION BY k ORDER BY term) AS r FROM d, (SELECT unnest(['vector', 'snapshot']) AS k) WHERE starts_with(term, k) AND term <> k) WHERE r <= 32) GROUP BY 1""")
#: Terms are words of letters, digits and underscores here; BM25 cuts at underscores too.
_TERM = "len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x = '{0}')) > 0"
_FULLTEXT = f"""WITH h AS ({_HITS}), m AS (SELECT doc_id FROM documents WHERE {_TERM.format('vector')} OR {_TERM.format('snapshot')}),
a AS (SELECT CAST(m.doc_id AS VARCHAR) AS node, coalesce(h.score, 1.0) AS score FROM m LEFT JOIN h USING (doc_id))
SELECT node, score FROM a ORDER BY score DESC, node OFFSET 3 LIMIT 40"""


def fulltext_relationships(spark, sf):
    g = GraphCatalog.empty(spark)
    e = table(spark, sf, "edge_suggestions").filter(F.col("source_id").isNotNull() & F.col("target_id").isNotNull()).groupBy(F.col("suggestion_id").alias("_rid")).agg(F.min("source_id").alias("_src"), F.min("target_id").alias("_dst"), F.min("reason").alias("reason"))
    g.add_rels("SUGGESTED", e, id="_rid")
    g.query("CREATE FULLTEXT INDEX reasons FOR ()-[r:SUGGESTED]-() ON EACH [r.reason]")
    hits = g.query("CALL db.index.fulltext.queryRelationships('reasons', $q, {limit: 500}) YIELD relationship, score RETURN relationship, score", {"q": 'shared^2.5 OR /sess[a-z]+/ OR "ten close"^0.5'})
    return hits.select("relationship", "score")


_FULLTEXT_RELS = f"""WITH e AS (SELECT suggestion_id AS relationship, lower(min(reason)) AS text FROM edge_suggestions WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1),
s AS (SELECT relationship, CASE WHEN {_TERM.format("shared")} THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(text, 'sess[a-z]+') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'ten close') THEN 0.5 ELSE 0 END AS score FROM e)
SELECT relationship, score FROM s WHERE score > 0 ORDER BY score DESC, relationship LIMIT 500"""


def vector_nodes(spark, sf):
    q = engine._query_vector(spark, sf)
    hits = _searchable(spark, sf).query("CALL db.index.vector.queryNodes('vectors', 25, $v) YIELD node, score RETURN node, score", {"v": q})
    return hits.select("node", F.round("score", 5).alias("score"))


_VECTOR = engine._KNN.format(s=engine._COS).replace("LIMIT 20", "LIMIT 25").replace("SELECT b.vec_id,", "SELECT CAST(b.vec_id AS VARCHAR) AS node,").replace("b.vec_id LIMIT", "CAST(b.vec_id AS VARCHAR) LIMIT")


def vector_relationships(spark, sf):
    g = GraphCatalog.empty(spark)
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("e"), "vec_id").alias("_rid"), F.lit("a").alias("_src"), F.lit("b").alias("_dst"), "embedding")
    g.add_rels("NEAR", e, id="_rid")
    g.query("CREATE VECTOR INDEX edges FOR ()-[r:NEAR]-() ON (r.embedding)")
    hits = g.query("CALL db.index.vector.queryRelationships('edges', 25, $v) YIELD relationship, score RETURN relationship, score", {"v": engine._query_vector(spark, sf)})
    return hits.select("relationship", F.round("score", 5).alias("score"))


_VECTOR_RELS = _VECTOR.replace("CAST(b.vec_id AS VARCHAR)", "'e' || b.vec_id").replace("AS node", "AS relationship")


def _retrieve(name: str):
    def run(spark, sf):
        g = _searchable(spark, sf)
        o = {"query": "vector index", "embedding": engine._query_vector(spark, sf), "limit": 30, "vectorWeight": 0.7, "bm25Weight": 1.0}
        hits = g.query(f"CALL {name}($o) YIELD node, rrf_score, vector_rank, bm25_rank, search_method, fallback_triggered RETURN node, rrf_score, vector_rank, bm25_rank, search_method, fallback_triggered", {"o": o})
        return hits.select("node", F.round("rrf_score", 8).alias("rrf_score"), F.col("vector_rank").cast("long").alias("vector_rank"), F.col("bm25_rank").cast("long").alias("bm25_rank"), "search_method", "fallback_triggered")

    return run


_RETRIEVE = f"""WITH h AS ({_HITS.replace("'vector', 'snapshot'", "'vector', 'index'")}), m AS (SELECT doc_id FROM documents WHERE {_TERM.format('vector')} OR {_TERM.format('index')}),
b AS (SELECT CAST(m.doc_id AS VARCHAR) AS id, coalesce(h.score, 1.0) AS score FROM m LEFT JOIN h USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 120),
br AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM b),
v AS (SELECT CAST(b.vec_id AS VARCHAR) AS id, {engine._COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 3 ORDER BY 2 DESC, 1 LIMIT 120),
vr AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM v),
u AS (SELECT id, score, r AS b, 0 AS v, 1.0 / (60 + r) AS s FROM br UNION ALL SELECT id, score, 0, r, 0.7 / (60 + r) FROM vr),
f AS (SELECT id, sum(s) AS s, max(score) AS score, max(b) AS b, max(v) AS v FROM u GROUP BY 1)
SELECT id AS node, round(s, 8) AS rrf_score, CAST(v AS BIGINT) AS vector_rank, CAST(b AS BIGINT) AS bm25_rank, 'rrf_hybrid' AS search_method, false AS fallback_triggered FROM f ORDER BY s DESC, score DESC, id LIMIT 30"""


def discover(spark, sf):
    """Retrieval by the text alone, then nothing further away."""
    g = _searchable(spark, sf)
    return g.query("CALL graph.discover({query: 'vector index', limit: 30}) YIELD node, depth RETURN node, depth").select("node", F.col("depth").cast("long").alias("depth"))


_DISCOVER = f"""WITH h AS ({_HITS.replace("'vector', 'snapshot'", "'vector', 'index'")}), m AS (SELECT doc_id FROM documents WHERE {_TERM.format('vector')} OR {_TERM.format('index')})
SELECT CAST(m.doc_id AS VARCHAR) AS node, 0::BIGINT AS depth FROM m LEFT JOIN h USING (doc_id) ORDER BY coalesce(h.score, 1.0) DESC, node LIMIT 30"""


def token_matches(spark, sf):
    return fulltext.token_matches(table(spark, sf, "documents"), "doc_id", F.col("text"), "the vector index of a snapshot").select(F.col("id").alias("doc_id"), "matches")


_MATCHES = f"WITH {engine._TOKENS} SELECT id AS doc_id, CAST(len(list_distinct(list_filter(t, lambda x: x IN ('vector', 'index', 'snapshot')))) AS BIGINT) AS matches FROM t WHERE len(list_filter(t, lambda x: x IN ('vector', 'index', 'snapshot'))) > 0"


def lexical_seeds(spark, sf):
    return fulltext.lexical_seeds(table(spark, sf, "documents"), "doc_id", F.col("text"), 50).select(F.col("id").alias("doc_id"), F.round("idf", 6).alias("idf"))


_SEEDS = f"WITH {engine._TOKENS} SELECT id AS doc_id, round(max(greatest(0.0, ln(1 + (docs - df + 0.5) / (df + 0.5)))), 6) AS idf FROM p JOIN d USING (term), s GROUP BY 1 ORDER BY max(greatest(0.0, ln(1 + (docs - df + 0.5) / (df + 0.5)))) DESC, id LIMIT 50"


def rescore(spark, sf):
    """The even vectors as candidates, reranked by the stored vectors."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return ranking.rescore(e.filter("id % 2 = 0"), e, engine._query_vector(spark, sf), 20).select(F.col("id").alias("vec_id"), F.round("score", 5).alias("score"))


_RESCORE = engine._KNN.format(s=engine._COS).replace("WHERE a.vec_id = 3", "WHERE a.vec_id = 3 AND b.vec_id % 2 = 0")


def redact(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.array("doc_type").alias("labels"))
    return ranking.redact(d, F.col("labels"), ["chat", "memory"], ["text"]).select("doc_id", F.length("text").alias("n"))


_REDACT = "SELECT doc_id, CASE WHEN doc_type IN ('chat', 'memory') THEN NULL ELSE length(text) END AS n FROM documents"


def rerank(spark, sf):
    """An external scorer: here the number of characters."""
    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", "text").withColumnRenamed("doc_id", "id")
    return ranking.rerank_with(d, "text", _chars).select(F.col("id").alias("doc_id"), F.col("final_score").cast("long").alias("score"))


def _chars(texts: pd.Series) -> pd.Series:
    return texts.str.len().astype("float64")


def lucene_slop(spark, sf):
    d = table(spark, sf, "documents")
    return d.filter(lucene.condition(lucene.parse('text:"index vector"~3'), {"text": F.col("text")})).select("doc_id")


_SLOP = f"""WITH w AS (SELECT doc_id, {engine._WORDS} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
n AS (SELECT doc_id, list_position(w[i + 1:i + 4], 'vector') AS k FROM p WHERE w[i] = 'index')
SELECT DISTINCT doc_id FROM n WHERE k > 0"""


# -- the rest --------------------------------------------------------------------------------------------------------
def functions(spark, sf):
    return build(spark, sf).query(
        """MATCH (o:Order) RETURN o.o_orderkey AS k, toFloatOrNull('1.5') AS a, toFloatOrNull('x') AS b, toBooleanOrNull('TRUE') AS c, toBooleanOrNull('yes') AS d, toBoolean('FALSE') AS e, toBoolean('false') AS e2, toList(o.o_orderkey) AS f, ltrim('  x ') AS g, rtrim(' x ') AS h,
        endsWith(o.o_orderpriority, 'HIGH') AS i, contains(o.o_orderpriority, 'URG') AS j, datetime.year(o.o_orderdate) AS l, datetime.month(o.o_orderdate) AS m, datetime.day(o.o_orderdate) AS n, datetime.hour(o.o_orderdate) AS ho, datetime.minute(o.o_orderdate) AS mi, datetime.second(o.o_orderdate) AS se,
        exists(o.o_orderstatus) AS p, exists(o.nothing) AS q, size(keys(o)) > 5 AS r, isEmpty('') AS s, isEmpty([]) AS t, isEmpty(o.o_orderstatus) AS u, round(e(), 6) AS ee, round(cos(o.o_orderkey), 6) AS v, round(tan(0.5), 6) AS w, round(asin(0.5), 6) AS x, round(acos(0.5), 6) AS y, round(atan(2), 6) AS z,
        round(radians(180), 6) AS ra, round(sinh(1), 6) AS sh, round(cosh(1), 6) AS ch, round(tanh(1), 6) AS th, slice([1, 2, 3, 4], 1, 3) AS sl, apoc.convert.toJson('a&<b>') AS js, apoc.meta.type(o.o_totalprice) AS mt, size(apoc.create.uuid()) AS uu, size(randomUUID()) AS ru,
        rand() < 1 AS rd, apoc.convert.fromJsonMap('{"a": 7, "b": {"c": [1, 2]}}').a AS fj, apoc.convert.fromJsonMap('{"a": 7, "b": {"c": [1, 2]}}').b.c AS fc, apoc.map.merge({a: 1, b: 2}, {b: 3}).b AS mm, toString(toBoolean(null)) AS tn, size(toList(null)) AS tl, now() > 0 AS nw"""
    )


_FUNCTIONS = """SELECT o_orderkey AS k, 1.5::DOUBLE AS a, NULL::DOUBLE AS b, true AS c, NULL::BOOLEAN AS d, true AS e, false AS e2, [o_orderkey] AS f, 'x ' AS g, ' x' AS h, ends_with(o_orderpriority, 'HIGH') AS i, contains(o_orderpriority, 'URG') AS j,
year(o_orderdate) AS l, month(o_orderdate) AS m, day(o_orderdate) AS n, 0::BIGINT AS ho, 0::BIGINT AS mi, 0::BIGINT AS se, true AS p, false AS q, true AS r, true AS s, true AS t, o_orderstatus = '' AS u, round(exp(1), 6) AS ee, round(cos(o_orderkey), 6) AS v, round(tan(0.5), 6) AS w, round(asin(0.5), 6) AS x,
round(acos(0.5), 6) AS y, round(atan(2), 6) AS z, round(pi(), 6) AS ra, round(sinh(1), 6) AS sh, round(cosh(1), 6) AS ch, round(tanh(1), 6) AS th, [2::BIGINT, 3] AS sl, '"a\\u0026\\u003cb\\u003e"' AS js, 'FLOAT' AS mt, 36::BIGINT AS uu, 36::BIGINT AS ru, true AS rd, 7.0::DOUBLE AS fj, [1.0::DOUBLE, 2.0] AS fc, 3::BIGINT AS mm,
'null' AS tn, 0::BIGINT AS tl, true AS nw FROM orders"""


def patterns(spark, sf):
    """Comma-separated segments, a path of one node, several labels, a relationship that is already bound, column names, and a bounded scan."""
    g = build(spark, sf)
    a = g.query("MATCH (c:Customer)-[:FROM_NATION]->(n:Nation), (s:Supplier)-[:SUPPLIER_NATION]->(n) RETURN n.n_name AS k, count(*) AS v")
    b = g.query("MATCH p = (n:Nation) RETURN n.n_name AS k, length(p) + size(nodes(p)) AS v")
    c = g.query("MATCH (n:Nation)-[r:IN_REGION]->(x) MATCH (n)-[r]->(y:Region) RETURN 'bound' AS k, count(*) AS v")
    d = g.query("MATCH (c:Customer:Nation) RETURN count(*) AS v").withColumn("k", F.lit("labels"))
    e = g.query("MATCH (o:Order) WITH o LIMIT 17 RETURN 'limit' AS k, count(*) AS v")
    f = g.query("MATCH (r:Region) RETURN r.r_name, toUpper(r.r_name)")
    f = f.select(F.lit("+".join(f.columns)).alias("k"), F.lit(1).cast("long").alias("v"))
    out = a
    for x in (b, c, d, e, f):
        out = out.unionByName(x.select("k", F.col("v").cast("long").alias("v")))
    return out


_PATTERNS = """SELECT n_name AS k, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) * (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS v FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT n_name, 1 FROM nation UNION ALL SELECT 'bound', count(*) FROM nation UNION ALL SELECT 'labels', 0 UNION ALL SELECT 'limit', 17 UNION ALL SELECT 'r.r_name+toUpper(r.r_name)', 1 FROM region"""


def version_snapshot(spark, sf):
    """The store's nodes as of a moment: each life is a version, its end a tombstone."""
    n = table(spark, sf, "nodes").select("id", "created_at_unix_ms", "deleted_at_unix_ms").distinct()
    chain = n.select("id", F.col("created_at_unix_ms").alias("version"), F.lit(False).alias("deleted")).unionByName(n.filter("deleted_at_unix_ms is not null").select("id", F.col("deleted_at_unix_ms").alias("version"), F.lit(True).alias("deleted")))
    return versions.snapshot(chain, "id", 1_760_000_000_000).select("id", "version")


_VERSIONS = """WITH n AS (SELECT DISTINCT id, created_at_unix_ms AS c, deleted_at_unix_ms AS d FROM nodes), v AS (SELECT id, c AS v, false AS x FROM n UNION ALL SELECT id, d, true FROM n WHERE d IS NOT NULL)
SELECT id, m[1] AS version FROM (SELECT id, max((v, x)) AS m FROM v WHERE v <= 1760000000000 GROUP BY 1) WHERE NOT m[2]"""


def version_changes(spark, sf):
    n = table(spark, sf, "nodes").select("id", F.col("created_at_unix_ms").alias("version")).distinct()
    return versions.changed_between(n, "id", 1_750_000_000_000, 1_760_000_000_000)


def default_policies(spark, sf):
    return governance.default_policies(spark)


_DEFAULTS = """SELECT label, days * 86400::BIGINT AS max_age_seconds, true AS enabled, c AS cascade_delete, k AS data_category FROM (VALUES ('User', 730, true, 'USER'), ('AuditLog', 2555, false, 'AUDIT'), ('Financial', 2555, false, 'FINANCIAL'), ('PHI', 2190, true, 'PHI'), ('Analytics', 90, false, 'ANALYTICS')) t(label, days, c, k)"""


def audit_chain(spark, sf):
    """All events as a chain in which each names a hash that the one before it does not have, but for the first, and one is missing."""
    e = table(spark, sf, "events").select(F.col("event_id").cast("long").alias("sequence"), F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("payload"))
    first = e.agg(F.min("sequence")).first()[0] or 0
    e = e.withColumn("sequence", F.col("sequence") - (first - 1)).withColumn("previous_hash", F.when(F.col("sequence") > 1, F.lit("none")))
    return governance.chain_breaks(governance.chain(e, F.col("payload")).withColumnRenamed("expected", "hash").filter("sequence <> 77"), F.col("payload")).groupBy("error").agg(F.count("*").alias("n"))


_AUDIT_CHAIN = "SELECT CASE WHEN event_id - (SELECT min(event_id) FROM events) = 77 THEN 'gap' ELSE 'previous_hash' END AS error, count(*) AS n FROM events WHERE event_id - (SELECT min(event_id) FROM events) NOT IN (0, 76) GROUP BY 1"


def access_stats(spark, sf):
    return knowledge.access_stats(table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("at"))).select("id", "access_count")


def on_access(spark, sf):
    """Every customer with an order is accessed, those with a negative balance twice, in two batches."""
    g = shop(spark, sf)
    g.query("CREATE DECAY PROFILE p OPTIONS { halfLifeSeconds: 60 }")
    g.query("CREATE PROMOTION PROFILE up OPTIONS { multiplier: 1.5 }")
    g.query("CREATE PROMOTION POLICY pp FOR (n:Customer) APPLY { ON ACCESS { SET n.seen = true SET n.hits = coalesce(n.hits, 0) + 1 } APPLY PROFILE up WHEN 'n.hits >= 1' }")
    ids = table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("_id"))
    g.record_access(ids)
    g.record_access(ids.join(table(spark, sf, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("_id")), "_id", "left_semi"))
    return g.query("MATCH (c:Customer) RETURN c.key AS k, c.seen AS seen, c.hits AS hits")


_ON_ACCESS = """SELECT c_custkey AS k, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN true END AS seen,
CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END END AS hits FROM customer"""


def obligations(spark, sf):
    n = table(spark, sf, "nodes").select("id", "labels").distinct()
    return governance.obligations(n, [("audit", "Person", None), ("retention", "Article", 30), ("retention", "Person", 90)], F.col("labels")).groupBy("audit", "max_age_days").agg(F.count("*").alias("n"))


_OBLIGATIONS = """WITH n AS (SELECT DISTINCT id, labels FROM nodes)
SELECT coalesce(list_contains(labels, 'Person'), false) AS audit, CASE WHEN list_contains(labels, 'Article') THEN 30 WHEN list_contains(labels, 'Person') THEN 90 END AS max_age_days, count(*) AS n FROM n GROUP BY 1, 2"""


def hydrate(spark, sf):
    d = table(spark, sf, "documents")
    hits = d.select(F.col("doc_id").alias("id"), F.lit("Document").alias("label"), F.array(F.when(F.col("doc_id") % 7 == 0, "vector").otherwise("bm25")).alias("sources"))
    entities = d.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.array("doc_type").alias("labels"), F.struct(F.length("text").alias("n"), F.struct("lang").alias("meta")).alias("body"), "source")
    out = ranking.hydrate(hits, entities, ["chat"], ["vector"], ["body.meta.lang", "source", "nothing"])
    return out.select("id", F.col("labels")[0].alias("label"), F.col("body.n").alias("n"), F.col("body.meta.lang").alias("lang"), "source")


_HYDRATE = """SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'Document' ELSE doc_type END AS label, CASE WHEN doc_id % 5 <> 0 THEN length(text) END AS n, NULL::VARCHAR AS lang, NULL::VARCHAR AS source
FROM documents WHERE doc_id % 7 <> 0 AND NOT coalesce(doc_id % 5 <> 0 AND doc_type = 'chat', false)"""


def suggestions(spark, sf):
    s = table(spark, sf, "edge_suggestions")
    r = s.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relationship_type").alias("rel_type"), F.col("confidence").alias("score"), F.to_date("suggested_at").alias("session"), F.floor(micros(F.col("suggested_at")) / 1000).alias("at_ms"))
    return signals.suggestions(r).select("source", "target", "rel_type", F.round("confidence", 7).alias("confidence"), "signals", "first_seen_ms", "last_seen_ms")


_SUGGESTIONS = """WITH r AS (SELECT DISTINCT source_id AS source, target_id AS target, relationship_type AS rel_type, confidence, epoch_us(suggested_at) // 1000 AS t FROM edge_suggestions WHERE confidence IS NOT NULL AND NOT isnan(confidence) AND source_id <> target_id)
SELECT source, target, rel_type, round(least(1.0, avg(confidence)), 7) AS confidence, count(*) AS signals, min(t) AS first_seen_ms, max(t) AS last_seen_ms FROM r GROUP BY 1, 2, 3"""


def vector_operators(spark, sf):
    e = table(spark, sf, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    unit = chunks.normalise(F.col("embedding"))
    return e.select("vec_id", F.round(chunks.mean_vector(v), 6).alias("mean"), F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"), F.round(F.array_max(chunks.softmax(v)), 6).alias("softmax"), F.round(euclidean(v, unit), 5).alias("moved"), F.round(cosine(v, unit), 5).alias("same"))


_VECTORS = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e)
SELECT vec_id, round(list_avg(v), 6) AS mean, CASE WHEN n > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS length, round(exp(list_max(v)) / list_sum(list_transform(v, lambda x: exp(x))), 6) AS softmax, round(list_distance(v, list_transform(v, lambda x: x / n)), 5) AS moved, 1.0::DOUBLE AS same FROM n"""


def score_normalisation(spark, sf):
    """The raw scores of the algorithms on 0 .. 1."""
    return links.topology(*engine._graph(spark, sf), view=[F.round(links.normalised(a, F.col(a)), 6).alias(a) for a in links.ENSEMBLE])


_NORMALISED = engine._TOPOLOGY.replace(", 8) AS", ", 12) AS").replace("SELECT source, target, CAST(c AS DOUBLE)", ", raw AS (SELECT source, target, CAST(c AS DOUBLE)") + """)
SELECT source, target, round(1 - 1 / (1 + common_neighbors / 2), 6) AS common_neighbors, round(jaccard, 6) AS jaccard, round(tanh(adamic_adar / 5), 6) AS adamic_adar, round(tanh(resource_allocation / 5), 6) AS resource_allocation,
round(CASE WHEN preferential_attachment <= 1 THEN 0.0 ELSE least(1.0, log10(preferential_attachment) / 4) END, 6) AS preferential_attachment FROM raw"""


def link_hybrid(spark, sf):
    g, q = engine._graph(spark, sf)
    s = table(spark, sf, "similarity_results").filter(F.col("score").isNotNull() & ~F.isnan("score")).groupBy(F.col("source_id").alias("source"), F.col("id").alias("target")).agg(F.max("score").alias("similarity"))
    t = links.topology(g, q, [F.col("common_neighbors").alias("score")], first=10, also=s)
    return links.hybrid(t, s, 10).select("source", "target", F.round("score", 7).alias("score"), "rank")


_HYBRID = engine._TOPOLOGY.replace("SELECT source, target, CAST(c AS DOUBLE)", ", raw AS (SELECT source, target, CAST(c AS DOUBLE)") + """),
m AS (SELECT source, target, common_neighbors AS c, min(common_neighbors) OVER (PARTITION BY source) AS lo, max(common_neighbors) OVER (PARTITION BY source) AS hi FROM raw),
s AS (SELECT source_id AS source, id AS target, max(score) AS x FROM similarity_results WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
h AS (SELECT m.source, m.target, 0.5 * CASE WHEN hi = lo THEN 1.0 ELSE (c - lo) / (hi - lo) END + 0.5 * coalesce(x, 0) AS score FROM m LEFT JOIN s ON s.source = m.source AND s.target = m.target)
SELECT source, target, round(score, 7) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS INTEGER) AS rank FROM h WHERE score >= 0.3) WHERE rank <= 10"""


def _pairs_sql(window: int) -> str:
    return engine._LOG.format(w=window)


def co_access_default(spark, sf):
    """At the default window and least number of times."""
    return signals.co_access(engine._log(spark, sf)).select("a", "b", "count", F.round("confidence", 6).alias("confidence"))


_CO_DEFAULT = _pairs_sql(30_000) + " SELECT least(s, d) AS a, greatest(s, d) AS b, count(*) AS count, round(least(0.8, count(*) / 10), 6) AS confidence FROM p GROUP BY 1, 2 HAVING count(*) >= 3"


def temporal_default(spark, sf):
    return signals.temporal(engine._log(spark, sf)).select("source", "target", engine.six_places(F.col("confidence")).alias("confidence"))


_TEMPORAL_DEFAULT = _pairs_sql(1_800_000) + " SELECT s AS source, d AS target, round(max(1 - age / 1800000), 6) AS confidence FROM p GROUP BY 1, 2"


def similarity_default(spark, sf):
    e = table(spark, sf, "similarity_results").filter(F.col("score").isNotNull() & ~F.isnan("score")).select(F.col("source_id").alias("source"), F.col("id").alias("target"), "score")
    return signals.similar(e)


def batch_nearest(spark, sf):
    """For each of the stated queries (ids divisible by 100) the nearest of all vectors."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return chunks.batch_nearest(e.filter("id % 100 = 0"), e).select("id", F.col("neighbour").alias("n"), F.round("score", 5).alias("score"))


_BATCH = f"""SELECT id, n, round(s, 5) AS score FROM (SELECT a.vec_id AS id, b.vec_id AS n, {engine._COS} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {engine._COS} DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE r = 1"""

def extensions(spark, sf):
    """A function and a procedure of the user."""
    g = build(spark, sf)
    g.functions["twice"] = lambda c: c.a(0) * 2
    g.procedures["my.segments"] = lambda comp, prefix: comp.catalog.query("MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS segment").filter(F.startswith("segment", F.lit(prefix)))
    return g.query("CALL my.segments('M') YIELD segment WITH segment MATCH (c:Customer) WHERE c.c_mktsegment = segment RETURN segment, count(c) AS customers, twice(count(c)) AS twice")


_EXTENSIONS = "SELECT c_mktsegment AS segment, count(*) AS customers, 2 * count(*) AS twice FROM customer WHERE starts_with(c_mktsegment, 'M') GROUP BY 1"


def _streamed(make, keys: list[str]):
    """The events as a stream, read to the end; the last count of each key."""

    def run(spark, sf):
        folder = _folder(spark)
        whole = table(spark, sf, "events")
        source = f"{folder}/in"
        whole.select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts")).write.parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        out = f"{folder}/out"
        q = make(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(out).groupBy(*keys).agg(F.max("events").alias("events"))

    return run


_WINDOWS = "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_s, event_type, count(*) AS events FROM events GROUP BY 1, 2"

ALL: dict[str, tuple] = {
    "extensions": (extensions, _EXTENSIONS),
    "stream_windowed_counts": (_streamed(lambda e: access.windowed_counts(e, "ts", ["event_type"]).select(F.col("window_start").cast("long").alias("window_s"), "event_type", "events"), ["window_s", "event_type"]), _WINDOWS),
    "import_csv": (_imported("none"), _IMPORTED),
    "import_gzip": (_imported("gzip"), _IMPORTED),
    "import_zip": (import_zip, "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation"),
    "import_preflight": (import_preflight, "SELECT * FROM (VALUES ('c', 'node', true, 6), ('n', 'node', true, 4), ('r', 'relationship', true, 4), ('c', 'relationship', false, 0)) t(file, target, ok, columns)"),
    "import_header": (import_header, _HEADER),
    "export_import": (export_import, _EXPORT),
    "snapshot_round_trip": (snapshot_round_trip, _SNAPSHOT),
    "json_graph": (json_graph, _JSON),
    "json_procedures": (json_procedures, _JSON_PROCEDURES),
    "json_rows": (json_rows, "SELECT n_nationkey, n_name FROM nation"),
    "procedure_fulltext_nodes": (fulltext_nodes, _FULLTEXT),
    "procedure_fulltext_relationships": (fulltext_relationships, _FULLTEXT_RELS),
    "procedure_vector_nodes": (vector_nodes, _VECTOR),
    "procedure_vector_relationships": (vector_relationships, _VECTOR_RELS),
    "procedure_retrieve": (_retrieve("db.retrieve"), _RETRIEVE),
    "procedure_rretrieve": (_retrieve("db.rretrieve"), _RETRIEVE),
    "procedure_discover": (discover, _DISCOVER),
    "search_token_matches": (token_matches, _MATCHES),
    "search_lexical_seeds": (lexical_seeds, _SEEDS),
    "search_rescore": (rescore, _RESCORE),
    "search_lucene_slop": (lucene_slop, _SLOP),
    "search_redact": (redact, _REDACT),
    "search_rerank": (rerank, "SELECT doc_id, length(text) AS score FROM documents WHERE text IS NOT NULL"),
    "cypher_functions": (functions, _FUNCTIONS),
    "cypher_patterns": (patterns, _PATTERNS),
    "version_snapshot": (version_snapshot, _VERSIONS),
    "version_changes": (version_changes, "SELECT id, count(DISTINCT created_at_unix_ms) AS changes FROM nodes WHERE created_at_unix_ms > 1750000000000 AND created_at_unix_ms <= 1760000000000 GROUP BY 1"),
    "policy_defaults": (default_policies, _DEFAULTS),
    "policy_audit_chain": (audit_chain, _AUDIT_CHAIN),
    "policy_access_stats": (access_stats, "SELECT user_id AS id, count(*) AS access_count FROM events GROUP BY 1"),
    "policy_on_access": (on_access, _ON_ACCESS),
    "policy_obligations": (obligations, _OBLIGATIONS),
    "search_hydrate": (hydrate, _HYDRATE),
    "signal_suggestions": (suggestions, _SUGGESTIONS),
    "vector_operators": (vector_operators, _VECTORS),
    "links_normalised": (score_normalisation, _NORMALISED),
    "links_hybrid": (link_hybrid, _HYBRID),
    "signal_co_access_default": (co_access_default, _CO_DEFAULT),
    "signal_temporal_default": (temporal_default, _TEMPORAL_DEFAULT),
    "signal_similarity_default": (similarity_default, engine._SIMILAR.replace("0.55", "0.82")),
    "vector_batch_nearest": (batch_nearest, _BATCH),
}


def queries() -> dict:
    return {n: f for n, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for n, (_, q) in ALL.items() if q is not None}

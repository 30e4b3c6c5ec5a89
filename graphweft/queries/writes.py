"""Queries that write: each makes a graph of whole tables, runs statements on it and reads the result back; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.plans.catalog import Databases, GraphCatalog
from graphweft.plans.constraints import ConstraintError
from graphweft.plans.mutate import WriteError
from graphweft.queries.graph import build
from graphweft.session import table


def shop(spark, sf) -> GraphCatalog:
    """Regions, nations, customers and suppliers with unique string ids, so that they can be written to."""
    g = GraphCatalog.empty(spark)
    t = lambda n: table(spark, sf, n)
    one = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    g.add_nodes("Region", t("region").select(one("r", "r_regionkey").alias("_id"), F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))
    g.add_nodes("Nation", t("nation").select(one("n", "n_nationkey").alias("_id"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))
    g.add_nodes("Customer", t("customer").select(one("c", "c_custkey").alias("_id"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")))
    g.add_nodes("Supplier", t("supplier").select(one("s", "s_suppkey").alias("_id"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))
    g.add_rels("IN_REGION", t("nation").select(one("i", "n_nationkey").alias("_rid"), one("n", "n_nationkey").alias("_src"), one("r", "n_regionkey").alias("_dst")), id="_rid")
    g.add_rels("FROM_NATION", t("customer").select(one("f", "c_custkey").alias("_rid"), one("c", "c_custkey").alias("_src"), one("n", "c_nationkey").alias("_dst"), F.col("c_acctbal").alias("w")), id="_rid")
    g.add_rels("SUPPLIER_NATION", t("supplier").select(one("u", "s_suppkey").alias("_rid"), one("s", "s_suppkey").alias("_src"), one("n", "s_nationkey").alias("_dst")), id="_rid")
    return g


#: name -> (statements, the last of which reads, SQL).
WRITES: dict[str, tuple[list[str], str]] = {
    "write_create_nodes": (
        ["MATCH (n:Nation) CREATE (c:Capital:Town {name: n.name, of: n.key})", "MATCH (c:Town:Capital) RETURN c.name AS name, c.of AS k, labels(c) AS l"],
        "SELECT n_name AS name, n_nationkey AS k, ['Capital', 'Town'] AS l FROM nation",
    ),
    "write_create_path": (
        ["MATCH (c:Customer) WHERE c.balance > 5000 CREATE (c)-[:HOLDS {amount: c.balance}]->(v:Voucher {worth: c.balance * 2})", "MATCH (c:Customer)-[h:HOLDS]->(v:Voucher) RETURN c.key AS k, h.amount AS a, v.worth AS w"],
        "SELECT c_custkey AS k, c_acctbal AS a, c_acctbal * 2 AS w FROM customer WHERE c_acctbal > 5000",
    ),
    "write_create_batch": (
        ["UNWIND range(1, 500) AS x CREATE (i:Item {k: x, square: x * x})", "MATCH (i:Item) RETURN i.k AS k, i.square AS s"],
        "SELECT k, k * k AS s FROM (SELECT unnest(range(1, 501)) AS k)",
    ),
    "write_merge_node": (
        ["MATCH (c:Customer) MERGE (s:Segment {name: c.segment}) ON CREATE SET s.state = 'made' ON MATCH SET s.state = 'found'", "MATCH (s:Segment) RETURN s.name AS name, s.state AS state"],
        "SELECT DISTINCT c_mktsegment AS name, 'made' AS state FROM customer",
    ),
    "write_merge_on_create_on_match": (
        ["MATCH (c:Customer) MERGE (s:Segment {name: c.segment})", "UNWIND ['BUILDING', 'GARDEN', 'GARDEN'] AS x MERGE (s:Segment {name: x}) ON CREATE SET s.state = 'made' ON MATCH SET s.state = 'found'", "MATCH (s:Segment) RETURN s.name AS name, s.state AS state"],
        "SELECT DISTINCT c_mktsegment AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'found' END AS state FROM customer UNION ALL SELECT 'GARDEN', 'made'",
    ),
    "write_merge_relationship": (
        ["MATCH (c:Customer) MERGE (s:Segment {name: c.segment})", *["MATCH (c:Customer), (s:Segment) WHERE c.segment = s.name MERGE (c)-[:BUYS]->(s)"] * 2, "MATCH (c:Customer)-[r:BUYS]->(s:Segment) RETURN s.name AS s, count(r) AS n"],
        "SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1",
    ),
    "write_set_property": (
        ["MATCH (c:Customer) WHERE c.balance < 0 SET c.debt = -c.balance, c.balance = 0.0", "MATCH (c:Customer) RETURN c.key AS k, c.debt AS d, c.balance AS b"],
        "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN -c_acctbal END AS d, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS b FROM customer",
    ),
    "write_set_map_merges": (
        ["MATCH (n:Nation) SET n = {note: 'seen', twice: n.key * 2}", "MATCH (n:Nation) RETURN n.name AS name, n.note AS note, n.twice AS t"],
        "SELECT n_name AS name, 'seen' AS note, n_nationkey * 2 AS t FROM nation",
    ),
    "write_set_add_skips_null": (
        ["MATCH (n:Nation) SET n += {name: null, note: 'x'}", "MATCH (n:Nation) RETURN n.name AS name, n.note AS note"],
        "SELECT n_name AS name, 'x' AS note FROM nation",
    ),
    "write_set_relationship_property": (
        ["MATCH (c:Customer)-[r:FROM_NATION]->(n:Nation) SET r.rank = c.key % 7", "MATCH ()-[r:FROM_NATION]->() RETURN r.rank AS r, count(*) AS n"],
        "SELECT c_custkey % 7 AS r, count(*) AS n FROM customer GROUP BY 1",
    ),
    "write_set_label": (
        ["MATCH (c:Customer) WHERE c.balance < 0 SET c:Debtor", "MATCH (d:Debtor) RETURN d.key AS k, labels(d) AS l"],
        "SELECT c_custkey AS k, ['Customer', 'Debtor'] AS l FROM customer WHERE c_acctbal < 0",
    ),
    "write_set_last_row_stands": (
        ["UNWIND [3, 9, 1] AS v MATCH (n:Nation) SET n.v = v + n.key", "MATCH (n:Nation) RETURN n.key AS k, n.v AS v"],
        "SELECT n_nationkey AS k, n_nationkey + 1 AS v FROM nation",
    ),
    "write_remove_property": (
        ["MATCH (c:Customer) WHERE c.balance > 0 REMOVE c.segment", "MATCH (c:Customer) RETURN c.segment AS s, count(*) AS n"],
        "SELECT CASE WHEN c_acctbal > 0 THEN NULL ELSE c_mktsegment END AS s, count(*) AS n FROM customer GROUP BY 1",
    ),
    "write_remove_label": (
        ["MATCH (c:Customer) SET c:Person", "MATCH (c:Person) WHERE c.balance < 0 REMOVE c:Person", "MATCH (c:Customer) RETURN size(labels(c)) AS labels, count(*) AS n"],
        "SELECT CASE WHEN c_acctbal < 0 THEN 1 ELSE 2 END AS labels, count(*) AS n FROM customer GROUP BY 1",
    ),
    "write_delete_relationships": (
        ["MATCH (c:Customer)-[r:FROM_NATION]->() WHERE c.balance < 0 DELETE r", "MATCH (c:Customer) OPTIONAL MATCH (c)-[r:FROM_NATION]->() RETURN c.key AS k, count(r) AS n"],
        "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 0 ELSE 1 END AS n FROM customer",
    ),
    "write_delete_nodes": (
        ["MATCH (c:Customer)-[r:FROM_NATION]->() WHERE c.balance < 0 DELETE r, c", "MATCH (c:Customer) RETURN c.key AS k"],
        "SELECT c_custkey AS k FROM customer WHERE c_acctbal >= 0",
    ),
    "write_detach_delete": (
        ["MATCH (n:Nation) WHERE n.key < 5 DETACH DELETE n", "MATCH (n:Nation)<-[r]-(x) RETURN n.key AS k, type(r) AS t, count(*) AS n"],
        "SELECT c_nationkey AS k, 'FROM_NATION' AS t, count(*) AS n FROM customer WHERE c_nationkey >= 5 GROUP BY 1 UNION ALL SELECT s_nationkey, 'SUPPLIER_NATION', count(*) FROM supplier WHERE s_nationkey >= 5 GROUP BY 1",
    ),
    "write_foreach": (
        ["MATCH (n:Nation) FOREACH (x IN [n.key, 7, n.key + 10] | SET n.last = x)", "MATCH (n:Nation) RETURN n.key AS k, n.last AS x"],
        "SELECT n_nationkey AS k, n_nationkey + 10 AS x FROM nation",
    ),
    "write_unwind_merge_set_batch": (
        ["UNWIND [{k: 1, v: 3}, {k: 2, v: 5}, {k: 1, v: 9}, {k: 1, v: 4}] AS row MERGE (p:Point {k: row.k}) SET p.v = row.v", "MATCH (p:Point) RETURN p.k AS k, p.v AS v"],
        "SELECT * FROM (VALUES (1::BIGINT, 4::BIGINT), (2, 5)) t(k, v)",
    ),
    "write_unwind_match_merge_relationships": (
        ["UNWIND range(0, 23) AS k MATCH (a:Nation {key: k}), (b:Nation {key: k + 1}) MERGE (a)-[r:NEXT {gap: 1}]->(b)", "MATCH (a:Nation)-[r:NEXT]->(b:Nation) RETURN a.key AS a, b.key AS b, r.gap AS g"],
        "SELECT a.n_nationkey AS a, b.n_nationkey AS b, 1::BIGINT AS g FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 WHERE a.n_nationkey <= 23",
    ),
    "write_in_subquery": (
        ["MATCH (r:Region) CALL { WITH r MATCH (r)<-[:IN_REGION]-(n:Nation) RETURN count(n) AS k } SET r.nations = k", "MATCH (r:Region) RETURN r.name AS name, r.nations AS n"],
        "SELECT r_name AS name, count(n_nationkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "write_vector_property": (
        ["MATCH (n:Nation {key: 3}) CREATE (v:Card {k: 1})", "CALL db.create.setNodeVectorProperty('n3', 'embedding', [1.0, 2.0, 0.5])", "MATCH (n:Nation) RETURN n.key AS k, size(n.embedding) AS n"],
        "SELECT n_nationkey AS k, CASE n_nationkey WHEN 3 THEN 3 END AS n FROM nation",
    ),
    "write_relationship_vector_property": (
        ["CALL db.create.setRelationshipVectorProperty('i4', 'embedding', [1.0, 2.0])", "MATCH (n:Nation)-[r:IN_REGION]->() RETURN n.key AS k, size(r.embedding) AS n"],
        "SELECT n_nationkey AS k, CASE n_nationkey WHEN 4 THEN 2 END AS n FROM nation",
    ),
    "index_hints": (
        ["CREATE INDEX by_key FOR (n:Nation) ON (n.key)", "MATCH (n:Nation) USING INDEX n:Nation(key) WHERE n.key > 4 RETURN n.name AS name"],
        "SELECT n_name AS name FROM nation WHERE n_nationkey > 4",
    ),
    "index_statements": (
        ["CREATE INDEX by_key FOR (n:Nation) ON (n.key)", "CREATE RANGE INDEX by_w FOR ()-[r:FROM_NATION]-() ON (r.w)", "CREATE INDEX gone FOR (n:Nation) ON (n.name)", "DROP INDEX gone", "CREATE INDEX by_key IF NOT EXISTS FOR (n:Nation) ON (n.key)", "CALL db.indexes() YIELD name, labelOrType, properties RETURN name, labelOrType, properties"],
        "SELECT * FROM (VALUES ('by_key', 'Nation', ['key']), ('by_w', 'FROM_NATION', ['w'])) t(name, \"labelOrType\", properties)",
    ),
    "constraint_statements": (
        ["CREATE CONSTRAINT a FOR (n:Nation) REQUIRE n.key IS UNIQUE", "CREATE CONSTRAINT b FOR (n:Nation) REQUIRE n.name IS NOT NULL", "CREATE CONSTRAINT c FOR (n:Region) REQUIRE n.key IS UNIQUE", "DROP CONSTRAINT c", "CALL db.constraints() YIELD name, type, labelOrType, properties RETURN name, type, labelOrType, properties"],
        "SELECT * FROM (VALUES ('a', 'UNIQUE', 'Nation', ['key']), ('b', 'EXISTS', 'Nation', ['name'])) t(name, type, \"labelOrType\", properties)",
    ),
    "procedure_labels": (["CALL db.labels() YIELD label RETURN label"], "SELECT unnest(['Customer', 'Nation', 'Region', 'Supplier']) AS label"),
    "procedure_relationship_types": (["CALL db.relationshipTypes() YIELD relationshipType RETURN relationshipType"], "SELECT unnest(['FROM_NATION', 'IN_REGION', 'SUPPLIER_NATION']) AS \"relationshipType\""),
    "procedure_property_keys": (["CALL db.propertyKeys() YIELD propertyKey RETURN propertyKey"], "SELECT unnest(['balance', 'key', 'name', 'segment', 'w']) AS \"propertyKey\""),
    "procedure_ping": (["CALL db.ping() YIELD success RETURN success"], "SELECT true AS success"),
    "procedure_info": (
        ["CALL db.info() YIELD name, nodeCount, relationshipCount RETURN name, nodeCount, relationshipCount"],
        'SELECT \'graph\' AS name, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS "nodeCount", (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS "relationshipCount"',
    ),
    "procedure_stats": (
        ["CALL graph.stats() YIELD nodes, relationships, labels, relationshipTypes RETURN *"],
        'SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS nodes, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS relationships, 4::BIGINT AS labels, 3::BIGINT AS "relationshipTypes"',
    ),
    "procedure_rel_properties": (["CALL db.schema.relProperties() YIELD relType, propertyName, propertyType RETURN relType, propertyName, propertyType"], "SELECT 'FROM_NATION' AS \"relType\", 'w' AS \"propertyName\", 'FLOAT' AS \"propertyType\""),
    "procedure_components": (["CALL dbms.components() YIELD name, edition RETURN name, edition"], "SELECT 'graphweft' AS name, 'spark' AS edition"),
    "procedure_dbms_info": (["CALL dbms.info() YIELD id, name RETURN id, name"], "SELECT 'graphweft' AS id, 'graphweft' AS name"),
    "procedure_version": (["CALL graph.version() YIELD version RETURN size(version) > 0 AS known"], "SELECT true AS known"),
    "procedure_procedures": (["CALL dbms.procedures() YIELD name WITH name WHERE name IN ['db.labels', 'db.ping', 'db.retrieve', 'no.such'] RETURN name"], "SELECT unnest(['db.labels', 'db.ping', 'db.retrieve']) AS name"),
    "procedure_functions": (["CALL dbms.functions() YIELD name WITH name WHERE name IN ['size', 'count', 'labels', 'apoc.text.join', 'nope'] RETURN name"], "SELECT unnest(['size', 'count', 'labels', 'apoc.text.join']) AS name"),
    "procedure_config": (["CALL dbms.listConfig() YIELD name, value WITH name, value WHERE name = 'spark.sql.session.timeZone' RETURN name, value"], "SELECT 'spark.sql.session.timeZone' AS name, 'UTC' AS value"),
    "procedure_client_config": (["CALL dbms.clientConfig() YIELD name WITH name WHERE name = 'spark.sql.session.timeZone' RETURN name"], "SELECT 'spark.sql.session.timeZone' AS name"),
    "procedure_connections": (["CALL dbms.listConnections() YIELD connectionId RETURN count(connectionId) AS n"], "SELECT 0::BIGINT AS n"),
    "procedure_analyzers": (["CALL db.index.fulltext.listAvailableAnalyzers() YIELD analyzer RETURN analyzer"], "SELECT 'standard' AS analyzer"),
    "procedure_subgraph": (
        ["CALL apoc.path.subgraphNodes('r2', {maxLevel: 2, relationshipFilter: '<IN_REGION|<FROM_NATION'}) YIELD node, depth RETURN node, depth"],
        """SELECT 'r2' AS node, 0 AS depth UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2""",
    ),
    "decay_statements": (
        ["CREATE DECAY PROFILE p OPTIONS { halfLifeSeconds: 60, visibilityThreshold: 0.3, scoreFloor: 0.1, function: 'linear', scope: 'NODE' }", "CREATE DECAY PROFILE b FOR (n:Customer) APPLY { DECAY PROFILE p, order: 10 }", "ALTER DECAY PROFILE p SET OPTIONS { visibilityThreshold: 0.5 }",
         "CREATE DECAY PROFILE q OPTIONS { halfLifeSeconds: 5 }", "DROP DECAY PROFILE q", "CALL graph.knowledgepolicy.profiles() YIELD name, function, halfLifeMs, threshold, floor RETURN name, function, halfLifeMs, threshold, floor"],
        "SELECT 'p' AS name, 'linear' AS function, 60000::BIGINT AS \"halfLifeMs\", 0.5::DOUBLE AS threshold, 0.1::DOUBLE AS floor",
    ),
    "decay_procedures": (
        ["CREATE DECAY PROFILE p OPTIONS { halfLifeSeconds: 60, function: 'step' }", "CREATE DECAY PROFILE b FOR (n:Customer) APPLY { DECAY PROFILE p }", "CALL graph.decay.info() YIELD labels, function, halfLifeMs RETURN labels, function, halfLifeMs"],
        "SELECT ['Customer'] AS labels, 'step' AS function, 60000::BIGINT AS \"halfLifeMs\"",
    ),
    "promotion_statements": (
        ["CREATE DECAY PROFILE p OPTIONS { halfLifeSeconds: 60 }", "CREATE DECAY PROFILE b FOR (n:Customer) APPLY { DECAY PROFILE p }", "CREATE PROMOTION PROFILE up OPTIONS { multiplier: 1.5, scoreFloor: 0.9 }", "CREATE PROMOTION POLICY pp FOR (n:Customer) APPLY { APPLY PROFILE up WHEN 'n.balance > 0' }",
         "CALL graph.knowledgepolicy.policies() YIELD labels, profile, promotions RETURN labels, profile, promotions"],
        "SELECT ['Customer'] AS labels, 'p' AS profile, 1 AS promotions",
    ),
    "policy_resolve": (
        ["CREATE DECAY PROFILE p OPTIONS { halfLifeSeconds: 60 }", "CREATE DECAY PROFILE b FOR (n:Customer) APPLY { DECAY PROFILE p }", "CALL graph.knowledgepolicy.resolve('c1', 'Customer', '') YIELD id, profile RETURN id, profile"],
        "SELECT 'c1' AS id, 'p' AS profile",
    ),
    "policy_info": (["CREATE DECAY PROFILE p OPTIONS { halfLifeSeconds: 60 }", "CREATE DECAY PROFILE b FOR (n:Customer) APPLY { DECAY PROFILE p }", "CALL graph.knowledgepolicy.info() YIELD bindings RETURN bindings"], "SELECT 1::BIGINT AS bindings"),
}


def _written(statements: list[str]):
    def run(spark, sf):
        g = shop(spark, sf)
        for q in statements[:-1]:
            g.query(q)
        return g.query(statements[-1])

    return run


#: Constraint -> whether the tables keep it, as SQL.
RULES = {
    "FOR (c:Customer) REQUIRE c.key IS UNIQUE": "(SELECT count(DISTINCT c_custkey) = count(*) FROM customer)",
    "FOR (c:Customer) REQUIRE c.segment IS UNIQUE": "(SELECT count(DISTINCT c_mktsegment) = count(*) FROM customer)",
    "FOR (c:Customer) REQUIRE c.balance IS NOT NULL": "(SELECT count(c_acctbal) = count(*) FROM customer)",
    "FOR (c:Customer) REQUIRE c.nothing IS NOT NULL": "(SELECT count(*) = 0 FROM customer)",
    "FOR (c:Customer) REQUIRE (c.key, c.name) IS NODE KEY": "(SELECT count(DISTINCT (c_custkey, c_name)) = count(*) FROM customer)",
    "FOR (c:Customer) REQUIRE (c.segment, c.name) IS NODE KEY": "(SELECT count(DISTINCT (c_mktsegment, c_name)) = count(*) FROM customer)",
    "FOR (c:Customer) REQUIRE c.key IS :: INTEGER": "true",
    "FOR (c:Customer) REQUIRE c.name IS :: INTEGER": "(SELECT count(*) = 0 FROM customer)",
    "FOR (c:Customer) REQUIRE c.segment IN ['BUILDING', 'MACHINERY']": "(SELECT count(*) = 0 FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY'))",
    "FOR (c:Customer) REQUIRE (c.segment, c.key, c.balance) IS TEMPORAL": "(SELECT count(*) = 0 FROM (SELECT c_custkey, max(coalesce(c_acctbal, 1e308)) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey, c_acctbal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM customer) WHERE b > c_custkey)",
    "FOR ()-[r:FROM_NATION]-() REQUIRE r.w IS NOT NULL": "(SELECT count(c_acctbal) = count(*) FROM customer)",
    "FOR ()-[r:FROM_NATION]-() REQUIRE r.w IS :: STRING": "(SELECT count(*) = 0 FROM customer)",
}


def constraint_checks(spark, sf):
    """Which constraints the whole tables keep."""
    g, out = shop(spark, sf), []
    for rule in RULES:
        try:
            g.version().query("CREATE CONSTRAINT x " + rule)
            out.append((rule, True))
        except ConstraintError:
            out.append((rule, False))
    return spark.createDataFrame(out, "rule string, kept boolean")


_RULES = " UNION ALL ".join("SELECT '" + r.replace("'", "''") + f"' AS rule, {q} AS kept" for r, q in RULES.items())


def refused_writes(spark, sf):
    """Statements that must fail, and the graph after them: all or nothing."""
    g, out = shop(spark, sf), []
    g.query("CREATE CONSTRAINT u FOR (n:Nation) REQUIRE n.key IS UNIQUE")
    for q in ("MATCH (n:Nation) DELETE n", "CREATE (:Nation {key: 3})", "MATCH (n:Nation) SET n.key = 1", "MATCH (n:Nation) SET n._id = 'x'", "MATCH (n:Nation) REMOVE n._id", "MATCH (n:Nation) CREATE (n)-[:A|B]->(n)"):
        try:
            g.query(q)
            out.append((q, False))
        except (ConstraintError, WriteError):
            out.append((q, True))
    n, r = g.query("MATCH (n:Nation) RETURN count(*) AS n").first()[0], g.query("MATCH ()-[r]->() RETURN count(r) AS n").first()[0]
    return spark.createDataFrame([(*x, n, r) for x in out], "statement string, refused boolean, nations long, relationships long")


_REFUSED = """SELECT unnest(['MATCH (n:Nation) DELETE n', 'CREATE (:Nation {key: 3})', 'MATCH (n:Nation) SET n.key = 1', 'MATCH (n:Nation) SET n._id = ''x''', 'MATCH (n:Nation) REMOVE n._id', 'MATCH (n:Nation) CREATE (n)-[:A|B]->(n)']) AS statement,
true AS refused, (SELECT count(*) FROM nation) AS nations, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS relationships"""


def transaction(spark, sf):
    """A version that is thrown away and one that is adopted."""
    g = shop(spark, sf)
    lost, kept = g.version(), g.version()
    lost.query("MATCH (n:Nation) DETACH DELETE n")
    kept.query("MATCH (c:Customer) WHERE c.balance < 0 SET c.debt = true")
    g.adopt(kept)
    return g.query("MATCH (c:Customer)-[:FROM_NATION]->(n:Nation) RETURN n.key AS k, count(c.debt) AS debtors, count(c) AS customers")


_TRANSACTION = "SELECT c_nationkey AS k, count(*) FILTER (c_acctbal < 0) AS debtors, count(*) AS customers FROM customer GROUP BY 1"


def databases(spark, sf):
    d = Databases(spark)
    d.query("CREATE DATABASE first")
    d.query("CREATE DATABASE second")
    d.query("CREATE DATABASE first IF NOT EXISTS")
    d.query("DROP DATABASE second")
    d.catalogs["first"].adopt(shop(spark, sf))
    n = d.query("MATCH (c:Customer) RETURN count(*) AS n", database="first").first()[0]
    return d.query("SHOW DATABASES").select("name", "status", F.lit(n).alias("customers"))


_DATABASES = "SELECT unnest(['first', 'system']) AS name, 'online' AS status, (SELECT count(*) FROM customer) AS customers"


def parameters(spark, sf):
    return build(spark, sf).query("MATCH (c:Customer) WHERE c.c_mktsegment IN $segments AND c.c_acctbal > $low.balance RETURN c.c_custkey AS k, $tag AS tag", {"segments": ["BUILDING", "MACHINERY"], "low": {"balance": 100.0}, "tag": "x"})


_PARAMETERS = "SELECT c_custkey AS k, 'x' AS tag FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 100"


def explain(spark, sf):
    """Only that there is a plan with a scan, as plans are no data."""
    plan = build(spark, sf).query("EXPLAIN MATCH (c:Customer) RETURN count(*) AS n")
    return plan.select(F.contains("plan", F.lit("Scan parquet")).alias("scan"))


def settings(spark, sf):
    return build(spark, sf).query("SHOW SETTINGS").filter("name = 'spark.sql.session.timeZone'").select("name", "value")


def decay_visibility(spark, sf):
    """What decay statements leave visible of the store's nodes, at a time a hundred days after the last one was made."""
    g = GraphCatalog.empty(spark)
    n = table(spark, sf, "nodes").filter("size(labels) = 1 and labels[0] in ('Article', 'Person')")
    for label in ("Article", "Person"):
        g.add_nodes(label, n.filter(F.col("labels")[0] == label).select(F.col("id").alias("_id"), "created_at_unix_ms").groupBy("_id").agg(F.max("created_at_unix_ms").alias("created_at_unix_ms")))
    g.query("CREATE DECAY PROFILE p OPTIONS { halfLifeSeconds: 8640000, visibilityThreshold: 0.25, function: 'linear' }")
    g.query("CREATE DECAY PROFILE b FOR (n:Article) APPLY { DECAY PROFILE p }")
    return g.query("MATCH (n) RETURN labels(n)[0] AS label, count(*) AS n", now_ms=1_783_000_000_000)


_VISIBILITY = """WITH n AS (SELECT id, labels[1] AS label, max(created_at_unix_ms) AS c FROM nodes WHERE len(labels) = 1 AND labels[1] IN ('Article', 'Person') GROUP BY ALL)
SELECT label, count(*) AS n FROM n WHERE label = 'Person' OR c IS NULL OR greatest(1 - greatest(1783000000000 - c, 0) / 17280000000.0, 0) >= 0.25 GROUP BY 1"""

ALL = {
    "constraint_checks": (constraint_checks, _RULES),
    "write_refused": (refused_writes, _REFUSED),
    "transaction": (transaction, _TRANSACTION),
    "databases": (databases, _DATABASES),
    "cypher_parameters": (parameters, _PARAMETERS),
    "cypher_explain": (explain, "SELECT true AS scan"),
    "show_settings": (settings, "SELECT 'spark.sql.session.timeZone' AS name, 'UTC' AS value"),
    "decay_visibility": (decay_visibility, _VISIBILITY),
}


def queries() -> dict:
    return {n: _written(q) for n, (q, _) in WRITES.items()} | {n: f for n, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for n, (_, q) in (WRITES | ALL).items()}

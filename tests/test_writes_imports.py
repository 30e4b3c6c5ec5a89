"""Writes that touch an entity several times, deletes, imports that must not lose anything, conversions and recorded accesses."""

import pytest
from pyspark.sql import functions as F

from graphweft.analytics import links, signals
from graphweft.plans.catalog import GraphCatalog
from graphweft.plans.constraints import ConstraintError
from graphweft.plans.mutate import WriteError
from graphweft.policy import governance, knowledge
from graphweft.search import lucene, ranking
from graphweft.sources import graphfiles
from graphweft.text import chunks


def rows(g, text, **params):
    return [tuple(r) for r in g.query(text, params).collect()]


def test_the_last_row_of_a_list_stands(spark):
    g = GraphCatalog.empty(spark)
    g.query("CREATE (:N {k: 1}), (:N {k: 2})")
    g.query("UNWIND [3, 9, 1] AS v MATCH (n:N) SET n.v = v")
    assert rows(g, "MATCH (n:N) RETURN DISTINCT n.v AS v") == [(1,)]
    g.query("UNWIND [1, 2] AS a UNWIND [5, 4] AS b MATCH (n:N) SET n.v = a * 10 + b, n.w = b")
    assert rows(g, "MATCH (n:N) RETURN DISTINCT n.v AS v, n.w AS w") == [(24, 4)]
    g.query("UNWIND [7, 6] AS v WITH v AS x MATCH (n:N {k: 1}) SET n.v = x")
    assert rows(g, "MATCH (n:N) RETURN n.v AS v ORDER BY n.k") == [(6,), (24,)]
    g.query("UNWIND [{k: 1, v: 5}, {k: 3, v: 6}, {k: 1, v: null}] AS r MERGE (n:N {k: r.k}) SET n.v = r.v")
    assert rows(g, "MATCH (n:N) RETURN n.k AS k, n.v AS v ORDER BY k") == [(1, None), (2, 24), (3, 6)]


def test_deletes_join_on_equal_keys_and_leave_other_tables_alone(spark):
    g = GraphCatalog.empty(spark)
    g.query("CREATE (:A {k: 1})-[:R]->(:B {k: 1}), (:A {k: 2}), (:C {k: 1})-[:S]->(:C {k: 2})")
    c, s = next(t.df for t in g.nodes if t.labels == ("C",)), next(t.df for t in g.rels if t.type == "S")
    with pytest.raises(WriteError):
        g.query("MATCH (a:A) DELETE a")
    g.query("MATCH (a:A {k: 2}) DELETE a")
    g.query("MATCH (a:A) DETACH DELETE a")
    assert rows(g, "MATCH (a:A) RETURN count(*) AS n") == [(0,)] and rows(g, "MATCH ()-[r:R]->() RETURN count(r) AS n") == [(0,)]
    assert next(t.df for t in g.nodes if t.labels == ("C",)) is c and next(t.df for t in g.rels if t.type == "S") is s


def test_constraints_are_checked_on_what_changed(spark):
    g = GraphCatalog.empty(spark)
    g.query("CREATE (:A {k: 1}), (:B {k: 1})")
    g.query("CREATE CONSTRAINT u FOR (a:A) REQUIRE a.k IS UNIQUE")
    g.query("CREATE (:B {k: 1})")
    with pytest.raises(ConstraintError):
        g.query("CREATE (:A {k: 1})")
    with pytest.raises(ConstraintError):
        g.query("MATCH (b:B) SET b:A")


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_imports_keep_every_label_and_refuse_what_they_cannot_keep(spark, tmp_path):
    n = write(tmp_path, "n.csv", "k:ID,:LABEL,size:short,tags:string[]\na,B;A,3,x;y\nb,A;B,,\nc,,5,\nd,C,1,z\n")
    r = write(tmp_path, "r.csv", ":START_ID,:END_ID,:TYPE,w:byte\na,b,T,1\nb,nobody,T,2\n")
    g, report = graphfiles.import_graph(spark, [n], [r], empty_as_null=True)
    assert report == {"relationships_imported": 1, "bad_relationships": 1}
    assert rows(g, "MATCH (x:B) RETURN id(x) AS i, labels(x) AS l ORDER BY i") == [("a", ["A", "B"]), ("b", ["A", "B"])]
    assert rows(g, "MATCH (x:Node) RETURN id(x) AS i") == [("c",)] and rows(g, "MATCH (x:A)-[r:T]->(y:B) RETURN r.w AS w") == [(1,)]
    for bad in (":START_ID,:END_ID,:TYPE\na,b,\n", ":START_ID,:END_ID\na,b\n", ":START_ID,:END_ID,:TYPE,w:byte\na,b,T,abc\n", ":START_ID,:END_ID,:TYPE,w:float[]\na,b,T,1;x\n", ":START_ID,:END_ID,:TYPE,w:strange\na,b,T,1\n"):
        with pytest.raises(ValueError):
            graphfiles.import_graph(spark, [n], [write(tmp_path, "bad.csv", bad)], empty_as_null=True)
    many = write(tmp_path, "many.csv", ":START_ID,:END_ID,:TYPE\n" + "".join(f"a,b,T{k}\n" for k in range(1001)))
    with pytest.raises(ValueError):
        graphfiles.import_graph(spark, [n], [many], empty_as_null=True)


def test_conversions(spark):
    g = GraphCatalog(spark)
    q = "RETURN toBoolean(null) AS a, toBoolean('FALSE') AS b, toBoolean('false') AS c, toBoolean('') AS d, toBoolean(0) AS e, toBoolean([]) AS f, toList(null) AS h, toList(1) AS i, toList([2]) AS j"
    assert rows(g, q) == [(None, True, False, False, False, True, [], [1], [2])]
    q = """RETURN apoc.convert.fromJsonMap('{"a": 1, "b": [1, 2.5], "c": {"d": "x"}}') AS m, apoc.convert.fromJsonMap('[1]') AS n, apoc.convert.fromJsonMap('no') AS o"""
    m, n, o = rows(g, q)[0]
    assert (m.a, m.b, m.c.d, n, o) == (1.0, [1.0, 2.5], "x", None, None)
    df = spark.createDataFrame([('{"a": 1, "b": {"c": 2}}',)], "t string")
    g.add_nodes("T", df, "t")
    assert rows(g, "MATCH (x:T) RETURN apoc.convert.fromJsonMap(x.t).a AS a, apoc.convert.fromJsonMap(x.t).b AS b") == [("1", '{"c":2}')]


def test_accesses_of_nodes_and_relationships(spark):
    g = GraphCatalog.empty(spark)
    g.query("CREATE (a:M {k: 1})-[:L {k: 5}]->(b:M {k: 2})")
    g.query("CREATE PROMOTION PROFILE up OPTIONS { multiplier: 2.0 }")
    g.query("CREATE PROMOTION POLICY p FOR (n:M) APPLY { ON ACCESS { SET n.hits = coalesce(n.hits, 0) + 1 } APPLY PROFILE up }")
    g.query("CREATE PROMOTION POLICY q FOR ()-[r:L]-() APPLY { ON ACCESS { SET r.hits = coalesce(r.hits, 0) + 1 } APPLY PROFILE up }")
    first = g.query("MATCH (a:M {k: 1})-[r]->() RETURN id(a) AS _id UNION ALL MATCH ()-[r:L]->() RETURN id(r) AS _id")
    for _ in range(2):
        g.record_access(first.unionByName(first))
    g.record_access(first.limit(0))
    assert rows(g, "MATCH (a:M)-[r:L]->(b) RETURN a.hits AS a, r.hits AS r, b.hits AS b") == [(2, 2, None)]


def test_promotions_that_do_not_compile_are_errors(spark):
    df = spark.createDataFrame([("a", 0)], "_id string, created_at_unix_ms long")
    table = type("T", (), {"df": df})
    rule = lambda when: knowledge.KnowledgePolicy([knowledge.Binding(("A",), knowledge.Profile("p", 1, threshold=0.5), (knowledge.Promotion(when, 1, 1.0),))])
    assert knowledge.hide(table, rule("hits > 3"), ("A",), 9_000_000_000).count() == 0
    assert knowledge.hide(table, rule("created_at_unix_ms = 0"), ("A",), 9_000_000_000).count() == 1
    with pytest.raises(Exception, match="PARSE|parse|UNRESOLVED_ROUTINE"):
        knowledge.hide(table, rule("nofunction(("), ("A",), 9_000_000_000)


def test_busy_moments_are_cut(spark):
    log = spark.createDataFrame([(f"n{k % 9}", 1000 + k % 50) for k in range(300)] + [("x", None), (None, 5)], "node string, at_ms long")
    whole = sorted(tuple(r) for r in signals.access_pairs(log, 1000).collect())
    assert whole and whole == sorted(tuple(r) for r in signals.access_pairs(log, 1000, bucket_rows=7).collect())
    assert signals.access_pairs(log.limit(0), 1000).count() == 0


def test_attachment_with_a_hub(spark):
    edges = [("hub", f"n{k:02d}") for k in range(30)] + [(f"n{k:02d}", f"n{k + 1:02d}") for k in range(0, 28, 2)] + [("a", "b"), ("b", "c")]
    g = links.snapshot(spark.createDataFrame(edges, "a string, b string"))
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for k in (1, 3):
        got = {}
        for r in links.attachment(g, spark.createDataFrame([("a",), ("hub",), ("n05",), ("none",)], "source string"), k).orderBy("rank").collect():
            got.setdefault(r.source, []).append(r.target)
        for s in ("a", "hub", "n05"):
            want = sorted((t for t in near if t != s and t not in near[s]), key=lambda t: (-len(near[t]), t))[:k]
            assert got[s] == want
    plan = links.attachment(g, spark.createDataFrame([("a",)], "source string"), 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_obligations_and_hydration(spark):
    df = spark.createDataFrame([(1, ["A", "B"]), (2, ["B"]), (3, None)], "id int, labels array<string>")
    got = governance.obligations(df, [("retention", "B", 5), ("audit", "A", None), ("retention", "A", 9)], F.col("labels")).orderBy("id").collect()
    assert [(r.audit, r.max_age_days) for r in got] == [(True, 5), (False, 5), (False, None)]
    hits = spark.createDataFrame([(1, "L", ["v"], 0.5), (2, "L", ["b"], 0.4), (3, "X", None, 0.3)], "id int, label string, sources array<string>, score double")
    entities = spark.createDataFrame([(1, ["A"], "n", {"x": 1, "y": 2}), (1, ["A"], "n", {"x": 1, "y": 2})], "id int, labels array<string>, name string, body struct<x:int,y:int>")
    out = {r.id: r for r in ranking.hydrate(hits, entities, redacted=["name", "body.x", "no.such", "score"]).collect()}
    assert (out[1].name, out[1].body.x, out[1].body.y, out[1].score) == (None, None, 2, 0.5) and out[2].labels == ["L"] and out[3].labels == ["X"]
    assert {r.id for r in ranking.hydrate(hits, entities, ["X"], ["v"]).collect()} == {2} and [r.id for r in ranking.hydrate(hits, entities, require=True).collect()] == [1]


def test_scores_of_text_queries(spark):
    df = spark.createDataFrame([(1, "the red_fox ran"), (2, "red fox"), (3, None)], "id int, t string")
    tree = lucene.parse('red^2 OR "d_f" OR /R[A-Z]N/^0.5')
    assert {r.id: r.s for r in df.select("id", lucene.score(tree, {"t": F.col("t")}).alias("s")).collect()} == {1: 1.5, 2: 2.0, 3: None}


def test_batch_nearest(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [0.0, 0.0])], "id int, vector array<double>")
    assert {r.id: r.neighbour for r in chunks.batch_nearest(v, v).collect()} == {1: 2, 2: 1, 3: 2}
    assert chunks.batch_nearest(v.limit(0), v).count() == 0

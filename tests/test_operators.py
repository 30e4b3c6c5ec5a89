"""Search, policy, analytics, text, files and streaming on small inputs with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweft.analytics import links, signals
from graphweft.policy import governance, knowledge
from graphweft.search import fulltext, lucene, ranking
from graphweft.sources import graphfiles
from graphweft.text import chunks


def test_bm25_closed_form(spark):
    df = spark.createDataFrame([(1, "red apple"), (2, "red red pear"), (3, "the"), (4, None)], "id int, text string")
    got = {r.id: r.score for r in fulltext.bm25(df, "id", F.col("text"), "RED the", expand=False).collect()}
    idf = math.log(1 + (4 - 2 + 0.5) / 2.5)
    avg = 5 / 4
    want = {i: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg)) for i, tf, n in ((1, 1, 2), (2, 2, 3))}
    assert got == pytest.approx(want)
    assert fulltext.bm25(df, "id", F.col("text"), "the", expand=False).count() == 0
    assert fulltext.bm25(df.limit(0), "id", F.col("text"), "red").count() == 0
    assert {r.id for r in fulltext.bm25(df, "id", F.col("text"), "app").collect()} == {1}
    assert [tuple(r) for r in fulltext.token_matches(df, "id", F.col("text"), "red pear plum").orderBy("id").collect()] == [(1, 1), (2, 2)]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("quick", {1, 2}), ("quick AND fox", {1}), ("quick -fox", {2}), ("+quick +lazy", {2}), ('"quick brown"', {1}), ('"quick fox"~1', {1}), ('"quick fox"', set()), ("qu?ck", {1, 2}), ("la*", {2, 3}), ("quik~1", {1, 2}),
        ("/f.x/", {1}), ("n:[10 TO 20]", {1, 2}), ("n:{10 TO 20]", {2}), ("lang:*", {1, 3}), ("(fox OR lazy) AND NOT dog", {1}), ("lang:en^2 fox", {1}), ("nofield:x", set()), ("NOT quick", {3}),
    ],
)
def test_lucene(spark, query, want):
    df = spark.createDataFrame([(1, "The quick brown fox", 10, "en"), (2, "quick, lazy dog!", 20, None), (3, "Lazy dog", 30, "de")], "id int, text string, n int, lang string")
    cond = lucene.condition(lucene.parse(query), {"text": F.col("text"), "n": F.col("n"), "lang": F.col("lang")})
    assert {r.id for r in df.filter(cond).collect()} == want


def test_lucene_errors():
    for bad in ("(a", 'a"', "f:"):
        with pytest.raises(lucene.LuceneError):
            lucene.parse(bad)


def test_knn_rrf_and_mmr(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [1.0]), (5, None), (6, [0.0, 0.0])], "id int, v array<double>")
    assert [r.id for r in ranking.knn(df, "id", "v", [1.0, 0.1], 2).collect()] == [1, 3]
    a = spark.createDataFrame([(1, 9.0, 1), (2, 8.0, 2)], "id int, score double, rank int")
    b = spark.createDataFrame([(2, 0.9, 1), (3, 0.8, 2)], "id int, score double, rank int")
    got = ranking.rrf({"x": a, "y": b}, {"y": 0.5}).collect()
    assert [(r.id, r.x_rank, r.y_rank) for r in got] == [(2, 2, 1), (1, 1, 0), (3, 0, 2)]
    assert got[0].rrf_score == pytest.approx(1 / 62 + 0.5 / 61)
    assert ranking.mmr_order(np.array([1.0, 0.95, 0.5]), [[1, 0], [1, 0], [0, 1]], 0.5) == [0, 2, 1]
    assert ranking.mmr_order(np.array([1.0, 0.9]), [None, None], 1.0) == [0, 1]


def test_decay_and_resolution(spark):
    df = spark.createDataFrame([(0,), (100,), (200,), (-5,)], "age long")
    got = df.select(*[knowledge.decay_score(F.col("age"), h, f).alias(f"{f}{k}") for k, (h, f) in enumerate([(100, "exponential"), (100, "linear"), (100, "step"), (-100, "exponential"), (0, "linear")])]).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, 1.0, 0.0, 1.0), (0.5, 0.5, 1.0, 0.5, 1.0), (0.25, 0.0, 0.0, 0.75, 1.0), (1.0, 1.0, 1.0, 0.0, 1.0)]
    p = lambda n: knowledge.Profile(n)
    pol = knowledge.KnowledgePolicy([knowledge.Binding(("A",), p("a")), knowledge.Binding(("A", "B"), p("ab")), knowledge.Binding((), p("all")), knowledge.Binding(("C",), p("c"), order=-1)])
    assert [pol.resolve(x).profile.name for x in (["B", "A"], ["A", "B", "Z"], ["A", "Z"], ["Z"], [], ["A", "C"], None)] == ["ab", "ab", "a", "all", "all", "c", "all"]


def test_scores_with_promotion(spark):
    prof = knowledge.Profile("x", 100, "linear", threshold=0.3)
    b = knowledge.Binding(("A",), prof, (knowledge.Promotion("hits > 2", 3.0, 0.2, 0.9),))
    df = spark.createDataFrame([(["A"], 0, 5), (["A"], 0, 0), (["A"], None, 0), (None, 0, 0)], "labels array<string>, created_at_unix_ms long, hits int")
    got = knowledge.score_table(df, knowledge.KnowledgePolicy([b]), 160).collect()
    assert [(round(r.base_score, 3), round(r.final_score, 3), r.hidden) for r in got] == [(0.2, 0.6, False), (0.2, 0.2, True), (1.0, 1.0, False), (1.0, 1.0, False)]


def test_kalman_follows_observations(spark):
    df = spark.createDataFrame([("a", float(t), 0.8) for t in range(40)] + [("b", None, None), ("c", 0.0, 0.1)], "k string, at_s double, observed double")
    got = {r.k: r.weight for r in knowledge.kalman(df, "k").collect()}
    assert got.keys() == {"a", "c"} and got["a"] == pytest.approx(0.8, abs=0.02)


def test_retention_and_audit(spark):
    rec = spark.createDataFrame([("1", "User", "s1", 0), ("2", "User", "s2", 0), ("3", "User", "s3", 10**9), ("4", "Other", "s4", 0)], "id string, label string, subject string, created_at_s long")
    hold = spark.createDataFrame([("s2", True), ("s1", False)], "subject string, active boolean")
    d = governance.sweep(rec, governance.default_policies(spark), hold, 10**9)
    assert tuple(governance.sweep_report(d).first()) == (3, 2, 1, 1)
    assert {r.id for r in governance.apply_sweep(rec, d).collect()} == {"2", "3", "4"}
    import hashlib

    rows, before = [], None
    for k in range(1, 6):
        h = hashlib.sha256(f"{k}|{before or ''}|p{k}".encode()).hexdigest()
        rows.append((k, before, h, f"p{k}"))
        before = h
    schema = "sequence long, previous_hash string, hash string, payload string"
    assert governance.chain_breaks(spark.createDataFrame(rows, schema), F.col("payload")).count() == 0
    bad = [*rows[:2], (3, rows[2][1], rows[2][2], "changed"), rows[4]]
    assert {(r.sequence, r.error) for r in governance.chain_breaks(spark.createDataFrame(bad, schema), F.col("payload")).collect()} == {(3, "hash"), (5, "gap")}


def test_link_prediction_closed_form(spark):
    e = spark.createDataFrame([("alice", "bob"), ("alice", "charlie"), ("bob", "diana"), ("charlie", "diana"), ("bob", "eve"), ("bob", "alice"), ("x", "x"), (None, "bob")], "a string, b string")
    g = links.snapshot(e)
    q = spark.createDataFrame([("alice",)], "source string")
    t = {r.target: r for r in links.topology(g, q).collect()}
    assert t["diana"].common_neighbors == 2 and t["diana"].resource_allocation == pytest.approx(1 / 3 + 1 / 2) and t["diana"].jaccard == 1.0
    assert t["diana"].adamic_adar == pytest.approx(1 / math.log(3) + 1 / math.log(2))
    got = spark.range(1).select(links.normalised("common_neighbors", F.lit(2.0)), links.normalised("resource_allocation", F.lit(1 / 3 + 1 / 2))).first()
    assert tuple(got) == pytest.approx((0.5, math.tanh((1 / 3 + 1 / 2) / 5)))
    assert [(r.target, r.rank) for r in links.predict(g, q, "jaccard").collect()][0] == ("diana", 1)
    assert {r.target for r in links.attachment(g, q, 5).collect()} == {"diana", "eve"}
    assert links.ensemble(g, q).first().target == "diana"
    sem = spark.createDataFrame([("alice", "eve", 0.9)], "source string, target string, similarity double")
    assert links.hybrid(links.predict(g, q, "jaccard"), sem, 5).count() == 2


@pytest.mark.parametrize("block", [2, 1_000])
def test_pairs_that_meet_in_hubs(spark, monkeypatch, block):
    """With every node above degree 8 a hub all is as without hubs, also the best few and those with a similarity."""
    monkeypatch.setattr(links, "BLOCK", block)
    rng = np.random.default_rng(11)
    e = [(f"n{x:02d}", f"n{y:02d}") for x, y in zip(rng.integers(0, 60, 110), rng.zipf(1.6, 110) % 60)]
    e += [("h", f"n{k:02d}") for k in range(0, 60, 2)] + [("i", f"n{k:02d}") for k in range(0, 60, 3)] + [("h", "i"), ("h", "leaf")] + [("h", f"m{k:02d}") for k in range(30)]
    g = links.snapshot(spark.createDataFrame(e, "a string, b string"))
    q = spark.createDataFrame([(x,) for x in ("n00", "n02", "n03", "n06", "n07", "n12", "h", "leaf", "none")], "source string")

    def of(df):
        rows = df.collect()
        out = {(r.source, r.target): tuple(r)[2:] for r in rows}
        assert len(out) == len(rows)
        return out

    def same(a, b):
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in b)

    want = of(links.topology(g, q, hub=10**9))
    same(of(links.topology(g, q, hub=8)), want)
    assert len(want) > 200
    sim = spark.createDataFrame([(s, t, float(v)) for (s, t), v in zip(sorted(want), rng.random(len(want))) if v > 0.8] + [("n00", "h", 0.9), ("n00", "n00", 1.0)], "source string, target string, similarity double")
    for name in ("common_neighbors", "jaccard"):
        view = [F.round(name, 9).alias("score")]
        full = links.topology(g, q, view, hub=10**9)
        few = links.topology(g, q, view, first=3, also=sim, hub=8)
        assert few.count() < full.count()
        same(of(links.top(few, 3)), of(links.top(full, 3)))
        same(of(links.hybrid(few, sim, 3, threshold=0.1)), of(links.hybrid(full, sim, 3, threshold=0.1)))


def test_signals(spark):
    log = spark.createDataFrame([("a", 0), ("b", 10), ("a", 20), ("b", 25), ("c", 70_000), (None, 5)], "node string, at_ms long")
    assert [tuple(r) for r in signals.co_access(log, 30_000, 3).collect()] == [("a", "b", 4, 0.4)] or [r["count"] for r in signals.co_access(log, 30_000, 3).collect()] == [4]
    t = {(r.source, r.target): r.confidence for r in signals.temporal(log, 100).collect()}
    assert t == pytest.approx({("b", "a"): 0.95, ("a", "b"): 0.9})
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("b", "a", 0.9), ("c", "d", 0.4)], "source string, target string, confidence double")
    assert {(r.source, r.target): round(r.confidence, 2) for r in signals.transitive(e).collect()} == {("a", "c"): 0.72}
    p = spark.createDataFrame([("a", "b", 0.96), ("a", "b", 0.83), ("a", "c", 0.5), ("a", "a", 1.0)], "source string, target string, score double")
    assert [tuple(r) for r in signals.similar(p).collect()] == [("a", "b", 0.9)]


@pytest.mark.parametrize("rows", [1, 400, 100_000])
def test_closest_accesses_in_passes(spark, rows):
    """Against all pairs, with ties in time and several passes; the pairs themselves are never shuffled or aggregated."""
    rng = np.random.default_rng(3)
    log = [(f"n{int(x)}", int(t)) for x, t in zip(rng.zipf(1.5, 900) % 60, rng.integers(-200, 4_000, 900))]
    log += [("é", 5), ("z", 5), ("\U0001f600", 5), ("\ufb01", 5)]
    want = {}
    for x, t1 in log:
        for y, t0 in log:
            if x != y and t1 - t0 < 50 and (t0 < t1 or t0 == t1 and y < x):
                want[x, y] = min(t1 - t0, want.get((x, y), 50))
    frame = spark.createDataFrame([*log, (None, 7), ("n1", None)], "node string, at_ms long")
    if rows == 1:
        frame, rows = frame.filter("node in ('n1', 'n2', 'n3', 'z')"), 30
        want = {k: v for k, v in want.items() if set(k) <= {"n1", "n2", "n3", "z"}}
    df = signals.temporal(frame, 50, rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Join" not in plan
    got = df.collect()
    assert {(r.source, r.target): r.confidence for r in got} == pytest.approx({k: 1 - v / 50 for k, v in want.items()})
    assert len(got) == len(want)
    assert signals.temporal(frame.limit(0), 50).count() == 0


def test_closest_accesses_of_busy_nodes(spark):
    """Three nodes with 100,000 accesses each in one window: their 30 billion pairs can't be gone through; b follows a and c, which come at one time."""
    n = 100_000
    frame = spark.range(3 * n).selectExpr("element_at(array('a', 'b', 'c'), int(id % 3) + 1) AS node", "id div 3 * 10 + if(id % 3 = 1, 4, 0) AS at_ms")
    at = np.sort(np.concatenate([np.arange(n) * 10, np.arange(n) * 10, np.arange(n) * 10 + 4]))
    low, high = signals._ranges(at, np.arange(n) * 10, None, 10 * n)
    assert (high - low).sum() < 2 * len(at)
    got = {(r.source, r.target): r.age for r in signals.closest(frame, 10 * n).collect()}
    assert got == {("a", "b"): 6, ("a", "c"): 10, ("b", "a"): 4, ("b", "c"): 4, ("c", "a"): 0, ("c", "b"): 6}


def test_chunks(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "id int, t string")
    assert [(r.chunk, r.char_offset) for r in chunks.by_chars(df, "t", 4, 1).orderBy("chunk_no").collect()] == [("abcd", 0), ("defg", 3), ("ghij", 6)]
    assert chunks.sentence_chunks("One. Two! Three three three. x", 9) == [(0, "One. Two!"), (9, " Three three three."), (28, " x")]
    text = "a b c d e f g h"
    assert chunks.token_chunks(text, 3, 1, lambda t: len(t.split()))[0] == "a b c"
    assert chunks.token_chunks(" x ", 3, 0, lambda t: len(t.split())) == ["x"]
    got = spark.range(1).select(chunks.softmax(F.array(F.lit(1.0), F.lit(1.0))), chunks.normalise(F.array(F.lit(3.0), F.lit(4.0))), chunks.entity_text(F.array().cast("array<string>"), {})).first()
    assert tuple(got) == ([0.5, 0.5], [0.6, 0.8], "node")


def test_files_round_trip(spark, tmp_path):
    import gzip
    import zipfile

    nodes = ':ID(P),:LABEL,name,age:int,tags:string[],vec:vector{dimensions:2},:IGNORE\n1,Person,"A, b",3,x;y,0.5;1,z\n2,Person;Admin,Bob,,,1;2,z\n'
    rels = ":START_ID(P),:END_ID(P),:TYPE,w:double\n1,2,KNOWS,0.5\n1,9,KNOWS,1\n"
    (tmp_path / "n.csv.gz").write_bytes(gzip.compress(nodes.encode()))
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("r.csv", rels)
    g, report = graphfiles.import_graph(spark, [str(tmp_path / "n.csv.gz")], [str(tmp_path / "r.zip")])
    assert report == {"relationships_imported": 1, "bad_relationships": 1}
    assert [tuple(r) for r in g.query("MATCH (a)-[r:KNOWS]->(b) RETURN a.name AS a, a.tags AS t, r.w AS w, b.name AS b").collect()] == [("A, b", ["x", "y"], 0.5, "Bob")]
    with pytest.raises(ValueError):
        graphfiles.import_graph(spark, [str(tmp_path / "n.csv.gz")], [str(tmp_path / "r.zip")], skip_bad_relationships=False)
    graphfiles.write_snapshot(g, str(tmp_path / "snap"))
    assert graphfiles.read_snapshot(spark, str(tmp_path / "snap")).query("MATCH (n) RETURN count(*) AS n").first()[0] == 2
    assert any("rels" in p for p in graphfiles.export_graph(g, str(tmp_path / "out")))
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "1", "labels": ["A"], "properties": {"k": 1}}, {"id": "2", "labels": ["A"], "properties": {"k": 2}}], "relationships": [{"id": "r", "startNode": "1", "endNode": "2", "type": "T", "properties": {"w": 1.5}}]}')
    j = graphfiles.import_json(spark, str(tmp_path / "g.json"))
    assert tuple(j.query("MATCH (a)-[r:T]->(b) RETURN a.k AS a, b.k AS b, r.w AS w").first()) == (1, 2, 1.5)
    with pytest.raises(ValueError):
        graphfiles.parse_header(["name:string"], "node")


def test_search_procedures(spark):
    from graphweft.plans.catalog import GraphCatalog

    g = GraphCatalog.empty(spark)
    g.query("CREATE (:Doc {t: 'red apple', v: [1.0, 0.0]}), (:Doc {t: 'green apple', v: [0.0, 1.0]}), (:Doc {t: 'plum', v: [0.7, 0.7]})")
    g.query("CREATE FULLTEXT INDEX ft FOR (d:Doc) ON EACH [d.t]")
    g.query("CREATE VECTOR INDEX vx FOR (d:Doc) ON (d.v)")
    ids = {r.t: r.i for r in g.query("MATCH (d:Doc) RETURN d.t AS t, id(d) AS i").collect()}
    assert {r.node for r in g.query("CALL db.index.fulltext.queryNodes('ft', 'apple -green') YIELD node, score RETURN node").collect()} == {ids["red apple"]}
    assert [r.node for r in g.query("CALL db.index.vector.queryNodes('vx', 1, [1.0, 0.1]) YIELD node RETURN node").collect()] == [ids["red apple"]]
    got = g.query("CALL db.retrieve({query: 'apple', embedding: [0.0, 1.0], limit: 2}) YIELD node, rrf_score, search_method RETURN node, search_method ORDER BY rrf_score DESC").collect()
    assert got[0].node == ids["green apple"] and got[0].search_method == "rrf_hybrid"
    g.query("MATCH (a:Doc {t: 'plum'}), (b:Doc {t: 'red apple'}) CREATE (a)-[:NEAR]->(b)")
    got = {r.node: r.depth for r in g.query("CALL graph.discover({query: 'red. green.', depth: 1, limit: 2})").collect()}
    assert got == {ids["red apple"]: 0, ids["green apple"]: 0, ids["plum"]: 1}


def test_streaming_co_access(spark, tmp_path):
    from graphweft.streaming.access import co_access_stream, windowed_counts

    spark.createDataFrame([("g", n, t) for n, t in [("a", 0), ("b", 1), ("a", 2), ("b", 3), ("c", 90_000)]], "g string, node string, at_ms long").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("g string, node string, at_ms long").parquet(str(tmp_path / "in"))
    q = co_access_stream(src, "g", "node", "at_ms").writeStream.format("memory").queryName("co_access_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.a, r.b, r["count"]) for r in spark.table("co_access_out").collect()} == {("a", "b", 3), ("a", "b", 4)}
    batch = spark.createDataFrame([("x", 0)], "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert windowed_counts(batch, "ts", ["k"]).count() == 1


def test_functions_registry():
    from graphweft.functions.scalars import REGISTRY, register

    assert len(REGISTRY) > 110
    with pytest.raises(ValueError):
        register("toUpper")(lambda c: c)


def test_versions_databases_and_preflight(spark, tmp_path):
    from graphweft.operators import versions
    from graphweft.plans.catalog import Databases

    c = spark.createDataFrame([("a", 1, "x", False), ("a", 3, "y", False), ("b", 2, "z", False), ("b", 4, None, True)], "id string, version long, v string, deleted boolean")
    see = lambda at: {r.id: r.v for r in versions.snapshot(c, "id", at).collect()}
    assert see(0) == {} and see(2) == {"a": "x", "b": "z"} and see(9) == {"a": "y"}
    assert {(r.id, r.version, r.next_version) for r in versions.intervals(c, "id").collect()} == {("a", 1, 3), ("a", 3, None), ("b", 2, 4), ("b", 4, None)}
    assert [(r.id, r.changes) for r in versions.changed_between(c, "id", 1, 3).orderBy("id").collect()] == [("a", 1), ("b", 1)]
    d = Databases(spark)
    d.query("CREATE DATABASE one")
    d.query("CREATE (:X {k: 1})", database="one")
    assert d.query("MATCH (x:X) RETURN x.k AS k", database="one").first()[0] == 1
    assert [r.name for r in d.query("SHOW DATABASES").collect()] == ["one", "system"]
    d.query("DROP DATABASE one")
    with pytest.raises(ValueError):
        d.query("RETURN 1 AS x", database="one")
    (tmp_path / "n.csv").write_text(":ID,name\n1,a\n")
    (tmp_path / "r.csv").write_text(":START_ID,w:int\n1,2\n")
    got = graphfiles.preflight(spark, [(str(tmp_path / "n.csv"), "node"), (str(tmp_path / "r.csv"), "relationship"), (str(tmp_path / "none.csv"), "node")]).collect()
    assert [(r.ok, r.columns) for r in got] == [(True, 2), (False, 0), (False, 0)]


def test_rescore_uses_stored_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1])], "id int, vector array<double>")
    assert [r.id for r in ranking.rescore(spark.createDataFrame([(2,), (3,), (3,)], "id int"), v, [1.0, 0.0], 5).collect()] == [3, 2]

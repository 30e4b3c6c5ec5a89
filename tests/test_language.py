"""The query language on small graphs with known answers, and against a nested-loop interpreter."""

import random

import pytest

from graphweft.plans.catalog import GraphCatalog
from graphweft.plans.compiler import CompileError
from graphweft.plans.constraints import ConstraintError
from graphweft.plans.mutate import WriteError
from graphweft.plans.parser import ParseError, parse


def rows(g, text, **params):
    return [tuple(r) for r in g.query(text, params).collect()]


@pytest.fixture(scope="module")
def social(spark):
    g = GraphCatalog.empty(spark)
    g.add_nodes("Person", spark.createDataFrame([(str(k), n, a) for k, n, a in [(1, "Ann", 30), (2, "Bob", None), (3, "Cat", 25), (4, "Dan", 41)]], "_id string, name string, age long"))
    g.add_rels("TRUSTS", spark.createDataFrame([("e1", "1", "2", 5), ("e2", "2", "1", 3), ("e3", "3", "2", None), ("e4", "4", "3", 2), ("e5", "2", "3", 9)], "_rid string, _src string, _dst string, w long"), id="_rid")
    return g


@pytest.fixture(scope="module")
def retail(spark):
    g = GraphCatalog(spark)
    g.add_nodes("Product", spark.createDataFrame([(1, "Lamp", 6.0), (2, "Nail", 0.5), (3, "Rope", 4.0)], "id long, name string, price double"), "id")
    g.add_nodes("Order", spark.createDataFrame([(1,), (2,)], "id long"), "id")
    g.add_rels("ORDERS", spark.createDataFrame([(1, 1, 5), (2, 1, 3), (2, 2, 40)], "o long, p long, quantity int"), "o", "p", "Order", "Product")
    return g


def test_optional_match_keeps_zero_rows(retail):
    assert rows(retail, "MATCH (p:Product) OPTIONAL MATCH (p)<-[r:ORDERS]-(o:Order) RETURN p.name AS n, count(o) AS k ORDER BY k DESC, n") == [("Lamp", 2), ("Nail", 1), ("Rope", 0)]


def test_revenue_by_product(retail):
    assert rows(retail, "MATCH (p:Product)<-[r:ORDERS]-(:Order) WITH p, sum(p.price * r.quantity) AS revenue RETURN p.name AS n, revenue ORDER BY revenue DESC") == [("Lamp", 48.0), ("Nail", 20.0)]


def test_aggregates_and_identity(spark):
    g = GraphCatalog(spark).add_nodes("Item", spark.createDataFrame([("a", 10), ("a", 30), ("b", 5)], "cat string, val int").withColumnRenamed("cat", "cat"), "val")
    assert rows(g, "MATCH (i:Item) RETURN count(i) AS n, sum(i.val) AS s, min(i.val) AS lo, max(i.val) AS hi") == [(3, 45.0, 5.0, 30.0)]
    assert rows(g, "MATCH (i:Item) WHERE i.val > 99 RETURN count(i) AS n, sum(i.val) AS s, avg(i.val) AS a, collect(i.val) AS l, stdev(i.val) AS d") == [(0, 0.0, None, [], None)]
    assert rows(g, "MATCH (i:Item {cat: 'b'}) RETURN stdev(i.val) AS d") == [(0.0,)]


def test_mutual_and_homomorphism(social):
    assert rows(social, "MATCH (a:Person)-[:TRUSTS]->(b)-[:TRUSTS]->(a) WHERE a.name < b.name RETURN a.name AS a, b.name AS b ORDER BY b") == [("Ann", "Bob"), ("Bob", "Cat")]
    assert rows(social, "MATCH (a)-[r]->(b)<-[s]-(c) RETURN count(*) AS n") == [(9,)]
    assert social.query("MATCH (a)-[r]->(b)<-[s]-(c) RETURN count(*) AS n", unique_rels=True).first()[0] == 4


def test_variable_length_and_paths(social):
    assert rows(social, "MATCH (a:Person {name: 'Dan'})-[:TRUSTS*1..3]->(x) RETURN x.name AS x ORDER BY x") == [("Ann",), ("Bob",), ("Cat",)]
    assert rows(social, "MATCH p = (a:Person {name: 'Dan'})-[:TRUSTS*2]->(x) RETURN x.name AS x, length(p) AS l ORDER BY x") == [("Bob", 2)]
    assert rows(social, "MATCH (a:Person {name: 'Dan'}), (b:Person {name: 'Bob'}) MATCH p = shortestPath((a)-[:TRUSTS*]->(b)) RETURN length(p) AS l, [n IN nodes(p) | n._id] AS n") == [(2, ["4", "3", "2"])]
    assert rows(social, "MATCH (a:Person {name: 'Bob'}), (b:Person {name: 'Dan'}) MATCH p = shortestPath((a)-[:TRUSTS*]->(b)) RETURN p") == []
    assert rows(social, "MATCH (a:Person {name: 'Dan'})-[:TRUSTS*0..1]->(x) RETURN count(*) AS n") == [(2,)]


def test_all_shortest_paths_keeps_equal_routes(spark):
    g = GraphCatalog.empty(spark).add_nodes("N", spark.createDataFrame([(x,) for x in "abcd"], "_id string"))
    g.add_rels("T", spark.createDataFrame([("1", "a", "b"), ("2", "a", "c"), ("3", "b", "d"), ("4", "c", "d"), ("5", "a", "b")], "_rid string, _src string, _dst string"), id="_rid")
    assert rows(g, "MATCH (x {_id: 'a'}), (y {_id: 'd'}) MATCH p = allShortestPaths((x)-[:T*]->(y)) RETURN count(p) AS n, min(length(p)) AS l") == [(3, 2.0)]
    assert rows(g, "MATCH (x {_id: 'a'})-[:T*1..2]->(y {_id: 'd'}) RETURN count(*) AS n") == [(3,)]
    assert rows(g, "CALL apoc.path.subgraphNodes('a', {maxLevel: 1}) YIELD node, depth RETURN node, depth ORDER BY node") == [("a", 0), ("b", 1), ("c", 1)]


def test_two_valued_logic(social):
    assert rows(social, "MATCH (p:Person) WHERE p.age = null RETURN p.name AS n") == [("Bob",)]
    assert rows(social, "MATCH (p:Person) WHERE NOT p.age > 26 RETURN p.name AS n ORDER BY n") == [("Bob",), ("Cat",)]
    assert rows(social, "MATCH (p:Person) WHERE p.age <> 30 RETURN count(*) AS n") == [(3,)]
    assert rows(social, "RETURN null = null AS a, null IN [null] AS b, 1 = 'x' AS c, 'a' + null AS d, 7 / 2 AS e, 1 / 0 AS f, 5 % 0 AS g") == [(True, True, False, "anull", 3.5, None, None)]
    assert rows(social, "RETURN true XOR false AND false AS a, NOT 0 AS b, 1 AND 'x' AS c") == [(False, True, True)]


def test_exists_patterns_and_comprehensions(social):
    assert rows(social, "MATCH (p:Person) WHERE (p)-[:TRUSTS]->(:Person {name: 'Ann'}) RETURN p.name AS n ORDER BY n") == [("Bob",)]
    assert rows(social, "MATCH (p:Person) WHERE NOT (p)<-[:TRUSTS]-() RETURN p.name AS n") == [("Dan",)]
    assert rows(social, "MATCH (p:Person) WHERE EXISTS { (p)<-[:TRUSTS]-(q) WHERE q.age > 40 } OR p.name = 'Ann' RETURN p.name AS n ORDER BY n") == [("Ann",), ("Cat",)]
    got = rows(social, "MATCH (p:Person) RETURN p.name AS n, [(p)<-[:TRUSTS]-(q) WHERE q.age > 26 | q.name] AS l ORDER BY n")
    assert [(n, sorted(x)) for n, x in got] == [("Ann", []), ("Bob", ["Ann"]), ("Cat", ["Dan"]), ("Dan", [])]


def test_subquery_union_and_procedures(social):
    assert rows(social, "MATCH (p:Person) CALL { WITH p MATCH (p)<-[:TRUSTS]-(q) RETURN count(q) AS k } RETURN p.name AS n, k ORDER BY n")[:2] == [("Ann", 1), ("Bob", 2)]
    assert rows(social, "CALL { RETURN 1 AS x UNION RETURN 1 AS x } RETURN count(*) AS n") == [(1,)]
    assert rows(social, "CALL { RETURN 1 AS x UNION ALL RETURN 1 AS x } RETURN count(*) AS n") == [(2,)]
    assert rows(social, "CALL db.relationshipTypes()") == [("TRUSTS",)]
    with pytest.raises(CompileError):
        social.query("CALL no.such()")


def test_parameters_and_errors(social):
    assert rows(social, "MATCH (p:Person) WHERE p.name IN $names RETURN p.name AS n ORDER BY n LIMIT $k", names=["Ann", "Dan"], k=1) == [("Ann",)]
    for bad in ("MATCH (a", "RETURN", "MATCH (a) RETURN a LIMIT 1 + 1", "FOO", "MATCH (a)-[:X]>(b) RETURN a"):
        with pytest.raises(ParseError):
            parse(bad)
    with pytest.raises(CompileError):
        social.query("RETURN x")
    with pytest.raises(CompileError):
        social.query("RETURN $missing AS x")


def test_writes(spark):
    g = GraphCatalog.empty(spark)
    g.query("CREATE (a:P {name: 'Ann', age: 1})-[:KNOWS {w: 1}]->(b:P {name: 'Bob'})")
    g.query("UNWIND ['Ann', 'Eve', 'Eve'] AS n MERGE (p:P {name: n}) ON CREATE SET p.fresh = true ON MATCH SET p.seen = true")
    assert rows(g, "MATCH (p:P) RETURN p.name AS n, p.fresh AS f, p.seen AS s ORDER BY n") == [("Ann", None, True), ("Bob", None, None), ("Eve", True, None)]
    g.query("MATCH (a:P {name: 'Ann'}) SET a += {age: null, city: 'X'}, a:Q")
    assert rows(g, "MATCH (a:Q) RETURN a.age AS a, a.city AS c, labels(a) AS l") == [(1, "X", ["P", "Q"])]
    g.query("MATCH (a:Q) REMOVE a:Q, a.city")
    assert rows(g, "MATCH (a:P {name: 'Ann'}) RETURN a.city AS c, labels(a) AS l") == [(None, ["P"])]
    before = g.version()
    with pytest.raises(WriteError):
        g.query("MATCH (a:P {name: 'Ann'}) DELETE a")
    g.query("MATCH (a:P {name: 'Ann'})-[r:KNOWS]->() DELETE r, a")
    assert rows(g, "MATCH (n) RETURN count(*) AS n") == [(2,)] and rows(before, "MATCH (n) RETURN count(*) AS n") == [(3,)]
    g.query("MATCH (p:P) FOREACH (x IN [1, 2] | SET p.k = x)")
    assert rows(g, "MATCH (p:P) RETURN DISTINCT p.k AS k") == [(2,)]


def test_read_only_views_refuse_writes(retail):
    with pytest.raises(WriteError):
        retail.query("CREATE (:Product)")


@pytest.mark.parametrize(
    ("rule", "bad"),
    [
        ("REQUIRE x.name IS UNIQUE", "CREATE (:X {name: 'a'})"),
        ("REQUIRE x.name IS NOT NULL", "CREATE (:X {k: 1})"),
        ("REQUIRE (x.name, x.k) IS NODE KEY", "CREATE (:X {name: 'b'})"),
        ("REQUIRE x.k IS :: INTEGER", "CREATE (:X {name: 'c', k: 'text'})"),
        ("REQUIRE x.name IN ['a', 'b']", "CREATE (:X {name: 'z', k: 2})"),
        ("REQUIRE (x.name, x.f, x.t) IS TEMPORAL", "CREATE (:X {name: 'a', k: 3, f: 5, t: 9})"),
    ],
)
def test_constraints(spark, rule, bad):
    g = GraphCatalog.empty(spark)
    g.query("CREATE (:X {name: 'a', k: 1, f: 1, t: 6})")
    g.query(f"CREATE CONSTRAINT c FOR (x:X) {rule}")
    g.query("CREATE CONSTRAINT c IF NOT EXISTS FOR (x:X) " + rule)
    with pytest.raises(ConstraintError):
        g.query(bad)
    assert rows(g, "MATCH (x:X) RETURN count(*) AS n") == [(1,)]
    g.query("DROP CONSTRAINT c")
    g.query(bad)


def test_random_patterns_against_nested_loops(spark):
    rng = random.Random(3)
    for _ in range(3):
        n = 7
        nodes = [(str(k), rng.choice(["A", "B"]), rng.randrange(4)) for k in range(n)]
        edges = [(f"e{k}", str(rng.randrange(n)), str(rng.randrange(n)), rng.choice(["R", "S"])) for k in range(14)]
        g = GraphCatalog.empty(spark)
        for label in "AB":
            g.add_nodes(label, spark.createDataFrame([(i, v) for i, x, v in nodes if x == label], "_id string, v long"))
        for t in "RS":
            g.add_rels(t, spark.createDataFrame([(e, a, b) for e, a, b, x in edges if x == t], "_rid string, _src string, _dst string"), id="_rid")
        label, value = {i: x for i, x, _ in nodes}, {i: v for i, _, v in nodes}

        def hops(kind, d):
            out = [(a, b) for _, a, b, x in edges if x == kind]
            return out if d == "out" else [(b, a) for a, b in out] if d == "in" else out + [(b, a) for a, b in out if a != b]

        for d1, a1, d2, a2 in [("out", "-[:R]->", "in", "<-[:S]-"), ("both", "-[:R]-", "out", "-[:S]->"), ("in", "<-[:S]-", "both", "-[:R]-")]:
            k1, k2 = a1[a1.index(":") + 1], a2[a2.index(":") + 1]
            want = sorted((a, b, c) for a, b in hops(k1, d1) for b2, c in hops(k2, d2) if b == b2 and label[a] == "A" and value[c] >= value[b])
            got = sorted(rows(g, f"MATCH (a:A){a1}(b){a2}(c) WHERE c.v >= b.v RETURN id(a) AS a, id(b) AS b, id(c) AS c"))
            assert got == want
            opt = rows(g, f"MATCH (a:A) OPTIONAL MATCH (a){a1}(b) RETURN id(a) AS a, count(b) AS n")
            assert dict(opt) == {i: sum(x == i for x, _ in hops(k1, d1)) for i, x, _ in nodes if x == "A"}


def test_two_hop_count_makes_no_pairs(retail):
    plan = retail.query("EXPLAIN MATCH (a:Product)<-[:ORDERS]-(o)-[:ORDERS]->(b:Product) RETURN count(*) AS n").first()[0]
    assert rows(retail, "MATCH (a:Product)<-[:ORDERS]-(o)-[:ORDERS]->(b:Product) RETURN count(*) AS n") == [(5,)]
    assert plan.count("Join") and "Aggregate" in plan.split("Join")[1]


def test_pattern_count_sums_variables_out(spark):
    """Cycles, trees, loops and separate parts against nested loops; a join meets summed rows, not matches."""
    rng = random.Random(5)
    g = GraphCatalog(spark)
    edges = {}
    for k in "ABC":
        g.add_nodes(k, spark.range(6), "id")
    for t, x, y in (("R", "A", "B"), ("S", "C", "B"), ("T", "C", "A"), ("U", "A", "A")):
        edges[t] = [(rng.randrange(6), rng.randrange(6)) for _ in range(25)]
        g.add_rels(t, spark.createDataFrame(edges[t], "s long, d int"), "s", "d", x, y)
    R, S, T, U = (edges[k] for k in "RSTU")
    cycle = "MATCH (a:A)-[:R]->(b)<-[:S]-(c:C)-[:T]->(a) RETURN count(*) AS n"
    plan = g.query(cycle)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Join", 1)[1]
    assert rows(g, cycle) == [(sum(b == y and c == z and w == a for a, b in R for c, y in S for z, w in T),)]
    assert rows(g, "MATCH (a:A)-[r:R]->(b), (c:C)-[:S]->(b), (a)-[:U]->(a) RETURN count(r) AS n") == [(sum(b == y and u == v == a for a, b in R for _, y in S for u, v in U),)]
    assert rows(g, "MATCH (a)-[:U]->(x)-[:U]->(y)-[:U]-(z) RETURN count(*) AS n") == [(sum((v == w) * (x == q) + (v == w) * (x == s and q != s) for _, v in U for w, x in U for q, s in U),)]
    assert rows(g, "MATCH (a)-[:R]->(b), (c)-[:S]->(d), (e)-[:T]->(f) RETURN count(*) AS n") == [(25**3,)]
    assert rows(g, "MATCH (a:B)-[:R]->(b)-[:S]->(c)-[:T]->(d) RETURN count(*) AS n") == [(0,)]


def test_counts_of_distinct_nodes_are_made_apart(spark):
    rng = random.Random(6)
    g = GraphCatalog(spark)
    g.add_nodes("N", spark.createDataFrame([(k, "even" if k % 2 == 0 else "odd") for k in range(8)], "id int, name string"), "id")
    g.add_nodes("A", spark.range(9), "id").add_nodes("B", spark.range(9), "id")
    R, S = ([(rng.randrange(9), rng.randrange(8)) for _ in range(m)] for m in (14, 6))
    for t, e, x in (("R", R, "A"), ("S", S, "B")):
        g.add_rels(t, spark.createDataFrame(e, "s long, d int"), "s", "d", x, "N")
    text = "MATCH (a:A)-[:R]->(n:N) MATCH (b:B)-[:S]->(n) RETURN n.name AS name, count(DISTINCT a) AS x, count(DISTINCT b) AS y ORDER BY y DESC, name"
    met = [(n % 2, a, b) for a, n in R for b, m in S if n == m]
    want = [(name, len({a for k, a, _ in met if k == v}), len({b for k, _, b in met if k == v})) for v, name in enumerate(("even", "odd")) if any(k == v for k, *_ in met)]
    df = g.query(text)
    assert "Union" in df._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in df.collect()] == sorted(want, key=lambda r: (-r[2], r[0]))
    assert rows(g, "MATCH (b:B)-[:S]->(n)<-[:R]-(a) RETURN count(DISTINCT a) AS x, n.id % 2 AS k, count(DISTINCT b) + 1 AS y ORDER BY k") == [(x, v, y + 1) for v in (0, 1) for name, x, y in want if name == ("even", "odd")[v]]


def test_filters_and_columns_reach_the_scan(spark, sf):
    from graphweft.queries.graph import build

    plan = build(spark, sf).query("EXPLAIN MATCH (o:Order) WHERE o.o_totalprice > 1000 RETURN o.o_orderkey AS k").first()[0]
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_decay_statements_hide_stale_nodes_and_relationships(spark):
    g = GraphCatalog.empty(spark)
    g.query("CREATE (a:Memo {k: 'old', created_at_unix_ms: 0, hits: 5})-[:LINKS {created_at_unix_ms: 0}]->(b:Memo {k: 'new', created_at_unix_ms: 9000, hits: 0}), (c:Memo {k: 'dull', created_at_unix_ms: 0, hits: 0})")
    g.query("CREATE DECAY PROFILE p OPTIONS { halfLifeSeconds: 1, visibilityThreshold: 0.3, scoreFloor: 0.0, function: 'linear', scope: 'NODE', scoreFrom: 'CREATED', enabled: true }")
    g.query("CREATE DECAY PROFILE b FOR (n:Memo) APPLY { DECAY PROFILE p, order: 10 }")
    g.query("CREATE DECAY PROFILE e FOR ()-[r:LINKS]-() APPLY { DECAY PROFILE p, visibilityThreshold: 0.2, order: 1 }")
    g.query("CREATE PROMOTION PROFILE up OPTIONS { scope: 'NODE', multiplier: 1.5, scoreFloor: 0.9, scoreCap: 1.0, enabled: true }")
    g.query("CREATE PROMOTION POLICY pp FOR (n:Memo) APPLY { ON ACCESS { SET n.lastAccessedAt = timestamp() SET n.hits = coalesce(n.hits, 0) + 1 } APPLY PROFILE up WHEN 'n.hits >= 3' }")
    seen = lambda: [r.k for r in g.query("MATCH (n:Memo) RETURN n.k AS k ORDER BY k", now_ms=9500).collect()]
    assert seen() == ["new", "old"] and len(rows(g, "MATCH (n:Memo) RETURN n.k")) == 3
    assert g.query("MATCH (a)-[r:LINKS]->(b) RETURN count(*) AS n", now_ms=9500).first()[0] == 0
    g.query("ALTER PROMOTION POLICY pp SET ENABLED false")
    assert seen() == ["new"]
    g.query("ALTER DECAY PROFILE p SET OPTIONS { visibilityThreshold: 0.0 }")
    assert seen() == ["dull", "new", "old"]
    assert rows(g, "CALL graph.knowledgepolicy.resolve('x', 'Memo', '') YIELD profile RETURN profile") == [("p",)]
    assert {r.name for r in g.query("SHOW DECAY PROFILES").collect()} == {"p", "b", "e", "up", "pp"}
    with pytest.raises(ConstraintError):
        g.query("CREATE DECAY PROFILE z FOR (n:X) APPLY { DECAY PROFILE nope }")
    g.query("DROP DECAY PROFILE b")


def test_relationships_are_aggregated_before_the_join(retail, social):
    plan = retail.query("EXPLAIN MATCH (p:Product)<-[r:ORDERS]-(o:Order) RETURN p.name AS n, count(o) AS k, avg(r.quantity) AS a").first()[0]
    tree = plan.split("\n\n")[0]
    assert tree.index("Join") < tree.rindex("HashAggregate")  # one aggregation lies below the join
    q = "MATCH (p:Product)<-[r:ORDERS]-(o:Order) RETURN p.name AS n, count(o) AS k, sum(r.quantity) AS s, avg(r.quantity) AS a, min(r.quantity) AS lo, max(r.quantity) AS hi, count(*) + 1 AS c ORDER BY k DESC"
    assert rows(retail, q) == [("Lamp", 2, 8.0, 4.0, 3.0, 5.0, 3), ("Nail", 1, 40.0, 40.0, 40.0, 40.0, 2)]
    assert rows(social, "MATCH (a:Person)<-[r:TRUSTS]-(b) RETURN a.name AS a, avg(r.w) AS m, count(r.w) AS n ORDER BY a") == [("Ann", 3.0, 1), ("Bob", 5.0, 1), ("Cat", 5.5, 2)]
    assert rows(social, "MATCH (a:Person)-[r:TRUSTS]-(b) RETURN a.age > 26 AS k, count(b) AS n ORDER BY k") == [(False, 7), (True, 3)]
    assert rows(social, "MATCH (a:Person {name: 'Bob'})<-[r:TRUSTS]-(b) WITH a, count(b) AS n WHERE n > 1 RETURN a.name AS a, n") == [("Bob", 2)]
    assert rows(social, "MATCH (a:Person)<-[r:TRUSTS]-(b) RETURN a.name AS a, collect(b.name) AS l ORDER BY a")[:1] == [("Ann", ["Bob"])]

"""Queries of the query language over the driver tables, each with its SQL."""

from __future__ import annotations

from graphweft.queries.graph import build, store

#: name -> (statement, SQL). Sums and averages are rounded on both sides, as their order differs.
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "cypher_orders_by_segment": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_mktsegment AS segment, count(o) AS orders, round(sum(o.o_totalprice), 2) AS revenue ORDER BY revenue DESC",
        "SELECT c_mktsegment AS segment, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    ),
    "cypher_products_per_category": (
        "MATCH (n:Nation)<-[:FROM_NATION]-(c:Customer) RETURN n.n_name AS nation, count(c) AS customers ORDER BY customers DESC",
        "SELECT n_name AS nation, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name",
    ),
    "cypher_customer_brand_distinct_orders": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) RETURN c.c_name AS customer, p.p_brand AS brand, count(DISTINCT o) AS orders ORDER BY orders DESC, customer, brand LIMIT 10",
        "SELECT c_name AS customer, p_brand AS brand, count(DISTINCT o_orderkey) AS orders FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 ORDER BY orders DESC, customer, brand LIMIT 10",
    ),
    "cypher_optional_match_orders_count": (
        "MATCH (p:Part) OPTIONAL MATCH (p)<-[r:CONTAINS]-(o:Order) RETURN p.p_partkey AS part, count(o) AS orders ORDER BY orders DESC, part ASC LIMIT 100",
        "SELECT p_partkey AS part, count(l_orderkey) AS orders FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 ORDER BY orders DESC, part LIMIT 100",
    ),
    "cypher_revenue_by_product": (
        "MATCH (p:Part)<-[r:CONTAINS]-(:Order) WITH p, sum(p.p_retailprice * r.l_quantity) AS revenue RETURN p.p_partkey AS part, p.p_name AS name, round(revenue, 2) AS revenue ORDER BY revenue DESC, part ASC LIMIT 10",
        "SELECT p_partkey AS part, p_name AS name, round(sum(p_retailprice * l_quantity), 2) AS revenue FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2 ORDER BY revenue DESC, part LIMIT 10",
    ),
    "cypher_count_all_relationships": (
        "MATCH ()-[r]->() RETURN type(r) AS type, count(r) AS n",
        """SELECT 'IN_REGION' AS type, count(*) AS n FROM nation UNION ALL SELECT 'FROM_NATION', count(*) FROM customer UNION ALL SELECT 'SUPPLIER_NATION', count(*) FROM supplier
        UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""",
    ),
    "cypher_two_hop_count": (
        "MATCH (a)-[:PLACED]->(b)-[:CONTAINS]->(c) RETURN count(*) AS n",
        "SELECT count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    ),
    "cypher_two_hop_siblings": (
        "MATCH (a:Part)<-[:CONTAINS]-(o:Order)-[:CONTAINS]->(b:Part) RETURN count(*) AS n",
        "SELECT CAST(sum(k * k) AS BIGINT) AS n FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey)",
    ),
    "cypher_degree_out_in": (
        "MATCH (s:Supplier)-[:SUPPLIES]->(p:Part) RETURN s.s_name AS supplier, count(p) AS parts",
        "SELECT s_name AS supplier, count(DISTINCT l_partkey) AS parts FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name",
    ),
    "cypher_edge_property_aggregate": (
        "MATCH (p:Part)<-[r:CONTAINS]-() RETURN p.p_partkey AS part, avg(r.l_quantity) AS a, min(r.l_quantity) AS lo, max(r.l_quantity) AS hi, count(r.l_quantity) AS n",
        "SELECT l_partkey AS part, avg(l_quantity) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi, count(l_quantity) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
    ),
    "cypher_aggregates": (
        "MATCH (c:Customer) RETURN c.c_mktsegment AS s, count(*) AS n, round(sum(c.c_acctbal), 2) AS total, round(avg(c.c_acctbal), 4) AS mean, round(stdev(c.c_acctbal), 4) AS sd, round(stdevp(c.c_acctbal), 4) AS sdp, min(c.c_acctbal) AS lo, max(c.c_acctbal) AS hi",
        "SELECT c_mktsegment AS s, count(*) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd, round(stddev_pop(c_acctbal), 4) AS sdp, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1",
    ),
    "cypher_aggregate_identity": (
        "MATCH (c:Customer) WHERE c.c_acctbal > 1e12 RETURN count(*) AS n, sum(c.c_acctbal) AS s, avg(c.c_acctbal) AS a, size(collect(c.c_name)) AS l",
        "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS a, CAST(0 AS BIGINT) AS l",
    ),
    "cypher_collect": (
        "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, n ORDER BY n.n_name RETURN r.r_name AS region, size(collect(n.n_name)) AS n, size(collect(DISTINCT n.n_regionkey)) AS d",
        "SELECT r_name AS region, count(*) AS n, CAST(1 AS BIGINT) AS d FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "cypher_where_comparisons": (
        "MATCH (o:Order) WHERE o.o_totalprice >= 1000 AND o.o_totalprice < 200000 AND o.o_orderstatus <> 'P' AND NOT o.o_orderpriority = '1-URGENT' AND o.o_custkey BETWEEN 10 AND 500 RETURN count(*) AS n, min(o.o_orderkey) AS k",
        "SELECT count(*) AS n, CAST(min(o_orderkey) AS DOUBLE) AS k FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 200000 AND o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT' AND o_custkey BETWEEN 10 AND 500",
    ),
    "cypher_where_strings": (
        "MATCH (p:Part) WHERE p.p_name STARTS WITH 'b' OR p.p_name ENDS WITH 'rod' OR p.p_name CONTAINS 'ew' OR p.p_brand =~ '#1' XOR p.p_size > 40 RETURN p.p_partkey AS k",
        "SELECT p_partkey AS k FROM part WHERE p_name LIKE 'b%' OR p_name LIKE '%rod' OR p_name LIKE '%ew%' OR ((p_brand LIKE '%#1%') <> (p_size > 40))",
    ),
    "cypher_in_list": (
        "MATCH (p:Part) WHERE p.p_size IN [1, 5, 9, 13] AND NOT p.p_partkey IN [1, 2, 3] RETURN p.p_partkey AS k, p.p_size AS z",
        "SELECT p_partkey AS k, p_size AS z FROM part WHERE p_size IN (1, 5, 9, 13) AND p_partkey NOT IN (1, 2, 3)",
    ),
    "cypher_null_equality": (
        "MATCH (d:Document) RETURN d.lang = null AS missing, d.lang IS NULL AS is_null, count(*) AS n",
        "SELECT lang IS NULL AS missing, lang IS NULL AS is_null, count(*) AS n FROM documents GROUP BY 1, 2",
    ),
    "cypher_with_having": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n > 12 RETURN c.c_custkey AS k, n",
        "SELECT o_custkey AS k, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) > 12",
    ),
    "cypher_with_pipeline": (
        "MATCH (c:Customer)-[:FROM_NATION]->(n:Nation) WITH n.n_name AS nation, c.c_acctbal AS b ORDER BY b DESC SKIP 10 LIMIT 50 WITH nation, count(*) AS k RETURN nation, k",
        "SELECT nation, count(*) AS k FROM (SELECT n_name AS nation, c_acctbal AS b FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY b DESC OFFSET 10 LIMIT 50) GROUP BY 1",
    ),
    "cypher_distinct": (
        "MATCH (c:Customer)-[:FROM_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN DISTINCT c.c_mktsegment AS s, r.r_name AS r",
        "SELECT DISTINCT c_mktsegment AS s, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "cypher_order_skip_limit": (
        "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k SKIP 5 LIMIT 20",
        "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k OFFSET 5 LIMIT 20",
    ),
    "cypher_unwind": (
        "UNWIND range(1, 20, 3) AS x UNWIND [x, x * 10] AS y RETURN x, y, x % 4 AS m, y / 4 AS q, x ^ 2 AS p, -x AS neg",
        "SELECT x, y, x % 4 AS m, y / 4 AS q, CAST(x * x AS DOUBLE) AS p, -x AS neg FROM (SELECT unnest(range(1, 21, 3)) AS x), LATERAL (SELECT unnest([x, x * 10]) AS y)",
    ),
    "cypher_comma_cross": (
        "MATCH (r:Region), (n:Nation) RETURN count(*) AS n",
        "SELECT count(*) AS n FROM region, nation",
    ),
    "cypher_equi_join": (
        "MATCH (c:Customer), (s:Supplier) WHERE c.c_nationkey = s.s_nationkey RETURN c.c_nationkey AS nation, count(*) AS pairs",
        "SELECT c_nationkey AS nation, count(*) AS pairs FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1",
    ),
    "cypher_theta_join": (
        "MATCH (a:Nation), (b:Nation) WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey RETURN a.n_name AS a, b.n_name AS b",
        "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    ),
    "cypher_bound_variable": (
        "MATCH (c:Customer)-[:FROM_NATION]->(n:Nation) MATCH (s:Supplier)-[:SUPPLIER_NATION]->(n) RETURN n.n_name AS nation, count(DISTINCT c) AS customers, count(DISTINCT s) AS suppliers",
        "SELECT n_name AS nation, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    "cypher_cycle": (
        "MATCH (c:Customer)-[:FROM_NATION]->(n)<-[:SUPPLIER_NATION]-(s:Supplier)-[:SUPPLIES]->(p:Part)<-[:CONTAINS]-(o:Order)<-[:PLACED]-(c) RETURN count(*) AS n",
        "SELECT count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN (SELECT DISTINCT l_suppkey AS sk, l_partkey AS pk FROM lineitem) ON sk = s_suppkey JOIN lineitem ON l_partkey = pk JOIN orders ON o_orderkey = l_orderkey AND o_custkey = c_custkey",
    ),
    "cypher_undirected": (
        "MATCH (n:Nation)-[r]-(x) RETURN n.n_name AS nation, count(r) AS n",
        "SELECT n_name AS nation, 1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation",
    ),
    "cypher_type_union": (
        "MATCH (n:Nation)<-[r:FROM_NATION|SUPPLIER_NATION]-(x) RETURN n.n_name AS nation, type(r) AS t, count(*) AS n",
        "SELECT n_name AS nation, 'FROM_NATION' AS t, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT n_name, 'SUPPLIER_NATION', count(*) FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    "cypher_semi_join": (
        "MATCH (p:Part) WHERE (p)<-[:CONTAINS]-(:Order) RETURN count(p) AS n",
        "SELECT count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)",
    ),
    "cypher_anti_join": (
        "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order {o_orderstatus: 'P'}) RETURN c.c_custkey AS k",
        "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    ),
    "cypher_exists_where": (
        "MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > c.c_acctbal * 40 AND o.o_orderstatus = 'F' } RETURN c.c_custkey AS k",
        "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40 AND o_orderstatus = 'F')",
    ),
    "cypher_pattern_in_or": (
        "MATCH (c:Customer) WHERE c.c_acctbal > 9000 OR (c)-[:PLACED]->(:Order {o_orderstatus: 'P'}) RETURN c.c_custkey AS k",
        "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    ),
    "cypher_optional_where": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > c.c_acctbal * 30 RETURN c.c_custkey AS k, count(o) AS n, max(o.o_totalprice) AS m",
        "SELECT c_custkey AS k, count(o_orderkey) AS n, max(o_totalprice) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 30 GROUP BY 1",
    ),
    "cypher_pattern_comprehension": (
        "MATCH (r:Region) RETURN r.r_name AS region, size([(r)<-[:IN_REGION]-(n:Nation) WHERE n.n_nationkey > 6 | n.n_name]) AS n",
        "SELECT r_name AS region, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 6) AS n FROM region",
    ),
    "cypher_call_subquery": (
        "MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:FROM_NATION]-(c:Customer) WHERE c.c_acctbal > 0 RETURN count(c) AS k } RETURN n.n_name AS nation, k",
        "SELECT n_name AS nation, count(c_custkey) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY 1",
    ),
    "cypher_union": (
        "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k",
        "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    ),
    "cypher_union_all": (
        "CALL { MATCH (c:Customer) RETURN c.c_nationkey AS k UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS k } RETURN k, count(*) AS n",
        "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1",
    ),
    "cypher_case": (
        "MATCH (c:Customer) RETURN CASE WHEN c.c_acctbal < 0 THEN 'debt' WHEN c.c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, CASE c.c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS code, count(*) AS n",
        "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS code, count(*) AS n FROM customer GROUP BY 1, 2",
    ),
    "cypher_lists": (
        "MATCH (p:Part) WITH p.p_partkey AS k, range(1, p.p_size % 7 + 1) AS l RETURN k, size(l) AS n, head(l) AS h, last(l) AS t, size(tail(l)) AS r, [x IN l WHERE x % 2 = 1 | x * x] AS odd, reduce(s = 0, x IN l | s + x) AS total, all(x IN l WHERE x > 0) AS a, any(x IN l WHERE x > 6) AS b, none(x IN l WHERE x > 6) AS c, single(x IN l WHERE x = 1) AS d, indexOf(l, 3) AS i, l[1] AS second, reverse(l) AS rev, l[0..2] AS part",
        """WITH b AS (SELECT p_partkey AS k, range(1, p_size % 7 + 2) AS l FROM part)
        SELECT k, len(l) AS n, l[1] AS h, l[-1] AS t, len(l) - 1 AS r, list_transform(list_filter(l, lambda x: x % 2 = 1), lambda x: x * x) AS odd, CAST(list_sum(l) AS BIGINT) AS total, true AS a, len(l) > 6 AS b, len(l) <= 6 AS c, true AS d,
        CAST(coalesce(list_position(l, 3), 0) - 1 AS BIGINT) AS i, l[2] AS second, list_reverse(l) AS rev, l[1:2] AS part FROM b""",
    ),
    "cypher_strings": (
        "MATCH (c:Customer) RETURN c.c_custkey AS k, toUpper(c.c_mktsegment) AS u, toLower(c.c_name) AS l, left(c.c_name, 3) AS a, right(c.c_name, 4) AS b, substring(c.c_name, 2, 5) AS m, replace(c.c_name, 'Customer', 'C') AS r, size(c.c_name) AS n, split(c.c_name, '#')[1] AS s, reverse(c.c_name) AS v, trim('  x ') AS t, c.c_name + '/' + c.c_custkey AS j, char_length(c.c_mktsegment) AS cl, startsWith(c.c_name, 'Cu') AS w",
        "SELECT c_custkey AS k, upper(c_mktsegment) AS u, lower(c_name) AS l, left(c_name, 3) AS a, right(c_name, 4) AS b, substring(c_name, 3, 5) AS m, replace(c_name, 'Customer', 'C') AS r, length(c_name) AS n, split_part(c_name, '#', 2) AS s, reverse(c_name) AS v, 'x' AS t, c_name || '/' || c_custkey AS j, length(c_mktsegment) AS cl, starts_with(c_name, 'Cu') AS w FROM customer",
    ),
    "cypher_numbers": (
        "MATCH (o:Order) RETURN o.o_orderkey AS k, abs(-o.o_totalprice) AS a, ceil(o.o_totalprice) AS c, floor(o.o_totalprice) AS f, round(o.o_totalprice) AS r, sign(o.o_totalprice - 100000) AS s, round(sqrt(o.o_totalprice), 6) AS q, round(log(o.o_totalprice), 6) AS l, round(log10(o.o_totalprice), 6) AS t, round(exp(o.o_orderkey / 1e7), 6) AS e, round(sin(o.o_orderkey), 6) AS sn, round(atan2(o.o_orderkey, 3), 6) AS at, round(degrees(1.0), 6) AS d, pow(2, 10) AS p, round(pi(), 6) AS pi, toInteger('12') AS i, toInteger('abc') AS z, toFloat('1.5') AS g, toIntegerOrNull('x') AS nn, toString(o.o_orderkey) AS st, toBoolean('true') AS tb",
        "SELECT o_orderkey AS k, abs(-o_totalprice) AS a, ceil(o_totalprice) AS c, floor(o_totalprice) AS f, round(o_totalprice) AS r, CAST(sign(o_totalprice - 100000) AS BIGINT) AS s, round(sqrt(o_totalprice), 6) AS q, round(ln(o_totalprice), 6) AS l, round(log10(o_totalprice), 6) AS t, round(exp(o_orderkey / 1e7), 6) AS e, round(sin(o_orderkey), 6) AS sn, round(atan2(o_orderkey, 3), 6) AS at, round(degrees(1.0), 6) AS d, CAST(1024 AS DOUBLE) AS p, round(pi(), 6) AS pi, CAST(12 AS BIGINT) AS i, CAST(0 AS BIGINT) AS z, CAST(1.5 AS DOUBLE) AS g, CAST(NULL AS BIGINT) AS nn, CAST(o_orderkey AS VARCHAR) AS st, true AS tb FROM orders",
    ),
    "cypher_dates": (
        "MATCH (o:Order) RETURN o.o_orderkey AS k, date(o.o_orderdate) AS d, datetime(o.o_orderdate) AS dt, date.year(o.o_orderdate) AS y, date.month(o.o_orderdate) AS m, date.day(o.o_orderdate) AS dd, date.quarter(o.o_orderdate) AS q, date.dayOfWeek(o.o_orderdate) AS w, date.dayOfYear(o.o_orderdate) AS dy, date.week(o.o_orderdate) AS wk, date.truncate('month', o.o_orderdate) AS tm, datetime.truncate('hour', o.o_orderdate) AS th, date('2024-03-05') AS lit, localdatetime('2024-03-05T01:02:03Z') AS ld, time('2024-03-05T01:02:03') AS t, duration() AS du",
        "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS dt, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, quarter(o_orderdate) AS q, isodow(o_orderdate) AS w, dayofyear(o_orderdate) AS dy, CAST(ceil(dayofyear(o_orderdate) / 7.0) AS BIGINT) AS wk, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS tm, strftime(date_trunc('hour', o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS th, '2024-03-05' AS lit, '2024-03-05T01:02:03' AS ld, '01:02:03Z' AS t, 'PT0S' AS du FROM orders",
    ),
    "cypher_json": (
        "MATCH (e:Event) RETURN e.event_id AS k, apoc.text.join([e.event_type, toString(e.user_id)], '-') AS j, apoc.coll.toSet([1, 2, 1]) AS s, apoc.coll.flatten([[1, 2], [3]]) AS f, valueType(e.value) AS t, coalesce(null, e.event_type) AS c, nullIf(e.event_type, 'click') AS n, apoc.convert.fromJsonMap('{\"a\": \"x\"}').a AS m",
        "SELECT event_id AS k, event_type || '-' || user_id AS j, [1, 2] AS s, [1, 2, 3] AS f, 'FLOAT' AS t, event_type AS c, nullif(event_type, 'click') AS n, 'x' AS m FROM events",
    ),
    "cypher_vector_functions": (
        "MATCH (a:Vector {vec_id: 1}), (b:Vector) RETURN b.vec_id AS k, vector.similarity.cosine(a.embedding, b.embedding) AS c, vector.similarity.euclidean(a.embedding, b.embedding) AS e",
        "SELECT b.vec_id AS k, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS c, round(1 / (1 + list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS e FROM embeddings a, embeddings b WHERE a.vec_id = 1",
    ),
    "cypher_all_nodes": (
        "MATCH (n) RETURN labels(n)[0] AS label, count(*) AS n",
        "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Document', count(*) FROM documents UNION ALL SELECT 'Vector', count(*) FROM embeddings",
    ),
    "cypher_path_value": (
        "MATCH p = (c:Customer)-[:FROM_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN c.c_custkey AS k, length(p) AS hops, size(nodes(p)) AS nodes, size(relationships(p)) AS rels",
        "SELECT c_custkey AS k, CAST(2 AS BIGINT) AS hops, CAST(3 AS BIGINT) AS nodes, CAST(2 AS BIGINT) AS rels FROM customer",
    ),
    "cypher_variable_length": (
        "MATCH (r:Region {r_name: 'ASIA'})<-[*1..2]-(x) RETURN labels(x)[0] AS label, count(*) AS n",
        """SELECT 'Nation' AS label, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'
        UNION ALL SELECT 'Customer', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'
        UNION ALL SELECT 'Supplier', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""",
    ),
    "cypher_shortest_path": (
        "MATCH (a:Customer {c_custkey: 7}), (b:Region) MATCH p = shortestPath((a)-[:FROM_NATION|IN_REGION*..5]-(b)) RETURN b.r_name AS region, length(p) AS hops",
        "SELECT r_name AS region, CAST(2 AS BIGINT) AS hops FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = 7",
    ),
    "cypher_all_shortest_paths": (
        "MATCH (a:Supplier {s_suppkey: 3}), (b:Supplier {s_suppkey: 4}) MATCH p = allShortestPaths((a)-[:SUPPLIES*..2]-(b)) RETURN length(p) AS hops, count(*) AS paths",
        "SELECT CAST(2 AS BIGINT) AS hops, count(*) AS paths FROM (SELECT l_partkey FROM lineitem WHERE l_suppkey = 3 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey = 4) HAVING count(*) > 0",
    ),
    "cypher_property_index_seek": (
        "MATCH (o:Order {o_orderstatus: 'F', o_orderpriority: '2-HIGH'}) WHERE o.o_totalprice > 100000 RETURN o.o_orderkey AS k",
        "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_totalprice > 100000",
    ),
    "cypher_edge_range": (
        "MATCH (o:Order)-[r:CONTAINS {l_returnflag: 'R'}]->(p:Part) WHERE r.l_quantity >= 45 RETURN o.o_orderkey AS o, p.p_partkey AS p, r.l_quantity AS q",
        "SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_quantity >= 45",
    ),
    "cypher_schema_procedures": ("CALL db.schema.visualization() YIELD source, relType, target RETURN source, relType, target",
        "SELECT * FROM (VALUES ('Customer', 'FROM_NATION', 'Nation'), ('Customer', 'PLACED', 'Order'), ('Nation', 'IN_REGION', 'Region'), ('Order', 'CONTAINS', 'Part'), ('Supplier', 'SUPPLIER_NATION', 'Nation'), ('Supplier', 'SUPPLIES', 'Part')) t(source, \"relType\", target)"),
    "cypher_property_keys": ("CALL db.schema.nodeProperties() YIELD nodeType, propertyName, propertyType RETURN nodeType, propertyName, propertyType",
        """SELECT l AS "nodeType", column_name AS "propertyName", CASE WHEN data_type LIKE '%[]' THEN 'LIST' WHEN data_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') THEN 'INTEGER' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'FLOAT' WHEN data_type = 'BOOLEAN' THEN 'BOOLEAN' ELSE 'STRING' END AS "propertyType"
        FROM information_schema.columns JOIN (VALUES ('region', 'Region'), ('nation', 'Nation'), ('customer', 'Customer'), ('supplier', 'Supplier'), ('part', 'Part'), ('orders', 'Order'), ('events', 'Event'), ('documents', 'Document'), ('embeddings', 'Vector')) t(n, l) ON table_name = n"""),
}

#: The same over the store's own tables, whose references may not hold.
STORE: dict[str, tuple[str, str | None]] = {
    "store_relationship_counts": (
        "MATCH (a)-[r]->(b) RETURN type(r) AS t, count(*) AS n",
        """WITH l AS (SELECT DISTINCT id FROM nodes WHERE deleted_at_unix_ms IS NULL), e AS (SELECT DISTINCT id, start_node, end_node, edge_type FROM edges)
        SELECT edge_type AS t, count(*) AS n FROM e WHERE start_node IN (SELECT id FROM l) AND end_node IN (SELECT id FROM l) AND edge_type IS NOT NULL GROUP BY 1""",
    ),
    "store_mutual": (
        "MATCH (a)-[:KNOWS]->(b)-[:KNOWS]->(a) WHERE id(a) < id(b) RETURN id(a) AS a, id(b) AS b, count(*) AS n",
        """WITH l AS (SELECT DISTINCT id FROM nodes WHERE deleted_at_unix_ms IS NULL), e AS (SELECT DISTINCT id, start_node AS s, end_node AS t FROM edges WHERE edge_type = 'KNOWS')
        SELECT x.s AS a, x.t AS b, count(*) AS n FROM e x JOIN e y ON x.t = y.s AND x.s = y.t WHERE x.s < x.t AND x.s IN (SELECT id FROM l) AND x.t IN (SELECT id FROM l) GROUP BY 1, 2""",
    ),
}


def _run(statement: str, graph):
    return lambda spark, sf_dir: graph(spark, sf_dir).query(statement)


def queries() -> dict:
    return {n: _run(q, build) for n, (q, _) in STATEMENTS.items()} | {n: _run(q, store) for n, (q, _) in STORE.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in (STATEMENTS | STORE).items() if sql is not None}

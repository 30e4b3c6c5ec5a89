"""Queries of the search, policy, analytics and text operators over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.analytics import links, signals
from graphweft.functions.scalars import cosine
from graphweft.policy import governance, knowledge
from graphweft.search import fulltext, lucene, ranking
from graphweft.session import micros, table
from graphweft.text import chunks

NOW_MS = 1_783_000_000_000
QUERY = "vector index returned broken snapshot"
STOP = ", ".join(f"'{w}'" for w in fulltext.STOP_WORDS)


def bm25(spark, sf):
    hits = fulltext.bm25(table(spark, sf, "documents"), "doc_id", F.col("text"), QUERY, expand=False)
    return hits.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_prefix(spark, sf):
    """With prefix expansion, the best hundred."""
    hits = fulltext.bm25(table(spark, sf, "documents"), "doc_id", F.col("text"), "index snap", expand=True)
    return hits.orderBy(F.desc("score"), "id").limit(100).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


_TOKENS = f"""t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) >= 2 AND x NOT IN ({STOP})) AS t FROM documents),
p AS (SELECT id, n, term, count(*) AS tf FROM (SELECT id, len(t) AS n, unnest(t) AS term FROM t) GROUP BY ALL),
s AS (SELECT count(*) AS docs, avg(len(t)) AS avg_len FROM t),
d AS (SELECT term, count(*) AS df FROM p GROUP BY 1)"""


def _bm25_sql(terms: str) -> str:
    return f"""WITH {_TOKENS}, q AS ({terms}),
    w AS (SELECT q.term, q.weight * greatest(0.0, ln(1 + (docs - df + 0.5) / (df + 0.5))) AS w, avg_len FROM q JOIN d USING (term), s)
    SELECT id AS doc_id, round(sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))), 6) AS score FROM p JOIN w USING (term) GROUP BY 1 HAVING sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))) > 0"""


_BM25 = _bm25_sql("SELECT unnest(['vector', 'index', 'returned', 'broken', 'snapshot']) AS term, 1.0 AS weight")
_BM25_PREFIX = (
    _bm25_sql(
        """SELECT term, sum(weight) AS weight FROM (SELECT unnest(['index', 'snap']) AS term, 1.0 AS weight UNION ALL SELECT term, 0.8 FROM
    (SELECT term, row_number() OVER (PARTITION BY k ORDER BY term) AS r FROM d, (SELECT unnest(['index', 'snap']) AS k) WHERE starts_with(term, k) AND term <> k) WHERE r <= 32) GROUP BY 1"""
    )
    + " ORDER BY sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))) DESC, id LIMIT 100"
)


def lucene_boolean(spark, sf):
    tree = lucene.parse('+vector +(index OR label) -"search service" lang:en')
    d = table(spark, sf, "documents")
    return d.filter(lucene.condition(tree, {"text": F.col("text"), "lang": F.col("lang")})).select("doc_id")


def lucene_wildcard_fuzzy(spark, sf):
    tree = lucene.parse("text:snapsh?t AND (text:indx~1 OR text:/ROLLB.*ed/)")
    d = table(spark, sf, "documents")
    return d.filter(lucene.condition(tree, {"text": F.col("text")})).select("doc_id")


def lucene_phrase_range(spark, sf):
    tree = lucene.parse('text:"ector INDEX" AND n_chars:[200 TO 900}')
    d = table(spark, sf, "documents")
    return d.filter(lucene.condition(tree, {"text": F.col("text"), "n_chars": F.col("n_chars")})).select("doc_id")


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"
_LUCENE_BOOLEAN = f"""WITH w AS (SELECT doc_id, text, {_WORDS} AS w FROM documents)
SELECT doc_id FROM w WHERE list_contains(w, 'vector') AND (list_contains(w, 'index') OR list_contains(w, 'label')) AND NOT contains(lower(text), 'search service')"""
_LUCENE_WILDCARD = f"""WITH w AS (SELECT doc_id, text, {_WORDS} AS w FROM documents)
SELECT doc_id FROM w WHERE len(list_filter(w, lambda x: regexp_full_match(x, 'snapsh.t'))) > 0 AND (len(list_filter(w, lambda x: levenshtein(x, 'indx') <= 1)) > 0 OR regexp_matches(lower(text), 'rollb.*ed'))"""
_LUCENE_PHRASE = """SELECT doc_id FROM documents WHERE contains(lower(text), 'ector index') AND n_chars >= 200 AND n_chars < 900"""


def _query_vector(spark, sf):
    return [float(x) for x in table(spark, sf, "embeddings").filter("vec_id = 3").first()["embedding"]]


def knn_cosine(spark, sf):
    return ranking.knn(table(spark, sf, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf), 20).select(F.col("id").alias("vec_id"), F.round("score", 5).alias("score"))


def knn_euclidean(spark, sf):
    return ranking.knn(table(spark, sf, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf), 20, "euclidean").select(F.col("id").alias("vec_id"), F.round("score", 5).alias("score"))


_KNN = "SELECT b.vec_id, round({s}, 5) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND len(a.embedding) = len(b.embedding) ORDER BY {s} DESC, b.vec_id LIMIT 20"
_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_EUC = "1 / (1 + list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"


def rrf(spark, sf):
    """The text and the vector list of a query, joined by row number of their ids (the tables share no key)."""
    text = fulltext.bm25(table(spark, sf, "documents"), "doc_id", F.col("text"), "vector index", expand=False).orderBy(F.desc("score"), "id").limit(50)
    vec = ranking.knn(table(spark, sf, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf), 50)
    fused = ranking.rrf({"bm25": ranking.ranked(text), "vector": ranking.ranked(vec)}, {"bm25": 1.0, "vector": 0.7})
    return fused.select("id", F.round("rrf_score", 8).alias("rrf_score"), "bm25_rank", "vector_rank")


_RRF = (
    f"""WITH {_TOKENS}, q AS (SELECT unnest(['vector', 'index']) AS term),
w AS (SELECT term, greatest(0.0, ln(1 + (docs - df + 0.5) / (df + 0.5))) AS w, avg_len FROM q JOIN d USING (term), s),
h AS (SELECT id, sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))) AS score FROM p JOIN w USING (term) GROUP BY 1),
b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM h ORDER BY r LIMIT 50),
k AS (SELECT b.vec_id AS id, row_number() OVER (ORDER BY {_COS} DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id = 3 ORDER BY r LIMIT 50),
u AS (SELECT id, r AS br, 0 AS vr, 1.0 / (60 + r) AS s FROM b UNION ALL SELECT id, 0, r, 0.7 / (60 + r) FROM k)
SELECT id, round(sum(s), 8) AS rrf_score, CAST(max(br) AS INTEGER) AS bm25_rank, CAST(max(vr) AS INTEGER) AS vector_rank FROM u GROUP BY 1"""
)


def mmr(spark, sf):
    """The fifty nearest of one vector per label, reranked for diversity."""
    q = F.array(*[F.lit(x) for x in _query_vector(spark, sf)])
    e = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), cosine(F.col("embedding"), q).alias("score"))
    from pyspark.sql import Window

    hits = e.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "id"))).filter("r <= 50").drop("r")
    return ranking.mmr(hits, "label").select("label", F.col("id").alias("vec_id"), "new_rank")


def decay(spark, sf):
    p = [
        knowledge.Binding(("Article",), knowledge.Profile("article", 30 * knowledge.DAY_MS, "exponential", threshold=0.1), (knowledge.Promotion("updated_at_unix_ms > created_at_unix_ms + 86400000", 2.0, 0.05, 0.9),)),
        knowledge.Binding(("Person",), knowledge.Profile("person", 200 * knowledge.DAY_MS, "linear", threshold=0.2, floor=0.1)),
        knowledge.Binding(("Ticket",), knowledge.Profile("ticket", 100 * knowledge.DAY_MS, "step", threshold=0.5)),
        knowledge.Binding((), knowledge.Profile("rest", 300 * knowledge.DAY_MS, "exponential", threshold=0.3, anchor="VERSION")),
    ]
    n = table(spark, sf, "nodes").select("id", "labels", "created_at_unix_ms", "updated_at_unix_ms").distinct()
    s = knowledge.score_table(n, knowledge.KnowledgePolicy(p), NOW_MS)
    return s.groupBy("hidden").agg(F.count("*").alias("n"), F.round(F.sum("final_score"), 4).alias("total"))


_DECAY = f"""WITH n AS (SELECT DISTINCT id, labels, created_at_unix_ms AS c, updated_at_unix_ms AS u FROM nodes),
b AS (SELECT *, CASE WHEN labels IS NULL OR len(labels) = 0 THEN 'rest' WHEN len(list_sort(labels)) >= 1 AND (SELECT count(*) FROM (SELECT unnest(labels) AS l) WHERE l IN ('Article', 'Person', 'Ticket')) > 0
  THEN (SELECT min(l) FROM (SELECT unnest(labels) AS l) WHERE l IN ('Article', 'Person', 'Ticket')) ELSE 'rest' END AS k, CAST(greatest({NOW_MS} - c, 0) AS DOUBLE) AS a, CAST(greatest({NOW_MS} - coalesce(u, c), 0) AS DOUBLE) AS v FROM n),
f AS (SELECT k, CASE k WHEN 'Article' THEN CASE WHEN u > c + 86400000 THEN least(0.9, greatest(0.05, 2 * pow(2.0, -a / (30 * 86400000.0)))) ELSE pow(2.0, -a / (30 * 86400000.0)) END
  WHEN 'Person' THEN greatest(0.1, greatest(1 - a / (400 * 86400000.0), 0)) WHEN 'Ticket' THEN CASE WHEN a <= 100 * 86400000.0 THEN 1.0 ELSE 0.0 END ELSE pow(2.0, -v / (300 * 86400000.0)) END AS s FROM b)
SELECT s < CASE k WHEN 'Article' THEN 0.1 WHEN 'Person' THEN 0.2 WHEN 'Ticket' THEN 0.5 ELSE 0.3 END AS hidden, count(*) AS n, round(sum(s), 4) AS total FROM f GROUP BY 1"""


def weight_decay(spark, sf):
    e = table(spark, sf, "events")
    age = (F.lit(NOW_MS * 1000) - micros(F.col("ts"))) / 1e6
    w = F.col("value") / 100
    return e.select("event_id", F.round(knowledge.weight_decay(w, age, "exponential", 1e-8), 8).alias("ex"), F.round(knowledge.weight_decay(w, age, "power", 0.1), 8).alias("po"), F.round(knowledge.weight_decay(w, age, "gaussian", 1e8), 8).alias("ga"), F.round(knowledge.access_boost(w), 8).alias("boost"))


_WEIGHT = f"""SELECT event_id, round(w * exp(-1e-8 * a), 8) AS ex, round(w * pow(a, -0.1), 8) AS po, round(w * exp(-a * a / (2 * 1e8 * 1e8)), 8) AS ga, round(least(1.0, w + 0.5), 8) AS boost
FROM (SELECT event_id, value / 100 AS w, ({NOW_MS}000 - epoch_us(ts)) / 1e6 AS a FROM events)"""


def kalman(spark, sf):
    e = table(spark, sf, "events").select("user_id", (micros(F.col("ts")) / 1e6).alias("at_s"), F.col("value").alias("observed"))
    return knowledge.kalman(e, "user_id").select("user_id", F.round("weight", 5).alias("weight"), F.round("decay_rate", 7).alias("decay_rate"))


_KALMAN = """WITH e AS (SELECT user_id, list({t: epoch_us(ts) / 1e6, z: value} ORDER BY ts, value) AS l FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY 1),
i AS (SELECT user_id, list_prepend({t: l[1].t, z: 0::DOUBLE, x: 0.5::DOUBLE, y: 0::DOUBLE, a: 1::DOUBLE, b: 0::DOUBLE, c: 0::DOUBLE, d: 1::DOUBLE}, list_transform(l, lambda o: {t: o.t, z: o.z, x: 0::DOUBLE, y: 0::DOUBLE, a: 0::DOUBLE, b: 0::DOUBLE, c: 0::DOUBLE, d: 0::DOUBLE})) AS l FROM e),
k AS (SELECT user_id, list_reduce(l, lambda s, o: list_transform(list_transform(list_transform([{f: exp(-s.y * (o.t - s.t))}],
  lambda m: {x: s.x * m.f, a: s.a * m.f * m.f + 1e-4, b: s.b * m.f, c: s.c * m.f, d: s.d + 1e-4}),
  lambda p: {p: p, g: p.a / (p.a + 0.01), h: p.c / (p.a + 0.01)}),
  lambda u: {t: o.t, z: o.z, x: u.p.x + u.g * (o.z - u.p.x), y: greatest(s.y + u.h * (o.z - u.p.x), 0), a: (1 - u.g) * u.p.a, b: (1 - u.g) * u.p.b, c: u.p.c - u.h * u.p.a, d: u.p.d - u.h * u.p.b})[1]) AS s FROM i)
SELECT user_id, round(s.x, 5) AS weight, round(s.y, 7) AS decay_rate FROM k"""


def valid_time(spark, sf):
    n = table(spark, sf, "nodes").select("id", "created_at_unix_ms", "deleted_at_unix_ms").distinct()
    return knowledge.valid_at(n, 1_760_000_000_000, "created_at_unix_ms", "deleted_at_unix_ms").select("id")


_VALID = "SELECT DISTINCT id FROM (SELECT DISTINCT id, created_at_unix_ms, deleted_at_unix_ms FROM nodes) WHERE created_at_unix_ms <= 1760000000000 AND (deleted_at_unix_ms IS NULL OR 1760000000000 < deleted_at_unix_ms)"


def _records(spark, sf):
    n = table(spark, sf, "nodes").select("id", F.explode("labels").alias("label"), (F.col("created_at_unix_ms") / 1000).cast("long").alias("created_at_s")).distinct()
    return n.withColumn("subject", F.substring("id", -2, 2))


def retention(spark, sf):
    p = spark.createDataFrame([("Person", 200 * 86_400, True), ("Article", 365 * 86_400, True), ("Device", 1, False)], "label string, max_age_seconds long, enabled boolean")
    h = spark.createDataFrame([("07", True), ("13", True), ("20", False)], "subject string, active boolean")
    d = governance.sweep(_records(spark, sf), p, h, NOW_MS // 1000)
    return governance.sweep_report(d)


_RETENTION = f"""WITH r AS (SELECT DISTINCT id, unnest(labels) AS label, created_at_unix_ms // 1000 AS s, right(id, 2) AS subject FROM nodes),
d AS (SELECT *, {NOW_MS // 1000} - s > CASE label WHEN 'Person' THEN {200 * 86_400} ELSE {365 * 86_400} END AS x, subject IN ('07', '13') AS h FROM r WHERE label IN ('Person', 'Article'))
SELECT count(*) AS inspected, count(*) FILTER (x) AS expired, count(*) FILTER (x AND h) AS held, count(*) FILTER (x AND NOT h) AS deleted FROM d"""


def audit_windows(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("type"), F.when(F.col("value") > 50, "ok").otherwise("denied").alias("status"), F.col("ts").alias("at"))
    return governance.audit_counts(e, "2024-01-10", "2024-02-10")


_AUDIT = "SELECT event_type AS type, CASE WHEN value > 50 THEN 'ok' ELSE 'denied' END AS status, count(*) AS events FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-02-10' GROUP BY 1, 2"


def compliance(spark, sf):
    c = table(spark, sf, "customer")
    return governance.mask(c, [("mask", "c_name", ("admin",)), ("mask", "c_acctbal_text", ()), ("restrict", "BUILDING", ("admin",))], "analyst", F.array("c_mktsegment")).select("c_custkey", "c_name", "c_mktsegment")


_COMPLIANCE = "SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN '***' END AS c_name, c_mktsegment FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'"


def _graph(spark, sf):
    """Nodes and all their edges, without direction; asked for every node whose number is divisible by 100."""
    e = table(spark, sf, "edges").select(F.col("start_node").alias("a"), F.col("end_node").alias("b"))
    n = table(spark, sf, "nodes").select("id").distinct()
    asked = n.filter(F.regexp_extract("id", r"node-([0-9]+)", 1).try_cast("long") % 100 == 0).select(F.col("id").alias("source"))
    return links.snapshot(e, n), asked


def link_topology(spark, sf):
    return links.topology(*_graph(spark, sf), view=[F.col("common_neighbors"), *[F.round(c, 8).alias(c) for c in ("jaccard", "adamic_adar", "resource_allocation")], F.col("preferential_attachment")])


_LINKS = """WITH n AS (SELECT DISTINCT id FROM nodes), e AS (SELECT start_node AS a, end_node AS b FROM edges WHERE start_node <> end_node AND start_node IN (SELECT id FROM n) AND end_node IN (SELECT id FROM n)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), d AS (SELECT a AS id, count(*) AS d FROM g GROUP BY 1), q AS (SELECT id FROM n WHERE TRY_CAST(regexp_extract(id, 'node-([0-9]+)', 1) AS BIGINT) % 100 = 0),
t AS (SELECT x.a AS source, y.b AS target, count(*) AS c, coalesce(sum(CASE WHEN d > 1 THEN 1 / ln(d) END), 0) AS aa, sum(1 / d) AS ra FROM g x JOIN q ON q.id = x.a JOIN g y ON x.b = y.a JOIN d ON d.id = x.b WHERE x.a <> y.b GROUP BY 1, 2)"""
_TOPOLOGY = _LINKS + """ SELECT source, target, CAST(c AS DOUBLE) AS common_neighbors, round(c / (s.d + u.d - c), 8) AS jaccard, round(aa, 8) AS adamic_adar, round(ra, 8) AS resource_allocation, CAST(s.d * u.d AS DOUBLE) AS preferential_attachment
FROM t JOIN d s ON s.id = source JOIN d u ON u.id = target WHERE NOT EXISTS (SELECT 1 FROM g WHERE a = source AND b = target)"""


def link_top(spark, sf):
    g, q = _graph(spark, sf)
    return links.predict(g, q, "common_neighbors", 5).select("source", "target", "score", "rank")


_LINK_TOP = _LINKS + """ SELECT * FROM (SELECT source, target, CAST(c AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY source ORDER BY c DESC, target) AS INTEGER) AS rank FROM t WHERE NOT EXISTS (SELECT 1 FROM g WHERE a = source AND b = target)) WHERE rank <= 5"""


def link_attachment(spark, sf):
    g, q = _graph(spark, sf)
    return links.attachment(g, q, 5).select("source", "target", "score", "rank")


_ATTACH = _LINKS + """ SELECT * FROM (SELECT q.id AS source, d.id AS target, CAST(s.d * d.d AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY q.id ORDER BY s.d * d.d DESC, d.id) AS INTEGER) AS rank FROM q JOIN d s ON s.id = q.id, d WHERE d.id <> q.id AND NOT EXISTS (SELECT 1 FROM g WHERE a = q.id AND b = d.id)) WHERE rank <= 5"""


def link_ensemble(spark, sf):
    g, q = _graph(spark, sf)
    return links.ensemble(g, q, 5).select("source", "target", F.round("score", 6).alias("score"), "rank")


_ENSEMBLE = (
    _LINKS
    + """, raw AS (SELECT source, target, c::DOUBLE AS cn, c / (s.d + u.d - c) AS ja, aa, ra FROM t JOIN d s ON s.id = source JOIN d u ON u.id = target WHERE NOT EXISTS (SELECT 1 FROM g WHERE a = source AND b = target)),
p AS (SELECT q.id AS source, d.id AS target, CAST(s.d * d.d AS DOUBLE) AS s FROM q JOIN d s ON s.id = q.id, d WHERE d.id <> q.id AND NOT EXISTS (SELECT 1 FROM g WHERE a = q.id AND b = d.id)),
x AS (SELECT source, target, cn AS s, 0.1 AS w FROM raw UNION ALL SELECT source, target, ja, 0.2 FROM raw UNION ALL SELECT source, target, aa, 0.3 FROM raw UNION ALL SELECT source, target, ra, 0.25 FROM raw UNION ALL SELECT source, target, s, 0.15 FROM p),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, w ORDER BY s DESC, target) AS r FROM x) WHERE r <= 5),
m AS (SELECT source, target, w * CASE WHEN max(s) OVER v = min(s) OVER v THEN 1 ELSE (s - min(s) OVER v) / (max(s) OVER v - min(s) OVER v) END AS s FROM k WINDOW v AS (PARTITION BY source, w)),
f AS (SELECT source, target, sum(s) AS s FROM m GROUP BY 1, 2)
SELECT * FROM (SELECT source, target, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY source ORDER BY s DESC, target) AS INTEGER) AS rank FROM f) WHERE rank <= 5"""
)


def _log(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("node"), F.floor(micros(F.col("ts")) / 1000).alias("at_ms"))


def co_access(spark, sf):
    c = signals.co_access(_log(spark, sf), 30_000, 1)
    return c.select("a", "b", "count", F.round("confidence", 6).alias("confidence"))


_LOG = "WITH l AS (SELECT CAST(user_id AS VARCHAR) AS n, epoch_us(ts) // 1000 AS t FROM events), p AS (SELECT x.n AS s, y.n AS d, x.t - y.t AS age FROM l x JOIN l y ON x.n <> y.n AND x.t - y.t < {w} AND (y.t < x.t OR y.t = x.t AND y.n < x.n))"
_CO = _LOG.format(w=30_000) + " SELECT least(s, d) AS a, greatest(s, d) AS b, count(*) AS count, round(least(0.8, count(*) / 10), 6) AS confidence FROM p GROUP BY 1, 2"


def six_places(c):
    """``round(c, 6)`` of fractions that lie between two such numbers nowhere halfway, without a decimal for each row."""
    return F.rint(c * 1e6) / 1e6


def temporal_signal(spark, sf):
    return signals.temporal(_log(spark, sf), 600_000).select("source", "target", six_places(F.col("confidence")).alias("confidence"))


_TEMPORAL = _LOG.format(w=600_000) + " SELECT s AS source, d AS target, round(max(1 - age / 600000), 6) AS confidence FROM p GROUP BY 1, 2"


def transitive(spark, sf):
    s = table(spark, sf, "edge_suggestions").filter(~F.isnan("confidence"))
    e = s.groupBy(F.col("source_id").alias("source"), F.col("target_id").alias("target")).agg(F.max("confidence").alias("confidence"))
    return signals.transitive(e, 0.5).select("source", "via", "target", F.round("confidence", 6).alias("confidence"))


_TRANSITIVE = """WITH e AS (SELECT source_id AS s, target_id AS t, max(confidence) AS c FROM edge_suggestions WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY 1, 2)
SELECT x.s AS source, x.t AS via, y.t AS target, round(x.c * y.c, 6) AS confidence FROM e x JOIN e y ON x.t = y.s WHERE x.s <> y.t AND x.c * y.c >= 0.5"""


def evidence(spark, sf):
    s = table(spark, sf, "edge_suggestions").filter(F.col("confidence").isNotNull() & ~F.isnan("confidence"))
    r = s.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relationship_type").alias("rel_type"), F.col("confidence").alias("score"), F.to_date("suggested_at").alias("session"), F.floor(micros(F.col("suggested_at")) / 1000).alias("at_ms"))
    e = signals.evidence(r, 1_770_000_000_000)
    return e.groupBy("rel_type", "accepted").agg(F.count("*").alias("n"), F.sum("signals").alias("signals"))


_EVIDENCE = """WITH r AS (SELECT *, epoch_us(suggested_at) // 1000 AS at_ms, CASE lower(relationship_type) WHEN 'similar_to' THEN {v: [2, 0.7, 1, 48]} WHEN 'coaccess' THEN {v: [5, 0.3, 3, 12]} WHEN 'topology' THEN {v: [2, 0.6, 1, 72]} WHEN 'depends_on' THEN {v: [3, 0.6, 2, 168]} ELSE {v: [3, 0.5, 2, 24]} END.v AS v
FROM edge_suggestions WHERE confidence IS NOT NULL AND NOT isnan(confidence)),
g AS (SELECT source_id, target_id, relationship_type AS rel_type, v, count(*) AS signals, avg(confidence) AS score, count(DISTINCT CAST(suggested_at AS DATE)) AS sessions FROM r WHERE 1770000000000 - at_ms <= v[4] * 3600000 GROUP BY ALL)
SELECT rel_type, signals >= v[1] AND score >= v[2] AND sessions >= v[3] AS accepted, count(*) AS n, CAST(sum(signals) AS BIGINT) AS signals FROM g GROUP BY 1, 2"""


def similarity_signal(spark, sf):
    e = table(spark, sf, "similarity_results").filter(F.col("score").isNotNull() & ~F.isnan("score")).select(F.col("source_id").alias("source"), F.col("id").alias("target"), "score")
    return signals.similar(e, 10, 0.55)


_SIMILAR = """WITH b AS (SELECT source_id AS source, id AS target, max(score) AS score FROM similarity_results WHERE score >= 0.55 AND NOT isnan(score) AND source_id <> id GROUP BY 1, 2)
SELECT source, target, CASE WHEN score >= 0.95 THEN 0.9 WHEN score >= 0.9 THEN 0.7 WHEN score >= 0.85 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS r FROM b) WHERE r <= 10"""


def chunk_chars(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return chunks.by_chars(d, "text", 400, 50).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("char_length").cast("long").alias("chars"), F.max("char_offset").alias("last"))


_CHUNKS = """WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, n, unnest(range(0, CAST(greatest(ceil((n - 400) / 350), 0) AS BIGINT) + 1)) * 350 AS o FROM d)
SELECT doc_id, count(*) AS n, CAST(sum(least(400, n - o)) AS BIGINT) AS chars, CAST(max(o) AS INTEGER) AS last FROM c GROUP BY 1"""


def chunk_sentences(spark, sf):
    return chunks.by_sentences(table(spark, sf, "documents"), "doc_id", "text", 300).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("char_length").alias("chars"))


def chunk_tokens(spark, sf):
    return chunks.by_tokens(table(spark, sf, "documents"), "doc_id", "text", 100, 10).groupBy("doc_id").agg(F.count("*").alias("n"))


_SENTENCES = """WITH d AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '[^.!?\n]*[.!?\n]|[^.!?\n]+'), lambda s: {n: 0, have: length(s)}) AS l FROM documents WHERE length(text) > 0)
SELECT doc_id, list_reduce(l, lambda a, b: CASE WHEN a.have > 0 AND a.have + b.have > 300 THEN {n: a.n + 1, have: b.have} ELSE {n: a.n, have: a.have + b.have} END).n + 1 AS n, length(text) AS chars FROM d"""
_SPACES = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
#: Chunks begin 90 words apart.
_TOKEN_CHUNKS = f"""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{_SPACES}'), lambda x: x <> '')) AS n FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(CASE WHEN n <= 100 THEN 1 ELSE 1 + ceil((n - 100) / 90.0) END AS BIGINT) AS n FROM w"""


def entity_text(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", chunks.entity_text(F.array(F.lit("Customer")), {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}).alias("t"))


_ENTITY = "SELECT c_custkey, 'labels: Customer' || chr(10) || 'name: ' || c_name || chr(10) || 'segment: ' || c_mktsegment AS t FROM customer"

ALL: dict[str, tuple] = {
    "search_bm25": (bm25, _BM25),
    "search_bm25_prefix": (bm25_prefix, _BM25_PREFIX),
    "search_lucene_boolean": (lucene_boolean, _LUCENE_BOOLEAN),
    "search_lucene_wildcard_fuzzy": (lucene_wildcard_fuzzy, _LUCENE_WILDCARD),
    "search_lucene_phrase_range": (lucene_phrase_range, _LUCENE_PHRASE),
    "search_knn_cosine": (knn_cosine, _KNN.format(s=_COS)),
    "search_knn_euclidean": (knn_euclidean, _KNN.format(s=_EUC)),
    "search_rrf": (rrf, _RRF),
    "search_mmr": (mmr, None),
    "policy_decay": (decay, _DECAY),
    "policy_weight_decay": (weight_decay, _WEIGHT),
    "policy_kalman": (kalman, _KALMAN),
    "policy_valid_time": (valid_time, _VALID),
    "policy_retention": (retention, _RETENTION),
    "policy_audit_windows": (audit_windows, _AUDIT),
    "policy_compliance": (compliance, _COMPLIANCE),
    "links_topology": (link_topology, _TOPOLOGY),
    "links_top": (link_top, _LINK_TOP),
    "links_attachment": (link_attachment, _ATTACH),
    "links_ensemble": (link_ensemble, _ENSEMBLE),
    "signal_co_access": (co_access, _CO),
    "signal_temporal": (temporal_signal, _TEMPORAL),
    "signal_transitive": (transitive, _TRANSITIVE),
    "signal_evidence": (evidence, _EVIDENCE),
    "signal_similarity": (similarity_signal, _SIMILAR),
    "text_chunk_chars": (chunk_chars, _CHUNKS),
    "text_chunk_sentences": (chunk_sentences, _SENTENCES),
    "text_chunk_tokens": (chunk_tokens, _TOKEN_CHUNKS),
    "text_entity": (entity_text, _ENTITY),
}


def queries() -> dict:
    return {n: f for n, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in ALL.items() if s is not None}

"""Procedures: name -> DataFrame. Extensions register their own with :func:`register` or in ``catalog.procedures``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import graphweft
from graphweft.functions.scalars import REGISTRY as FUNCTIONS
from graphweft.functions.scalars import type_name
from graphweft.plans import paths
from graphweft.plans import syntax as s
from graphweft.search import fulltext, lucene, ranking

REGISTRY: dict[str, tuple[Callable, str]] = {}


def register(name: str, columns: str):
    """Add a procedure ``f(comp, *args) -> DataFrame``; a name that is taken is refused."""

    def add(f):
        if name.lower() in REGISTRY:
            raise ValueError(f"procedure {name} is already registered")
        REGISTRY[name.lower()] = (f, columns)
        return f

    return add


def call(comp, name: str, args: list) -> DataFrame:
    f = comp.catalog.procedures.get(name) or (REGISTRY.get(name.lower()) or (None,))[0]
    if f is None:
        from graphweft.plans.compiler import CompileError

        raise CompileError(f"unknown procedure {name}")
    return f(comp, *args)


def rows(comp, data: list[tuple], columns: str) -> DataFrame:
    return comp.spark.createDataFrame(data, columns)


def show(comp, kind: str) -> DataFrame:
    cat = comp.catalog
    if "CONSTRAINT" in kind:
        return rows(comp, [(n, str(r.get("rule")), ":".join(r.get("labels", ())), list(r.get("properties", ()))) for n, r in sorted(cat.constraints.items())], "name string, type string, labelOrType string, properties array<string>")
    if "INDEX" in kind:
        return rows(comp, [(n, r["kind"].replace(" INDEX", "").replace("INDEX", "RANGE"), ":".join(r.get("labels", ())), list(r.get("properties", ()))) for n, r in sorted(cat.indexes.items())], "name string, type string, labelOrType string, properties array<string>")
    if "SETTING" in kind:
        return rows(comp, sorted(comp.spark.conf.getAll.items()), "name string, value string")
    if "DATABASE" in kind:
        return rows(comp, [(cat.name, "online")], "name string, status string")
    return rows(comp, [(n, str(r)) for n, r in sorted(cat.policies.items())], "name string, definition string")


def _types(df) -> dict[str, str]:
    return {f.name: type_name(f.dataType) for f in df.schema.fields}


@register("db.labels", "label")
def labels(comp) -> DataFrame:
    return rows(comp, [(x,) for x in sorted({x for t in comp.catalog.nodes for x in t.labels})], "label string")


@register("db.relationshipTypes", "relationshipType")
def relationship_types(comp) -> DataFrame:
    return rows(comp, [(x,) for x in sorted({r.type for r in comp.catalog.rels})], "relationshipType string")


@register("db.propertyKeys", "propertyKey")
def property_keys(comp) -> DataFrame:
    keys = {p for t in [*comp.catalog.nodes, *comp.catalog.rels] for p in t.properties if not p.startswith("_")}
    return rows(comp, [(x,) for x in sorted(keys)], "propertyKey string")


@register("db.constraints", "name, type, labelOrType, properties")
def constraints(comp) -> DataFrame:
    return show(comp, "CONSTRAINTS")


@register("db.indexes", "name, type, labelOrType, properties")
def indexes(comp) -> DataFrame:
    return show(comp, "INDEXES")


@register("db.ping", "success")
def ping(comp) -> DataFrame:
    return rows(comp, [(True,)], "success boolean")


def _count(tables: list) -> int:
    return sum(t.df.count() for t in tables)


@register("db.info", "id, name, creationDate, nodeCount, relationshipCount")
def info(comp) -> DataFrame:
    cat = comp.catalog
    return rows(comp, [(cat.name, cat.name, None, _count(cat.nodes), _count(cat.rels))], "id string, name string, creationDate string, nodeCount long, relationshipCount long")


@register("graph.stats", "nodes, relationships, labels, relationshipTypes")
def stats(comp) -> DataFrame:
    cat = comp.catalog
    return rows(comp, [(_count(cat.nodes), _count(cat.rels), len({x for t in cat.nodes for x in t.labels}), len({r.type for r in cat.rels}))], "nodes long, relationships long, labels long, relationshipTypes long")


@register("graph.version", "version")
def version(comp) -> DataFrame:
    return rows(comp, [(graphweft.__version__,)], "version string")


@register("db.schema.nodeProperties", "nodeType, propertyName, propertyType")
def node_properties(comp) -> DataFrame:
    data = sorted({(":".join(t.labels), p, _types(t.df)[p]) for t in comp.catalog.nodes for p in t.properties})
    return rows(comp, data, "nodeType string, propertyName string, propertyType string")


@register("db.schema.relProperties", "relType, propertyName, propertyType")
def rel_properties(comp) -> DataFrame:
    data = sorted({(r.type, p, _types(r.df)[p]) for r in comp.catalog.rels for p in r.properties})
    return rows(comp, data, "relType string, propertyName string, propertyType string")


@register("db.schema.visualization", "source, relType, target")
def visualization(comp) -> DataFrame:
    data = sorted({(":".join(r.src_labels or ("",)), r.type, ":".join(r.dst_labels or ("",))) for r in comp.catalog.rels})
    return rows(comp, data, "source string, relType string, target string")


@register("dbms.components", "name, versions, edition")
def components(comp) -> DataFrame:
    return rows(comp, [("graphweft", [graphweft.__version__], "spark")], "name string, versions array<string>, edition string")


@register("dbms.info", "id, name, creationDate")
def dbms_info(comp) -> DataFrame:
    return rows(comp, [("graphweft", "graphweft", None)], "id string, name string, creationDate string")


@register("dbms.procedures", "name, signature")
def procedures(comp) -> DataFrame:
    return rows(comp, sorted([(n, c) for n, (_, c) in REGISTRY.items()] + [(n, "") for n in comp.catalog.procedures]), "name string, signature string")


@register("dbms.functions", "name")
def functions(comp) -> DataFrame:
    names = set(FUNCTIONS) | set(comp.catalog.functions) | set(comp.GRAPH_FUNCTIONS) | set(s.AGGREGATES)
    return rows(comp, [(n,) for n in sorted(names)], "name string")


@register("dbms.listConfig", "name, value")
def list_config(comp) -> DataFrame:
    return show(comp, "SETTINGS")


@register("dbms.clientConfig", "name, value")
def client_config(comp) -> DataFrame:
    return show(comp, "SETTINGS")


@register("dbms.listConnections", "connectionId")
def connections(comp) -> DataFrame:
    return rows(comp, [], "connectionId string")


@register("db.index.fulltext.listAvailableAnalyzers", "analyzer, description")
def analyzers(comp) -> DataFrame:
    return rows(comp, [("standard", "letters and digits, lower case, without stop words")], "analyzer string, description string")


# -- search ----------------------------------------------------------------------------------------------------------
def _target(comp, index: str, relationships: bool) -> tuple[list, list[str]]:
    """The tables and columns an index names."""
    rule = comp.catalog.indexes.get(index)
    if rule is None:
        raise ValueError(f"index {index} does not exist")
    tables = [r for r in comp.catalog.rels if r.type in rule["labels"]] if relationships else comp.catalog.with_labels(tuple(rule["labels"]))
    return tables, list(rule.get("properties", ()))


def _id(t):
    return (t.key() if hasattr(t, "type") else F.col(f"`{t.id}`").cast("string")).alias("id")


def fulltext_hits(comp, index: str, query: str, relationships: bool) -> DataFrame:
    """``id, score``. Nodes: BM25 of the query's words, filtered by the whole query; rows the words do not score count 1. Relationships: the query's own score, with its boosts."""
    tables, props = _target(comp, index, relationships)
    tree = lucene.parse(query)
    out = None
    for t in tables:
        have = [p for p in props if p in t.df.columns] or [p for p, k in t.df.dtypes if k == "string" and not p.startswith("_")]
        docs = t.df.select(_id(t), *[F.col(f"`{p}`").cast("string").alias(p) for p in have])
        if relationships:
            hits = docs.select("id", lucene.score(tree, {p: F.col(f"`{p}`") for p in have}).alias("score")).filter(F.col("score").isNotNull())
            out = hits if out is None else out.unionByName(hits)
            continue
        text = fulltext.index_text(have)
        match = docs.filter(lucene.condition(tree, {p: F.col(f"`{p}`") for p in have})).select("id")
        ranked = fulltext.bm25(docs, "id", text, lucene.positive_text(tree))
        hits = match.join(ranked, "id", "left").select("id", F.coalesce("score", F.lit(1.0)).alias("score"))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return rows(comp, [], "id string, score double")
    return out.groupBy("id").agg((F.max if relationships else F.sum)("score").alias("score"))


def _window(df: DataFrame, options: dict | None) -> DataFrame:
    options = options or {}
    df = df.orderBy(F.desc("score"), "node")
    if options.get("skip"):
        df = df.offset(int(options["skip"]))
    return df.limit(int(options["limit"])) if options.get("limit") else df


@register("db.index.fulltext.queryNodes", "node, score")
def query_nodes(comp, index: str, query: str, options: dict | None = None) -> DataFrame:
    return _window(fulltext_hits(comp, index, query, False).withColumnRenamed("id", "node"), options)


@register("db.index.fulltext.queryRelationships", "relationship, score")
def query_relationships(comp, index: str, query: str, options: dict | None = None) -> DataFrame:
    return _window(fulltext_hits(comp, index, query, True).withColumnRenamed("id", "node"), options).withColumnRenamed("node", "relationship")


def vector_hits(comp, index: str, k: int, vector: list, relationships: bool) -> DataFrame:
    tables, props = _target(comp, index, relationships)
    out = None
    for t in tables:
        one = ranking.knn(t.df.select(_id(t), F.col(f"`{props[0]}`").alias("v")), "id", "v", vector, k)
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("score"), "id").limit(k)


@register("db.index.vector.queryNodes", "node, score")
def vector_nodes(comp, index: str, k: int, vector: list) -> DataFrame:
    return vector_hits(comp, index, k, vector, False).withColumnRenamed("id", "node")


@register("db.index.vector.queryRelationships", "relationship, score")
def vector_relationships(comp, index: str, k: int, vector: list) -> DataFrame:
    return vector_hits(comp, index, k, vector, True).withColumnRenamed("id", "relationship")


def retrieve(comp, o: dict) -> DataFrame:
    """Both searches over all indexes, fused by reciprocal rank; per source an item's worst rank over the indexes counts.

    Cut to the limit before the lowest score applies. With one source only, that source is the search method and a fallback.
    """
    limit, k = int(o.get("limit", 10)), float(o.get("rrfK", ranking.RRF_K))
    wanted = set(o.get("labels") or ())
    text, vec = [], []
    for name, rule in comp.catalog.indexes.items():
        if rule.get("on") != "node" or (wanted and not wanted & set(rule["labels"])):
            continue
        if "FULLTEXT" in rule["kind"] and o.get("query"):
            text.append(ranking.ranked(fulltext_hits(comp, name, o["query"], False).orderBy(F.desc("score"), "id").limit(limit * 4)))
        if "VECTOR" in rule["kind"] and o.get("embedding"):
            vec.append(ranking.ranked(vector_hits(comp, name, limit * 4, o["embedding"], False)))

    def one(lists):
        df = lists[0]
        for x in lists[1:]:
            df = df.unionByName(x)
        return df.groupBy("id").agg(F.max("score").alias("score"), F.max("rank").alias("rank"))

    lists = {n: one(x) for n, x in (("vector", vec), ("bm25", text)) if x}
    if not lists:
        if o.get("failClosed"):
            raise ValueError("no index answers this retrieval")
        return rows(comp, [], "node string, score double, rrf_score double, vector_rank int, bm25_rank int, search_method string, fallback_triggered boolean")
    fused = ranking.rrf(lists, {"vector": o.get("vectorWeight", 1.0), "bm25": o.get("bm25Weight", 1.0)}, k).limit(limit)
    fused = fused.filter(F.col("rrf_score") >= float(o.get("minRRFScore", 0.0)))
    for n in ("vector", "bm25"):
        if n not in lists:
            fused = fused.withColumn(f"{n}_rank", F.lit(0))
    method = "rrf_hybrid" if len(lists) == 2 else next(iter(lists))
    return fused.select(F.col("id").alias("node"), F.col("best_score").alias("score"), "rrf_score", "vector_rank", "bm25_rank", F.lit(method).alias("search_method"), F.lit(len(lists) < 2).alias("fallback_triggered"))


@register("graph.discover", "node, score, depth")
def discover(comp, o: dict) -> DataFrame:
    """Retrieval by parts of a long query, then what lies within ``depth`` hops of the best nodes.

    ``query`` is cut into sentences of up to ``chunkSize`` characters, each retrieved on its own (with ``embeddings[i]``, if given); a
    node's best score counts, and a neighbour scores half of that per hop.
    """
    from graphweft.text.chunks import sentence_chunks

    limit = int(o.get("limit", 10))
    parts = [c for _, c in sentence_chunks(str(o.get("query", "")), int(o.get("chunkSize", 500)))] or [""]
    vectors = list(o.get("embeddings") or [])
    found = None
    for i, part in enumerate(parts):
        hits = retrieve(comp, {**o, "query": part, "embedding": vectors[i] if i < len(vectors) else None, "limit": limit}).select("node", F.col("rrf_score").alias("score"))
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy("node").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "node").limit(limit)
    depth = int(o.get("depth", 0))
    if not depth:
        return best.withColumn("depth", F.lit(0))
    from graphweft.session import cut

    best = cut(best)
    edges, _ = comp.hop_edges(s.RelP(None, (), "both"))
    edges = edges.withColumn("src", F.col("src").cast("string")).withColumn("dst", F.col("dst").cast("string"))
    near = paths.reachable(edges, best.select(F.col("node").alias("start")), 0, depth, with_paths=True)
    near = near.join(best.withColumnRenamed("node", "start"), "start").withColumn("depth", F.size("rels"))
    scored = near.groupBy("node").agg(F.max(F.struct((F.col("score") / F.pow(F.lit(2.0), "depth")).alias("score"), (-F.col("depth")).alias("d"))).alias("x"))
    return scored.select("node", "x.score", (-F.col("x.d")).alias("depth")).orderBy(F.desc("score"), "node")


RETRIEVE = "node, score, rrf_score, vector_rank, bm25_rank, search_method, fallback_triggered"
register("db.retrieve", RETRIEVE)(retrieve)
register("db.rretrieve", RETRIEVE)(retrieve)


@register("db.create.setNodeVectorProperty", "id")
def set_node_vector(comp, id: str, key: str, vector: list) -> DataFrame:
    return _set_vector(comp, comp.catalog.nodes, "id", id, key, vector)


@register("db.create.setRelationshipVectorProperty", "id")
def set_rel_vector(comp, id: str, key: str, vector: list) -> DataFrame:
    return _set_vector(comp, comp.catalog.rels, "id", id, key, vector)


def _set_vector(comp, tables: list, id_name: str, id: str, key: str, vector: list) -> DataFrame:
    from dataclasses import replace

    v = F.array(*[F.lit(float(x)).cast("float") for x in vector])
    for i, t in enumerate(tables):
        old = F.col(f"`{key}`") if key in t.df.columns else F.lit(None).cast("array<float>")
        tables[i] = replace(t, df=t.df.withColumn(key, F.when(F.col(getattr(t, id_name)).cast("string") == str(id), v).otherwise(old)))
    return rows(comp, [(str(id),)], "id string")


# -- policy ----------------------------------------------------------------------------------------------------------
def _bindings(comp) -> list:
    from graphweft.policy import knowledge

    return [b for on in ("node", "relationship") for b in knowledge.from_statements(comp.catalog.policies, on).bindings]


@register("graph.knowledgepolicy.info", "bindings")
def policy_info(comp) -> DataFrame:
    return rows(comp, [(len(_bindings(comp)),)], "bindings long")


@register("graph.knowledgepolicy.profiles", "name, function, halfLifeMs, threshold, floor")
def policy_profiles(comp) -> DataFrame:
    data = sorted({(b.profile.name, b.profile.function, b.profile.half_life_ms, b.profile.threshold, b.profile.floor) for b in _bindings(comp)})
    return rows(comp, data, "name string, function string, halfLifeMs long, threshold double, floor double")


@register("graph.knowledgepolicy.policies", "labels, profile, promotions")
def policy_policies(comp) -> DataFrame:
    return rows(comp, [(list(b.labels), b.profile.name, len(b.promotions)) for b in _bindings(comp)], "labels array<string>, profile string, promotions int")


@register("graph.decay.info", "labels, function, halfLifeMs")
def decay_info(comp) -> DataFrame:
    return rows(comp, [(list(b.labels), b.profile.function, b.profile.half_life_ms) for b in _bindings(comp)], "labels array<string>, function string, halfLifeMs long")


@register("graph.knowledgepolicy.resolve", "id, profile")
def policy_resolve(comp, id: str, labels_csv: str = "", edge_type: str = "") -> DataFrame:
    from graphweft.policy import knowledge

    names = [edge_type] if edge_type else [x for x in labels_csv.split(",") if x]
    b = knowledge.from_statements(comp.catalog.policies, "relationship" if edge_type else "node").resolve(names)
    return rows(comp, [(str(id), b.profile.name if b else None)], "id string, profile string")


# -- graph and files -------------------------------------------------------------------------------------------------
@register("apoc.path.subgraphNodes", "node, depth")
def subgraph_nodes(comp, start, options: dict | None = None) -> DataFrame:
    """Nodes within reach of ``start`` (an id or a list of ids): ``minLevel, maxLevel = 3, relationshipFilter, labelFilter, limit``."""
    o = options or {}
    ids = [str(x) for x in (start if isinstance(start, list) else [start])]
    out, low, high = None, int(o.get("minLevel", 0)), int(o.get("maxLevel", 3))
    filters = [x for x in str(o.get("relationshipFilter", "")).split("|") if x]
    hops = None
    for x in filters or [""]:
        direction = "out" if x.endswith(">") else "in" if x.startswith("<") else "both"
        name = x.strip("<>")
        edges, native = comp.hop_edges(s.RelP(None, (name,) if name else (), direction))
        hops = edges if hops is None else hops.unionByName(edges)
    starts = rows(comp, [(x,) for x in ids], "start string")
    hops = hops.withColumn("src", F.col("src").cast("string")).withColumn("dst", F.col("dst").cast("string"))
    out = paths.reachable(hops, starts, low, high, with_paths=True).select(F.col("node").alias("node"), F.size("rels").alias("depth")).groupBy("node").agg(F.min("depth").alias("depth"))
    wanted = [x.strip("+/>") for x in str(o.get("labelFilter", "")).split("|") if x and not x.startswith("-")]
    if wanted:
        ok = None
        for t in comp.catalog.nodes:
            if set(wanted) & set(t.labels):
                one = t.df.select(comp.key(F.col(f"`{t.id}`"), t.labels, native).cast("string").alias("node"))
                ok = one if ok is None else ok.unionByName(one)
        out = out.join(ok, "node", "left_semi") if ok is not None else out.limit(0)
    out = out.orderBy("depth", "node")
    return out.limit(int(o["limit"])) if o.get("limit") else out


@register("apoc.load.json", "value")
def apoc_load_json(comp, source: str) -> DataFrame:
    df = comp.spark.read.option("multiLine", True).json(source)
    return df.select(F.struct("*").alias("value"))


@register("apoc.import.json", "nodes, relationships")
def apoc_import_json(comp, source: str) -> DataFrame:
    from graphweft.plans import mutate
    from graphweft.sources.graphfiles import import_json

    new = import_json(comp.spark, source)
    n, r = _count(new.nodes), _count(new.rels)
    for t in new.nodes:
        mutate.insert_nodes(comp, t.labels, t.df)
    for t in new.rels:
        mutate.insert_rels(comp, t.type, t.df)
    return rows(comp, [(n, r)], "nodes long, relationships long")

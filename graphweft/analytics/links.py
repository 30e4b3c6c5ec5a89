"""Link prediction: topology scores, their ensemble and a hybrid with semantic similarity.

All scores come from two equi joins: the neighbours of the asked sources, then the neighbours of those. The sources are a stated set of
queries against the whole graph; pairs between all nodes are never made. Pairs that only meet in hubs are not joined and aggregated:
what they share is the same for all nodes beside the same hubs with the same degree, so it is computed once for each such kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.session import checked_broadcast, cut, settle

#: Weights of the ensemble.
ENSEMBLE = {"common_neighbors": 0.1, "jaccard": 0.2, "adamic_adar": 0.3, "resource_allocation": 0.25, "preferential_attachment": 0.15}
#: Degree above which a node is a hub; nodes of one kind whose pairs with a source are made together.
HUB, BLOCK = 10_000, 1_000


def snapshot(edges: DataFrame, nodes: DataFrame | None = None, directed: bool = False) -> DataFrame:
    """Distinct ``a, b`` between known nodes without self loops; both directions unless ``directed``."""
    e = edges.select("a", "b").filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    if nodes is not None:
        ids = nodes.select("id").distinct()
        e = e.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    if not directed:
        e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return e.distinct()


def degrees(graph: DataFrame) -> DataFrame:
    return graph.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))


def topology(graph: DataFrame, sources: DataFrame, view: list[Column] | None = None, first: int | None = None, also: DataFrame | None = None, hub: int = HUB) -> DataFrame:
    """``source, target`` with all raw scores that need common neighbours: targets two hops away that are no neighbours.

    ``graph`` is a :func:`snapshot`, ``sources`` has distinct ``source``. ``view`` are columns over the scores to give instead of them. With
    ``first``, of a source's targets that it meets in hubs only and that have the same scores no more than the first ones in order of
    ``target`` are sure to be given, enough for any top ``first`` by a score; those of ``also (source, target)`` are given in any case.
    """
    view = view or [F.col(x) for x in ENSEMBLE]
    graph = settle(graph)
    deg = degrees(graph)
    hubs = checked_broadcast(cut(deg.filter(F.col("degree") > hub)))
    adamic, resource = F.when(F.col("degree") > 1, 1 / F.ln("degree")), 1 / F.col("degree")
    near = graph.join(sources.withColumnRenamed("source", "a"), "a", "left_semi").select(F.col("a").alias("source"), F.col("b").alias("mid"))
    mids = near.join(deg.filter(F.col("degree") <= hub).withColumnRenamed("id", "mid"), "mid")
    two = mids.join(graph.select(F.col("a").alias("mid"), F.col("b").alias("target")), "mid").filter(F.col("source") != F.col("target"))
    agg = two.groupBy("source", "target").agg(F.count("*").alias("common"), F.sum(adamic).alias("adamic_adar"), F.sum(resource).alias("resource_allocation"))
    near = near.withColumnRenamed("mid", "target")
    d = lambda n: deg.select(F.col("id").alias(n), F.col("degree").alias(f"d_{n}"))
    if hubs.isEmpty():
        return _scored(agg.join(near, ["source", "target"], "left_anti").join(d("source"), "source").join(d("target"), "target"), view, "source", "target")

    beside = graph.join(hubs.select(F.col("id").alias("b")), "b").groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_set("b")).alias("hubs"))
    beside = settle(beside.join(deg, "id").withColumn("block", F.floor((F.row_number().over(Window.partitionBy("hubs", "degree").orderBy("id")) - 1) / BLOCK)))
    asked = beside.join(sources.withColumnRenamed("source", "id"), "id", "left_semi").select(F.col("id").alias("source"), F.col("hubs").alias("s_hubs"), F.col("degree").alias("d_source"))
    members = beside.select(F.col("id").alias("target"), F.col("hubs").alias("t_hubs"), F.col("degree").alias("d_target"), "block")
    both = asked.select("s_hubs").distinct().withColumn("id", F.explode("s_hubs")).join(members.select("t_hubs").distinct().withColumn("id", F.explode("t_hubs")), "id").join(hubs, "id")
    both = cut(both.groupBy("s_hubs", "t_hubs").agg(F.count("*").alias("h_common"), F.sum(adamic).alias("h_adamic"), F.sum(resource).alias("h_resource")))

    if also is not None:
        also = also.select("source", "target").join(sources, "source", "left_semi").filter(F.col("source") != F.col("target")).distinct()
        none = also.select("source", "target", F.lit(0).cast("long").alias("common"), F.lit(None).cast("double").alias("adamic_adar"), F.lit(0.0).alias("resource_allocation"))
        agg = agg.unionByName(none).groupBy("source", "target").agg(*[F.sum(x).alias(x) for x in ("common", "adamic_adar", "resource_allocation")])
    agg = settle(agg)
    sums = agg.join(asked.select("source", "s_hubs"), "source", "left").join(members.select("target", "t_hubs"), "target", "left").join(both, ["s_hubs", "t_hubs"], "left")
    sums = sums.select("source", "target", (F.col("common") + F.coalesce("h_common", F.lit(0))).alias("common"), (F.coalesce("adamic_adar", F.lit(0.0)) + F.coalesce("h_adamic", F.lit(0.0))).alias("adamic_adar"), (F.col("resource_allocation") + F.coalesce("h_resource", F.lit(0.0))).alias("resource_allocation"))
    sums = sums.filter(F.col("common") > 0).join(near, ["source", "target"], "left_anti").join(d("source"), "source").join(d("target"), "target")
    sums = _scored(sums, view, "source", "target")

    of = ["t_hubs", "d_target"]
    kinds = asked.select("s_hubs", "d_source").distinct().join(both, "s_hubs").join(members.select(*of).distinct(), "t_hubs")
    kinds = kinds.select("s_hubs", "d_source", *of, F.col("h_common").alias("common"), F.col("h_adamic").alias("adamic_adar"), F.col("h_resource").alias("resource_allocation"))
    kinds = settle(_scored(kinds, view, "s_hubs", "t_hubs", F.col("d_source").alias("·s"), F.col("d_target").alias("·t"))).withColumnsRenamed({"·s": "d_source", "·t": "d_target"})
    blocks = members.groupBy(*of, "block").agg(F.sort_array(F.collect_list("target")).alias("targets"))
    known = agg.select("source", "target").unionByName(near).unionByName(sources.select("source", F.col("source").alias("target")))
    known = known.join(members, "target").groupBy("source", *of, "block").agg(F.collect_set("target").alias("known"))
    rows = asked.join(kinds, ["s_hubs", "d_source"]).drop("s_hubs", "d_source").join(blocks.select(*of, "block"), of)
    if first is not None:  # the first ones stand in the first blocks, which those that are known already may fill
        rows = rows.join(known.groupBy("source", *of).agg(F.sum(F.size("known")).alias("·n")), ["source", *of], "left")
        rows = rows.filter(F.col("block") * BLOCK <= first + F.coalesce("·n", F.lit(0))).drop("·n")
    rows = rows.join(known, ["source", *of, "block"], "left").join(blocks, [*of, "block"])
    targets = F.when(F.col("known").isNull(), F.col("targets")).otherwise(F.array_except("targets", "known"))
    return sums.unionByName(rows.select("source", F.explode(targets if first is None else F.slice(targets, 1, first)).alias("target"), *[f"`{x}`" for x in sums.columns[2:]]))


def _scored(sums: DataFrame, view: list[Column], *keep) -> DataFrame:
    """``keep`` and ``view`` over the scores, from the sums over common neighbours and both degrees."""
    union = F.col("d_source") + F.col("d_target") - F.col("common")
    scores = {"common_neighbors": F.col("common").cast("double"), "jaccard": F.col("common") / union, "adamic_adar": F.coalesce("adamic_adar", F.lit(0.0)), "preferential_attachment": (F.col("d_source") * F.col("d_target")).cast("double")}
    return sums.withColumns(scores).select(*keep, *view)


def normalised(algorithm: str, score: Column) -> Column:
    """A raw score on 0 .. 1."""
    return {
        "common_neighbors": lambda: 1 - 1 / (1 + score / 2),
        "jaccard": lambda: score,
        "adamic_adar": lambda: F.tanh(score / 5),
        "resource_allocation": lambda: F.tanh(score / 5),
        "preferential_attachment": lambda: F.when(score <= 1, 0.0).otherwise(F.least(F.lit(1.0), F.log10(score) / 4)),
    }[algorithm]()


def top(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc(score), "target")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def predict(graph: DataFrame, sources: DataFrame, algorithm: str, k: int = 10) -> DataFrame:
    """``source, target, score, rank`` by one algorithm, raw scores, ties by target."""
    if algorithm == "preferential_attachment":
        return attachment(graph, sources, k)
    return top(topology(graph, sources, [F.col(algorithm).alias("score")], first=k), k)


def attachment(graph: DataFrame, sources: DataFrame, k: int = 10) -> DataFrame:
    """Degree products with every node that is no neighbour: a source's top ``k`` are among the ``degree + k + 1`` nodes of the highest degrees.

    Each source asks for so many places of the one list in order of degree and joins them by place, so the rows are as many as the
    relationships of the sources; the list is as long as the longest that is asked for.
    """
    deg = degrees(graph)
    asked = sources.join(deg.withColumnRenamed("id", "source"), "source")
    most = asked.agg(F.max("degree")).first()[0] or 0
    best = deg.orderBy(F.desc("degree"), "id").limit(int(most) + k + 1)
    placed = best.select(F.row_number().over(Window.orderBy(F.desc("degree"), "id")).alias("place"), F.col("id").alias("target"), F.col("degree").alias("d"))
    wanted = asked.select("source", "degree", F.explode(F.sequence(F.lit(1), (F.col("degree") + k + 1).cast("int"))).alias("place"))
    pairs = wanted.join(checked_broadcast(cut(placed)), "place").filter(F.col("source") != F.col("target"))
    near = graph.select(F.col("a").alias("source"), F.col("b").alias("target"))
    pairs = pairs.join(near, ["source", "target"], "left_anti")
    return top(pairs.select("source", "target", (F.col("degree") * F.col("d")).cast("double").alias("score")), k)


def min_max(df: DataFrame, score: str = "score") -> DataFrame:
    """Scores of each source on 0 .. 1; 1 where all are equal."""
    w = Window.partitionBy("source")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn("_l", low).withColumn("_h", high).withColumn(score, F.when(F.col("_h") == F.col("_l"), 1.0).otherwise((F.col(score) - F.col("_l")) / (F.col("_h") - F.col("_l")))).drop("_l", "_h")


def ensemble(graph: DataFrame, sources: DataFrame, k: int = 10) -> DataFrame:
    """The weighted sum of the five algorithms' top ``k``, each min-max scaled per source."""
    base = topology(graph, sources, first=k)
    out = None
    for name, weight in ENSEMBLE.items():
        one = attachment(graph, sources, k) if name == "preferential_attachment" else top(base.select("source", "target", F.col(name).alias("score")), k)
        one = min_max(one.select("source", "target", "score")).withColumn("score", F.col("score") * weight)
        out = one if out is None else out.unionByName(one)
    return top(out.groupBy("source", "target").agg(F.sum("score").alias("score")), k)


def hybrid(topology_scores: DataFrame, semantic: DataFrame, k: int, topology_weight: float = 0.5, semantic_weight: float = 0.5, threshold: float = 0.3) -> DataFrame:
    """Scaled topology scores joined with ``semantic (source, target, similarity)``; pairs below the threshold are left out."""
    t = min_max(topology_scores.select("source", "target", "score")).withColumnRenamed("score", "topology_score")
    j = t.join(semantic.select("source", "target", F.col("similarity").alias("semantic_score")), ["source", "target"], "left").withColumn("semantic_score", F.coalesce("semantic_score", F.lit(0.0)))
    j = j.withColumn("score", topology_weight * F.col("topology_score") + semantic_weight * F.col("semantic_score")).filter(F.col("score") >= threshold)
    return top(j, k)

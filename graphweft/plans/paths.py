"""Variable-length hops and shortest paths: one join per level.

A level joins the frontier with the hops and drops what its start has reached before, so each node is reached at its smallest depth
only. Every level is checkpointed to the shared folder and counted; the loop ends when the frontier is empty. While frontier and reached nodes are few
(``BROADCAST_ROWS``, by those counts) they are broadcast, so that a level is one pass over the hops without a shuffle of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.session import BROADCAST_ROWS, cut

#: Deepest level of an unbounded hop.
MAX_DEPTH = 65_536
RELS = "array<struct<_id:string,_type:string>>"


def few(df: DataFrame, n: int) -> DataFrame:
    """``df``, of which at most ``n`` rows are known to exist, marked for broadcast if they are few."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def reachable(edges: DataFrame, starts: DataFrame, low: int, high: int | None, with_paths: bool = False) -> DataFrame:
    """``start, node[, rels]``: one row per path of the smallest depth, for depths of ``low`` to ``high``.

    ``edges`` has ``src, dst, rel``, ``starts`` has distinct ``start``. Without paths the frontier holds one row per start and node
    with the number of its paths, so that diamonds do not multiply rows before the end. No path leads back to its start.
    """
    edges = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    frontier = starts.filter(F.col("start").isNotNull()).withColumn("node", F.col("start"))
    frontier = frontier.withColumn("rels", F.array().cast(RELS)) if with_paths else frontier.withColumn("n", F.lit(1).cast("long"))
    frontier = cut(frontier)
    n = frontier.count()
    seen, reached = frontier.select("start", "node"), n
    out = frontier if low == 0 else frontier.limit(0)
    depth = 0
    while n and depth < (MAX_DEPTH if high is None else high):
        depth += 1
        step = few(frontier, n).join(edges, F.col("node") == F.col("src"))
        rest = [F.array_append("rels", F.col("rel")).alias("rels")] if with_paths else ["n"]
        step = step.select("start", F.col("dst").alias("node"), *rest).join(few(seen, reached), ["start", "node"], "left_anti")
        if not with_paths:
            step = step.groupBy("start", "node").agg(F.sum("n").alias("n"))
        frontier = cut(step)
        n = frontier.count()
        seen, reached = seen.unionByName(frontier.select("start", "node").distinct()), reached + n
        if n and depth >= low:
            out = out.unionByName(frontier)
    if with_paths:
        return out
    return out.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")


def shortest(edges: DataFrame, pairs: DataFrame, low: int, high: int | None, every: bool) -> DataFrame:
    """``start, end, path`` for the distinct ``pairs (start, end)``: one shortest path (the one with the smallest relationship ids) or all.

    The search goes on from the starts that still miss an end. ``path`` has ``nodes, relationships, length``.
    """
    edges = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    pairs = cut(pairs.filter(F.col("start").isNotNull() & F.col("end").isNotNull()))
    left = pairs.count()
    ends = ["start", "end"]
    start = pairs.select("start").distinct()
    frontier = start.withColumn("node", F.col("start")).withColumn("rels", F.array().cast(RELS)).withColumn("nodes", F.array(F.col("start").cast("string")))
    n = reached = left
    seen = frontier.select("start", "node")
    out = frontier.withColumnRenamed("node", "end").limit(0)
    depth = 0
    if low == 0:
        out = frontier.withColumnRenamed("node", "end").join(pairs, ends, "left_semi")
        pairs = cut(pairs.filter(F.col("start") != F.col("end")))
        left = pairs.count()
    while n and left and depth < (MAX_DEPTH if high is None else high):
        depth += 1
        step = few(frontier, n).join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.array_append("rels", F.col("rel")).alias("rels"), F.array_append("nodes", F.col("dst").cast("string")).alias("nodes"))
        step = step.join(few(seen, reached), ["start", "node"], "left_anti")
        if not every:
            step = step.groupBy("start", "node").agg(F.min(F.struct("rels", "nodes")).alias("x")).select("start", "node", "x.rels", "x.nodes")
        frontier = cut(step)
        n = frontier.count()
        seen, reached = seen.unionByName(frontier.select("start", "node").distinct()), reached + n
        if n and depth >= low:
            hit = cut(frontier.withColumnRenamed("node", "end").join(few(pairs, left), ends, "left_semi"))
            found = hit.select(ends).distinct()
            k = found.count()
            if k:
                out = out.unionByName(hit)
                pairs, left = cut(pairs.join(few(found, k), ends, "left_anti")), left - k
                frontier = frontier.join(few(pairs.select("start").distinct(), left), "start", "left_semi")
    nodes = F.transform("nodes", lambda x: F.struct(x.alias("_id"), F.lit(None).cast("array<string>").alias("_labels")))
    return out.select("start", "end", F.struct(nodes.alias("nodes"), F.col("rels").alias("relationships"), F.size("rels").cast("long").alias("length")).alias("path"))

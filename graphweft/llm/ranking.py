"""One ranking from several differently scaled scores.

Scores become percentiles within their source and algorithm, so that only their order counts. A target's percentiles form its own vector,
which is compared by leximin: sorted ascending, then lexicographically, so that a weak score cannot be masked by strong ones.

Leximin looks at the single weakest score first, so a score that is unrelated to the others, or one that is missing, decides alone. What the scores of a source have
in common is therefore measured first: ``r2``, the squared correlation of a score with the mean of the target's other scores, over the
targets of that source (0 if it is negative). A score keeps the share ``r2`` of its percentile and takes ``1 - r2`` from the mean of
the target's others (regression to what the others say); a missing one counts as the middle percentile and is treated alike. The same
rule holds for every score. ``vectors="scores"`` leaves the percentiles as they are: leximin with missing scores in the middle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweft.llm.topn import latest, split, top_n, usable
from graphweft.session import BROADCAST_ROWS, at_most, checked_broadcast, cut, table

#: Percentiles are whole numbers of 0 .. UNIT, so that sums are exact in any order.
UNIT = 1_000_000_000
HOT_ROWS, BUCKETS = 200_000, 128


def percentiles(df: DataFrame, keys: list[str], score: str, hot_rows: int = HOT_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``pct``: each score's mid-percentile within its ``keys``, ``(average rank - 1/2) / n`` in units of 1e-9, truncated.

    Groups of up to ``hot_rows`` rows are ranked by one window. Larger ones are reduced to distinct scores with counts, cut at their own
    quantiles, ranked within each cut and moved up by the rows below it: exact at every size.
    """

    def pct(twice: Column, n: Column) -> Column:
        return F.floor(twice * F.lit(UNIT) / (2 * n)).cast("long").alias("pct")

    cold, hot = split(df, keys, df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > hot_rows).drop("__n"))
    w = Window.partitionBy(*keys)
    here = F.count("*").over(Window.partitionBy(*keys, score))
    cold = cold.withColumn("__r", F.rank().over(w.orderBy(score))).withColumn("__h", here).withColumn("__n", F.count("*").over(w))
    # 2 * average rank - 1 = 2 * (rows below) + (rows here)
    cold = cold.select(*df.columns, pct(2 * (F.col("__r") - 1) + F.col("__h"), F.col("__n")))
    if hot is None:
        return cold
    vals = hot.groupBy(*keys, score).agg(F.count("*").alias("__c"))
    bounds = vals.groupBy(*keys).agg(F.percentile_approx(score, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(1000)).alias("__bounds"))
    vals = vals.join(bounds, keys).withColumn("__b", F.size(F.filter("__bounds", lambda b: b < F.col(score)))).drop("__bounds")
    per = vals.groupBy(*keys, "__b").agg(F.sum("__c").alias("__bc"))
    below = w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__below", F.coalesce(F.sum("__bc").over(below), F.lit(0))).withColumn("__n", F.sum("__bc").over(w)).drop("__bc")
    inside = Window.partitionBy(*keys, "__b").orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    vals = vals.withColumn("__in", F.sum("__c").over(inside)).join(per, [*keys, "__b"])
    vals = vals.select(*keys, score, pct(2 * (F.col("__below") + F.col("__in")) - F.col("__c"), F.col("__n")))
    return cold.unionByName(hot.join(vals, [*keys, score]).select(*df.columns, "pct"))


def shares(items: DataFrame) -> DataFrame:
    """``source_id, shares``: per source its algorithms in order, each with the share (thousandths) its scores keep.

    Sums of whole numbers (percentiles of 0 .. 10,000), so that their order changes nothing; partial sums are made before the shuffle.
    """
    one = items.select("source_id", "n", "total", F.explode("parts").alias("p")).select("source_id", "p.algorithm", F.expr("p.pct div 100000").alias("x"), F.expr("CASE WHEN n > 1 THEN ((total - p.pct) div (n - 1)) div 100000 END").alias("y"))
    both = F.when(F.col("y").isNotNull(), F.col("x"))
    s = one.groupBy("source_id", "algorithm").agg(F.count("y").alias("m"), *[F.coalesce(F.sum(v), F.lit(0)).cast("double").alias(k) for k, v in (("sx", both), ("sy", F.col("y")), ("sxy", both * F.col("y")), ("sxx", both * both), ("syy", F.col("y") * F.col("y")))])
    cov, vx, vy = F.expr("m * sxy - sx * sy"), F.expr("m * sxx - sx * sx"), F.expr("m * syy - sy * sy")
    kept = F.when((cov > 0) & (vx > 0) & (vy > 0), F.least(F.lit(1000), F.floor(1000 * cov * cov / (vx * vy)))).otherwise(0).cast("long")
    return s.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("algorithm", kept.alias("kept")))).alias("shares"))


def leximin_vector(vectors: str) -> Column:
    """A target's own vector in ascending order from ``parts, n, total, shares``, one number for each algorithm of its source; the higher, the better."""
    owns = F.transform("shares", lambda a: F.get(F.filter("parts", lambda x: x["algorithm"] == a["algorithm"]), F.lit(0))["pct"])
    middle = F.lit(UNIT // 2)
    if vectors == "scores":
        return F.array_sort(F.transform(owns, lambda own: F.coalesce(own, middle)))
    total, n = F.col("total"), F.col("n")

    def part(a: Column, own: Column) -> Column:
        rest = F.when(own.isNull(), F.floor(total / n)).when(n > 1, F.floor((total - own) / (n - 1))).otherwise(middle)
        return F.floor((a["kept"] * F.coalesce(own, middle) + (1000 - a["kept"]) * rest) / 1000)

    return F.array_sort(F.zip_with("shares", owns, part))


def fuse(scores: DataFrame, n: int, vectors: str = "supported", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The ``n`` best targets of each source from ``scores (source_id, algorithm, target_id, score)``, one row each.

    Columns ``source_id, target_id, vector, rank``; equal vectors go in ascending order of ``target_id``. A vector has one number for each algorithm
    that its source has a score of. Null and NaN scores and null sources, targets and algorithms are left out; of repeated (source, algorithm, target)
    rows the highest counts. Other columns are ignored; empty input gives no rows.
    """
    scores = scores.select("source_id", "algorithm", "target_id", "score").filter(usable("score") & F.col("source_id").isNotNull() & F.col("target_id").isNotNull() & F.col("algorithm").isNotNull())
    each = percentiles(scores, ["source_id", "algorithm"], "score", hot_rows)
    items = each.groupBy("source_id", "target_id").agg(F.sort_array(F.collect_list(F.struct("algorithm", "pct"))).alias("p"))
    last = F.filter("p", lambda x, i: F.coalesce(F.get("p", i + 1)["algorithm"] != x["algorithm"], F.lit(True)))
    items = items.select("source_id", "target_id", last.alias("parts"))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["pct"])
    items = cut(items.select("source_id", "target_id", "parts", F.size("parts").alias("n"), total.alias("total")))
    items = with_shares(items, cut(shares(items)), hot_rows)
    return top_n(items.select("source_id", "target_id", leximin_vector(vectors).alias("vector")), ["source_id"], "vector", "target_id", n, hot_rows)


def with_shares(items: DataFrame, shares: DataFrame, hot_rows: int) -> DataFrame:
    """The items with the shares of their source: by broadcast if the sources are few; else sources with many items by broadcast and the rest by shuffle."""
    if at_most(shares, BROADCAST_ROWS):
        return items.join(F.broadcast(shares), "source_id")
    heavy = items.groupBy("source_id").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows).select("source_id")
    cold, hot = split(items, ["source_id"], heavy)
    out = cold.join(shares, "source_id")
    return out if hot is None else out.unionByName(hot.join(checked_broadcast(cut(shares.join(heavy, "source_id", "left_semi"))), "source_id"))


def related_targets(spark: SparkSession, sf_dir: str, n: int = 10, vectors: str = "supported") -> DataFrame:
    """:func:`fuse` over the algorithms of ``predictions`` and the score of ``similarity_results``, for sources of ``predictions``.

    Null and NaN scores are left out; of repeated (source, algorithm, target) rows the latest counts (at equal times the highest).
    """
    p = latest(table(spark, sf_dir, "predictions"), ["source_id", "algorithm", "target_id"], "score", "predicted_at")
    sources = p.select("source_id").distinct()
    s = table(spark, sf_dir, "similarity_results").select("source_id", F.lit("similarity_results").alias("algorithm"), F.col("id").alias("target_id"), "score", "searched_at")
    s = latest(s.join(sources, "source_id", "left_semi"), ["source_id", "algorithm", "target_id"], "score", "searched_at")
    return fuse(cut(p.unionByName(s)), n, vectors)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related_targets(spark, sf_dir).select("source_id", "target_id")


def p1_leximin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the percentiles as they are, with ranks."""
    return related_targets(spark, sf_dir, vectors="scores").select("source_id", "target_id", "rank")

"""The N best rows of every group, for groups of any size.

Hot-cold split: exact group counts tell heavy groups from light ones. Light groups go through an ordinary window. A heavy group's rows
are cut by score range (quantile bounds of that group) and, within a range, by a hash of the row, so that equal scores spread too;
every piece keeps its own best N, and a last window over at most ``pieces x N`` rows of the group decides. Both results are united.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweft.session import BROADCAST_ROWS, cut, table

HOT_ROWS, RANGES, SALTS = 200_000, 64, 8


def _best(df: DataFrame, keys: list[str], score: str, tie: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n)


def split(df: DataFrame, keys: list[str], heavy: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows outside and inside the ``heavy`` groups; None if no group is heavy. Few heavy keys are broadcast, many join by shuffle."""
    heavy = cut(heavy)
    n = heavy.count()
    if n == 0:
        return df, None
    h = F.broadcast(heavy) if n <= BROADCAST_ROWS else heavy
    same = [df[k].eqNullSafe(heavy[k]) for k in keys]
    return df.join(h, same, "left_anti"), df.join(h, same, "left_semi")


def top_n(df: DataFrame, keys: list[str], score: str, tie: str, n: int, hot_rows: int = HOT_ROWS, ranges: int = RANGES, salts: int = SALTS) -> DataFrame:
    """The ``n`` rows of each group with the highest ``score``; equal scores in ascending order of ``tie``. Adds ``rank`` from 1.

    ``score`` must not be null, ``(keys, tie)`` should be unique (for repeats any of the equal rows). A null key is a group of its own.
    ``score`` may be any ordered type; ranges are cut by number only, so heavy groups with another type are cut by hash alone.
    Groups with fewer rows keep all of them, empty input gives no rows. A column ``rank`` of the input is replaced.
    """
    df = df.drop("rank")
    out = [*df.columns, "rank"]
    number = dict(df.dtypes)[score] in ("double", "float", "int", "bigint", "smallint", "tinyint")
    heavy = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > hot_rows).drop("__n")
    cold, hot = split(df, keys, heavy)
    cold = _best(cold, keys, score, tie, n)
    if hot is None:
        return cold.withColumn("rank", F.col("__rank").cast("int")).select(out)
    if number:
        at = [i / ranges for i in range(1, ranges)]
        bounds = hot.groupBy(*keys).agg(F.percentile_approx(score, F.array(*map(F.lit, at)), F.lit(1000)).alias("__bounds"))
        hot = hot.alias("h").join(bounds.alias("b"), [F.col(f"h.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]).select("h.*", "b.__bounds")
        hot = hot.withColumn("__range", F.size(F.filter("__bounds", lambda b: b < F.col(score)))).drop("__bounds")
    else:
        hot = hot.withColumn("__range", F.lit(0))
    hot = hot.withColumn("__salt", F.pmod(F.xxhash64(tie), F.lit(salts)))
    hot = _best(_best(hot, [*keys, "__range", "__salt"], score, tie, n).drop("__rank"), keys, score, tie, n)
    ranked = [d.withColumn("rank", F.col("__rank").cast("int")).select(out) for d in (cold, hot)]
    return ranked[0].unionByName(ranked[1])


def usable(score: str):
    return F.col(score).isNotNull() & ~F.isnan(score)


def latest(df: DataFrame, keys: list[str], score: str, at: str) -> DataFrame:
    """One row per ``keys``: the score of the latest ``at`` among the usable scores (of rows at the same time the highest)."""
    best = df.filter(usable(score)).groupBy(*keys).agg(F.max(F.struct(at, score)).alias("_x"))
    return best.select(*keys, F.col(f"_x.{score}").alias("score"))


def top_targets(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    """The ``n`` best targets of each source of ``edge_suggestions`` and of each source and algorithm of ``predictions``.

    Columns ``tbl, group_key, item_id, score, rank``. Null and NaN scores are left out, then the latest row of each (group, target)
    stands, then the highest scores, equal ones in ascending byte order of ``target_id``.
    """
    s = latest(table(spark, sf_dir, "edge_suggestions"), ["source_id", "target_id"], "confidence", "suggested_at")
    s = s.select(F.lit("edge_suggestions").alias("tbl"), F.col("source_id").alias("group_key"), F.col("target_id").alias("item_id"), "score")
    p = latest(table(spark, sf_dir, "predictions"), ["source_id", "algorithm", "target_id"], "score", "predicted_at")
    p = p.select(F.lit("predictions").alias("tbl"), F.concat("source_id", F.lit("|"), "algorithm").alias("group_key"), F.col("target_id").alias("item_id"), "score")
    return top_n(s.unionByName(p), ["tbl", "group_key"], "score", "item_id", n)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_targets(spark, sf_dir).select("tbl", "group_key", "item_id")

"""Version chains: which version of each entity a snapshot sees.

A chain has one row per version with ``version`` (rising), and ``deleted`` true for a tombstone. All is one aggregation per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(chain: DataFrame, key: str, at: int, version: str = "version", deleted: str = "deleted") -> DataFrame:
    """Each entity as of version ``at``: its latest version up to there, unless that is a tombstone. Of equal versions the greatest row stands."""
    rest = [c for c in chain.columns if c not in (key, version)]
    last = chain.filter(F.col(version) <= at).groupBy(key).agg(F.max(F.struct(version, *rest)).alias("__x"))
    return last.select(key, *[F.col(f"__x.{c}").alias(c) for c in (version, *rest)]).filter(~F.coalesce(F.col(deleted), F.lit(False)))


def intervals(chain: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The chain with ``next_version``: where each version stops to be the latest; null for the last one."""
    from pyspark.sql import Window

    return chain.withColumn("next_version", F.lead(version).over(Window.partitionBy(key).orderBy(version)))


def changed_between(chain: DataFrame, key: str, low: int, high: int, version: str = "version") -> DataFrame:
    """Keys with a version in ``(low, high]`` and how many."""
    return chain.filter((F.col(version) > low) & (F.col(version) <= high)).groupBy(key).agg(F.count("*").alias("changes"))

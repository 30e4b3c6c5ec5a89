"""Retention, compliance and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweft.session import checked_broadcast

DAY_S = 86_400
#: The policies of a new store: label, days, deletes what depends on it, category.
DEFAULT_POLICIES = (
    ("User", 730, True, "USER"),
    ("AuditLog", 2555, False, "AUDIT"),
    ("Financial", 2555, False, "FINANCIAL"),
    ("PHI", 2190, True, "PHI"),
    ("Analytics", 90, False, "ANALYTICS"),
)


def default_policies(spark: SparkSession) -> DataFrame:
    rows = [(label, days * DAY_S, True, cascade, category) for label, days, cascade, category in DEFAULT_POLICIES]
    return spark.createDataFrame(rows, "label string, max_age_seconds long, enabled boolean, cascade_delete boolean, data_category string")


def sweep(records: DataFrame, policies: DataFrame, holds: DataFrame, now_s: int, batch: int | None = None) -> DataFrame:
    """The decision on every record under a policy: ``id, label, subject, expired, held, delete``.

    ``records`` has ``id, label, subject, created_at_s``, ``holds`` has ``subject, active``. Nothing is deleted here (a dry run);
    :func:`apply_sweep` takes the decisions out of the records. ``batch`` inspects that many records, the oldest first.
    """
    p = policies.filter("enabled").select("label", "max_age_seconds")
    held = holds.filter("active").select("subject").distinct().withColumn("_held", F.lit(True))
    r = records.select("id", "label", "subject", "created_at_s").join(checked_broadcast(p), "label")
    if batch is not None:
        r = r.orderBy("created_at_s", "id").limit(batch)
    r = r.join(held, "subject", "left")
    expired = F.coalesce(F.lit(now_s) - F.col("created_at_s") > F.col("max_age_seconds"), F.lit(False))
    is_held = F.coalesce("_held", F.lit(False))
    return r.select("id", "label", "subject", expired.alias("expired"), (expired & is_held).alias("held"), (expired & ~is_held).alias("delete"))


def sweep_report(decisions: DataFrame) -> DataFrame:
    n = {"inspected": F.lit(True), "expired": F.col("expired"), "held": F.col("held"), "deleted": F.col("delete")}
    return decisions.agg(*[F.count_if(c).alias(k) for k, c in n.items()])


def apply_sweep(records: DataFrame, decisions: DataFrame) -> DataFrame:
    return records.join(decisions.filter("delete").select("id"), "id", "left_anti")


def mask(df: DataFrame, rules: list[tuple[str, str, tuple[str, ...]]], role: str, labels: Column | None = None) -> DataFrame:
    """``rules``: ``(kind, target, allowed roles)`` with kind ``mask`` (a column becomes ``***``) or ``restrict`` (rows of a label are left out)."""
    for kind, target, allowed in rules:
        if role in allowed:
            continue
        if kind == "mask" and target in df.columns:
            df = df.withColumn(target, F.when(F.col(target).isNotNull(), F.lit("***")))
        elif kind == "restrict" and labels is not None:
            df = df.filter(~F.coalesce(F.array_contains(labels, target), F.lit(False)))
    return df


def obligations(df: DataFrame, rules: list[tuple[str, str, int | None]], labels: Column) -> DataFrame:
    """Adds what the labels of a row oblige to: ``audit`` (a rule ``("audit", label, None)`` names one of them) and ``max_age_days``
    (of the first rule ``("retention", label, days)`` that does; null if none). Null labels oblige to nothing."""
    has = lambda label: F.coalesce(F.array_contains(labels, label), F.lit(False))
    audit, days = F.lit(False), [F.lit(None).cast("int")]
    for kind, label, value in rules:
        if kind == "audit":
            audit = audit | has(label)
        elif kind == "retention":
            days.insert(-1, F.when(has(label), F.lit(int(value))))
    return df.withColumn("audit", audit).withColumn("max_age_days", F.coalesce(*days))


def audit_counts(events: DataFrame, start: str, end: str) -> DataFrame:
    """Events per type and status within ``[start, end)``."""
    t = F.col("at")
    return events.filter((t >= F.lit(start).cast("timestamp")) & (t < F.lit(end).cast("timestamp"))).groupBy("type", "status").agg(F.count("*").alias("events"))


def chain(events: DataFrame, payload: Column) -> DataFrame:
    """Adds ``expected``: the hash of sequence, the hash before it and the payload."""
    return events.withColumn("expected", F.sha2(F.concat_ws("|", F.col("sequence").cast("string"), F.coalesce("previous_hash", F.lit("")), payload), 256))


def chain_breaks(events: DataFrame, payload: Column, buckets: int = 10_000) -> DataFrame:
    """Events where the chain breaks: ``sequence, error`` (gap, previous_hash, hash). No rows: the chain holds.

    Each event is compared with the one before it, found by joining on the sequence number, so that no task sees the whole chain.
    """
    e = chain(events, payload)
    before = e.select((F.col("sequence") + 1).alias("sequence"), F.col("hash").alias("_before"), F.lit(True).alias("_has"))
    j = e.join(before, "sequence", "left")
    error = (
        F.when((F.col("sequence") > 1) & F.col("_has").isNull(), "gap")
        .when(~F.col("previous_hash").eqNullSafe(F.col("_before")), "previous_hash")
        .when(~F.col("hash").eqNullSafe(F.col("expected")), "hash")
    )
    return j.select("sequence", error.alias("error")).filter(F.col("error").isNotNull())

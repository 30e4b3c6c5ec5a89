"""Score decay, promotion and visibility; weight decay and valid time. All arithmetic is Columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


@dataclass(frozen=True)
class Profile:
    """How a score decays. ``function``: exponential, linear, step or none; a negative half-life inverts the score."""

    name: str
    half_life_ms: int = 7 * DAY_MS
    function: str = "exponential"
    threshold: float = 0.0
    floor: float = 0.0
    anchor: str = "CREATED"  # CREATED, VERSION, LAST_ACCESSED, CUSTOM
    anchor_property: str | None = None
    no_decay: bool = False


@dataclass(frozen=True)
class Promotion:
    """What lifts a score while ``when`` (a SQL condition over the row's columns) holds."""

    when: str
    multiplier: float = 1.0
    floor: float = 0.0
    cap: float = 1.0


@dataclass(frozen=True)
class Binding:
    """A profile for a label set (empty: all others) with its promotions; the first whose condition holds counts."""

    labels: tuple[str, ...]
    profile: Profile
    promotions: tuple[Promotion, ...] = ()
    order: int = 0


@dataclass
class KnowledgePolicy:
    bindings: list[Binding] = field(default_factory=list)

    def resolve(self, labels) -> Binding | None:
        """The binding of exactly these labels, else of their largest subset (the lowest order, then labels), else the one for all."""
        wanted = tuple(sorted(labels or ()))
        by = {tuple(sorted(b.labels)): b for b in sorted(self.bindings, key=lambda b: (b.order, b.labels), reverse=True)}
        if wanted and wanted in by:
            return by[wanted]
        for size in range(len(wanted) - 1, 0, -1):
            found = [by[s] for s in combinations(wanted, size) if s in by]
            if found:
                return min(found, key=lambda b: (b.order, b.labels))
        return by.get(())


def from_statements(records: dict, on: str = "node") -> KnowledgePolicy:
    """The policy that decay and promotion statements have defined for nodes or relationships."""
    import re

    def enabled(r: dict) -> bool:
        return r.get("options", {}).get("enabled", True)

    promotions: dict[tuple, list[Promotion]] = {}
    for r in records.values():
        if isinstance(r, dict) and "POLICY" in r.get("kind", "") and r.get("on") == on and enabled(r):
            for name, when in r["rules"]:
                o = records[name]["options"]
                if o.get("enabled", True):
                    text = re.sub(rf"\b{re.escape(r['var'])}\.", "", when) if when and r.get("var") else when or "true"
                    promotions.setdefault(tuple(sorted(r["labels"])), []).append(Promotion(text, o.get("multiplier", 1.0), o.get("scoreFloor", 0.0), o.get("scoreCap", 1.0)))
    out = []
    for r in records.values():
        if isinstance(r, dict) and r.get("kind") == "DECAY PROFILE" and r.get("on") == on and enabled(r):
            for name, _ in r["rules"]:
                o = records[name]["options"] | r["overrides"]
                if not o.get("enabled", True):
                    continue
                p = Profile(name, int(float(o.get("halfLifeSeconds", 604_800)) * 1000), o.get("function", "exponential"), o.get("visibilityThreshold", 0.0), o.get("scoreFloor", 0.0), o.get("scoreFrom", "CREATED"), o.get("scoreFromProperty"), o.get("noDecay", False))
                out.append(Binding(tuple(r["labels"]), p, tuple(promotions.get(tuple(sorted(r["labels"])), ())), int(o.get("order", 0))))
    return KnowledgePolicy(out)


def hide(table, policy: KnowledgePolicy, names: tuple[str, ...], now_ms: int) -> DataFrame:
    """The rows of a catalog table that its policy shows. Rows without an anchor are shown; a condition on a missing property is false."""
    b = policy.resolve(names)
    df = table.df
    if b is None or ("created_at_unix_ms" not in df.columns and b.profile.anchor != "CUSTOM"):
        return df
    have = set(df.columns)
    usable = []
    for m in b.promotions:
        try:
            df.select(F.expr(m.when))
            usable.append(m)
        except AnalysisException as e:
            if e.getCondition() not in ("UNRESOLVED_COLUMN.WITH_SUGGESTION", "UNRESOLVED_COLUMN.WITHOUT_SUGGESTION"):
                raise
    _, _, hidden = scores(df.withColumn("created_at_unix_ms", F.lit(None).cast("long")) if "created_at_unix_ms" not in have else df, Binding(b.labels, b.profile, tuple(usable), b.order), now_ms)
    return df.filter(~hidden)


def decay_score(age_ms: Column, half_life_ms: int, function: str) -> Column:
    """The score of an age; negative ages count as 0."""
    if function == "none" or half_life_ms == 0:
        return F.lit(1.0)
    age, half = F.greatest(age_ms, F.lit(0)).cast("double"), float(abs(half_life_ms))
    raw = {
        "exponential": lambda: F.pow(F.lit(2.0), -age / half),
        "linear": lambda: F.greatest(1 - age / (2 * half), F.lit(0.0)),
        "step": lambda: F.when(age <= half, 1.0).otherwise(0.0),
    }[function]()
    return 1 - raw if half_life_ms < 0 else raw


def anchor(p: Profile, columns: list[str]) -> Column:
    created = F.col("created_at_unix_ms")
    if p.anchor == "VERSION":
        return F.coalesce("updated_at_unix_ms", created) if "updated_at_unix_ms" in columns else created
    if p.anchor == "LAST_ACCESSED":
        seen = [F.col(x) for x in ("lastAccessedAt", "last_accessed_at") if x in columns]
        return F.coalesce(*seen, created) if seen else created
    if p.anchor == "CUSTOM":
        return F.col(p.anchor_property).try_cast("bigint") if p.anchor_property in columns else F.lit(None).cast("long")
    return created


def scores(df: DataFrame, b: Binding, now_ms: int) -> tuple[Column, Column, Column]:
    """Base score, final score and whether the row is hidden, for rows under one binding."""
    p = b.profile
    if p.no_decay:
        return F.lit(1.0), F.lit(1.0), F.lit(False)
    at = anchor(p, df.columns)
    base = F.when(at.isNull(), F.lit(1.0)).otherwise(decay_score(F.lit(now_ms) - at, p.half_life_ms, p.function))
    lifted = base
    for m in reversed(b.promotions):
        lifted = F.when(F.coalesce(F.expr(m.when), F.lit(False)), F.least(F.lit(m.cap), F.greatest(F.lit(m.floor), base * m.multiplier))).otherwise(lifted)
    final = F.greatest(F.lit(p.floor), lifted)
    return base, final, final < p.threshold


def score_table(df: DataFrame, policy: KnowledgePolicy, now_ms: int, labels: str = "labels") -> DataFrame:
    """Adds ``base_score, final_score, hidden``. The few distinct label sets are resolved on the driver, rows by ``when`` chains."""
    key = F.array_sort(F.coalesce(F.col(labels), F.array().cast("array<string>")))
    sets = [tuple(r[0]) for r in df.select(key.alias("k")).distinct().limit(10_001).collect()]
    if len(sets) > 10_000:
        raise ValueError("more than 10,000 label sets")
    by: dict[Binding, list[tuple]] = {}
    for s in sets:
        b = policy.resolve(s)
        if b is not None:
            by.setdefault(b, []).append(s)
    base, final, hidden = F.lit(1.0), F.lit(1.0), F.lit(False)
    text = F.to_json(key)
    import json

    for b, own in by.items():
        mine = text.isin(*[json.dumps(list(s), separators=(",", ":"), ensure_ascii=False) for s in own])
        x, y, z = scores(df, b, now_ms)
        base, final, hidden = F.when(mine, x).otherwise(base), F.when(mine, y).otherwise(final), F.when(mine, z).otherwise(hidden)
    return df.withColumn("base_score", base).withColumn("final_score", final).withColumn("hidden", hidden)


def visible(df: DataFrame, policy: KnowledgePolicy, now_ms: int, labels: str = "labels") -> DataFrame:
    return score_table(df, policy, now_ms, labels).filter(~F.col("hidden")).drop("base_score", "final_score", "hidden")


def access_stats(log: DataFrame) -> DataFrame:
    """``id, access_count, last_accessed_at`` from an access log ``id, at``: what reads would have counted."""
    return log.groupBy("id").agg(F.count("*").alias("access_count"), F.max("at").alias("last_accessed_at"))


def weight_decay(weight: Column, elapsed_s: Column, model: str, parameter: float) -> Column:
    """``exponential`` (rate), ``power`` (exponent; the first second is free) or ``gaussian`` (sigma)."""
    if model == "exponential":
        return weight * F.exp(-parameter * elapsed_s)
    if model == "power":
        return F.when(elapsed_s < 1, weight).otherwise(weight * F.pow(elapsed_s, F.lit(-float(parameter))))
    return weight * F.exp(-elapsed_s * elapsed_s / (2 * parameter * parameter))


def access_boost(weight: Column) -> Column:
    return F.least(F.lit(1.0), weight + 0.5)


def kalman(df: DataFrame, key: str, weight0: float = 0.5, rate0: float = 0.0, q: float = 1e-4, r: float = 0.01) -> DataFrame:
    """``key, weight, decay_rate``: a two-state filter over each key's observations ``(at_s, observed)`` in order of time.

    One key's observations are a sequence and are folded in one task.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at_s", "observed"])
        x, p = np.array([weight0, rate0]), np.eye(2)
        before = None
        for at, z in zip(pdf["at_s"].to_numpy(float), pdf["observed"].to_numpy(float)):
            dt = 0.0 if before is None else at - before
            before = at
            f = np.diag([np.exp(-x[1] * dt), 1.0])
            x, p = f @ x, f @ p @ f.T + q * np.eye(2)
            gain = p[:, 0] / (p[0, 0] + r)
            x = x + gain * (z - x[0])
            x[1] = max(x[1], 0.0)
            p = (np.eye(2) - np.outer(gain, [1.0, 0.0])) @ p
        return pd.DataFrame({key: [pdf[key].iloc[0]], "weight": [x[0]], "decay_rate": [x[1]]})

    kind = dict(df.dtypes)[key]
    clean = df.select(key, "at_s", "observed").filter(F.col("observed").isNotNull() & F.col("at_s").isNotNull())
    return clean.groupBy(key).applyInPandas(fold, f"`{key}` {kind}, weight double, decay_rate double")


def valid_at(df: DataFrame, at: int | Column, start: str = "valid_from", end: str = "valid_until") -> DataFrame:
    """Rows whose half-open interval holds ``at``; an open end never ends."""
    at = F.lit(at) if isinstance(at, int) else at
    return df.filter((F.col(start) <= at) & (F.col(end).isNull() | (at < F.col(end))))

"""Constraints, indexes and other schema statements.

Constraints are checked as DataFrame queries for violations. Indexes are names for search targets: FULLTEXT and VECTOR say which
columns a search reads; RANGE needs nothing, as filters are pushed to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.plans import syntax as s


class ConstraintError(ValueError):
    pass


#: Property type names and the Spark types they accept.
TYPES = {
    "STRING": (T.StringType,), "INTEGER": (T.IntegralType,), "INT": (T.IntegralType,), "FLOAT": (T.NumericType,), "DOUBLE": (T.NumericType,), "NUMBER": (T.NumericType,), "BOOLEAN": (T.BooleanType,), "BOOL": (T.BooleanType,),
    "LIST": (T.ArrayType,), "MAP": (T.MapType, T.StructType), "DATE": (T.StringType, T.DateType), "DATETIME": (T.StringType, T.TimestampType), "POINT": (T.MapType, T.StructType),
}


def schema_statement(comp, x: s.Schema) -> None:
    cat = comp.catalog
    if x.action == "show":
        from graphweft.plans.compiler import Bound
        from graphweft.plans import procedures

        comp.df = procedures.show(comp, x.kind)
        comp.scope = {n: Bound("value") for n in comp.df.columns}
        return
    if "PROFILE" in x.kind or "POLICY" in x.kind:
        policy_statement(comp, x)
        return
    store = cat.constraints if "CONSTRAINT" in x.kind else cat.indexes if "INDEX" in x.kind else cat.policies
    name = x.name or f"{x.kind.lower()}_{len(store) + 1}"
    if x.action == "drop":
        if name not in store and not x.options.get("if"):
            raise ConstraintError(f"{x.kind.lower()} {name} does not exist")
        store.pop(name, None)
        return
    if name in store:
        if x.options.get("if"):
            return
        raise ConstraintError(f"{x.kind.lower()} {name} exists")
    rule = {k: v for k, v in x.options.items() if k not in ("if", "var")} | {"kind": x.kind}
    if isinstance(rule.get("domain"), s.ListOf):
        rule["domain"] = [i.value for i in rule["domain"].items]
    if isinstance(rule.get("options"), s.MapOf):
        rule["options"] = comp.constant(rule["options"])
    store[name] = rule
    if "CONSTRAINT" in x.kind:
        check(cat)


def policy_statement(comp, x: s.Schema) -> None:
    """Decay profiles and their bindings, promotion profiles and policies: kept as plain records that ``policy.knowledge`` reads."""
    store = comp.catalog.policies
    if x.action == "drop":
        if x.name not in store and not x.options.get("if"):
            raise ConstraintError(f"{x.kind.lower()} {x.name} does not exist")
        store.pop(x.name, None)
        return
    given = comp.constant(x.options["options"]) if "options" in x.options else {}
    if x.action == "alter":
        if x.name not in store:
            raise ConstraintError(f"{x.kind.lower()} {x.name} does not exist")
        old = store[x.name]
        store[x.name] = old | {"options": old.get("options", {}) | given}
        return
    if x.name in store:
        if x.options.get("if"):
            return
        raise ConstraintError(f"{x.kind.lower()} {x.name} exists")
    record = {"kind": x.kind, "options": given}
    if "on" in x.options:
        record |= {"on": x.options["on"], "labels": tuple(x.options["labels"]), "var": x.options.get("var")}
        record |= {"rules": x.options["rules"], "overrides": {k: comp.constant(v) for k, v in x.options["overrides"].items()}, "on_access": list(x.options["on_access"])}
        missing = [p for p, _ in record["rules"] if p not in store]
        if missing:
            raise ConstraintError(f"profile {missing[0]} does not exist")
    store[x.name] = record


def _frames(cat, rule: dict) -> list[DataFrame]:
    if rule["on"] == "node":
        return [t.df for t in cat.with_labels(tuple(rule["labels"]))]
    return [t.df for t in cat.rels if t.type in rule["labels"]]


def _at(df: DataFrame, p: str) -> Column:
    return F.col(f"`{p}`") if p in df.columns else F.lit(None).cast("string")


def violations(cat, rule: dict) -> DataFrame | None:
    """Rows or groups that break the rule; None if there is nothing to look at.

    UNIQUE and KEY count per key (null parts are exempt from UNIQUE); TEMPORAL keys are ``(..key, from, to)``, open intervals end
    never, and overlaps are found by comparing each interval with the latest end before it, in one sort per key.
    """
    frames = _frames(cat, rule)
    props, kind = rule["properties"], rule["rule"]
    if not frames:
        return None
    out = None
    if kind in ("UNIQUE", "KEY", "TEMPORAL"):
        df = frames[0].select(*[_at(frames[0], p).alias(p) for p in props])
        for f in frames[1:]:
            df = df.unionByName(f.select(*[_at(f, p).alias(p) for p in props]))
        missing = F.lit(False)
        for p in props:
            missing = missing | F.col(f"`{p}`").isNull()
        if kind == "TEMPORAL":
            from pyspark.sql import Window

            *keys, start, end = props
            until = F.coalesce(F.col(f"`{end}`").cast("double"), F.lit(float("inf")))
            w = Window.partitionBy(*[f"`{k}`" for k in keys]).orderBy(f"`{start}`", until).rowsBetween(Window.unboundedPreceding, -1)
            return df.filter(F.col(f"`{start}`").isNotNull()).withColumn("_before", F.max(until).over(w)).filter(F.col("_before") > F.col(f"`{start}`").cast("double"))
        twice = df.filter(~missing).groupBy(*[f"`{p}`" for p in props]).count().filter("count > 1").drop("count")
        return twice if kind == "UNIQUE" else twice.unionByName(df.filter(missing))
    for f in frames:
        p = props[0]
        x = _at(f, p)
        if kind == "EXISTS":
            bad = f.filter(x.isNull())
        elif kind == "DOMAIN":
            bad = f.filter(x.isNotNull() & ~x.isin(*rule["domain"]))
        elif kind == "TYPE":
            wanted = TYPES.get(rule["type"])
            bad = f.filter(x.isNotNull()) if wanted and p in f.columns and not isinstance(f.schema[p].dataType, wanted) else f.limit(0)
        else:
            continue
        bad = bad.select(x.cast("string").alias(p))
        out = bad if out is None else out.unionByName(bad)
    return out


def check(cat, unchanged: set[int] = frozenset()) -> None:
    """Raise if a constraint is violated. Constraints that see only ``unchanged`` frames (their ``id``) held before and are not looked at again."""
    for name, rule in cat.constraints.items():
        if not rule.get("rule") or all(id(f) in unchanged for f in _frames(cat, rule)):
            continue
        bad = violations(cat, rule)
        if bad is not None and not bad.isEmpty():
            raise ConstraintError(f"constraint {name} ({rule['rule']}) is violated")

"""Writes: every clause makes a new version of the tables it touches.

New and changed rows are written to the shared folder, because ids are drawn at random and later clauses read them. Writes need a catalog with unique
string ids (:meth:`GraphCatalog.empty`).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.plans import constraints
from graphweft.plans import syntax as s
from graphweft.plans.catalog import ORDER, SEP, NodeTable, RelTable
from graphweft.session import settle


class WriteError(ValueError):
    pass


def c(var: str, name: str) -> Column:
    return F.col(f"`{var}{SEP}{name}`")


def apply(comp, clause) -> None:
    if not isinstance(clause, s.Schema) and not comp.catalog.unique_ids:
        raise WriteError("this graph is a read-only view; writes need GraphCatalog.empty(spark)")
    if isinstance(clause, s.Schema):
        constraints.schema_statement(comp, clause)
        return
    if comp.df is None:
        comp.df = comp.spark.range(1).select()
    before = {id(t.df) for t in (*comp.catalog.nodes, *comp.catalog.rels)}
    {s.Create: create, s.Merge: merge, s.SetClause: set_clause, s.Remove: remove, s.Delete: delete, s.Foreach: foreach}[type(clause)](comp, clause)
    constraints.check(comp.catalog, before)


def _node_table(comp, labels: tuple[str, ...]) -> int | None:
    return next((k for k, t in enumerate(comp.catalog.nodes) if t.labels == labels), None)


def insert_nodes(comp, labels: tuple[str, ...], rows: DataFrame) -> None:
    """``rows`` has ``_id`` and properties."""
    from graphweft.plans.compiler import Compiler

    labels = tuple(sorted(labels))
    k = _node_table(comp, labels)
    if k is None:
        comp.catalog.nodes.append(NodeTable(labels, rows))
    else:
        comp.catalog.nodes[k] = replace(comp.catalog.nodes[k], df=Compiler.union(comp.catalog.nodes[k].df, rows))


def insert_rels(comp, type_: str, rows: DataFrame) -> None:
    """``rows`` has ``_rid, _src, _dst`` and properties."""
    from graphweft.plans.compiler import Compiler

    k = next((k for k, t in enumerate(comp.catalog.rels) if t.type == type_), None)
    if k is None:
        comp.catalog.rels.append(RelTable(type_, rows, id="_rid"))
    else:
        comp.catalog.rels[k] = replace(comp.catalog.rels[k], df=Compiler.union(comp.catalog.rels[k].df, rows))


def _valued(comp, props: s.MapOf | None) -> list[tuple[str, Column]]:
    out = []
    for k, v in props.items if props is not None else ():
        t = comp.type_of(v, {})
        x = comp.col(v)
        out.append((k, x.cast("string") if isinstance(t, T.NullType) else x))
    return out


def create(comp, clause: s.Create) -> None:
    from graphweft.plans.compiler import Bound

    for p in comp.named(clause.paths):
        fresh = [n for n in dict.fromkeys(p.nodes) if n.var not in comp.scope]
        for n in fresh:
            for k, x in _valued(comp, n.props):
                comp.df = comp.df.withColumn(f"{n.var}{SEP}{k}", x)
            comp.df = comp.df.withColumn(f"{n.var}{SEP}_id", F.uuid()).withColumn(f"{n.var}{SEP}_labels", F.array(*map(F.lit, sorted(n.labels))).cast("array<string>"))
        for r in p.rels:
            if r.many or len(r.types) != 1 or r.direction == "both":
                raise WriteError("CREATE needs a type and a direction")
            for k, x in _valued(comp, r.props):
                comp.df = comp.df.withColumn(f"{r.var}{SEP}{k}", x)
            comp.df = comp.df.withColumn(f"{r.var}{SEP}_id", F.uuid())
        comp.df = settle(comp.df)
        for n in fresh:
            names = [k for k, _ in n.props.items] if n.props is not None else []
            insert_nodes(comp, n.labels, comp.df.select(c(n.var, "_id").alias("_id"), *[c(n.var, k).alias(k) for k in names]))
            comp.scope[n.var] = Bound("node", (comp.catalog.nodes[_node_table(comp, tuple(sorted(n.labels)))],), tuple(names), True)
        for a, r, b in zip(p.nodes, p.rels, p.nodes[1:]):
            a, b = (b, a) if r.direction == "in" else (a, b)
            names = [k for k, _ in r.props.items] if r.props is not None else []
            insert_rels(comp, r.types[0], comp.df.select(c(r.var, "_id").alias("_rid"), c(a.var, "_id").alias("_src"), c(b.var, "_id").alias("_dst"), *[c(r.var, k).alias(k) for k in names]))
            comp.df = comp.df.withColumn(f"{r.var}{SEP}_type", F.lit(r.types[0])).withColumn(f"{r.var}{SEP}_src", c(a.var, "_id")).withColumn(f"{r.var}{SEP}_dst", c(b.var, "_id"))
            comp.scope[r.var] = Bound("rel", (), tuple(names))


def merge(comp, clause: s.Merge) -> None:
    """Bind what matches; for the rows without a match make one node or relationship per distinct combination of values, then bind it."""
    path = comp.named((clause.path,))[0]
    if not path.rels:
        if path.nodes[0].var not in comp.scope:
            _merge_node(comp, path.nodes[0], clause)
        return
    for n in path.nodes:
        if n.var not in comp.scope:
            _merge_node(comp, n, s.Merge(s.PathP((n,), ()), [], []))
    for a, r, b in zip(path.nodes, path.rels, path.nodes[1:]):
        _merge_rel(comp, a, r, b, clause)


def _bind_existing(comp, var: str, tables: list, keys: list[tuple[str, str]]) -> None:
    """Join the node tables on ``(property, column of the rows)``."""
    from graphweft.plans.compiler import Bound

    nodes = comp.node_frame(var, tables, True)
    on = F.lit(True)
    for prop, column in keys:
        on = on & (c(var, prop).eqNullSafe(F.col(f"`{column}`")) if f"{var}{SEP}{prop}" in nodes.columns else F.lit(False))
    comp.df = comp.df.join(nodes, on).drop(*[k for _, k in keys])
    comp.scope[var] = Bound("node", tuple(tables), tuple(dict.fromkeys(p for t in tables for p in t.properties)), True)


def _merge_node(comp, n: s.NodeP, clause: s.Merge) -> None:
    keys = []
    for k, x in _valued(comp, n.props):
        name = comp.temp()
        comp.df = comp.df.withColumn(name, x)
        keys.append((k, name))
    comp.df = settle(comp.df)
    tables = comp.catalog.with_labels(n.labels)
    wanted = comp.df.select(*[F.col(f"`{x}`") for _, x in keys]).distinct() if keys else comp.df.limit(1).select(F.lit(1).alias("·one"))
    if tables:
        nodes = comp.node_frame(n.var, tables, True)
        on = F.lit(True)
        for k, x in keys:
            on = on & (c(n.var, k).eqNullSafe(F.col(f"`{x}`")) if f"{n.var}{SEP}{k}" in nodes.columns else F.lit(False))
        missing = wanted.join(nodes, on, "left_anti")
    else:
        missing = wanted
    new = settle(missing.select(F.uuid().alias("_id"), *[F.col(f"`{x}`").alias(k) for k, x in keys]))
    if not new.isEmpty() or not tables:
        insert_nodes(comp, n.labels, new)
    _bind_existing(comp, n.var, comp.catalog.with_labels(n.labels), keys)
    _on(comp, n.var, new.select("_id"), clause)


def _merge_rel(comp, a: s.NodeP, r: s.RelP, b: s.NodeP, clause: s.Merge) -> None:
    from graphweft.plans.compiler import Bound

    if len(r.types) != 1:
        raise WriteError("MERGE needs one type")
    a, b = (b, a) if r.direction == "in" else (a, b)
    keys = []
    for k, x in _valued(comp, r.props):
        name = comp.temp()
        comp.df = comp.df.withColumn(name, x)
        keys.append((k, name))
    comp.df = settle(comp.df)
    wanted = comp.df.select(c(a.var, "_id").alias("_src"), c(b.var, "_id").alias("_dst"), *[F.col(f"`{x}`").alias(k) for k, x in keys]).distinct()

    def frame():
        tables = comp.catalog.with_types(r.types)
        return tables[0].df if tables else None

    have = frame()
    if have is not None:
        e, w = have.alias("e"), wanted.alias("w")
        ends = (F.col("e._src") == F.col("w._src")) & (F.col("e._dst") == F.col("w._dst"))
        if r.direction == "both":
            ends = ends | (F.col("e._src") == F.col("w._dst")) & (F.col("e._dst") == F.col("w._src"))
        for k, _ in keys:
            ends = ends & (F.col(f"e.`{k}`").eqNullSafe(F.col(f"w.`{k}`")) if k in have.columns else F.lit(False))
        missing = w.join(e, ends, "left_anti")
    else:
        missing = wanted
    new = settle(missing.withColumn("_rid", F.uuid()))
    insert_rels(comp, r.types[0], new)
    rels = frame()
    props = tuple(x for x in rels.columns if not x.startswith("_"))
    f = rels.select(c_(rels, "_rid").alias(f"{r.var}{SEP}_id"), F.lit(r.types[0]).alias(f"{r.var}{SEP}_type"), F.col("_src").alias(f"{r.var}{SEP}_src"), F.col("_dst").alias(f"{r.var}{SEP}_dst"), *[F.col(f"`{x}`").alias(f"{r.var}{SEP}{x}") for x in props])
    on = (c(r.var, "_src") == c(a.var, "_id")) & (c(r.var, "_dst") == c(b.var, "_id"))
    if r.direction == "both":
        on = on | (c(r.var, "_src") == c(b.var, "_id")) & (c(r.var, "_dst") == c(a.var, "_id"))
    for k, x in keys:
        on = on & c(r.var, k).eqNullSafe(F.col(f"`{x}`"))
    comp.df = comp.df.join(f, on).drop(*[x for _, x in keys])
    comp.scope[r.var] = Bound("rel", (), props)
    _on(comp, r.var, new.select(F.col("_rid").alias("_id")), clause)


def c_(df: DataFrame, name: str) -> Column:
    return df[name]


def _on(comp, var: str, created: DataFrame, clause: s.Merge) -> None:
    """ON CREATE for the rows whose entity is new, ON MATCH for the others."""
    if not clause.on_create and not clause.on_match:
        return
    marked = comp.df.join(created.select(F.col("_id").alias("·new")), c(var, "_id") == F.col("`·new`"), "left").withColumn("·new", F.col("`·new`").isNotNull())
    comp.df = settle(marked)
    for items, fresh in ((clause.on_create, True), (clause.on_match, False)):
        if items:
            _set(comp, items, F.col("`·new`") == fresh)
    comp.df = comp.df.drop("·new")


def set_clause(comp, clause: s.SetClause) -> None:
    _set(comp, clause.items, F.lit(True))


def _set(comp, items: list[s.SetItem], when: Column) -> None:
    for i in items:
        if i.var not in comp.scope:
            raise WriteError(f"variable {i.var} is not defined")
        if i.kind == "label":
            _relabel(comp, i.var, i.name, when, add=True)
            continue
        if i.kind == "prop":
            values = [(i.name, i.expr, False)]
        else:
            e = s.MapOf(tuple((k, s.Lit(v)) for k, v in comp.params[i.expr.name].items())) if isinstance(i.expr, s.Param) else i.expr
            if not isinstance(e, s.MapOf):
                t = comp.type_of(e, {})
                if not isinstance(t, T.StructType):
                    raise WriteError("SET = needs a map")
                e = s.MapOf(tuple((k, s.Prop(i.expr, k)) for k in t.fieldNames() if not k.startswith("_")))
            values = [(k, v, i.kind == "add") for k, v in e.items]  # both forms merge; += leaves nulls alone
        for name, expr, skip_null in values:
            if name.startswith("_"):
                raise WriteError(f"property {name} is reserved")
            t = comp.type_of(expr, {})
            x = comp.col(expr)
            if isinstance(t, T.NullType):
                column = f"{i.var}{SEP}{name}"
                if skip_null or column not in comp.df.columns:
                    continue
                x = x.cast(comp.df.schema[column].dataType)
            cond = when & x.isNotNull() if skip_null else when
            _write_property(comp, i.var, name, x, cond)


def _write_property(comp, var: str, name: str, value: Column, when: Column) -> None:
    """The value of the last row of each entity goes to its table and to the rows.

    Rows are in the order of the lists they were unwound from; among rows without one the greatest value stands, null being the least.
    """
    b = comp.scope[var]
    column = f"{var}{SEP}{name}"
    order = [F.col(f"`{x}`") for x in comp.df.columns if x.startswith(ORDER)]
    last = F.struct(*order, value.alias("v"))
    new = comp.df.filter(when & c(var, "_id").isNotNull()).groupBy(c(var, "_id").alias("·id")).agg(F.max_by(F.struct(value.alias("v")), last).alias("·v"))
    new = settle(new)
    kind = new.schema["·v"].dataType["v"].dataType
    tables = comp.catalog.nodes if b.kind == "node" else comp.catalog.rels
    for k, t in enumerate(tables):
        if b.kind == "node" and t.labels not in {x.labels for x in b.tables}:
            continue
        key = t.id if b.kind == "node" else "_rid"
        old = t.df
        if name not in old.columns:
            old = old.withColumn(name, F.lit(None).cast(kind))
        elif old.schema[name].dataType != kind:
            old = old.withColumn(name, F.col(f"`{name}`").cast(_wider(old.schema[name].dataType, kind)))
        to = old.schema[name].dataType
        joined = old.join(new, F.col(f"`{key}`") == F.col("`·id`"), "left")
        out = joined.withColumn(name, F.when(F.col("`·id`").isNotNull(), F.col("`·v`.v").cast(to)).otherwise(F.col(f"`{name}`"))).drop("·id", "·v")
        tables[k] = replace(t, df=settle(out))
    rows = comp.df.join(new, c(var, "_id") == F.col("`·id`"), "left")
    had = F.col(f"`{column}`") if column in comp.df.columns else F.lit(None)
    to = kind if column not in comp.df.columns else _wider(comp.df.schema[column].dataType, kind)
    comp.df = settle(rows.withColumn(column, F.when(F.col("`·id`").isNotNull(), F.col("`·v`.v").cast(to)).otherwise(had.cast(to))).drop("·id", "·v"))
    props = b.props if name in b.props else (*b.props, name)
    refreshed = tuple(t for t in comp.catalog.nodes if t.labels in {x.labels for x in b.tables}) if b.kind == "node" else b.tables
    comp.scope[var] = replace(b, props=props, tables=refreshed)


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    return T.StringType()


def _relabel(comp, var: str, labels: tuple, when: Column, add: bool) -> None:
    """Move the nodes to the table of their new label set."""
    b = comp.scope[var]
    if b.kind != "node":
        raise WriteError("labels belong to nodes")
    ids = settle(comp.df.filter(when & c(var, "_id").isNotNull()).select(c(var, "_id").alias("_id")).distinct())
    moved = []
    for t in list(b.tables):
        k = _node_table(comp, t.labels)
        target = tuple(sorted(set(t.labels) | set(labels) if add else set(t.labels) - set(labels)))
        if target == t.labels:
            continue
        go = settle(comp.catalog.nodes[k].df.join(ids, "_id", "left_semi"))
        comp.catalog.nodes[k] = replace(comp.catalog.nodes[k], df=settle(comp.catalog.nodes[k].df.join(ids, "_id", "left_anti")))
        insert_nodes(comp, target, go)
        moved.append(target)
    new = F.array_sort(F.array_union(c(var, "_labels"), F.array(*map(F.lit, labels)))) if add else F.array_except(c(var, "_labels"), F.array(*map(F.lit, labels)))
    comp.df = comp.df.withColumn(f"{var}{SEP}_labels", F.when(when, new).otherwise(c(var, "_labels")))
    keep = {t.labels for t in b.tables} | set(moved)
    comp.scope[var] = replace(b, tables=tuple(t for t in comp.catalog.nodes if t.labels in keep))


def remove(comp, clause: s.Remove) -> None:
    for var, kind, what in clause.items:
        if kind == "label":
            _relabel(comp, var, what, F.lit(True), add=False)
            continue
        if what.startswith("_"):
            raise WriteError(f"property {what} is reserved")
        if what in comp.scope[var].props:
            kindof = comp.df.schema[f"{var}{SEP}{what}"].dataType
            _write_property(comp, var, what, F.lit(None).cast(kindof), F.lit(True))


def delete(comp, clause: s.Delete) -> None:
    """Relationships first, so that a node and its relationships can be deleted together; all or nothing."""
    cat = comp.catalog
    names = sorted(clause.names, key=lambda n: comp.scope[n].kind == "node")
    for var in names:
        b = comp.scope[var]
        ids = settle(comp.df.select(c(var, "_id").alias("·d")).filter(F.col("`·d`").isNotNull()).distinct())
        if b.kind == "rel":
            types = {t.type for t in b.tables}
            for k, t in enumerate(cat.rels):
                if not types or t.type in types:
                    cat.rels[k] = replace(t, df=settle(t.df.join(ids, F.col(t.id) == F.col("`·d`"), "left_anti")))
            continue
        if b.kind != "node":
            raise WriteError("DELETE takes nodes and relationships")
        labels = {t.labels for t in b.tables}
        for k, t in enumerate(cat.rels):
            ends = [F.col(end) == F.col("`·d`") for end, own in ((t.src, t.src_labels), (t.dst, t.dst_labels)) if own is None or own in labels]
            if all(t.df.join(ids, on, "left_semi").isEmpty() for on in ends):
                continue
            if not clause.detach:
                raise WriteError("a node still has relationships; use DETACH DELETE")
            rest = t.df
            for on in ends:
                rest = rest.join(ids, on, "left_anti")
            cat.rels[k] = replace(t, df=settle(rest))
        for k, t in enumerate(cat.nodes):
            if t.labels in labels:
                cat.nodes[k] = replace(t, df=settle(t.df.join(ids, F.col(t.id) == F.col("`·d`"), "left_anti")))


def foreach(comp, clause: s.Foreach) -> None:
    """The body runs on the rows unwound by the list; the rows themselves stay."""
    before, scope = comp.df, dict(comp.scope)
    comp.unwind(s.Unwind(clause.of, clause.var))
    for inner in clause.body:
        apply(comp, inner)
    comp.df, comp.scope = before, scope


def record_access(catalog, ids: DataFrame) -> None:
    """Apply the ON ACCESS parts of the promotion policies to the nodes and relationships of ``ids (_id)``: what reading them would have set.

    Reads change nothing by themselves; accesses are collected (a log, a query's result) and recorded together, so that each table is
    written once. An id that stands several times is one access.
    """
    from graphweft.plans.compiler import Bound, Compiler

    target = catalog.version()
    ids = settle(ids.select(F.col("_id").cast("string").alias("·a")).filter(F.col("`·a`").isNotNull()).distinct())
    for record in catalog.policies.values():
        if not isinstance(record, dict) or "POLICY" not in record.get("kind", "") or not record.get("on_access") or not record.get("options", {}).get("enabled", True):
            continue
        comp = Compiler(target, {})
        var = record.get("var") or "n"
        if record["on"] == "node":
            tables = target.with_labels(tuple(record["labels"]))
            if not tables:
                continue
            comp.needs.add(var)
            comp.df = comp.node_frame(var, tables, True).join(ids, c(var, "_id") == F.col("`·a`"), "left_semi")
            comp.scope = {var: Bound("node", tuple(tables), tuple(dict.fromkeys(p for t in tables for p in t.properties)), True)}
        else:
            comp.df = None
            comp.clauses([s.Match((s.PathP((s.NodeP("·s", (), None), s.NodeP("·e", (), None)), (s.RelP(var, tuple(record["labels"]), "out"),)),), None, False)])
            comp.df = comp.df.join(ids, c(var, "_id") == F.col("`·a`"), "left_semi")
        _set(comp, [replace(i, var=var) for i in record["on_access"]], F.lit(True))
    catalog.adopt(target)

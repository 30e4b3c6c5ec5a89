"""From syntax tree to DataFrame: a fold over the clauses.

A bound node ``n`` is a group of flat columns ``n·_id, n·_labels, n·<property>``, a relationship has ``_id, _type, _src, _dst`` and its
properties. So every plan stays a tree of scans, filters, joins and aggregates over plain columns: filters reach the scans and unused
properties are never read. Values are made into structs only where a variable itself is returned.

Semantics worth knowing: patterns bind homomorphically (``unique_rels=True`` forbids using a relationship twice); conditions are
two-valued (null is false, ``null = null`` is true); comparisons between different kinds of values are false.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.functions.scalars import REGISTRY, Call, is_number, truthy
from graphweft.plans import paths, rewrites
from graphweft.plans import syntax as s
from graphweft.plans.catalog import ORDER, SEP, GraphCatalog, NodeTable, RelTable
from graphweft.plans.parser import parse
from graphweft.session import cut


class CompileError(ValueError):
    pass


@dataclass(frozen=True)
class Bound:
    """What a variable stands for: ``node``, ``rel``, ``rels`` (variable length), ``path`` or ``value``."""

    kind: str
    tables: tuple = ()
    props: tuple[str, ...] = ()
    native: bool = True
    complete: bool = True  # the properties are there, not the id alone


def c(var: str, name: str) -> Column:
    return F.col(f"`{var}{SEP}{name}`")


def columns_of(df: DataFrame, var: str) -> list[str]:
    return [x for x in df.columns if x.startswith(var + SEP)]


class Compiler:
    def __init__(self, catalog: GraphCatalog, params: dict, unique_rels: bool = False, visible=None):
        self.catalog, self.params, self.unique_rels = catalog, params, unique_rels
        self.spark = catalog.spark
        self.visible = visible
        self.df: DataFrame | None = None
        self.scope: dict[str, Bound] = {}
        self.needs: set[str] = set()
        self.counter = 0
        self.writes = False

    def temp(self) -> str:
        self.counter += 1
        return f"{SEP}t{self.counter}"

    # -- expressions -------------------------------------------------------------------------------------------
    def rows(self) -> DataFrame:
        return self.df if self.df is not None else self.spark.range(1).select()

    def type_of(self, e, env: dict) -> T.DataType:
        shadow = {k: (F.lit(None).cast(t) if not isinstance(t, T.NullType) else F.lit(None), t) for k, (_, t) in env.items()}
        x = self.col(e, shadow)  # may add columns to the rows
        return self.rows().select(x.alias("x")).schema[0].dataType

    def literal(self, v) -> Column:
        if isinstance(v, (list, tuple)):
            return F.array(*[self.literal(x) for x in v])
        if isinstance(v, dict):
            return F.struct(*[self.literal(x).alias(k) for k, x in v.items()]) if v else F.create_map().cast("map<string,string>")
        if isinstance(v, int) and not isinstance(v, bool):
            return F.lit(v).cast("long")
        return F.lit(v)

    def bool(self, e, env: dict | None = None) -> Column:
        """``e`` in boolean position, never null."""
        env = env or {}
        if isinstance(e, s.Bin) and e.op in ("AND", "OR", "XOR"):
            a, b = self.bool(e.left, env), self.bool(e.right, env)
            return a & b if e.op == "AND" else a | b if e.op == "OR" else a != b
        if isinstance(e, s.Un) and e.op == "NOT":
            return ~self.bool(e.of, env)
        return truthy(self.col(e, env), self.type_of(e, env))

    def condition(self, e) -> Column:
        """``e`` as a filter, where null already means false: comparisons stay bare, so that they reach the scan."""
        if isinstance(e, s.Bin) and e.op == "AND":
            return self.condition(e.left) & self.condition(e.right)
        if isinstance(e, s.Bin) and e.op in ("=", "<", "<=", ">", ">=", "CONTAINS", "STARTS", "ENDS"):
            lit = any(isinstance(x, (s.Lit, s.Param)) and (not isinstance(x, s.Lit) or x.value is not None) for x in (e.left, e.right))
            if e.op != "=" or lit:
                return self.compare(e.op, e.left, e.right, {}, bare=True)
        return self.bool(e)

    def compare(self, op: str, left, right, env: dict, bare: bool = False) -> Column:
        graph = [isinstance(x, s.Var) and x.name not in env and self.scope.get(x.name, Bound("value")).kind in ("node", "rel") for x in (left, right)]
        if op in ("=", "<>") and any(graph):
            a = self.id_of(left.name) if graph[0] else self.col(left, env)
            b = self.id_of(right.name) if graph[1] else self.col(right, env)
            return a.eqNullSafe(b) if op == "=" else ~a.eqNullSafe(b)
        a, b = self.col(left, env), self.col(right, env)
        ta, tb = self.type_of(left, env), self.type_of(right, env)
        if op in ("CONTAINS", "STARTS", "ENDS", "=~"):
            f = {"CONTAINS": F.contains, "STARTS": F.startswith, "ENDS": F.endswith, "=~": F.rlike}[op]
            out = f(a.cast("string"), b.cast("string"))
            return out if bare else F.coalesce(out, F.lit(False))
        null = isinstance(ta, T.NullType) or isinstance(tb, T.NullType)
        same = null or is_number(ta) and is_number(tb) or type(ta) is type(tb) or {type(ta), type(tb)} <= {T.DateType, T.TimestampType, T.TimestampNTZType}
        if not same and {type(ta), type(tb)} & {T.DateType, T.TimestampType, T.TimestampNTZType} and T.StringType in (type(ta), type(tb)):
            same = True
            a, b = (a.try_cast("timestamp_ntz"), b.try_cast("timestamp_ntz"))
        if op in ("=", "<>"):
            out = a.eqNullSafe(b) if same and not bare else a == b if same else F.lit(False)
            return out if op == "=" else ~out
        if not same or null or not (is_number(ta) or isinstance(ta, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))):
            return F.lit(False)
        out = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        return out if bare else F.coalesce(out, F.lit(False))

    def id_of(self, var: str) -> Column:
        return c(var, "_id")

    def value_of(self, var: str) -> Column:
        """A node, relationship or path variable as a struct."""
        b = self.scope[var]
        if b.kind == "node":
            return F.when(c(var, "_id").isNotNull(), F.struct(c(var, "_id").alias("_id"), c(var, "_labels").alias("_labels"), *[c(var, p).alias(p) for p in b.props]))
        if b.kind == "rel":
            return F.when(c(var, "_id").isNotNull(), F.struct(*[c(var, m).alias(m) for m in ("_id", "_type")], c(var, "_src").alias("_start"), c(var, "_dst").alias("_end"), *[c(var, p).alias(p) for p in b.props]))
        return F.col(f"`{var}`")

    def col(self, e, env: dict | None = None) -> Column:
        env = env if env is not None else {}
        if isinstance(e, s.Lit):
            return self.literal(e.value)
        if isinstance(e, s.Param):
            if e.name not in self.params:
                raise CompileError(f"parameter ${e.name} is missing")
            return self.literal(self.params[e.name])
        if isinstance(e, s.Var):
            if e.name in env:
                return env[e.name][0]
            if e.name not in self.scope:
                raise CompileError(f"variable {e.name} is not defined")
            return self.value_of(e.name)
        if isinstance(e, s.Prop):
            return self.prop(e, env)
        if isinstance(e, s.Index):
            return self.index(e, env)
        if isinstance(e, s.Bin):
            return self.binary(e, env)
        if isinstance(e, s.Un):
            if e.op == "NOT":
                return ~self.bool(e.of, env)
            if e.op in ("ISNULL", "NOTNULL"):
                x = self.id_of(e.of.name) if isinstance(e.of, s.Var) and e.of.name not in env and self.scope.get(e.of.name, Bound("value")).kind in ("node", "rel") else self.col(e.of, env)
                return x.isNull() if e.op == "ISNULL" else x.isNotNull()
            return -self.col(e.of, env)
        if isinstance(e, s.Between):
            return self.compare(">=", e.of, e.low, env) & self.compare("<=", e.of, e.high, env)
        if isinstance(e, s.Case):
            out = None
            for when, then in e.whens:
                cond = self.compare("=", e.subject, when, env) if e.subject is not None else self.bool(when, env)
                out = F.when(cond, self.col(then, env)) if out is None else out.when(cond, self.col(then, env))
            return out.otherwise(self.col(e.default, env))
        if isinstance(e, s.ListOf):
            if not e.items:
                return F.array().cast("array<string>")
            kinds = {"n" if is_number(t) else type(t).__name__ for t in (self.type_of(x, env) for x in e.items) if not isinstance(t, T.NullType)}
            cols = [self.col(x, env) for x in e.items]
            return F.array(*cols) if len(kinds) <= 1 else F.array(*[x.cast("string") for x in cols])
        if isinstance(e, s.MapOf):
            return F.struct(*[self.col(v, env).alias(k) for k, v in e.items]) if e.items else F.create_map().cast("map<string,string>")
        if isinstance(e, s.Comprehension):
            items, inner = self.inner(e.of, e.var, env)
            if e.where is not None:
                items = F.filter(items, lambda x: self.bool(e.where, inner(x)))
            return items if e.out == s.Var(e.var) else F.transform(items, lambda x: self.col(e.out, inner(x)))
        if isinstance(e, s.Quantified):
            items, inner = self.inner(e.of, e.var, env)

            def test(x):
                return self.bool(e.where, inner(x))

            if e.kind == "all":
                return F.coalesce(F.forall(items, test), F.lit(False))
            if e.kind in ("any", "none"):
                found = F.coalesce(F.exists(items, test), F.lit(False))
                return found if e.kind == "any" else ~found
            return F.coalesce(F.size(F.filter(items, test)) == 1, F.lit(False))
        if isinstance(e, s.Reduce):
            items, inner = self.inner(e.of, e.var, env)
            elem = self.type_of(e.of, env).elementType
            start = self.type_of(e.start, env)
            once = self.type_of(e.out, env | {e.acc: (F.lit(None), start), e.var: (F.lit(None), elem)})
            acc = T.DoubleType() if is_number(start) and once != start else once if isinstance(start, T.NullType) else start
            return F.aggregate(items, self.col(e.start, env).cast(acc), lambda a, x: self.col(e.out, inner(x) | {e.acc: (a, acc)}).cast(acc))
        if isinstance(e, s.HasLabel):
            return F.coalesce(self.has_labels(e.of.name, e.labels), F.lit(False))
        if isinstance(e, s.Fn):
            return self.function(e, env)
        if isinstance(e, s.Exists):
            return F.coalesce(F.col(f"`{self.flag(e)}`"), F.lit(False))
        if isinstance(e, s.PatternList):
            return F.col(f"`{self.pattern_list(e)}`")
        raise CompileError(f"cannot compile {e}")

    def inner(self, of, var: str, env: dict):
        t = self.type_of(of, env)
        if not isinstance(t, T.ArrayType):
            raise CompileError(f"{of} is no list")
        return self.col(of, env), lambda x: env | {var: (x, t.elementType)}

    def has_labels(self, var: str, labels: tuple) -> Column:
        b = self.scope[var]
        if b.kind == "rel":
            return c(var, "_type").isin(*labels)
        out = F.lit(True)
        for x in labels:
            out = out & F.array_contains(c(var, "_labels"), x)
        return out

    def prop(self, e: s.Prop, env: dict) -> Column:
        if isinstance(e.of, s.Var) and e.of.name not in env:
            b = self.scope.get(e.of.name)
            if b is None:
                raise CompileError(f"variable {e.of.name} is not defined")
            if b.kind in ("node", "rel"):
                if e.name in b.props or e.name in ("_id", "_labels", "_type"):
                    return c(e.of.name, e.name)
                return F.lit(None)
        return self.field(self.col(e.of, env), self.type_of(e.of, env), e.name)

    def field(self, x: Column, t: T.DataType, name: str) -> Column:
        if isinstance(t, T.StructType):
            return x[name] if name in t.fieldNames() else F.lit(None)
        if isinstance(t, T.MapType):
            return F.try_element_at(x, F.lit(name))
        if isinstance(t, T.StringType):
            return F.get_json_object(x, f"$.{name}")
        return F.lit(None)

    def index(self, e: s.Index, env: dict) -> Column:
        t = self.type_of(e.of, env)
        if isinstance(e.at, (s.Lit, s.Param)):
            key = e.at.value if isinstance(e.at, s.Lit) else self.params.get(e.at.name)
            if isinstance(key, str):
                return self.prop(s.Prop(e.of, key), env)
        x, at = self.col(e.of, env), self.col(e.at, env)
        if isinstance(t, T.MapType):
            return F.try_element_at(x, at)
        at = at.cast("int")
        return F.when(at >= 0, F.get(x, at))

    def binary(self, e: s.Bin, env: dict) -> Column:
        op = e.op
        if op in ("AND", "OR", "XOR"):
            return self.bool(e, env)
        if op in ("=", "<>", "<", "<=", ">", ">=", "CONTAINS", "STARTS", "ENDS", "=~"):
            return self.compare(op, e.left, e.right, env)
        if op == "IN":
            if isinstance(e.right, s.ListOf) and not e.right.items:
                return F.lit(False)
            x = self.id_of(e.left.name) if isinstance(e.left, s.Var) and e.left.name not in env and self.scope.get(e.left.name, Bound("value")).kind in ("node", "rel") else self.col(e.left, env)
            items = e.right.items if isinstance(e.right, s.ListOf) else [s.Lit(v) for v in self.params.get(e.right.name, ())] if isinstance(e.right, s.Param) else None
            if items is not None and all(isinstance(i, s.Lit) and i.value is not None for i in items):
                return F.coalesce(x.isin(*[i.value for i in items]), F.lit(False)) if items else F.lit(False)
            return F.coalesce(F.exists(self.col(e.right, env), lambda v: v.eqNullSafe(x)), F.lit(False))
        a, b = self.col(e.left, env), self.col(e.right, env)
        ta, tb = self.type_of(e.left, env), self.type_of(e.right, env)
        if op == "+":
            if isinstance(ta, T.ArrayType):
                return F.concat(a, b) if isinstance(tb, T.ArrayType) else F.array_append(a, b)
            if isinstance(tb, T.ArrayType):
                return F.concat(F.array(a), b)
            if is_number(ta) and is_number(tb):
                return a + b
            return F.concat(F.coalesce(a.cast("string"), F.lit("null")), F.coalesce(b.cast("string"), F.lit("null")))
        a, b = (x if is_number(t) else x.try_cast("double") for x, t in ((a, ta), (b, tb)))
        if op == "-":
            return a - b
        if op == "*":
            return a * b
        if op == "/":
            return F.try_divide(a.cast("double"), b.cast("double"))
        if op == "%":
            return F.try_mod(a, b)
        if op == "^":
            return F.pow(a.cast("double"), b.cast("double"))
        raise CompileError(f"unknown operator {op}")

    GRAPH_FUNCTIONS = frozenset("type labels id elementid nodes relationships length keys properties startnode endnode".split())

    def function(self, e: s.Fn, env: dict) -> Column:
        name = e.name.lower()
        if name in s.AGGREGATES:
            return self.aggregate(e, env)
        if name in self.GRAPH_FUNCTIONS:
            v = e.args[0]
            b = self.scope.get(v.name) if isinstance(v, s.Var) and v.name not in env else None
            if b is not None and b.kind in ("node", "rel"):
                if name in ("id", "elementid"):
                    return self.id_of(v.name)
                if name == "labels":
                    return c(v.name, "_labels")
                if name == "type":
                    return c(v.name, "_type")
                if name == "keys":
                    shown = sorted(p for p in b.props if not p.startswith("_"))
                    return F.filter(F.array(*[F.when(c(v.name, p).isNotNull(), F.lit(p)) for p in shown]), lambda x: x.isNotNull()) if shown else F.array().cast("array<string>")
                if name == "properties":
                    return F.struct(*[c(v.name, p).alias(p) for p in b.props if not p.startswith("_")])
                if name in ("startnode", "endnode"):
                    return c(v.name, "_src" if name == "startnode" else "_dst")
            x, t = self.col(v, env), self.type_of(v, env)
            names = {"id": "_id", "elementid": "_id", "labels": "_labels", "type": "_type", "nodes": "nodes", "relationships": "relationships", "length": "length"}
            if name in names:
                if name == "length" and not isinstance(t, T.StructType):
                    return F.size(x).cast("long") if isinstance(t, T.ArrayType) else F.length(x).cast("long")
                return self.field(x, t, names[name]) if not (name == "length" and isinstance(t, T.StructType)) else x["length"]
            if name == "keys":
                if isinstance(t, T.MapType):
                    return F.map_keys(x)
                shown = [n for n in t.fieldNames() if not n.startswith("_")]
                return F.array(*map(F.lit, shown))
            if isinstance(t, T.StructType):
                return F.struct(*[x[n].alias(n) for n in t.fieldNames() if not n.startswith("_")])
            return x
        f = self.catalog.functions.get(name) or REGISTRY.get(name)
        if f is None:
            raise CompileError(f"unknown function {e.name}")
        return f(Call([self.col(a, env) for a in e.args], [self.type_of(a, env) for a in e.args], [a.value if isinstance(a, s.Lit) else None for a in e.args]))

    def aggregate(self, e: s.Fn, env: dict) -> Column:
        name, arg = e.name.lower(), e.args[0]
        if name == "count":
            if arg == s.Lit("*"):
                return F.count(F.lit(1))
            b = self.scope.get(arg.name) if isinstance(arg, s.Var) and arg.name not in env else None
            x = self.id_of(arg.name) if b is not None and b.kind in ("node", "rel") else self.col(arg, env)
            return F.count_distinct(x) if e.distinct else F.count(x)
        x = self.col(arg, env)
        if name == "·total":
            return F.coalesce(F.sum(x), F.lit(0)).cast("long")
        if name == "·mean":
            return F.try_divide(F.sum(x), F.sum(self.col(e.args[1], env)))
        if name == "collect":
            return F.array_distinct(F.collect_list(x)) if e.distinct else F.collect_list(x)
        t = self.type_of(arg, env)
        number = x.cast("double") if is_number(t) else x.try_cast("double")
        if name in ("min", "max"):
            y = number if is_number(t) or isinstance(t, T.NullType) else x
            return F.min(y) if name == "min" else F.max(y)
        if name == "sum":
            return F.coalesce(F.sum_distinct(number) if e.distinct else F.sum(number), F.lit(0.0))
        if e.distinct and name == "avg":
            return F.try_divide(F.sum_distinct(number), F.count_distinct(number))
        if name == "avg":
            return F.avg(number)
        spread = F.stddev_samp(number) if name == "stdev" else F.stddev_pop(number)
        return F.when(F.count(number) == 1, F.lit(0.0)).otherwise(spread)

    # -- patterns ----------------------------------------------------------------------------------------------
    def node_tables(self, p: s.NodeP) -> list[NodeTable]:
        if p.var in self.scope and self.scope[p.var].kind == "node":
            return list(self.scope[p.var].tables)
        if p.var in self.tables_of:
            return self.tables_of[p.var]
        return self.catalog.with_labels(p.labels)

    def native(self, var: str, tables: list[NodeTable]) -> bool:
        """Whether the variable's ids are the keys of its one table; else they name their labels too."""
        if var in self.scope and self.scope[var].kind == "node":
            return self.scope[var].native
        return self.forms.get(var, len(tables) == 1 or self.catalog.unique_ids)

    def candidates(self, patterns: tuple) -> dict[str, list[NodeTable]]:
        """The tables each node variable can come from, narrowed by the ends of the relationships around it."""
        cand: dict[str, list[NodeTable]] = {}
        for p in patterns:
            for n in p.nodes:
                own = self.node_tables(n)
                cand[n.var] = [t for t in cand.get(n.var, own) if t in own and set(n.labels) <= set(t.labels)]
        for _ in range(3):
            for p in patterns:
                for a, r, b in zip(p.nodes, p.rels, p.nodes[1:]):
                    if r.many or p.shortest:
                        continue
                    steps = list(self.steps(r, cand[a.var], cand[b.var]))
                    for var, side in ((a.var, 1), (b.var, 2)):
                        ends = [x[side] for x in steps]
                        if None not in ends:
                            cand[var] = [t for t in cand[var] if t.labels in ends]
        return cand

    def steps(self, r: s.RelP, left: list[NodeTable], right: list[NodeTable]):
        """``(table, left labels, right labels, reversed)`` of every relationship table that can make the hop."""
        ll, rl = {t.labels for t in left}, {t.labels for t in right}
        for t in self.catalog.with_types(r.types):
            for back in (False, True):
                if back and r.direction == "out" or not back and r.direction == "in":
                    continue
                a, b = (t.dst_labels, t.src_labels) if back else (t.src_labels, t.dst_labels)
                if (a is None or a in ll) and (b is None or b in rl):
                    yield t, a, b, back

    def implied(self, r: s.RelP, left: list[NodeTable], right: list[NodeTable], end: bool) -> bool:
        """Whether the hop's tables alone say that its end (or start) has the labels asked for."""
        tables = right if end else left
        return len(tables) == len(self.catalog.nodes) or all(x[2 if end else 1] is not None for x in self.steps(r, left, right))

    def key(self, col: Column, labels: tuple | None, native: bool) -> Column:
        if native or self.catalog.unique_ids:
            return col
        return F.concat(F.lit(":".join(labels or ()) + "/"), col.cast("string"))

    def node_frame(self, var: str, tables: list[NodeTable], native: bool) -> DataFrame:
        frames = []
        for t in tables:
            df = t.df if self.visible is None else self.visible(t)
            own = [self.key(F.col(f"`{t.id}`"), t.labels, native).alias(f"{var}{SEP}_id"), F.array(*map(F.lit, t.labels)).cast("array<string>").alias(f"{var}{SEP}_labels")]
            frames.append(df.select(*own, *[F.col(f"`{p}`").alias(f"{var}{SEP}{p}") for p in t.properties]))
        if not frames:
            return self.spark.createDataFrame([], f"`{var}{SEP}_id` string, `{var}{SEP}_labels` array<string>")
        out = frames[0]
        for f in frames[1:]:
            out = self.union(out, f)
        return out

    @staticmethod
    def union(a: DataFrame, b: DataFrame) -> DataFrame:
        """Union by name; a property with different types becomes text."""
        ta, tb = dict(a.dtypes), dict(b.dtypes)
        for x in ta.keys() & tb.keys():
            if ta[x] != tb[x] and "void" not in (ta[x], tb[x]):
                number = {"int", "bigint", "double", "float"}
                to = "double" if {ta[x], tb[x]} <= number else "string"
                a, b = a.withColumn(x, F.col(f"`{x}`").cast(to)), b.withColumn(x, F.col(f"`{x}`").cast(to))
        return a.unionByName(b, allowMissingColumns=True)

    def rel_frame(self, r: s.RelP, a: str, b: str, left: list[NodeTable], right: list[NodeTable], native: tuple[bool, bool]) -> tuple[DataFrame, tuple[str, ...], bool]:
        """The hop as a frame ``r·.. , ·from, ·to``, its properties, and whether its ends are known to exist."""
        out, props, trusted = None, [], True
        for t, la, lb, back in self.steps(r, left, right):
            src, dst = (t.dst, t.src) if back else (t.src, t.dst)
            f = t.df if self.visible is None else self.visible(t)
            if back and r.direction == "both":
                f = f.filter(~F.col(f"`{t.src}`").eqNullSafe(F.col(f"`{t.dst}`"))) if t.src_labels == t.dst_labels else f
            f = f.select(
                self.key(F.col(f"`{src}`"), la, native[0]).alias(f"{r.var}{SEP}~from"),
                self.key(F.col(f"`{dst}`"), lb, native[1]).alias(f"{r.var}{SEP}~to"),
                t.key().alias(f"{r.var}{SEP}_id"),
                F.lit(t.type).alias(f"{r.var}{SEP}_type"),
                F.col(f"`{t.src}`").cast("string").alias(f"{r.var}{SEP}_src"),
                F.col(f"`{t.dst}`").cast("string").alias(f"{r.var}{SEP}_dst"),
                *[F.col(f"`{p}`").alias(f"{r.var}{SEP}{p}") for p in t.properties],
            )
            props += [p for p in t.properties if p not in props]
            trusted &= t.trusted
            out = f if out is None else self.union(out, f)
        if out is None:
            ends = [x.df.schema[x.id].dataType.simpleString() if n and len(ts) == 1 else "string" for x, n, ts in ((left[0] if left else None, native[0], left), (right[0] if right else None, native[1], right)) if x is not None]
            ends = (ends + ["string", "string"])[:2] if len(ends) < 2 else ends
            fields = [f"`{r.var}{SEP}~from` {ends[0]}", f"`{r.var}{SEP}~to` {ends[1]}", *[f"`{r.var}{SEP}{m}` string" for m in ("_id", "_type", "_src", "_dst")]]
            out = self.spark.createDataFrame([], ", ".join(fields))
        return out, tuple(props), trusted

    def filter_props(self, var: str, props: s.MapOf | None) -> None:
        if props is not None:
            for k, v in props.items:
                self.df = self.df.filter(self.condition(s.Bin("=", s.Prop(s.Var(var), k), v)))

    def bind_node(self, n: s.NodeP, tables: list[NodeTable], complete: bool) -> Bound:
        props = tuple(dict.fromkeys(p for t in tables for p in t.properties))
        b = Bound("node", tuple(tables), props if complete else (), self.native(n.var, tables), complete)
        self.scope[n.var] = b
        return b

    def scan(self, n: s.NodeP, tables: list[NodeTable]) -> None:
        f = self.node_frame(n.var, tables, self.native(n.var, tables))
        self.df = f if self.df is None or not self.df.columns else self.df.crossJoin(f)
        self.bind_node(n, tables, True)
        self.filter_props(n.var, n.props)

    def named(self, paths_: tuple) -> tuple:
        """The same patterns with a name for everything."""

        def fresh():
            self.counter += 1
            return f"_a{self.counter}"

        out = []
        for p in paths_:
            nodes = tuple(n if n.var else replace(n, var=fresh()) for n in p.nodes)
            rels = tuple(r if r.var else replace(r, var=fresh()) for r in p.rels)
            out.append(replace(p, nodes=nodes, rels=rels))
        return tuple(out)

    def anonymous(self, n: s.NodeP) -> bool:
        return n.var not in self.needs and n.props is None

    def match(self, patterns: tuple, where) -> None:
        """Inner match of the patterns onto the current rows, then the condition."""
        patterns = self.named(patterns)
        cand = self.candidates(patterns)
        wheres = self.conjuncts(where)
        rels_here: list[str] = []
        for p in sorted(patterns, key=lambda x: bool(x.shortest)):
            k = next((i for i, n in enumerate(p.nodes) if n.var in self.scope), 0)
            if p.nodes[k].var not in self.scope:
                # The end that says most about itself is read first.
                if len(p.rels) and p.nodes[-1].props is not None and p.nodes[0].props is None:
                    k = len(p.nodes) - 1
                first = p.nodes[k]
                if p.rels and not p.shortest and self.df is None and self.anonymous(first) and not (p.rels[k].many if k < len(p.rels) else p.rels[k - 1].many) and len(p.nodes) > 1:
                    self.start_with_rel(p, k, cand)
                else:
                    self.scan(first, cand[first.var])
            else:
                self.complete(p.nodes[k])
                self.filter_props(p.nodes[k].var, p.nodes[k].props)
                if p.nodes[k].labels:
                    self.df = self.df.filter(self.has_labels(p.nodes[k].var, p.nodes[k].labels))
            wheres = self.apply(wheres)
            if p.shortest:
                wheres = self.shortest(p, cand, wheres)
                continue
            for i in range(k, len(p.rels)):
                wheres = self.apply(self.hop(p.nodes[i], p.rels[i], p.nodes[i + 1], cand, wheres))
            for i in range(k - 1, -1, -1):
                r = p.rels[i]
                flipped = replace(r, direction={"out": "in", "in": "out", "both": "both"}[r.direction])
                wheres = self.apply(self.hop(p.nodes[i + 1], flipped, p.nodes[i], cand, wheres))
            rels_here += [r.var for r in p.rels if not r.many]
            if p.var:
                self.bind_path(p)
        if self.unique_rels:
            for i, a in enumerate(rels_here):
                for b in rels_here[:i]:
                    self.df = self.df.filter(c(a, "_id") != c(b, "_id"))
        for w in wheres:
            self.where(w)

    def start_with_rel(self, p: s.PathP, k: int, cand: dict) -> None:
        """A pattern that begins with a node of which only the id matters begins with the relationship table."""
        i = k if k < len(p.rels) else k - 1
        r = p.rels[i]
        r = r if k == i else replace(r, direction={"out": "in", "in": "out", "both": "both"}[r.direction])
        a, b = p.nodes[k], p.nodes[i + 1 if k == i else i]
        natives = [self.native(x.var, cand[x.var]) for x in (a, b)]
        _, _, trusted = self.rel_frame(r, a.var, b.var, cand[a.var], cand[b.var], tuple(natives))
        if not trusted or self.visible is not None or not self.implied(r, cand[a.var], cand[b.var], False):
            self.scan(a, cand[a.var])
            return
        self.bind_node(a, cand[a.var], False)
        self.df = None
        self.pending = a.var

    pending: str | None = None

    def conjuncts(self, e) -> list:
        if e is None:
            return []
        return self.conjuncts(e.left) + self.conjuncts(e.right) if isinstance(e, s.Bin) and e.op == "AND" else [e]

    def ready(self, e) -> bool:
        names = {x.name for x in s.walk(e) if isinstance(x, s.Var)} | {n.var for x in s.walk(e) if isinstance(x, s.NodeP) for n in [x] if n.var}
        local = {x.var for x in s.walk(e) if isinstance(x, (s.Comprehension, s.Quantified, s.Reduce))} | {x.acc for x in s.walk(e) if isinstance(x, s.Reduce)}
        return self.df is not None and not any(isinstance(x, (s.Exists, s.PatternList)) for x in s.walk(e)) and names - local <= set(self.scope)

    def apply(self, wheres: list) -> list:
        """Apply the conditions whose variables are bound; later hops then start from fewer rows."""
        rest = []
        for w in wheres:
            if self.ready(w):
                self.df = self.df.filter(self.condition(w))
            else:
                rest.append(w)
        return rest

    def complete(self, n: s.NodeP) -> None:
        """Join the properties of a node of which only the id was bound so far."""
        b = self.scope[n.var]
        if b.kind == "node" and not b.complete and not self.anonymous(n):
            f = self.node_frame(n.var, list(b.tables), b.native)
            self.df = self.df.drop(*[x for x in columns_of(self.df, n.var) if not x.endswith(f"{SEP}_id")]).join(f, f"{n.var}{SEP}_id")
            self.bind_node(n, list(b.tables), True)

    def hop(self, a: s.NodeP, r: s.RelP, b: s.NodeP, cand: dict, wheres: list) -> list:
        if r.many:
            self.many(a, r, b, cand)
            return wheres
        known = b.var in self.scope
        natives = tuple(self.native(x.var, cand[x.var]) for x in (a, b))
        f, props, trusted = self.rel_frame(r, a.var, b.var, cand[a.var], cand[b.var], natives)
        start, end = f"{r.var}{SEP}~from", f"{r.var}{SEP}~to"
        again = r.var in self.scope
        if again:
            f = f.withColumnsRenamed({x: x.replace(r.var + SEP, r.var + SEP + "again", 1) for x in columns_of(f, r.var) if x not in (start, end)}).select(start, end, f"`{r.var}{SEP}again_id`")
        if self.pending == a.var and self.df is None:
            self.df = f.withColumn(f"{a.var}{SEP}_id", F.col(f"`{start}`")).withColumn(f"{a.var}{SEP}_labels", F.array(*map(F.lit, cand[a.var][0].labels)).cast("array<string>"))
            self.pending = None
        else:
            on = c(a.var, "_id") == F.col(f"`{start}`")
            if again:
                on = on & (c(r.var, "_id") == F.col(f"`{r.var}{SEP}again_id`"))
            if known:
                on = on & (c(b.var, "_id") == F.col(f"`{end}`"))
            self.df = self.df.join(f, on)
        if again:
            self.df = self.df.drop(f"{r.var}{SEP}again_id")
        else:
            self.scope[r.var] = Bound("rel", (), props)
            self.filter_props(r.var, r.props)
        if known:
            if not (self.pending is None and self.df is None):
                self.df = self.df.filter(c(b.var, "_id") == F.col(f"`{end}`"))
            self.filter_props(b.var, b.props)
            if b.labels:
                self.df = self.df.filter(self.has_labels(b.var, b.labels))
            self.df = self.df.drop(start, end)
            return wheres
        if trusted and self.anonymous(b) and self.visible is None and self.implied(r, cand[a.var], cand[b.var], True):
            labels = F.array(*map(F.lit, cand[b.var][0].labels)) if len(cand[b.var]) == 1 else F.array()
            self.df = self.df.withColumn(f"{b.var}{SEP}_id", F.col(f"`{end}`")).withColumn(f"{b.var}{SEP}_labels", labels.cast("array<string>"))
            self.bind_node(b, cand[b.var], False)
        else:
            nodes = self.node_frame(b.var, cand[b.var], natives[1])
            self.df = self.df.join(nodes, F.col(f"`{end}`") == c(b.var, "_id"))
            self.bind_node(b, cand[b.var], True)
            self.filter_props(b.var, b.props)
        self.df = self.df.drop(start, end)
        return wheres

    def hop_edges(self, r: s.RelP) -> DataFrame:
        """All hops of a variable-length step as ``src, dst, rel`` with global keys."""
        tables = self.catalog.nodes
        one = replace(r, var="·e", low=None, high=None)
        native = self.catalog.unique_ids or len(tables) == 1 or len({x for t in self.catalog.with_types(r.types) for x in (t.src_labels, t.dst_labels)}) == 1
        f, props, _ = self.rel_frame(one, "", "", tables, tables, (native, native))
        saved, scope = self.df, self.scope
        self.df, self.scope = f, {"·e": Bound("rel", (), props)}
        self.filter_props("·e", r.props)
        f = self.df
        self.df, self.scope = saved, scope
        return f.select(c("·e", "~from").alias("src"), c("·e", "~to").alias("dst"), F.struct(c("·e", "_id").alias("_id"), c("·e", "_type").alias("_type")).alias("rel")), native

    def end_key(self, n: s.NodeP, tables: list[NodeTable], native_edges: bool) -> Column:
        b = self.scope[n.var]
        if native_edges or not b.native or self.catalog.unique_ids:
            return c(n.var, "_id")
        return self.key(c(n.var, "_id"), tables[0].labels, False)

    def many(self, a: s.NodeP, r: s.RelP, b: s.NodeP, cand: dict) -> None:
        edges, native = self.hop_edges(r)
        self.df = self.df.withColumn("·start", self.end_key(a, cand[a.var], native))
        want = r.var in self.needs or any(p for p in self.path_vars if r.var in p)
        reach = paths.reachable(edges, self.df.select(F.col("`·start`").alias("start")).distinct(), r.low, r.high, with_paths=want)
        names = {"start": "·start", "node": "·end"} | ({"rels": r.var} if want else {})
        self.df = self.df.join(reach.withColumnsRenamed(names), "·start")
        if b.var in self.scope:
            self.df = self.df.filter(self.end_key(b, cand[b.var], native) == F.col("`·end`"))
            self.filter_props(b.var, b.props)
        else:
            nodes = self.node_frame(b.var, cand[b.var], native)
            self.df = self.df.join(nodes, F.col("`·end`") == c(b.var, "_id"))
            self.bind_node(b, cand[b.var], True)
            self.scope[b.var] = replace(self.scope[b.var], native=native)
            self.filter_props(b.var, b.props)
        self.df = self.df.drop("·start", "·end")
        if want:
            self.scope[r.var] = Bound("rels")

    def shortest(self, p: s.PathP, cand: dict, wheres: list) -> list:
        a, b, r = p.nodes[0], p.nodes[-1], p.rels[0]
        if b.var not in self.scope:
            self.scan(b, cand[b.var])
        elif a.var not in self.scope:
            self.scan(a, cand[a.var])
        wheres = self.apply(wheres)
        edges, native = self.hop_edges(r)
        self.df = self.df.withColumn("·start", self.end_key(a, cand[a.var], native)).withColumn("·end", self.end_key(b, cand[b.var], native))
        pairs = self.df.select(F.col("`·start`").alias("start"), F.col("`·end`").alias("end")).distinct()
        found = paths.shortest(edges, pairs, r.low if r.many else 1, r.high if r.many else 1, every=p.shortest == "all")
        name = p.var or self.temp()
        self.df = self.df.join(found.withColumnsRenamed({"start": "·start", "end": "·end", "path": name}), ["·start", "·end"]).drop("·start", "·end")
        self.scope[name] = Bound("path")
        self.scope[r.var] = Bound("rels")
        self.df = self.df.withColumn(r.var, F.col(f"`{name}`")["relationships"])
        return wheres

    def bind_path(self, p: s.PathP) -> None:
        nodes = [F.struct(c(n.var, "_id").cast("string").alias("_id"), c(n.var, "_labels").alias("_labels")) for n in p.nodes]
        parts, hops = [], F.lit(0).cast("long")
        for r in p.rels:
            if r.many:
                parts.append(F.col(f"`{r.var}`"))
                hops = hops + F.size(F.col(f"`{r.var}`"))
            else:
                parts.append(F.array(F.struct(c(r.var, "_id").alias("_id"), c(r.var, "_type").alias("_type"))))
                hops = hops + 1
        empty = F.array().cast("array<struct<_id:string,_type:string>>")
        rels = F.concat(*parts) if parts else empty
        self.df = self.df.withColumn(p.var, F.struct(F.array(*nodes).alias("nodes"), rels.alias("relationships"), hops.alias("length")))
        self.scope[p.var] = Bound("path")

    # -- patterns beside the rows: optional, exists, comprehensions --------------------------------------------------
    def beside(self, patterns: tuple, inner_where=None, extra: set[str] | None = None) -> tuple[Compiler, list[str]]:
        """The patterns matched on their own. Shared variables are matched as new ones; which they are is returned."""
        sub = Compiler(self.catalog, self.params, self.unique_rels, self.visible)
        sub.counter = self.counter + 1000
        sub.path_vars = self.path_vars
        sub.needs = set(self.needs) | (extra or set())
        patterns = self.named(patterns)
        shared = [v for v in dict.fromkeys(n.var for p in patterns for n in p.nodes) if v in self.scope]
        # A shared variable needs no more than its id on this side, and keeps the tables it is bound to.
        used = {x.name for w in [inner_where] for x in s.walk(w) if isinstance(x, s.Var)} if inner_where is not None else set()
        sub.needs -= {v for v in shared if v not in used and v not in (extra or ())}
        sub.tables_of = {v: list(self.scope[v].tables) for v in shared}
        sub.forms = {v: self.scope[v].native for v in shared}
        sub.match(patterns, inner_where)
        self.counter = sub.counter
        for v in shared:
            if sub.scope[v].native != self.scope[v].native:
                raise CompileError(f"{v} is bound to several labels on one side only; give it a label")
        return sub, shared

    tables_of: dict = {}
    forms: dict = {}
    made: dict = {}
    path_vars: list = []

    def optional(self, m: s.Match) -> None:
        if self.df is None:
            self.match(m.paths, m.where)
            return
        inner, outer = [], []
        pattern_vars = {n.var for p in m.paths for n in p.nodes} | {r.var for p in m.paths for r in p.rels} | {p.var for p in m.paths}
        bound = {n.var for p in m.paths for n in p.nodes if n.var in self.scope}
        for w in self.conjuncts(m.where):
            names = {x.name for x in s.walk(w) if isinstance(x, s.Var)}
            (inner if names <= pattern_vars - bound else outer).append(w)
        where = None
        for w in inner:
            where = w if where is None else s.Bin("AND", where, w)
        sub, shared = self.beside(m.paths, where)
        side = sub.df
        new = {v: b for v, b in sub.scope.items() if v not in shared}
        keep, on = [], None
        for v in shared:
            keep.append(F.col(f"`{v}{SEP}_id`").alias(f"·o{SEP}{v}"))
            cond = c(v, "_id") == F.col(f"`·o{SEP}{v}`")
            on = cond if on is None else on & cond
        drop = {x for v in shared for x in columns_of(side, v)}
        side = side.select(*[F.col(f"`{x}`") for x in side.columns if x not in drop], *keep)
        before = (self.df, dict(self.scope))
        self.scope |= new
        if outer:
            # Conditions over both sides belong to the join; they are resolved on a frame that has both.
            both = before[0].crossJoin(side)
            self.df = both
            for w in outer:
                extra = self.condition(w)
                on = extra if on is None else on & extra
        self.df = before[0].join(side, on if on is not None else F.lit(True), "left").drop(*[f"·o{SEP}{v}" for v in shared])

    def flag(self, e: s.Exists) -> str:
        """A boolean column that says whether the pattern is there; for conditions inside OR and the like."""
        if self.made.get(e) in self.df.columns:
            return self.made[e]
        inner = {x.name for x in s.walk(e.where) if isinstance(x, s.Var)} if e.where is not None else set()
        sub, shared = self.beside(e.paths, e.where, inner)
        name = self.temp()
        ids = sub.df.select(*[c(v, "_id").alias(f"·x{SEP}{v}") for v in shared]).distinct().withColumn(name, F.lit(True))
        on = None
        for v in shared:
            cond = c(v, "_id") == F.col(f"`·x{SEP}{v}`")
            on = cond if on is None else on & cond
        self.df = self.df.join(ids, on if on is not None else F.lit(True), "left").drop(*[f"·x{SEP}{v}" for v in shared])
        self.made = {**self.made, e: name}
        return name

    def pattern_list(self, e: s.PatternList) -> str:
        if self.made.get(e) in self.df.columns:
            return self.made[e]
        pattern_vars = {n.var for n in e.path.nodes} | {r.var for r in e.path.rels}
        extra = {x.name for part in (e.where, e.out) if part is not None for x in s.walk(part) if isinstance(x, s.Var)}
        if not extra <= pattern_vars:
            raise CompileError("a pattern comprehension can use the variables of its pattern only")
        sub, shared = self.beside((e.path,), e.where, extra)
        name = self.temp()
        keys = [f"·x{SEP}{v}" for v in shared]
        value = sub.id_of(e.out.name) if isinstance(e.out, s.Var) and sub.scope[e.out.name].kind == "node" else sub.col(e.out)
        lists = sub.df.select(*[c(v, "_id").alias(k) for v, k in zip(shared, keys)], value.alias(name)).groupBy(*keys).agg(F.collect_list(name).alias(name))
        on = None
        for v, k in zip(shared, keys):
            cond = c(v, "_id") == F.col(f"`{k}`")
            on = cond if on is None else on & cond
        kind = lists.schema[name].dataType.simpleString()
        self.df = self.df.join(lists, on if on is not None else F.lit(True), "left").drop(*keys).withColumn(name, F.coalesce(F.col(f"`{name}`"), F.array().cast(kind)))
        self.made = {**self.made, e: name}
        return name

    def where(self, e) -> None:
        """A condition: patterns at its top level become semi and anti joins, everything else a filter."""
        for w in self.conjuncts(e):
            negated = isinstance(w, s.Un) and w.op == "NOT" and isinstance(w.of, s.Exists)
            x = w.of if negated else w
            if isinstance(x, s.Exists):
                pattern_vars = {n.var for p in x.paths for n in p.nodes} | {r.var for p in x.paths for r in p.rels}
                inner, outer = [], []
                for v in self.conjuncts(x.where):
                    names = {y.name for y in s.walk(v) if isinstance(y, s.Var)}
                    (inner if names <= pattern_vars else outer).append(v)
                cond = None
                for v in inner:
                    cond = v if cond is None else s.Bin("AND", cond, v)
                extra = {y.name for v in inner + outer for y in s.walk(v) if isinstance(y, s.Var)}
                sub, shared = self.beside(x.paths, cond, extra)
                side = sub.df
                on = None
                if outer:
                    drop = {y for v in shared for y in columns_of(side, v)}
                    side = side.select(*[F.col(f"`{y}`") for y in side.columns if y not in drop], *[F.col(f"`{v}{SEP}_id`").alias(f"·x{SEP}{v}") for v in shared])
                    frame, scope = self.df, dict(self.scope)
                    self.df, self.scope = frame.crossJoin(side), self.scope | {k: b for k, b in sub.scope.items() if k not in shared}
                    for v in outer:
                        extra_on = self.condition(v)
                        on = extra_on if on is None else on & extra_on
                    self.df, self.scope = frame, scope
                else:
                    side = side.select(*[c(v, "_id").alias(f"·x{SEP}{v}") for v in shared])
                for v in shared:
                    same = c(v, "_id") == F.col(f"`·x{SEP}{v}`")
                    on = same if on is None else on & same
                self.df = self.df.join(side, on if on is not None else F.lit(True), "left_anti" if negated else "left_semi")
            else:
                cond = self.condition(w)
                self.df = self.df.filter(cond)

    # -- projection --------------------------------------------------------------------------------------------
    def project(self, p: s.Project) -> None:
        items = list(p.items)
        if p.star:
            shown = [v for v in self.scope if not v.startswith(("_a", SEP)) and not v.startswith("_anon")]
            items = [s.Item(s.Var(v), v, v) for v in shown] + items
        names = [i.alias or i.text for i in items]
        if self.df is None:
            self.df = self.spark.range(1).select()
        grouped = any(s.has_aggregate(i.expr) for i in items)
        before = dict(self.scope)
        entity = [isinstance(i.expr, s.Var) and i.expr.name in self.scope and self.scope[i.expr.name].kind in ("node", "rel") for i in items]
        new: dict[str, Bound] = {}
        for i, n, g in zip(items, names, entity):
            new[n] = self.scope[i.expr.name] if g else replace(self.scope[i.expr.name]) if isinstance(i.expr, s.Var) and i.expr.name in self.scope else Bound("value")
        hold = {n: f"{SEP}p{k}" for k, n in enumerate(names)}

        def entity_columns(src: str, dst: str) -> list[tuple[str, str]]:
            return [(x, dst + x[len(src) :]) for x in columns_of(self.df, src)]

        if grouped:
            self.group(items, names, entity, hold)
        else:
            values = [(hold[n], self.col(i.expr)) for i, n, g in zip(items, names, entity) if not g]
            for k, v in values:  # expressions may add columns by join, so the frame is read after all are built
                self.df = self.df.withColumn(k, v)
            renames = [(a, hold[n] + b[len(n) :]) for i, n, g in zip(items, names, entity) if g for a, b in entity_columns(i.expr.name, n)]
            for a, b in renames:
                self.df = self.df.withColumn(b, F.col(f"`{a}`"))
        mine = [x for x in self.df.columns if any(x == hold[n] or x.startswith(hold[n] + SEP) for n in names)]
        final = {}
        for n in names:
            for x in mine:
                if x == hold[n] or x.startswith(hold[n] + SEP):
                    final[x] = n + x[len(hold[n]) :]
        if p.distinct:
            ids = [x for x in mine if not any(x.startswith(hold[n] + SEP) for n, g in zip(names, entity) if g) or x.endswith(f"{SEP}_id")]
            self.df = self.df.select(*[F.col(f"`{x}`") for x in mine]).dropDuplicates(ids)
        if grouped or p.distinct:
            frame_scope = {}
        else:
            frame_scope = before
        # Within WHERE and ORDER BY new names hide old ones.
        held = {hold[n]: b for n, b in new.items()}
        alias_of = {n: hold[n] for n in names}

        def resolve(e):
            for i, n in zip(items, names):
                if e == i.expr:
                    return s.Var(hold[n])
            if isinstance(e, s.Var) and e.name in alias_of:
                return s.Var(alias_of[e.name])
            if hasattr(e, "__dataclass_fields__"):
                return replace(e, **{f: resolve(getattr(e, f)) for f in e.__dataclass_fields__ if f not in ("name", "op", "var", "acc", "kind", "distinct")} | ({"name": e.name} if "name" in e.__dataclass_fields__ else {}))
            if isinstance(e, tuple):
                return tuple(resolve(x) for x in e)
            return e

        self.scope = frame_scope | held
        if p.where is not None:
            self.where(resolve(p.where))
        if p.order:
            keys = [self.order_key(resolve(o.expr), o.descending) for o in p.order]
            self.df = self.df.orderBy(*keys)
        if p.skip is not None:
            self.df = self.df.offset(self.number(p.skip))
        if p.limit is not None:
            self.df = self.df.limit(self.number(p.limit))
        order = [] if grouped or p.distinct or p.last else [F.col(f"`{x}`") for x in self.df.columns if x.startswith(ORDER)]
        self.df = self.df.select(*[F.col(f"`{x}`").alias(final[x]) for x in mine], *order)
        self.scope = new
        if p.last:
            self.df = self.df.select(*[(self.value_of(n) if new[n].kind in ("node", "rel") else F.col(f"`{n}`")).alias(n) for n in names])
            self.scope = {n: Bound("value") for n in names}

    def order_key(self, e, descending: bool) -> Column:
        if isinstance(e, s.Var) and self.scope.get(e.name, Bound("value")).kind in ("node", "rel"):
            x = self.id_of(e.name)
        else:
            x = self.col(e)
        return x.desc_nulls_last() if descending else x.asc_nulls_last()

    def number(self, e) -> int:
        v = e.value if isinstance(e, s.Lit) else self.params[e.name]
        if not isinstance(v, int) or v < 0:
            raise CompileError("SKIP and LIMIT take an integer of at least 0")
        return v

    def group(self, items, names, entity, hold) -> None:
        """Implicit grouping: items without aggregates are the keys, a node or relationship by its id."""
        keys, carried, aggs, after = [], [], [], []
        key_alias: list[tuple] = []
        for i, n, g in zip(items, names, entity):
            if g:
                src = i.expr.name
                keys.append(c(src, "_id").alias(f"{hold[n]}{SEP}_id"))
                carried += [F.first(F.col(f"`{x}`")).alias(hold[n] + x[len(src) :]) for x in columns_of(self.df, src) if x != f"{src}{SEP}_id"]
            elif not s.has_aggregate(i.expr):
                keys.append(self.col(i.expr).alias(hold[n]))
                key_alias.append((i.expr, hold[n]))
        for i, n in zip(items, names):
            if s.has_aggregate(i.expr):
                after.append((n, self.lift(i.expr, aggs, key_alias)))
        grouped = self.df.groupBy(*keys) if keys else self.df
        cols = [a.alias(k) for k, a in aggs] + carried
        scope = {k: Bound("value") for k, _ in aggs} | {k: Bound("value") for _, k in key_alias}
        self.df = grouped.agg(*cols)
        self.scope = self.scope | scope
        for n, e in after:
            self.df = self.df.withColumn(hold[n], self.col(e))

    def lift(self, e, aggs: list, key_alias: list):
        """The expression over the grouped rows: aggregates and keys become columns of theirs."""
        for k, alias in key_alias:
            if e == k:
                return s.Var(alias)
        if isinstance(e, s.Fn) and e.name.lower() in s.AGGREGATES:
            name = self.temp()
            aggs.append((name, self.aggregate(e, {})))
            return s.Var(name)
        if isinstance(e, tuple):
            return tuple(self.lift(x, aggs, key_alias) for x in e)
        if hasattr(e, "__dataclass_fields__"):
            return replace(e, **{f: self.lift(getattr(e, f), aggs, key_alias) for f in e.__dataclass_fields__ if isinstance(getattr(e, f), tuple) or hasattr(getattr(e, f), "__dataclass_fields__")})
        return e

    # -- clauses -----------------------------------------------------------------------------------------------
    def clauses(self, todo: list) -> None:
        self.needs |= needed(todo)
        self.writes |= any(isinstance(x, (s.SetClause, s.Merge, s.Foreach)) for x in todo)
        self.path_vars = [{r.var for r in p.rels} | {p.var} for x in todo if isinstance(x, s.Match) for p in x.paths if p.var]
        todo = [self.name_path(x) for x in todo]
        for k, clause in enumerate(todo):
            if isinstance(clause, s.Match):
                if clause.optional:
                    self.optional(clause)
                else:
                    self.match(clause.paths, clause.where)
            elif isinstance(clause, s.Where):
                self.where(clause.expr)
            elif isinstance(clause, s.Project):
                self.project(clause)
            elif isinstance(clause, s.Unwind):
                self.unwind(clause)
            elif isinstance(clause, s.CallSub):
                self.subquery(clause.query)
            elif isinstance(clause, s.CallProc):
                self.procedure(clause, last=k == len(todo) - 1)
            else:
                from graphweft.plans import mutate

                mutate.apply(self, clause)

    def name_path(self, x):
        """Relationships of a named path get names, so that the path can be put together from them."""
        if isinstance(x, s.Match) and any(p.var for p in x.paths):
            out = []
            for p in x.paths:
                if p.var and not p.shortest:
                    p = self.named((p,))[0]
                    self.path_vars.append({r.var for r in p.rels} | {p.var})
                out.append(p)
            return replace(x, paths=tuple(out))
        return x

    def unwind(self, u: s.Unwind) -> None:
        if self.df is None:
            self.df = self.spark.range(1).select()
        t = self.type_of(u.expr, {})
        if not isinstance(t, T.ArrayType):
            self.df = self.df.limit(0).withColumn(u.alias, F.lit(None).cast("string"))
        else:
            items = self.col(u.expr)
            if self.writes:  # the order of the rows decides which of several writes to one entity stands
                at = f"{ORDER}{sum(x.startswith(ORDER) for x in self.df.columns)}"
                kept = [F.col(f"`{x}`") for x in self.df.columns if x != u.alias]
                self.df = self.df.select(*kept, F.posexplode(items).alias(at, u.alias))
            else:
                self.df = self.df.withColumn(u.alias, F.explode(items))
        self.scope[u.alias] = Bound("value")

    def subquery(self, q: s.Query) -> None:
        """``CALL { ... }``: compiled on the outer rows; a part that groups is grouped per outer row."""
        outer, scope = self.df, dict(self.scope)
        results = []
        if outer is not None and scope:
            row = self.temp()
            outer = cut(outer.withColumn(row, F.monotonically_increasing_id()))
        for part in q.parts:
            sub = Compiler(self.catalog, self.params, self.unique_rels, self.visible)
            sub.counter, sub.needs = self.counter + 100, self.needs | needed(part)
            uses = {x.name for cl in part for x in s.walk(_tree(cl)) if isinstance(x, s.Var)} | {n.var for cl in part for n in s.walk(_tree(cl)) if isinstance(n, s.NodeP)}
            correlated = outer is not None and bool(uses & set(scope))
            last = part[-1]
            if correlated:
                sub.df, sub.scope = outer, scope | {row: Bound("value")}
                carry = [s.Item(s.Var(row), row, row)]
                part = [replace(cl, items=cl.items + carry) if isinstance(cl, s.Project) and not cl.star else cl for cl in part]
            sub.clauses(part)
            self.counter = sub.counter
            names = [i.alias or i.text for i in last.items] if isinstance(last, s.Project) else []
            if isinstance(last, s.Project) and any(s.has_aggregate(i.expr) for i in last.items) and correlated:
                sub.df = outer.select(row).join(sub.df, row, "left")
            results.append((sub.df, correlated, names))
        out = results[0][0]
        for (f, _, _), every in zip(results[1:], q.all_flags):
            out = self.union(out, f) if every else self.union(out, f).distinct()
        names = [x for x in out.columns if not x.startswith(SEP)]
        if results[0][1]:
            self.df = outer.join(out, row).drop(row)
        else:
            self.df = out if self.df is None or not scope else outer.drop(row).crossJoin(out)
        self.scope = scope | {n: Bound("value") for n in names}

    def procedure(self, call: s.CallProc, last: bool) -> None:
        from graphweft.plans import procedures

        args = [self.constant(a) for a in call.args]
        out = procedures.call(self, call.name, args)
        if call.yields:
            out = out.select(*[F.col(f"`{a}`").alias(b) for a, b in call.yields])
        self.df = out if self.df is None else self.df.crossJoin(out)
        self.scope |= {n: Bound("value") for n in out.columns}

    def constant(self, e):
        """A literal, parameter, list or map of them as a Python value."""
        if isinstance(e, s.Lit):
            return e.value
        if isinstance(e, s.Param):
            return self.params[e.name]
        if isinstance(e, s.ListOf):
            return [self.constant(x) for x in e.items]
        if isinstance(e, s.MapOf):
            return {k: self.constant(v) for k, v in e.items}
        if isinstance(e, s.Un) and e.op == "-":
            return -self.constant(e.of)
        return self.spark.range(1).select(self.col(e).alias("x")).first()[0]


def _tree(clause):
    """A clause as something :func:`syntax.walk` can go through."""
    if isinstance(clause, s.Project):
        return tuple([i.expr for i in clause.items] + [o.expr for o in clause.order] + [x for x in (clause.where,) if x is not None])
    if isinstance(clause, s.Match):
        return (clause.paths, clause.where) if clause.where is not None else (clause.paths,)
    if isinstance(clause, (s.SetClause, s.Merge, s.Foreach)):
        flat = clause.items if isinstance(clause, s.SetClause) else clause.on_create + clause.on_match if isinstance(clause, s.Merge) else []
        own = tuple((s.Var(i.var), i.expr) if i.expr is not None else (s.Var(i.var),) for i in flat)
        return own + ((clause.path,) if isinstance(clause, s.Merge) else (clause.of, tuple(_tree(x) for x in clause.body)) if isinstance(clause, s.Foreach) else ())
    if isinstance(clause, s.CallSub):
        return tuple(_tree(x) for p in clause.query.parts for x in p)
    if isinstance(clause, s.Delete):
        return tuple(s.Var(n) for n in clause.names)
    if isinstance(clause, s.Remove):
        return tuple(s.Var(i[0]) for i in clause.items)
    if isinstance(clause, (s.Unwind, s.Where)):
        return (clause.expr,)
    if isinstance(clause, s.Create):
        return (clause.paths,)
    return ()


def needed(clauses: list) -> set[str]:
    """Variables of which more than the id is used: all but those that are only counted or joined on."""
    out: set[str] = set()

    def visit(e):
        if isinstance(e, s.Fn) and e.name.lower() in ("count", "id", "elementid") and e.args and isinstance(e.args[0], s.Var):
            return
        if isinstance(e, s.Var):
            out.add(e.name)
        if isinstance(e, (s.NodeP, s.RelP)):
            if e.props is not None:
                visit(e.props)
                out.add(e.var)
            return
        if isinstance(e, (tuple, list)):
            for x in e:
                visit(x)
        elif hasattr(e, "__dataclass_fields__"):
            for f in e.__dataclass_fields__:
                x = getattr(e, f)
                if isinstance(x, (tuple, list)) or hasattr(x, "__dataclass_fields__"):
                    visit(x)

    for cl in clauses:
        visit(_tree(cl))
        if isinstance(cl, s.Project) and cl.star:
            out |= {n.var for x in clauses if isinstance(x, s.Match) for p in x.paths for n in (*p.nodes, *p.rels) if n.var}
        if isinstance(cl, (s.Merge, s.Create)):
            ps = cl.paths if isinstance(cl, s.Create) else (cl.path,)
            out |= {n.var for p in ps for n in (*p.nodes, *p.rels) if n.var}
    return out


def run(catalog: GraphCatalog, text: str, params: dict, unique_rels: bool = False, now_ms: int | None = None) -> DataFrame:
    """Parse, rewrite and compile a statement. ``EXPLAIN`` gives the plan as one column ``plan``.

    With ``now_ms`` the decay statements of the catalog apply: nodes and relationships whose score is below their threshold are not read.
    """
    q = parse(text)
    visible = None
    if now_ms is not None and catalog.policies:
        from graphweft.policy import knowledge

        both = {k: knowledge.from_statements(catalog.policies, k) for k in ("node", "relationship")}

        def visible(t):
            node = isinstance(t, NodeTable)
            return knowledge.hide(t, both["node" if node else "relationship"], t.labels if node else (t.type,), now_ms)

    result = None
    target = catalog.version()
    for k, part in enumerate(q.parts):
        comp = Compiler(target, params, unique_rels, visible)
        done = rewrites.two_hop_count(comp, part) if not unique_rels and visible is None else None
        if done is None and not unique_rels and visible is None:
            done = rewrites.pattern_count(comp, part)
        if done is None:
            part_left = rewrites.distinct_apart(comp, part) if not unique_rels and visible is None else part
            comp.clauses(rewrites.aggregate_first(comp, part_left) if visible is None else part)
            done = comp.df if comp.df is not None else catalog.spark.range(0).select()
        if not (isinstance(part[-1], (s.Project, s.CallProc, s.Schema)) or result is not None):
            done = done.select().limit(0)
        if result is None:
            result = done
        else:
            result = Compiler.union(result, done)
            if not q.all_flags[k - 1]:
                result = result.distinct()
    catalog.adopt(target)
    if q.explain:
        plan = result._jdf.queryExecution().explainString(result._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return catalog.spark.createDataFrame([(plan,)], "plan string")
    return result

"""Rewrites that Catalyst does not make."""

from __future__ import annotations

from dataclasses import replace
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.plans import syntax as s
from graphweft.plans.catalog import SEP


def two_hop_count(comp, clauses: list) -> DataFrame | None:
    """``MATCH (a)-[..]->(b)-[..]->(c) RETURN count(*)`` as the sum over b of arrivals times departures; the pairs are never made."""
    if len(clauses) != 2 or not isinstance(clauses[0], s.Match) or not isinstance(clauses[1], s.Project):
        return None
    m, p = clauses
    if m.optional or m.where is not None or len(m.paths) != 1 or not p.last or p.star or p.distinct or len(p.items) != 1 or p.order or p.skip or p.limit:
        return None
    path, e = m.paths[0], p.items[0].expr
    if len(path.rels) != 2 or path.shortest or path.var or any(r.many or r.props for r in path.rels) or any(n.props for n in path.nodes):
        return None
    names = [n.var for n in path.nodes if n.var]
    if not (isinstance(e, s.Fn) and e.name.lower() == "count" and not e.distinct) or len(set(names)) != len(names):
        return None
    if e.args[0] != s.Lit("*") and not (isinstance(e.args[0], s.Var) and e.args[0].name in names + [r.var for r in path.rels]):
        return None
    path = comp.named((path,))[0]
    cand = comp.candidates((path,))
    sides = []
    natives = [comp.native(n.var, cand[n.var]) for n in path.nodes]
    for k, r in enumerate(path.rels):
        a, b = path.nodes[k], path.nodes[k + 1]
        f, _, trusted = comp.rel_frame(replace(r), a.var, b.var, cand[a.var], cand[b.var], (natives[k], natives[k + 1]))
        if not trusted or not all(comp.implied(r, cand[a.var], cand[b.var], end) for end in (False, True)):
            return None
        sides.append(f.groupBy(F.col(f"`{r.var}{SEP}{'~to' if k == 0 else '~from'}`").alias("b")).agg(F.count(F.lit(1)).alias(f"n{k}")))
    total = sides[0].join(sides[1], "b").agg(F.coalesce(F.sum(F.col("n0") * F.col("n1")), F.lit(0)).cast("long").alias(p.items[0].alias or p.items[0].text))
    return total


def pattern_count(comp, clauses: list) -> DataFrame | None:
    """``MATCH`` of three or more relationships, also in a cycle, with ``RETURN count(*)``: one variable after the other is summed out, so
    that a join never meets more variables than the pattern needs at that place, and the matches themselves are never made."""
    if len(clauses) != 2 or not isinstance(clauses[0], s.Match) or not isinstance(clauses[1], s.Project):
        return None
    m, p = clauses
    if not p.last or p.star or p.distinct or len(p.items) != 1 or p.order or p.skip or p.limit or p.where is not None:
        return None
    e = p.items[0].expr
    if not (isinstance(e, s.Fn) and e.name.lower() == "count" and not e.distinct):
        return None
    names = {x.var for path in m.paths for x in (*path.nodes, *path.rels) if x.var}
    if e.args[0] != s.Lit("*") and not (isinstance(e.args[0], s.Var) and e.args[0].name in names):
        return None
    found = _factors(comp, [m])
    if found is None or len(found[0]) < 3:
        return None
    total = None
    for _, f in _summed_out(found[0], set(), True):
        total = f if total is None else total.crossJoin(f.withColumnRenamed(f"{SEP}n", f"{SEP}m")).select((F.col(f"`{SEP}n`") * F.col(f"`{SEP}m`")).alias(f"{SEP}n"))
    return total.select(F.coalesce(F.col(f"`{SEP}n`"), F.lit(0)).cast("long").alias(p.items[0].alias or p.items[0].text))


def distinct_apart(comp, clauses: list) -> list:
    """Several ``count(DISTINCT x)`` of nodes per properties of one node ``k``: instead of all matches, the pairs ``k, x`` that occur in one
    are made for each ``x`` apart and put below each other, the other ``x`` being null there.

    Binds ``k`` and the ``x`` in ``comp`` and gives the clauses that remain; other statements are given back as they are.
    """
    matches = [m for m in clauses[:-1] if isinstance(m, s.Match)]
    if not matches or len(matches) != len(clauses) - 1 or not isinstance(clauses[-1], s.Project):
        return clauses
    p = clauses[-1]
    if not p.last or p.star or p.distinct or p.where is not None:
        return clauses
    exprs = [i.expr for i in p.items] + [o.expr for o in p.order]
    aggs = list(dict.fromkeys(x for e in exprs for x in s.walk(e) if isinstance(x, s.Fn) and x.name.lower() in s.AGGREGATES))
    if any(not a.distinct or a.name.lower() != "count" or not isinstance(a.args[0], s.Var) for a in aggs) or any(isinstance(x, (s.Exists, s.PatternList)) for e in exprs for x in s.walk(e)):
        return clauses
    nodes = {n.var for m in matches for path in m.paths for n in path.nodes if n.var}
    counted = list(dict.fromkeys(a.args[0].name for a in aggs))
    keys = {v.name for i in p.items for v in s.walk(_without(i.expr, aggs)) if isinstance(v, s.Var)}
    if len(counted) < 2 or len(keys) != 1 or keys & set(counted) or not (keys | set(counted)) <= nodes:
        return clauses
    known = keys | set(counted) | {i.alias or i.text for i in p.items}
    if any(isinstance(v, s.Var) and v.name not in known for o in p.order for v in s.walk(o.expr)):
        return clauses
    found = _factors(comp, matches)
    if found is None:
        return clauses
    factors, cand = found
    (key,) = keys
    sides = []
    for x in counted:
        left = _summed_out(factors, {key, x}, False)
        pairs = left[0][1]
        for names, f in left[1:]:
            pairs = _meet(pairs, f, [n for n in names if n in pairs.columns])
        sides.append(pairs.select(F.col(f"`{key}`").alias(f"{SEP}key"), *[(F.col(f"`{x}`") if x == y else F.lit(None)).alias(f"{y}{SEP}_id") for y in counted]))
    rows = sides[0]
    for side in sides[1:]:
        rows = rows.unionByName(side)
    by = {n.var: n for m in matches for path in m.paths for n in path.nodes if n.var}
    comp.needs |= {key}
    comp.scan(replace(by[key], labels=()), cand[key])
    comp.df = comp.df.join(rows, F.col(f"`{key}{SEP}_id`") == F.col(f"`{SEP}key`")).drop(f"{SEP}key")
    for x in counted:
        comp.df = comp.df.withColumn(f"{x}{SEP}_labels", F.array().cast("array<string>"))
        comp.bind_node(by[x], cand[x], False)
    return [p]


def _factors(comp, matches: list) -> tuple[list, dict] | None:
    """The relationships of plain patterns as ``({variables}, frame of their keys)``, with the tables of each node; None where a node or
    relationship says more than that it is there."""
    if any(m.optional or m.where is not None for m in matches):
        return None
    plain = [path for m in matches for path in m.paths]
    rels = [r for path in plain for r in path.rels]
    if any(path.shortest or path.var or not path.rels for path in plain) or any(r.many or r.props is not None for r in rels) or any(n.props is not None for path in plain for n in path.nodes):
        return None
    named = [r.var for r in rels if r.var]
    if len(set(named)) != len(named):
        return None
    plain = comp.named(tuple(plain))
    cand = comp.candidates(plain)
    out = []
    for path in plain:
        for a, r, b in zip(path.nodes, path.rels, path.nodes[1:]):
            f, _, trusted = comp.rel_frame(r, a.var, b.var, cand[a.var], cand[b.var], tuple(comp.native(x.var, cand[x.var]) for x in (a, b)))
            if not trusted or not all(comp.implied(r, cand[a.var], cand[b.var], end) for end in (False, True)):
                return None
            start, end = F.col(f"`{r.var}{SEP}~from`"), F.col(f"`{r.var}{SEP}~to`")
            f = f.filter(start == end).select(start.alias(a.var)) if a.var == b.var else f.select(start.alias(a.var), end.alias(b.var))
            out.append((frozenset((a.var, b.var)), f))
    return out, cand


def _meet(a: DataFrame, b: DataFrame, on: list) -> DataFrame:
    return a.join(b, on) if on else a.crossJoin(b)


def _summed_out(factors: list, keep: set, counted: bool) -> list:
    """``factors`` after all variables but ``keep`` are summed out, rows counted in ``·n`` or only kept apart.

    The next variable is the one whose join is estimated smallest, from the rows and distinct keys of the relationships.
    """
    n = f"{SEP}n"
    left = sorted({v for names, _ in factors for v in names} - keep)
    stats = len(left) > 1
    state = []
    for names, f in factors:
        size, seen = 1, {}
        if stats:
            row = f.agg(F.count(F.lit(1)), *[F.approx_count_distinct(F.col(f"`{v}`")) for v in sorted(names)]).first()
            size, seen = max(1, row[0]), {v: max(1, d) for v, d in zip(sorted(names), row[1:])}
        state.append((names, f.withColumn(n, F.lit(1).cast("long")) if counted else f, size, seen))

    def joined(v: str) -> float:
        own = [x for x in state if v in x[0]]
        shared = {w: sorted(x[3].get(w, 1) for x in own if w in x[0]) for x in own for w in x[0]}
        return prod(x[2] for x in own) / prod(prod(d[1:]) for d in shared.values())

    while left:
        v = min(left, key=joined)
        left.remove(v)
        size = joined(v)
        own = sorted((x for x in state if v in x[0]), key=lambda x: -x[2])
        state = [x for x in state if v not in x[0]]
        names, f = own[0][:2]
        for other, g, *_ in own[1:]:
            if counted:
                f = _meet(f, g.withColumnRenamed(n, f"{SEP}m"), sorted(names & other)).withColumn(n, F.col(f"`{n}`") * F.col(f"`{SEP}m`")).drop(f"{SEP}m")
            else:
                f = _meet(f, g, sorted(names & other))
            names |= other
        names -= {v}
        seen = {w: min(x[3].get(w, 1) for x in own if w in x[0]) for w in names}
        groups = prod(seen.values())
        rest = [F.col(f"`{w}`") for w in sorted(names)]
        if not counted:
            f = f.select(*rest).distinct()
        elif not names or groups < size or not stats or len(own) == 1:
            f = f.groupBy(*rest).agg(F.sum(n).alias(n))
        else:
            f = f.select(*rest, n)
        state.append((names, f, max(1, min(size, groups)), seen))
    return [(names, f) for names, f, *_ in state]


def aggregate_first(comp, clauses: list) -> list:
    """``MATCH (x)-[r]-(y)`` followed by aggregates over ``r`` and counts of ``y`` per properties of ``x``: the relationships are aggregated
    per end before they meet the table of ``x``, so the join has one row per node instead of one per relationship.

    Binds ``x`` and the partial aggregates in ``comp`` and gives the clauses that remain; other statements are given back as they are.
    """
    if len(clauses) < 2 or not isinstance(clauses[0], s.Match) or not isinstance(clauses[1], s.Project):
        return clauses
    m, p = clauses[:2]
    if m.optional or m.where is not None or len(m.paths) != 1 or p.star or p.distinct or p.where is not None:
        return clauses
    path = m.paths[0]
    if len(path.rels) != 1 or path.var or path.shortest or path.rels[0].many or path.rels[0].props is not None:
        return clauses
    path = comp.named((path,))[0]
    r, ends = path.rels[0], path.nodes
    used = {v.name for i in p.items for v in s.walk(i.expr) if isinstance(v, s.Var)} | {v.name for o in p.order for v in s.walk(o.expr) if isinstance(v, s.Var)}
    aggs = list(dict.fromkeys(x for i in p.items for x in s.walk(i.expr) if isinstance(x, s.Fn) and x.name.lower() in s.AGGREGATES))
    inside = {v.name for a in aggs for v in s.walk(a.args) if isinstance(v, s.Var)}
    outside = {v.name for i in p.items for v in s.walk(_without(i.expr, aggs)) if isinstance(v, s.Var)}
    if not aggs or ends[0].var == ends[1].var or r.var in outside:
        return clauses
    keyed = [k for k, n in enumerate(ends) if n.var in outside]
    if len(keyed) != 1:
        return clauses
    x, y = ends[keyed[0]], ends[1 - keyed[0]]
    if x.var in inside or y.props is not None or any(isinstance(v, (s.Exists, s.PatternList)) for i in p.items for v in s.walk(i.expr)):
        return clauses
    if any(v in used for v in (y.var, r.var)) and any(isinstance(v, s.Var) and v.name in (y.var, r.var) for o in p.order for v in s.walk(_without(o.expr, aggs))):
        return clauses
    plan = []
    for a in aggs:
        name, arg = a.name.lower(), a.args[0]
        if a.distinct or name not in ("count", "sum", "avg", "min", "max"):
            return clauses
        whole = arg == s.Lit("*") or isinstance(arg, s.Var) and arg.name in (y.var, r.var)
        prop = isinstance(arg, s.Prop) and arg.of == s.Var(r.var)
        if not (name == "count" and whole or prop):
            return clauses
        plan.append((a, name, None if whole else arg.name))
    if keyed[0] == 1:
        r = replace(r, direction={"out": "in", "in": "out", "both": "both"}[r.direction])
    cand = comp.candidates((replace(path, nodes=(x, y), rels=(r,)),))
    natives = (comp.native(x.var, cand[x.var]), comp.native(y.var, cand[y.var]))
    f, props, trusted = comp.rel_frame(r, x.var, y.var, cand[x.var], cand[y.var], natives)
    if not trusted or not comp.implied(r, cand[x.var], cand[y.var], True) or any(q is not None and q not in props for _, _, q in plan):
        return clauses
    from pyspark.sql import types as T

    from graphweft.functions.scalars import is_number

    parts, terms = [], {}
    for k, (a, name, q) in enumerate(plan):
        c = F.col(f"`{r.var}{SEP}{q}`") if q else F.lit(1)
        t = f.schema[f"{r.var}{SEP}{q}"].dataType if q else T.LongType()
        number = c.cast("double") if is_number(t) else c.try_cast("double")
        n, n2 = f"{SEP}g{k}", f"{SEP}h{k}"
        if name == "count":
            parts.append(F.count(c).alias(n))
            terms[a] = s.Fn("·total", (s.Var(n),))
        elif name == "avg":
            parts += [F.sum(number).alias(n), F.count(number).alias(n2)]
            terms[a] = s.Fn("·mean", (s.Var(n), s.Var(n2)))
        else:
            v = number if name == "sum" or is_number(t) else c
            parts.append({"sum": F.sum, "min": F.min, "max": F.max}[name](v).alias(n))
            terms[a] = s.Fn(name, (s.Var(n),))
    g = f.groupBy(F.col(f"`{r.var}{SEP}~from`").alias(f"{SEP}end")).agg(*parts)
    comp.needs |= {x.var}
    comp.scan(x, cand[x.var])
    comp.df = comp.df.join(g, F.col(f"`{x.var}{SEP}_id`") == F.col(f"`{SEP}end`")).drop(f"{SEP}end")
    from graphweft.plans.compiler import Bound

    comp.scope |= {n: Bound("value") for n in g.columns if n != f"{SEP}end"}
    items = [s.Item(_replaced(i.expr, terms), i.alias or i.text, i.text) for i in p.items]
    order = [s.Order(_replaced(o.expr, terms), o.descending) for o in p.order]
    return [replace(p, items=items, order=order), *clauses[2:]]


def _without(e, aggs: list):
    return _replaced(e, {a: s.Lit(None) for a in aggs})


def _replaced(e, terms: dict):
    if isinstance(e, s.Fn) and e in terms:
        return terms[e]
    if isinstance(e, tuple):
        return tuple(_replaced(x, terms) for x in e)
    if hasattr(e, "__dataclass_fields__"):
        return replace(e, **{f: _replaced(getattr(e, f), terms) for f in e.__dataclass_fields__ if isinstance(getattr(e, f), tuple) or hasattr(getattr(e, f), "__dataclass_fields__")})
    return e

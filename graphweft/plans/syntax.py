"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Prop:
    of: Any
    name: str


@dataclass(frozen=True)
class Index:
    of: Any
    at: Any


@dataclass(frozen=True)
class Fn:
    name: str
    args: tuple
    distinct: bool = False


@dataclass(frozen=True)
class Un:
    op: str
    of: Any


@dataclass(frozen=True)
class Bin:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Between:
    of: Any
    low: Any
    high: Any


@dataclass(frozen=True)
class Case:
    subject: Any
    whens: tuple
    default: Any


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class MapOf:
    items: tuple


@dataclass(frozen=True)
class Comprehension:
    var: str
    of: Any
    where: Any
    out: Any


@dataclass(frozen=True)
class Quantified:
    kind: str
    var: str
    of: Any
    where: Any


@dataclass(frozen=True)
class Reduce:
    acc: str
    start: Any
    var: str
    of: Any
    out: Any


@dataclass(frozen=True)
class HasLabel:
    of: Any
    labels: tuple


@dataclass(frozen=True)
class NodeP:
    var: str | None
    labels: tuple = ()
    props: MapOf | None = None


@dataclass(frozen=True)
class RelP:
    var: str | None
    types: tuple
    direction: str  # out, in, both
    props: MapOf | None = None
    low: int | None = None  # set for variable length
    high: int | None = None

    @property
    def many(self) -> bool:
        return self.low is not None


@dataclass(frozen=True)
class PathP:
    nodes: tuple
    rels: tuple
    var: str | None = None
    shortest: str | None = None  # one, all


@dataclass(frozen=True)
class Exists:
    """EXISTS { pattern WHERE ... } or a bare pattern in a condition."""

    paths: tuple
    where: Any = None


@dataclass(frozen=True)
class PatternList:
    path: PathP
    where: Any
    out: Any


@dataclass
class Item:
    expr: Any
    alias: str | None
    text: str


@dataclass
class Order:
    expr: Any
    descending: bool


@dataclass
class Match:
    paths: tuple
    where: Any = None
    optional: bool = False


@dataclass
class Where:
    expr: Any


@dataclass
class Project:
    """RETURN or WITH."""

    items: list[Item]
    star: bool = False
    distinct: bool = False
    where: Any = None
    order: list[Order] = field(default_factory=list)
    skip: Any = None
    limit: Any = None
    last: bool = False


@dataclass
class Unwind:
    expr: Any
    alias: str


@dataclass
class CallSub:
    query: Any


@dataclass
class CallProc:
    name: str
    args: tuple
    yields: list[tuple[str, str]] | None
    star: bool = False


@dataclass
class Create:
    paths: tuple


@dataclass
class Merge:
    path: PathP
    on_create: list
    on_match: list


@dataclass
class SetItem:
    kind: str  # prop, replace, add, label
    var: str
    name: Any
    expr: Any


@dataclass
class SetClause:
    items: list[SetItem]


@dataclass
class Remove:
    items: list[tuple]


@dataclass
class Delete:
    names: list[str]
    detach: bool


@dataclass
class Foreach:
    var: str
    of: Any
    body: list


@dataclass
class Schema:
    """CREATE/DROP/SHOW of constraints, indexes, databases and policies."""

    action: str
    kind: str
    name: str | None = None
    options: dict = field(default_factory=dict)


@dataclass
class Query:
    parts: list[list]  # clause lists
    all_flags: list[bool] = field(default_factory=list)  # UNION ALL between parts
    explain: bool = False


#: The last two exist in rewritten statements only: the sum of partial counts, and a mean from partial sums and counts.
AGGREGATES = frozenset({"count", "collect", "sum", "avg", "min", "max", "stdev", "stdevp", "·total", "·mean"})


def walk(node, into_patterns: bool = True):
    """Every node of an expression or pattern tree, itself first."""
    yield node
    if isinstance(node, (tuple, list)):
        children = node
    elif hasattr(node, "__dataclass_fields__"):
        if not into_patterns and isinstance(node, (Exists, PatternList)):
            return
        children = [getattr(node, f) for f in node.__dataclass_fields__]
    elif isinstance(node, dict):
        children = list(node.values())
    else:
        return
    for c in children:
        if isinstance(c, (tuple, list, dict)) or hasattr(c, "__dataclass_fields__"):
            yield from walk(c, into_patterns)


def has_aggregate(e) -> bool:
    return any(isinstance(x, Fn) and x.name.lower() in AGGREGATES for x in walk(e, False))

"""The graph as typed views over DataFrames: one table per label set, one per relationship type and end labels."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEP = "·"
#: Columns that number the rows of each list a writing statement unwinds, the outermost first.
ORDER = f"{SEP}order"


@dataclass(frozen=True)
class NodeTable:
    """Nodes with exactly the labels ``labels``; ``id`` names the key column, all other columns are properties."""

    labels: tuple[str, ...]
    df: DataFrame = field(compare=False)
    id: str = "_id"

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c != self.id or self.id != "_id"]


@dataclass(frozen=True)
class RelTable:
    """Relationships of one type between nodes of two label sets (None: any, for graphs whose ids are unique).

    ``trusted``: every end is known to exist, so a hop to a node of which nothing else is asked needs no join with its table.
    """

    type: str
    df: DataFrame = field(compare=False)
    src: str = "_src"
    dst: str = "_dst"
    src_labels: tuple[str, ...] | None = None
    dst_labels: tuple[str, ...] | None = None
    id: str | None = None
    trusted: bool = True

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("_")]

    def key(self) -> Column:
        return F.col(self.id).cast("string") if self.id else F.concat_ws("|", F.lit(self.type), F.col(self.src).cast("string"), F.col(self.dst).cast("string"))


@dataclass
class GraphCatalog:
    """All tables of a graph. Queries read it; writes replace tables, so that earlier DataFrames keep their version."""

    spark: SparkSession
    nodes: list[NodeTable] = field(default_factory=list)
    rels: list[RelTable] = field(default_factory=list)
    unique_ids: bool = False
    name: str = "graph"
    constraints: dict = field(default_factory=dict)
    indexes: dict = field(default_factory=dict)
    policies: dict = field(default_factory=dict)
    procedures: dict = field(default_factory=dict)
    functions: dict = field(default_factory=dict)

    @classmethod
    def empty(cls, spark: SparkSession, name: str = "graph") -> GraphCatalog:
        """A graph for writing: string ids that are unique over all tables."""
        return cls(spark, unique_ids=True, name=name)

    def version(self) -> GraphCatalog:
        """A copy whose tables can be replaced without touching this one: what a transaction works on."""
        return replace(self, nodes=list(self.nodes), rels=list(self.rels), constraints=dict(self.constraints), indexes=dict(self.indexes), policies=dict(self.policies))

    def adopt(self, other: GraphCatalog) -> None:
        """Commit: take over the tables of a version."""
        self.nodes, self.rels, self.constraints, self.indexes, self.policies = other.nodes, other.rels, other.constraints, other.indexes, other.policies

    def add_nodes(self, labels: tuple[str, ...] | str, df: DataFrame, id: str = "_id") -> GraphCatalog:
        self.nodes.append(NodeTable((labels,) if isinstance(labels, str) else tuple(sorted(labels)), df, id))
        return self

    def add_rels(self, type: str, df: DataFrame, src: str = "_src", dst: str = "_dst", src_labels=None, dst_labels=None, id: str | None = None, trusted: bool = True) -> GraphCatalog:
        def tup(x):
            return None if x is None else (x,) if isinstance(x, str) else tuple(sorted(x))

        self.rels.append(RelTable(type, df, src, dst, tup(src_labels), tup(dst_labels), id, trusted))
        return self

    def with_labels(self, labels: tuple[str, ...]) -> list[NodeTable]:
        return [t for t in self.nodes if set(labels) <= set(t.labels)]

    def with_types(self, types: tuple[str, ...]) -> list[RelTable]:
        return [r for r in self.rels if not types or r.type in types]

    def query(self, text: str, params: dict | None = None, **options) -> DataFrame:
        """Compile a statement to a DataFrame; writes are applied to this catalog when the statement compiles."""
        from graphweft.plans.compiler import run

        return run(self, text, params or {}, **options)

    def record_access(self, ids: DataFrame) -> None:
        """Apply the ON ACCESS parts of the promotion policies to the nodes and relationships of ``ids (_id)``."""
        from graphweft.plans import mutate

        mutate.record_access(self, ids)


class Databases:
    """Named catalogs: ``SHOW DATABASES``, ``CREATE DATABASE x``, ``DROP DATABASE x``; other statements go to the named catalog."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.catalogs: dict[str, GraphCatalog] = {"system": GraphCatalog.empty(spark, "system")}

    def query(self, text: str, params: dict | None = None, database: str = "system", **options) -> DataFrame:
        from graphweft.plans.parser import parse
        from graphweft.plans.syntax import Schema

        first = parse(text).parts[0][0]
        if isinstance(first, Schema) and "DATABASE" in first.kind:
            if first.action == "create":
                if first.name in self.catalogs and not first.options.get("if"):
                    raise ValueError(f"database {first.name} exists")
                self.catalogs.setdefault(first.name, GraphCatalog.empty(self.spark, first.name))
            elif first.action == "drop":
                if first.name == "system" or (first.name not in self.catalogs and not first.options.get("if")):
                    raise ValueError(f"database {first.name} cannot be dropped")
                self.catalogs.pop(first.name, None)
            return self.spark.createDataFrame([(n, "online") for n in sorted(self.catalogs)], "name string, status string")
        if database not in self.catalogs:
            raise ValueError(f"database {database} does not exist")
        return self.catalogs[database].query(text, params, **options)

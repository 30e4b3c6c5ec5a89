"""The driver tables as a graph: views only, keys stay as they are typed."""

from __future__ import annotations

from pyspark.sql import SparkSession

from graphweft.plans.catalog import GraphCatalog
from graphweft.session import table


_built: dict[tuple[str, str], GraphCatalog] = {}


def build(spark: SparkSession, sf_dir: str) -> GraphCatalog:
    """The graph of a data folder. The catalog (schemas and views, no rows) is kept per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        if len(_built) >= 16:
            _built.clear()
        _built[key] = _views(spark, sf_dir)
    return _built[key].version()


def _views(spark: SparkSession, sf_dir: str) -> GraphCatalog:
    t = lambda n: table(spark, sf_dir, n)
    g = GraphCatalog(spark)
    for label, name, key in (
        ("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"),
        ("Part", "part", "p_partkey"), ("Order", "orders", "o_orderkey"), ("Event", "events", "event_id"), ("Document", "documents", "doc_id"), ("Vector", "embeddings", "vec_id"),
    ):
        g.add_nodes(label, t(name), key)
    g.add_rels("IN_REGION", t("nation").select("n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey", "Nation", "Region")
    g.add_rels("FROM_NATION", t("customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", "Customer", "Nation")
    g.add_rels("SUPPLIER_NATION", t("supplier").select("s_suppkey", "s_nationkey"), "s_suppkey", "s_nationkey", "Supplier", "Nation")
    g.add_rels("PLACED", t("orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", "Customer", "Order")
    g.add_rels("CONTAINS", t("lineitem"), "l_orderkey", "l_partkey", "Order", "Part")
    g.add_rels("SUPPLIES", t("lineitem").select("l_suppkey", "l_partkey").distinct(), "l_suppkey", "l_partkey", "Supplier", "Part")
    return g


def store(spark: SparkSession, sf_dir: str) -> GraphCatalog:
    """The property-graph store's own tables: one row per node and relationship, ids unique, references unchecked."""
    from pyspark.sql import functions as F

    n = table(spark, sf_dir, "nodes").filter("deleted_at_unix_ms is null").select("id", "labels", "created_at_unix_ms").dropDuplicates(["id"])
    e = table(spark, sf_dir, "edges").filter(F.col("edge_type").isNotNull()).select("id", "start_node", "end_node", "edge_type", "created_at_unix_ms").dropDuplicates(["id"])
    g = GraphCatalog(spark, unique_ids=True)
    g.add_nodes("Node", n, "id")
    for t in sorted(r["edge_type"] for r in e.select("edge_type").distinct().collect()):
        g.add_rels(t, e.filter(F.col("edge_type") == t), "start_node", "end_node", id="id", trusted=False)
    return g

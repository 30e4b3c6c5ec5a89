"""Registered queries use the whole of their tables."""

from pyspark.sql import functions as F

from graphweft.queries import engine, graph, language


def test_store_has_every_relationship_type(spark, sf):
    types = {r.edge_type for r in spark.read.parquet(f"{sf}/edges.parquet").filter("edge_type is not null").select("edge_type").distinct().collect()}
    assert {r.type for r in graph.store(spark, sf).rels} == types


def test_link_prediction_uses_edges_of_every_type(spark, sf):
    e = spark.read.parquet(f"{sf}/edges.parquet")
    n = spark.read.parquet(f"{sf}/nodes.parquet").select("id").distinct()
    known = e.join(n.withColumnRenamed("id", "start_node"), "start_node", "left_semi").join(n.withColumnRenamed("id", "end_node"), "end_node", "left_semi")
    want = known.filter("start_node <> end_node").select(F.least("start_node", "end_node"), F.greatest("start_node", "end_node")).distinct().count()
    assert engine._graph(spark, sf)[0].count() == 2 * want


def test_vector_functions_score_every_vector(spark, sf):
    got = language.queries()["cypher_vector_functions"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()

"""Orphan references against a loop over rows and lives."""

import random

from graphweft.operators import references


def tables(spark, rows, nodes):
    refs = spark.createDataFrame(rows, "tbl string, row_id string, ref_column string, key string, t long")
    n = spark.createDataFrame(nodes, "id string, created_at_unix_ms long, deleted_at_unix_ms long, labels string, lives string")
    return refs, n


def brute(rows, nodes):
    out = []
    for r in rows:
        if not any(i == r[3] and a is not None and a * 1000 <= r[4] and (b is None or r[4] < b * 1000) for i, a, b, *_ in nodes):
            out.append(r)
    return sorted(out)


def test_hot_keys_and_lives_against_brute_force(spark):
    rng = random.Random(5)
    nodes = [(f"n{k}", rng.randrange(100), None if rng.random() < 0.5 else 50 + rng.randrange(100), "x", "y") for k in range(30)]
    nodes += nodes[:5] + [("n1", 400, None, "x", "y"), ("n2", None, None, "x", "y"), (None, 1, None, "x", "y")]
    rows = [("t", f"r{k}", "c", "n0" if k % 3 else f"n{rng.randrange(40)}", rng.randrange(600) * 1000) for k in range(1500)]
    refs, n = tables(spark, rows, nodes)
    for heavy, most in ((10, 1000), (10, 0), (10_000, 1000)):  # heavy keys with few and many lives, no heavy keys
        got = sorted(tuple(r) for r in references.orphans(refs, n, 3000, heavy_rows=heavy, most_lives=most).collect())
        assert got == brute(rows, nodes)


def test_reasons(spark):
    rows = [("t", "a", "c", "none", 5000), ("t", "b", "c", "k", 500), ("t", "c", "c", "k", 2500), ("t", "d", "c", "k", 4500)]
    refs, n = tables(spark, rows, [("k", 1, 2, "", ""), ("k", 3, 4, "", ""), ("other", 1, None, "", "")])
    assert {r.row_id: r.why for r in references.reasons(references.orphans(refs, n, 4), n).collect()} == {"a": "missing", "b": "later", "c": "deleted", "d": "deleted"}


def test_no_rows_no_nodes(spark):
    refs, n = tables(spark, [("t", "a", "c", "k", 5)], [("k", 0, None, "", "")])
    assert references.orphans(refs.limit(0), n, 1).count() == 0
    assert references.orphans(refs, n.limit(0), 1).count() == 1
    assert references.orphans(refs, n, 1).count() == 0


def test_boundaries_are_half_open(spark):
    rows = [("t", str(t), "c", "k", t) for t in (999, 1000, 1999, 2000)]
    refs, n = tables(spark, rows, [("k", 1, 2, "", "")])
    assert {r.row_id for r in references.orphans(refs, n, 1).collect()} == {"999", "2000"}


def test_found_rows_stand_once(spark, sf):
    found = references.p2_found(spark, sf)
    assert found.columns == ["tbl", "row_id", "ref_column"]
    assert found.count() == found.distinct().count() > 0


def test_null_and_empty_keys_are_no_references(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", None, "", 1), ("b", "k", "", 1), ("c", "k", "j", None)], "id string, x string, y string, t long")
    got = references.references(df, "t", F.col("id"), F.col("t"), {"x": F.col("x"), "y": F.col("y")}).collect()
    assert [(r.row_id, r.ref_column, r.key) for r in got] == [("b", "x", "k")]

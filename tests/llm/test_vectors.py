"""One-bit codes: unbiased estimates within their bounds, and neighbours against brute force."""

import numpy as np
import pytest

from graphweft.llm import vectors as v

SCHEMA = "field string, space string, id string, vec array<float>, extra int"


def frame(spark, x, space="s", prefix="n"):
    return spark.createDataFrame([("f", space, f"{prefix}{i:05d}", [float(t) for t in row], 1) for i, row in enumerate(x)], SCHEMA)


def clustered(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for k in range(0, n - 4, 9):  # small groups of similar vectors
        for j in range(1, 4):
            x[k + j] = x[k] + rng.standard_normal(dim) * rng.uniform(0.05, 0.6)
    return x.astype(np.float32) * rng.uniform(0.1, 9, (n, 1)).astype(np.float32)


def brute(ids, x, least, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u.astype(float) @ u.T.astype(float)
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k]
        out |= {tuple(sorted((ids[i], ids[j]))) for j in order if s[i, j] >= least}
    return out


@pytest.mark.parametrize("dim", [96, 128, 50])
def test_estimates_keep_their_bounds(dim):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, dim))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[1] = x[0]
    turn = v.rotation(dim)
    assert np.allclose(turn @ turn.T, np.eye(dim), atol=1e-4)
    codes, scale = v.encode(x @ turn)
    est, sigma = v.estimate(*v.quantise(x @ turn), codes, scale)
    half = v.EPSILON * sigma
    true = x @ x.T
    off = ~np.eye(len(x), dtype=bool)
    assert abs((est - true)[off].mean()) < 0.01
    assert (np.abs(est - true) <= half[None] + 0.02)[off].mean() > 0.995
    assert codes.shape[1] * 8 == -(-dim // 64) * 8


def test_pairs_against_brute_force(spark):
    x = clustered(900, 96)
    ids = [f"n{i:05d}" for i in range(len(x))]
    want = brute(ids, x, 0.8, 10)
    for kw in ({}, {"per_cell": 30}, {"per_cell": 30, "block": 40}):
        got = {(r.id_a, r.id_b) for r in v.similar_pairs(frame(spark, x), **kw).collect()}
        assert not got - want and len(got & want) >= 0.97 * len(want)


def test_copies_link_to_their_first_ids_only(spark):
    rng = np.random.default_rng(4)
    one = rng.standard_normal((1, 96)).astype(np.float32)
    x = np.concatenate([np.repeat(one, 60, 0), one + 0.02 * rng.standard_normal((2, 96)).astype(np.float32), rng.standard_normal((40, 96)).astype(np.float32)])
    ids = [f"n{i:05d}" for i in range(len(x))]
    df = frame(spark, x)
    got = {(r.id_a, r.id_b) for r in v.similar_pairs(df.unionByName(df)).collect()}
    assert got == brute(ids, x, 0.8, 10)
    assert len(got) < 60 * 13


def test_collections_stay_apart_and_empty_input(spark):
    x = clustered(60, 96)
    df = frame(spark, x, "a").unionByName(frame(spark, x, "b", "m"))
    got = v.similar_pairs(df).collect()
    assert {r.space for r in got} == {"a", "b"} and all((r.id_a[0] == r.id_b[0]) and ((r.id_a[0] == "n") == (r.space == "a")) for r in got)
    assert v.similar_pairs(df.limit(0)).count() == 0
    assert v.similar_pairs(df.limit(1)).count() == 0


def test_a_third_of_all_vectors_close_together(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((900, 96)).astype(np.float32)
    x[:300] = rng.standard_normal(96) + 0.1 * rng.standard_normal((300, 96))
    want = brute([f"n{i:05d}" for i in range(900)], x, 0.8, 10)
    got = {(r.id_a, r.id_b) for r in v.similar_pairs(frame(spark, x), per_cell=100).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_unusable_vectors(spark):
    from pyspark.sql import functions as F

    rows = [([1.0, 2.0],), ([1.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([None, 1.0],), (None,), ([],)]
    df = spark.createDataFrame(rows, "v array<float>")
    assert [r[0] for r in df.select(v.usable(F.col("v"), F.lit(2))).collect()] == [True] + [False] * 7


def test_nearest_has_full_recall_on_a_query_set(spark):
    x = clustered(700, 96, 7)
    df = frame(spark, x)
    ids = [f"n{i:05d}" for i in range(len(x))]
    asked = df.filter("id like '%00'")
    got = {}
    for r in v.nearest(df, asked, 10, block=150).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for i in range(0, len(x), 100):
        s = u @ u[i]
        s[i] = -2
        hit += len(got[ids[i]] & {ids[j] for j in np.argsort(-s)[:10]})
    assert hit >= 0.97 * 70


def test_recall_on_the_tables(spark, sf):
    want, total, found = set(), 0, {tuple(r) for r in v.p5_found(spark, sf).collect()}
    pdf = v.collections(spark, sf).dropDuplicates(["field", "space", "id"]).toPandas()
    for (f, s), g in pdf.groupby(["field", "space"]):
        want |= {(f, s, *p) for p in brute(list(g["id"]), np.array(list(g["vec"])), 0.8, 10)}
    assert len(found & want) >= 0.9 * len(want) and not found - want


def recall(spark, x, **kw):
    """Of the true pairs, by similarities in double precision."""
    u = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(min(i, j), max(i, j)) for i, row in enumerate(s) for j in np.argpartition(-row, 10)[:10] if row[j] >= 0.8}
    got = {(int(r.id_a[1:]), int(r.id_b[1:])) for r in v.similar_pairs(frame(spark, x), **kw).collect()}
    assert not got - want
    return len(got & want) / len(want)


@pytest.mark.parametrize(("n", "kw"), [(600, {}), (1500, {}), (1500, {"block": 100})])
def test_near_copies_in_many_cells_are_compared_with_each_other(spark, n, kw):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3 * n, 96)).astype(np.float32)
    x[:n] = rng.standard_normal(96) + 0.1 * rng.standard_normal((n, 96))
    assert recall(spark, x, per_cell=50, **kw) >= 0.999


def test_recall_does_not_fall_with_the_number_of_cells(spark):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((6000, 96)).astype(np.float32)
    x[3000:] = x[:3000] + 0.68 * rng.standard_normal((3000, 96))
    for per_cell in (600, 100, 30):
        assert recall(spark, x, per_cell=per_cell) >= 0.97

"""Top-N and rank fusion against plain Python."""

import math
import random

from graphweft.llm import ranking, topn


def test_top_n_hot_and_cold_against_brute_force(spark):
    rng = random.Random(1)
    rows = [("hot" if k % 3 else f"g{rng.randrange(20)}", rng.choice([1.0, 2.0, 2.5, -1.0, float(rng.randrange(50))]), f"t{k:05d}", k) for k in range(3000)]
    rows += [(None, 1.0, "x", 1), (None, 2.0, "y", 2)]
    df = spark.createDataFrame(rows, "g string, score double, item string, rank int")
    want = set()
    for g in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:5]
        want |= {(g, r[2], k + 1) for k, r in enumerate(best)}
    for hot in (100, 10**9):
        got = topn.top_n(df, ["g"], "score", "item", 5, hot_rows=hot, ranges=8, salts=3)
        assert {(r.g, r.item, r["rank"]) for r in got.collect()} == want
    assert topn.top_n(df.limit(0), ["g"], "score", "item", 5).count() == 0


def test_all_scores_equal_in_a_hot_group(spark):
    df = spark.createDataFrame([("h", 1.0, f"{k:04d}") for k in range(2000)], "g string, score double, item string")
    got = topn.top_n(df, ["g"], "score", "item", 5, hot_rows=10, ranges=4, salts=4).collect()
    assert sorted(r.item for r in got) == ["0000", "0001", "0002", "0003", "0004"]


def test_latest_usable_row_counts(spark):
    rows = [("a", "t", 1.0, 1), ("a", "t", 9.0, 0), ("a", "t", float("nan"), 5), ("a", "t", None, 6), ("a", "u", None, 1), ("a", "v", 2.0, 3), ("a", "v", 3.0, 3), ("a", "v", 3.0, 3)]
    df = spark.createDataFrame(rows, "s string, t string, score double, at int")
    assert {tuple(r) for r in topn.latest(df, ["s", "t"], "score", "at").collect()} == {("a", "t", 1.0), ("a", "v", 3.0)}


def test_percentiles_cut_and_whole_agree(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), float(rng.randrange(200))) for _ in range(1500)]
    df = spark.createDataFrame(rows, "g string, score double")
    want = {}
    for g in "ab":
        own = [s for x, s in rows if x == g]
        for s in set(own):
            want[g, s] = (2 * sum(v <= s for v in own) - own.count(s)) * ranking.UNIT // (2 * len(own))
    for hot in (10**9, 50):
        assert {(r.g, r.score): r.pct for r in ranking.percentiles(df, ["g"], "score", hot_rows=hot, buckets=7).collect()} == want


def test_fusion_ignores_scale_and_one_outlier(spark):
    rng = random.Random(3)
    rows = []
    for t in range(40):
        q = t / 40
        for k in range(6):
            rows.append(("s", f"a{k}", f"t{t:02d}", math.exp((q + rng.gauss(0, 0.02)) * (k + 1)) * 10**k))
    rows += [("s", f"a{k}", "loud", 1e12 if k == 5 else -1.0) for k in range(6)]
    df = spark.createDataFrame(rows, "source_id string, algorithm string, target_id string, score double").selectExpr("*", "1 AS pct", "'x' AS vector")
    got = [r.target_id for r in ranking.fuse(df, 10).orderBy("rank").collect()]
    assert set(got) == {f"t{t:02d}" for t in range(30, 40)}
    plain = [r.target_id for r in ranking.fuse(df, 10, vectors="scores").collect()]
    assert "loud" not in plain and len(set(plain) & set(got)) >= 8


def test_fusion_edge_cases(spark):
    df = spark.createDataFrame([("s", "a", "t1", 1.0), ("s", "a", "t2", 1.0), (None, "a", "t", 1.0), ("s", None, "t", 1.0), ("s", "a", None, 1.0), ("s", "a", "n", None)], "source_id string, algorithm string, target_id string, score double")
    assert [(r.target_id, r["rank"]) for r in ranking.fuse(df, 10).orderBy("rank").collect()] == [("t1", 1), ("t2", 2)]
    assert ranking.fuse(df.limit(0), 10).count() == 0


def test_found_gives_ten_targets_a_source(spark, sf):
    n = ranking.p1_found(spark, sf).groupBy("source_id").count().collect()
    assert n and all(r["count"] == 10 for r in n)


def test_fusion_against_plain_python(spark):
    rng = random.Random(9)
    rows = []
    for s in "xyz":
        for t in range(60):
            q = rng.random()
            for k in range(5):
                if rng.random() < 0.8 and not (s == "z" and k == 4):
                    rows.append((s, f"a{k}", f"t{t:02d}", rng.random() if k == 3 else q + rng.gauss(0, 0.2)))
    df = spark.createDataFrame([*rows, rows[0], ("x", rows[0][1], rows[0][2], -9.0), ("x", "a0", "t00", float("nan"))], "source_id string, algorithm string, target_id string, score double")
    got = {}
    for r in ranking.percentiles(df.filter("score = score and not isnan(score)"), ["source_id", "algorithm"], "score").collect():
        key = (r.source_id, r.target_id)
        got.setdefault(key, {})[r.algorithm] = max(r.pct, got.get(key, {}).get(r.algorithm, 0))
    want = {}
    for s in "xyz":
        own = {t: p for (x, t), p in got.items() if x == s}
        keep = {}
        for a in sorted({a for p in own.values() for a in p}):
            pairs = [(p[a] // 100000, (sum(p.values()) - p[a]) // (len(p) - 1) // 100000) for p in own.values() if a in p and len(p) > 1]
            n, sx, sy = len(pairs), sum(x for x, _ in pairs), sum(y for _, y in pairs)
            cov, vx, vy = n * sum(x * y for x, y in pairs) - sx * sy, n * sum(x * x for x, _ in pairs) - sx * sx, n * sum(y * y for _, y in pairs) - sy * sy
            keep[a] = int(1000 * cov * cov / (vx * vy)) if cov > 0 else 0
        vec = {}
        for t, p in own.items():
            rest = {a: [v for b, v in p.items() if b != a] for a in keep}
            vec[t] = sorted((keep[a] * p.get(a, ranking.UNIT // 2) + (1000 - keep[a]) * (sum(rest[a]) // len(rest[a]) if rest[a] else ranking.UNIT // 2)) // 1000 for a in keep)
        best = sorted(vec, key=lambda t: ([-v for v in vec[t]], t))[:10]
        want |= {(s, t, k + 1): vec[t] for k, t in enumerate(best)}
    for hot in (10**9, 20):
        assert {(r.source_id, r.target_id, r["rank"]): r.vector for r in ranking.fuse(df, 10, hot_rows=hot).collect()} == want
    items = spark.createDataFrame([("x", "t", 1)], "source_id string, target_id string, parts int")
    assert ranking.with_shares(items, spark.createDataFrame([("x", 2), ("y", 3)], "source_id string, shares int"), 10).count() == 1


def test_one_unrelated_score_does_not_decide(spark):
    """Five scores agree, the sixth is chance: the related targets come first, which leximin of the bare percentiles does not give."""
    rng = random.Random(5)
    rows = []
    for t in range(60):
        good = t < 10
        rows += [("s", f"a{k}", f"t{t:02d}", (10 if good else 0) + rng.random()) for k in range(5)] + [("s", "chance", f"t{t:02d}", rng.random())]
    df = spark.createDataFrame(rows, "source_id string, algorithm string, target_id string, score double")
    want = {f"t{t:02d}" for t in range(10)}
    assert {r.target_id for r in ranking.fuse(df, 10).collect()} == want
    assert len({r.target_id for r in ranking.fuse(df, 10, vectors="scores").collect()} & want) < 10

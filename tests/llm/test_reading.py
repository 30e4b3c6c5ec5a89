"""Reading levels: held-out accuracy on the graded samples, and what has no level."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweft.llm import reading
from graphweft.llm.leaks import runs


@pytest.fixture(scope="module")
def graded(spark, sf):
    rows = spark.read.parquet(f"{sf}/reading_samples.parquet").orderBy("sample_id").collect()
    return [r.text for r in rows], np.array([r.level_no for r in rows])


def test_held_out_accuracy(graded):
    texts, levels = graded
    part = np.arange(len(texts)) % 5
    got = np.zeros(len(texts))
    for k in range(5):
        m = reading.train([t for t, p in zip(texts, part) if p != k], levels[part != k])
        for i in np.nonzero(part == k)[0]:
            got[i] = reading.level(m, texts[i])
    assert np.mean(np.round(got) == levels) > 0.9
    assert np.mean((got >= 3.5) == (levels >= 4)) > 0.97


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        s, y = rng.standard_normal(12), rng.integers(1, 6, 12).astype(float)
        knots, values = reading.isotonic(s, y)
        assert (np.diff(values) > 0).all() and (np.diff(knots) >= 0).all()
        o = np.sort(s), y[np.argsort(s, kind="stable")]
        want = [max(min(np.mean(o[1][a : b + 1]) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]  # max-min formula
        assert np.allclose(sorted(set(np.round(values, 9))), sorted(set(np.round(want, 9))))


def test_ranker_puts_higher_levels_higher():
    rng = np.random.default_rng(3)
    level = rng.integers(1, 6, 80)
    x = np.stack([level + rng.standard_normal(80) * 0.5, rng.standard_normal(80)], 1)
    w = reading.pairwise_ranker(x, level)
    assert w[0] > 3 * abs(w[1])


def test_ranker_against_listed_pairs_and_its_memory():
    rng = np.random.default_rng(4)
    level = rng.integers(1, 6, 90)
    x = np.stack([level + rng.standard_normal(90), *rng.standard_normal((3, 90))], 1)
    i, j = np.nonzero(level[:, None] > level)
    d, w = x[i] - x[j], np.zeros(4)
    for _ in range(40):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        w -= np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-2 * np.eye(4), -(d * p[:, None]).mean(0) + 1e-2 * w)
    for block in (7, 1000):
        assert np.allclose(reading.pairwise_ranker(x, level, block=block), w, atol=1e-7)
    tracemalloc.start()
    reading.pairwise_ranker(rng.standard_normal((3000, 18)), rng.integers(1, 6, 3000), rounds=2)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


#: Sentences of languages that no table has, and English that has hardly a function word.
FOREIGN = [
    "De tabel wordt in de nacht geladen en de rij is in de ochtend klaar, dus we zien de fout in de app. Het systeem is in orde en de test was goed.",
    "Wij hebben gisteren de hele database opnieuw opgebouwd omdat de verbinding steeds wegviel en niemand wist waarom dat zo was.",
    "La banca dati viene caricata ogni notte e il risultato resta disponibile per tutti gli utenti che hanno il permesso di leggere.",
    "Databasen laddas varje natt och resultatet finns tillgängligt för alla användare som har rätt att läsa den på morgonen.",
    "Vi har indlæst hele databasen igen fordi forbindelsen blev afbrudt og ingen vidste hvorfor det skete i nat.",
    "Baza danych jest ladowana kazdej nocy i wynik jest dostepny dla wszystkich uzytkownikow ktorzy maja prawo go czytac.",
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua",
]
ENGLISH = [
    "Distributed transactional consistency guarantees require quorum replication, deterministic conflict resolution, monotonic timestamp allocation, bounded staleness, linearizable acknowledgements throughout geographically heterogeneous deployments.",
    "Photosynthesis converts sunlight into chemical energy, feeding nearly every organism living upon earth today.",
    "Heteroscedastic residual variance undermines ordinary least squares inference despite asymptotic unbiasedness.",
]


def test_language_is_learned(spark, sf, graded):
    texts, levels = graded
    t = lambda n: spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{n}.parquet")
    m, _ = reading.fit_model(t("reading_samples"), t("test_items"), t("documents"))
    assert {"en", "de"} <= set(m["languages"].names) and "un" not in m["languages"].names
    assert [reading.level(m, x) for x in FOREIGN] == [None] * len(FOREIGN)
    assert all(reading.level(m, x) is not None for x in [*ENGLISH, *texts])
    for held_out in ("de", "es", "pt"):  # French, whose words English shares, is told apart only once it is learned
        own = [x for x in reading.labelled_texts(t("documents").filter(F.lower("lang").startswith(held_out)), 30).get(held_out, []) if len(x) > 60]
        rest, _ = reading.fit_model(t("reading_samples"), t("test_items"), t("documents").filter(~F.lower("lang").startswith(held_out)))
        whole = [reading.level(m, x) is None for x in own]
        assert sum((reading.level(rest, x) is None) == y for x, y in zip(own, whole)) >= 0.9 * len(own), held_out


def test_labels_files_and_items(spark, sf, tmp_path, monkeypatch):
    rows = [(k, lang, f"text {k}") for k, lang in enumerate(["en", "EN-us", "eng", "und", None, "x", "english", "de", "DE"] * 12)]
    got = reading.labelled_texts(spark.createDataFrame(rows, "doc_id long, lang string, text string"), 20)
    assert {k: len(v) for k, v in got.items()} == {"en": 20, "de": 20}
    spark.range(60).repartition(6).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert reading.some_files(t, 6).count() == 60 and 0 < reading.some_files(t, 2).count() < 60
    monkeypatch.setattr(reading, "MAX_ITEM_CHARS", 10)
    with pytest.raises(ValueError):
        reading.fit_model(spark.read.parquet(f"{sf}/reading_samples.parquet"), spark.read.parquet(f"{sf}/test_items.parquet"))


def test_prose_leaves_code_logs_and_test_passages_out():
    text = "This is the first sentence of the text.\n```sql\nSELECT a FROM b WHERE c = 1;\n```\n2026-01-02T03:04:05Z INFO a::b node took=3ms\n<p>It goes on here.</p>\nMATCH (a)-[:X]->(b) RETURN a\nthe red fox ran over the old stone wall today"
    seeds = frozenset(runs("the red fox ran over the old stone wall today".split()))
    assert [s for s, _ in reading.prose(text, seeds)] == ["this is the first sentence of the text.", "it goes on here."]


def test_what_has_no_level(spark, sf, graded):
    texts, _ = graded
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Der Index wird gespeichert, sobald die Verbindung geprüft ist und das Netz bereit ist."), (5, "MATCH (n) RETURN n\n" * 40), (6, "too short"), (7, texts[0] * 300), (8, texts[-1]), (9, texts[-1])]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, level string")
    got = {r.doc_id: r.level for r in reading.reading_levels(docs, t("reading_samples"), t("test_items")).collect()}
    assert len(got) == 9 and all(got[k] is None for k in range(1, 7)) and got[7] is not None and got[8] == got[9] is not None
    assert reading.reading_levels(docs.limit(0), t("reading_samples"), t("test_items")).count() == 0

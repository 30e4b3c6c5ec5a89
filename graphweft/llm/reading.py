"""Reading level of each document by a learned linear ranker.

A document's own English prose is cut out first: code, log lines, markup and stretches of test items are left out, and texts whose
prose is not mainly English have no level. Whether it is, a model of letter trigrams tells that is learned from the language labels of a
bounded sample of documents and from the graded samples (:class:`Languages`). The prose becomes a vector of syntax and vocabulary features. A linear ranker is learned
on pairs of graded samples (logistic loss on the difference of their features), and its score is calibrated to a level by isotonic
regression. Training uses at most ``MAX_SAMPLES`` graded texts on the driver; scoring reads each document once, without a shuffle.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweft.llm.leaks import SEED, runs
from graphweft.llm.words import TAG, WORD, plain, words
from graphweft.session import ship, spread, table as read_table

#: Graded samples used for training at most; of more, those with the smallest hashes.
MAX_SAMPLES = 3_000
#: Labelled documents from which languages are learned: so many of each label, those with the smallest hashes, from so many files; labels with
#: fewer than LEAST_LABELLED of them, and the less frequent beyond MAX_LABELS, are not learned.
PER_LABEL, LABEL_FILES, LEAST_LABELLED, MAX_LABELS = 200, 64, 10, 24
#: Characters of test items whose wording can be cut out; more are an error, not a part of them.
MAX_ITEM_CHARS = 50_000_000
#: Prose of fewer words has no level.
LEAST_WORDS = 8
#: Trigrams are hashed to so many numbers; English prose has at least this share of the mean advantage of English over bare letters.
TRIGRAMS, ENGLISH_SHARE = 1 << 15, 0.25

SUBORDINATORS = frozenset("although because before after if unless until when whenever whereas whereby wherein which while whose whom provided since though that notwithstanding inasmuch irrespective whether thereby consequently furthermore accordingly principally".split())
PRONOUNS = frozenset("i you he she we they me him us them my your our it".split())
SUFFIXES = ("tion", "sion", "ment", "ity", "ance", "ence", "ism", "ical", "ive", "ous", "ally", "ably", "ized", "ize", "izes", "ization", "ational", "ness")

FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
STAMP = re.compile(r"\W*\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\s*at [\w.$]+\(")
LOG = re.compile(r"\b(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b.*[=:\[]")
#: A line without any of these signs is neither code nor, but for its time stamp, a log line.
SUSPECT = re.compile(r"[(){}\[\]=;$>:]")
CODE = re.compile(r"^\s*(?:MATCH|MERGE|CREATE|UNWIND|CALL|RETURN|WITH|OPTIONAL|DETACH|SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|SET|def|class|import|return|for|if|while|let|const|var|fn|pub|use|public|private)\b.*[(){}\[\]=;$]|^\s*[{}\[\]();]|[;{}]\s*$|->|=>|\w\(\w*\)|::|\w+=\w+")
SIGNS = re.compile(r"[{}\[\]()<>=;|\\_$#*/@^~]")
LINE_END = re.compile(r"[\r\n]+")
STOPS = re.compile(r"(?<=[.!?])\s+|\n+")
VOWELS = re.compile(r"[aeiouy]+")


def own_lines(text: str) -> str:
    """The text without fenced code, markup, log lines and lines of code."""
    if "```" in text or "~~~" in text:
        text = FENCE.sub("\n", text)
    if "<" in text:
        text = TAG.sub("\n", text)
    kept = []
    for line in LINE_END.split(text):
        if not line or line.isspace() or STAMP.match(line):
            continue
        if SUSPECT.search(line) and (LOG.search(line) or CODE.search(line)) or len(SIGNS.findall(line)) > 0.06 * len(line):
            continue
        kept.append(line)
    return "\n".join(kept)


def prose(text: str, seeds: set | frozenset) -> list[tuple[str, list[str]]]:
    """The sentences and lines of the text that are its own prose, in plain lower case, with their words.

    A sentence of which more than a third of the words stand in runs of test items (``seeds``, tuples of words) is left out.
    """
    out = []
    for s in STOPS.split(plain(own_lines(text))):
        ws = WORD.findall(s)
        if not ws:
            continue
        if seeds:
            hits = [k for k, t in enumerate(zip(ws, ws[1:], ws[2:], ws[3:])) if t in seeds]
            if hits:
                covered, end = 0, 0
                for k in hits:
                    covered += k + SEED - max(k, end)
                    end = k + SEED
                if covered > 0.35 * len(ws):
                    continue
        out.append((s, ws))
    return out


#: Words whose properties a process remembers; when they are more, it starts afresh.
REMEMBERED = 200_000


def trigrams(word: str) -> np.ndarray:
    """Numbers of the letter trigrams of a word with a mark at both ends."""
    c = np.frombuffer(f"^{word}$".encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B1)) ^ (c[1:-1] * np.uint64(0x85EBCA77)) ^ (c[2:] * np.uint64(0xC2B2AE3D))
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)


class Languages:
    """What languages words look like: for each, the log-likelihood of the word's trigrams above that of its bare letters. English is the first.

    Learned from texts by label, smoothed counts of trigrams; ``letters`` are the frequencies of single letters over all languages alike. Wrong
    labels are mended once: each text goes to the language it is most like, then all are learned anew.
    """

    def __init__(self, texts: dict[str, list[list[str]]]):
        self.names = ["en", *sorted(k for k in texts if k != "en")]
        labelled = [(self.names.index(k), Counter(ws)) for k, v in texts.items() for ws in v if ws]
        self._learn(labelled)
        if len(self.names) > 1:
            self._learn([(int(self.of(c).argmax()), c) for _, c in labelled])
        english = [self.of(c)[0] / max(1, sum(len(w) * n for w, n in c.items())) for k, c in labelled if k == 0]
        self.least = ENGLISH_SHARE * float(np.mean(english)) if english else 0.0

    def _learn(self, labelled: list[tuple[int, Counter]]) -> None:
        per = [Counter() for _ in self.names]
        for k, c in labelled:
            per[k].update(c)
        count, letters = np.full((len(self.names), TRIGRAMS), 0.5), Counter()
        for k, words_of in enumerate(per):
            own = Counter()
            for w, n in words_of.items():
                np.add.at(count[k], trigrams(w), n)
                for x in w:
                    own[x] += n
                own["^"] += n
            total = sum(own.values())
            for x, n in own.items():
                letters[x] += n / total
        self.table = np.log(count / count.sum(1, keepdims=True)).T.copy()
        total = sum(letters.values())
        self.letters = {x: math.log(n / total) for x, n in letters.items()}

    def score(self, word: str) -> np.ndarray:
        rare = math.log(1e-5)
        own = [self.letters.get(x, rare) for x in f"^{word}^"]
        return self.table[trigrams(word)].sum(0) - (3 * sum(own) - 2 * (own[0] + own[-1]) - own[1] - own[-2] if len(own) > 3 else sum(own))

    def of(self, counted: Counter) -> np.ndarray:
        out = np.zeros(len(self.names))
        for w, n in counted.items():
            out += n * self.score(w)
        return out


class WordTable:
    """Per word: length, long at 7, 10 and 13 letters, syllables, suffix, subordinator, pronoun, grade (0: unknown), then its likeness to each language."""

    def __init__(self, grades: dict[str, float], languages: Languages):
        self.grades, self.languages, self.width = grades, languages, 9 + len(languages.names)
        self.at, self.rows, self.matrix, self.done = {}, [], np.zeros((0, self.width)), 0

    def row(self, w: str) -> list[float]:
        n = len(w)
        own = [n, n >= 7, n >= 10, n >= 13, max(1, len(VOWELS.findall(w))), w.endswith(SUFFIXES), w in SUBORDINATORS, w in PRONOUNS, self.grades.get(w, 0.0)]
        return own + self.languages.score(w).tolist()

    def of(self, ws: list[str]) -> np.ndarray:
        at = self.at
        try:
            return self.matrix[[at[w] for w in ws]]
        except KeyError:
            pass
        if len(at) > REMEMBERED:
            at.clear()
            self.rows.clear()
            self.done = 0
        for w in set(ws) - at.keys():
            at[w] = len(self.rows)
            self.rows.append(self.row(w))
        if len(self.matrix) < len(self.rows):
            self.matrix = np.zeros((2 * len(self.rows) + 1024, self.width))
            self.done = 0
        self.done = min(self.done, len(self.rows))
        self.matrix[self.done : len(self.rows)] = self.rows[self.done :]
        self.done = len(self.rows)
        return self.matrix[[at[w] for w in ws]]


def features(sentences: list[tuple[str, list[str]]], table: WordTable) -> np.ndarray | None:
    """Syntax and vocabulary features of prose; null if it is too short or not English.

    English: its words are more like English than like each other language, and more so than bare letters by what English prose is on average.
    """
    ws = [w for _, own in sentences for w in own if w.isalpha()]
    if len(ws) < LEAST_WORDS:
        return None
    n = len(ws)
    x = table.of(ws)
    total = x.sum(0)
    lang = total[9:]
    if lang[0] < lang.max() or lang[0] < table.languages.least * total[0]:
        return None
    commas = sum(s.count(",") for s, _ in sentences)
    ends = sum(s.rstrip()[-1:] in ".!?" for s, _ in sentences)
    g = np.sort(x[:, 8])
    g = g[np.searchsorted(g, 0.5) :].tolist() or [3.0]
    k = len(g)
    rates = [sum(g) / k, g[(k - 1) // 4], g[-((k - 1) // 4) - 1], (k - bisect_left(g, 3.5)) / k, (k - bisect_left(g, 4.5)) / k, bisect_right(g, 1.5) / k]
    return np.array([*(total[:8] / n).tolist(), commas / n, math.log(n / max(1, ends)), math.log(n / len(sentences)), *rates])


def word_grades(texts: list[list[str]], levels: np.ndarray, weight: float = 2.0) -> dict[str, float]:
    """The mean level of the samples in which each word stands, drawn to the overall mean by ``weight`` samples."""
    total, count = defaultdict(float), defaultdict(int)
    mean = float(np.mean(levels))
    for ws, level in zip(texts, levels):
        for w in set(ws):
            total[w] += level
            count[w] += 1
    return {w: (total[w] + weight * mean) / (count[w] + weight) for w in total if count[w] >= 2}


def pairwise_ranker(x: np.ndarray, levels: np.ndarray, ridge: float = 1e-2, rounds: int = 40, block: int = 256) -> np.ndarray:
    """Weights of a linear score that puts the higher graded of two samples higher: logistic loss over all graded pairs, by Newton steps.

    Pairs are not listed: gradient and curvature are sums over rows and columns of the matrix of pairs, of which ``block`` rows are made at once.
    """
    levels = np.asarray(levels)
    pairs = max(1, sum(int((levels < v).sum()) * int((levels == v).sum()) for v in np.unique(levels)))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        s = x @ w
        grad, curve = np.zeros(len(w)), np.zeros((len(w), len(w)))
        for lo in range(0, len(x), block):
            own = x[lo : lo + block]
            p = (levels[lo : lo + block, None] > levels) / (1 + np.exp(np.clip(s[lo : lo + block, None] - s, -30, 30)))
            q = p * (1 - p)
            grad -= p.sum(1) @ own - p.sum(0) @ x
            both = own.T @ (q @ x)
            curve += own.T @ (q.sum(1)[:, None] * own) + x.T @ (q.sum(0)[:, None] * x) - both - both.T
        step = np.linalg.solve(curve / pairs + ridge * np.eye(len(w)), grad / pairs + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def isotonic(score: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best rising fit of level to score (pool adjacent violators); between knots it is read off linearly."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean level, weight, sum of scores
    for k in order:
        blocks.append([float(level[k]), 1.0, float(score[k])])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, c, s = blocks.pop()
            a = blocks[-1]
            a[0], a[1], a[2] = (a[0] * a[1] + m * c) / (a[1] + c), a[1] + c, a[2] + s
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


def _alphabetic(sentences: list[tuple[str, list[str]]]) -> list[str]:
    return [w for _, own in sentences for w in own if w.isalpha()]


def train(texts: list[str], levels, seeds=frozenset(), labelled: dict[str, list[str]] | None = None) -> dict:
    """The model: languages, word grades, scaling, weights and calibration. ``labelled`` has texts by language label."""
    own = [prose(t, seeds) for t in texts]
    ws = [_alphabetic(p) for p in own]
    by = {k: [_alphabetic(prose(t, seeds)) for t in v] for k, v in (labelled or {}).items()}
    by["en"] = by.get("en", []) + ws
    languages = Languages(by)
    levels = np.asarray(levels, float)
    grades = word_grades(ws, levels)
    table = WordTable(grades, languages)
    feats = [features(p, table) for p in own]
    ok = np.array([f is not None for f in feats], bool)
    x, y = np.stack([f for f in feats if f is not None]), levels[ok]
    mean, std = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = (x - mean) / std
    w = pairwise_ranker(z, y)
    knots, values = isotonic(z @ w, y)
    return {"languages": languages, "grades": grades, "mean": mean, "std": std, "weights": w, "knots": knots, "values": values}


def level(model: dict, text: str | None, seeds=frozenset(), table: WordTable | None = None) -> float | None:
    """The calibrated level of a text, or null if it has none."""
    if not text or text.isspace():
        return None
    f = features(prose(text, seeds), table or WordTable(model["grades"], model["languages"]))
    if f is None:
        return None
    return float(np.interp(((f - model["mean"]) / model["std"]) @ model["weights"], model["knots"], model["values"]))


def labelled_texts(docs: DataFrame, per_label: int = PER_LABEL) -> dict[str, list[str]]:
    """Texts by language label from ``docs (doc_id, lang, text)``: at most ``per_label`` of each of the ``MAX_LABELS`` most frequent labels.

    A label is the first two letters of a language code; null, ``und`` and what is no code are no labels. Ids are chosen before texts are read.
    """
    code = F.col("lang").rlike(r"\A[A-Za-z]{2,3}(?:[-_].*)?\z") & (F.lower("lang") != "und")
    ids = docs.filter(code).select("doc_id", F.lower(F.left("lang", F.lit(2))).alias("label"))
    labels = [r[0] for r in ids.groupBy("label").count().filter(F.col("count") >= LEAST_LABELLED).orderBy(F.desc("count"), "label").limit(MAX_LABELS).collect()]
    w = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.filter(F.col("label").isin(labels)).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_label).select("doc_id", "label")
    out: dict[str, list[str]] = {}
    for r in docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.col("text").isNotNull()).select("label", "text").orderBy("label", "doc_id").collect():
        out.setdefault(r["label"], []).append(r["text"])
    return out


def fit_model(samples: DataFrame, items: DataFrame, labelled: DataFrame | None = None, max_samples: int = MAX_SAMPLES) -> tuple[dict, frozenset]:
    """The model of the graded samples (``text, level_no``) and of the labelled documents, and the seeds of the test items (``text``)."""
    rows = samples.filter(F.col("text").isNotNull() & F.col("level_no").isNotNull()).orderBy(F.xxhash64("text")).limit(max_samples).select("text", "level_no").collect()
    items = items.select("text").filter(F.col("text").isNotNull()).distinct()
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) > MAX_ITEM_CHARS:
        raise ValueError(f"test items of more than {MAX_ITEM_CHARS} characters")
    seeds = frozenset(s for r in items.collect() for s in runs(words(r["text"])))
    return train([r["text"] for r in rows], [r["level_no"] for r in rows], seeds, labelled_texts(labelled) if labelled is not None else None), seeds


def reading_levels(docs: DataFrame, samples: DataFrame, items: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``doc_id, level double`` of every document (``doc_id, text``); null where it has none (null, blank, no English prose).

    ``labelled (doc_id, lang, text)`` are documents with language labels; without them English is told from bare letters alone.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(fit_model(samples, items, labelled))

    def run(batches):
        model, seeds = sent.value
        own = WordTable(model["grades"], model["languages"])
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "level": pd.array([level(model, t, seeds, own) for t in b["text"]], dtype="Float64")})

    return spread(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, level double")


def some_files(docs: DataFrame, n: int = LABEL_FILES) -> DataFrame:
    """The rows of ``n`` files of a table, evenly spread over it; all of them if there are no more."""
    files = sorted(docs.inputFiles())
    if len(files) <= n:
        return docs
    return docs.sparkSession.read.schema(docs.schema).parquet(*[files[k * len(files) // n] for k in range(n)])


def document_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return reading_levels(docs, read_table(spark, sf_dir, "reading_samples"), read_table(spark, sf_dir, "test_items"), some_files(docs))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_levels(spark, sf_dir).filter(F.col("level") >= 3.5).select("doc_id")


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per rounded level; null is the number without a level."""
    return document_levels(spark, sf_dir).groupBy(F.round("level").cast("int").alias("level_no")).agg(F.count("*").alias("documents"))

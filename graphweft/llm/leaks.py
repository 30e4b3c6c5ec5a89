"""Evaluation items that stand in the corpus, whole, in part or edited.

Items with the same words are one text. A text's runs of ``SEED`` words are its seeds. A seed opens a match if it is rare, standing in at
most ``RARE`` texts, or, in a part of ``WINDOW`` successive seeds (a passage of the shortest length) without a rare one, if it is among the rarest
of that part: so every passage can be found, however many texts share its wording. How many texts a seed stands in is counted once over
all items. Each document is read once per pass over the items: its seeds are joined with those that open a match, and every stretch of
at least ``HITS`` seeds of one text, one of which opens a match, is aligned with that text by Smith-Waterman (match 1, other word, missing or additional
word -2). A document holds an item if at least ``LEAST_WORDS`` words match and the score is at least ``LEAST_SCORE``. Short passages with exchanged
words score less, as does wording that is merely similar; of those only names and numbers differ. So the score need only be
``LEAST_SCORE_SPECIFIC`` if the passage spans ``LEAST_WORDS`` words of the text and all of these that stand in at most ``RARE`` texts match. Of a
text of fewer words all must stand there in order. An alignment with these scores and up to six exchanged words holds at least four seeds
unless every run is shorter than a seed. Texts of fewer than ``SEED`` words are no passages.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweft.llm.words import words
from graphweft.session import checked_broadcast, cut, ship, spread, table

SEED, RARE, HITS, LEAST_WORDS, LEAST_SCORE, LEAST_SCORE_SPECIFIC, PENALTY = 4, 5, 4, 15, 13, 11, 2
#: Seeds of a passage of LEAST_WORDS words.
WINDOW = LEAST_WORDS - SEED + 1
#: Words of item texts that are held in memory at once (about 40 bytes each); more take more passes over the corpus.
WORDS_PER_PASS = 2_000_000
#: Seeds further apart than this many words belong to different stretches; a stretch is aligned with so much text around it.
STRETCH, AROUND = 40, 34


def runs(ws: list[str], n: int = SEED):
    """All runs of ``n`` words, in order."""
    return zip(*[ws[k:] for k in range(n)])


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, list[int], tuple[int, int], tuple[int, int]]:
    """Smith-Waterman on word ids: score, matching words of the item, and the span (end exclusive) in item and document of the best alignment."""
    n, m = len(item), len(doc)
    h = np.zeros((n + 1, m + 1), np.int32)
    slope = PENALTY * np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.zeros(m + 1, np.int32)
        row[1:] = np.maximum(h[i - 1, :-1] + np.where(doc == item[i - 1], 1, -PENALTY), h[i - 1, 1:] - PENALTY)
        np.maximum(row, 0, out=row)
        h[i] = np.maximum.accumulate(row + slope) - slope  # additional words of the document
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    score, to, end, matched = int(h[i, j]), int(i), int(j), []
    while i > 0 and j > 0 and h[i, j] > 0:
        same = item[i - 1] == doc[j - 1]
        if h[i, j] == h[i - 1, j - 1] + (1 if same else -PENALTY):
            i, j = i - 1, j - 1
            if same:
                matched.append(int(i))
        elif h[i, j] == h[i - 1, j] - PENALTY:
            i -= 1
        else:
            j -= 1
    return score, matched, (int(i), to), (int(j), end)


def seed_codes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each run of ``SEED`` word ids, and whether all its words are known (not -1)."""
    if len(ids) < SEED:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    code, known = np.zeros(len(ids) - SEED + 1, np.uint64), np.ones(len(ids) - SEED + 1, bool)
    for k in range(SEED):
        part = ids[k : len(ids) - SEED + 1 + k]
        code = (code ^ (part.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        known &= part >= 0
    return code, known


class ItemTexts:
    """Some item texts in memory: their words as numbers, and the seeds that open a match with the texts they stand in."""

    def __init__(self, rows: list[tuple[int, list[str], list[int], list[int]]]):
        """``rows``: number of the text, its words, the positions of the seeds that open a match and of the words that stand in few texts."""
        self.ids: dict[str, int] = {}
        for r in rows:
            for w in r[1]:
                self.ids.setdefault(w, len(self.ids))
        self.names = [r[0] for r in rows]
        self.coded = [np.array([self.ids[w] for w in r[1]], np.int32) for r in rows]
        self.specific = [frozenset(r[3]) for r in rows]
        codes = [seed_codes(c)[0] for c in self.coded]
        self.seeds = [np.unique(c) for c in codes]
        opening = [np.unique(c[np.asarray(at, np.int64)]) if len(at) else c[:0] for c, (_, _, at, _) in zip(codes, rows)]
        flat = np.concatenate([*opening, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.codes, self.first = np.unique(flat[order], return_index=True)
        self.last = np.append(self.first[1:], len(flat)).astype(np.int64)
        self.texts = np.repeat(np.arange(len(rows)), [len(o) for o in opening])[order]

    def stretches(self, codes: np.ndarray, known: np.ndarray) -> list[tuple[int, int, int]]:
        """``(text, first, last)``: seed positions of each stretch of a document that may hold a text."""
        at = np.flatnonzero(known)
        hit = at[_among(codes[at], self.codes)]
        opens: dict[int, list[int]] = {}
        for p, i in zip(hit.tolist(), np.searchsorted(self.codes, codes[hit]).tolist()):
            for t in self.texts[self.first[i] : self.last[i]].tolist():
                opens.setdefault(t, []).append(p)
        out = []
        for t, opened in opens.items():
            own = self.seeds[t]
            mine = at[_among(codes[at], own)]
            ends = np.flatnonzero(np.diff(mine) > STRETCH) + 1
            for part in np.split(mine, ends):
                if len(part) >= min(HITS, len(self.coded[t]) - SEED + 1) and any(part[0] <= p <= part[-1] for p in opened):
                    out.append((t, int(part[0]), int(part[-1])))
        return out

    def held(self, t: int, score: int, matched: list[int], span: tuple[int, int]) -> bool:
        """Whether an alignment with a text is a passage of it."""
        n = len(self.coded[t])
        if n < LEAST_WORDS:
            return score == n
        if len(matched) >= LEAST_WORDS and score >= LEAST_SCORE:
            return True
        if score < LEAST_SCORE_SPECIFIC or span[1] - span[0] < LEAST_WORDS:
            return False
        return self.specific[t].intersection(range(*span)) <= set(matched)

    def leaks_in(self, texts: list[str]) -> list[tuple[int, int, int, int, str]]:
        """``(position, number of the text, matching words, score, passage)`` for every item text that stands in each of ``texts``; the best stretch of each."""
        split = [words(t) for t in texts]
        size = np.array([len(ws) + 1 for ws in split], np.int64)
        start = np.cumsum(size) - size
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for ws in split for w in (*ws, None)), np.int32, size.sum())  # None: between two documents
        codes, known = seed_codes(ids)
        at = np.flatnonzero(known)
        at = at[_among(codes[at], self.codes)]
        out = []
        for d in np.unique(np.searchsorted(start, at, "right") - 1).tolist():
            ws, lo, n = split[d], start[d], max(0, len(split[d]) - SEED + 1)
            best: dict[int, tuple[int, int, str]] = {}
            for t, first, last in self.stretches(codes[lo : lo + n], known[lo : lo + n]):
                a, b = max(0, first - AROUND), min(len(ws), last + SEED + AROUND)
                score, matched, span, (x, y) = align(self.coded[t], ids[lo + a : lo + b])
                if self.held(t, score, matched, span) and (t not in best or best[t][1] < score):
                    best[t] = (len(matched), score, " ".join(ws[a + x : a + y]))
            out += [(d, self.names[t], *v) for t, v in sorted(best.items())]
        return out


def _among(codes: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(codes), bool)
    return ordered[np.minimum(np.searchsorted(ordered, codes), len(ordered) - 1)] == codes


def _parts(docs: list, texts: list, most: int = 2_000_000):
    """The documents with text, in parts of about ``most`` characters."""
    ids, own, size = [], [], 0
    for d, t in zip(docs, texts):
        if t:
            ids.append(d)
            own.append(t)
            size += len(t)
            if size >= most:
                yield ids, own
                ids, own, size = [], [], 0
    yield ids, own


def item_texts(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different texts of ``items (item_id, text)``: ``text_id, ws, opening, specific`` (words, positions of the seeds that open a
    match and of the words that stand in at most ``RARE`` texts), and which item holds which: ``text_id, item_id``. Of repeated item ids one text counts; items without words are left out."""

    def split(batches):
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "ws": [words(t) for t in b["text"]]})

    one = items.select("item_id", "text").filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).groupBy("item_id").agg(F.max("text").alias("text"))
    each = one.mapInPandas(split, "item_id long, ws array<string>").filter(F.size("ws") > 0)
    each = cut(each.withColumn("h", F.xxhash64("ws")))
    texts = cut(each.groupBy("h", "ws").agg(F.min("item_id").alias("text_id")))
    members = each.join(texts, ["h", "ws"]).select("text_id", "item_id")
    seeds = texts.filter(F.size("ws") >= SEED).select("text_id", (F.size("ws") - SEED).alias("end"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("ws") - SEED + 1), lambda k: F.xxhash64(F.slice("ws", k, SEED)))).alias("pos", "seed"))
    common = seeds.select("text_id", "seed").distinct().groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") > RARE)
    seeds = seeds.join(common, "seed", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    w = Window.partitionBy("text_id").orderBy("pos")
    whole = (F.col("pos") + WINDOW - 1 <= F.col("end")) | (F.col("pos") == 0)
    seeds = seeds.withColumn("least", F.when(whole, F.min("n").over(w.rowsBetween(0, WINDOW - 1))))
    opens = F.col("n") == F.greatest(F.lit(1), F.max("least").over(w.rowsBetween(1 - WINDOW, 0)))
    opening = seeds.withColumn("opens", (F.col("n") == 1) | opens).filter("opens").groupBy("text_id").agg(F.sort_array(F.collect_list("pos")).alias("opening"))
    at = texts.select("text_id", F.posexplode("ws").alias("pos", "word"))
    usual = at.select("text_id", "word").distinct().groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") > RARE)
    specific = at.join(usual, "word", "left_anti").groupBy("text_id").agg(F.sort_array(F.collect_list("pos")).alias("specific"))
    none = F.array().cast("array<int>")
    return texts.join(opening, "text_id").join(specific, "text_id", "left").select("text_id", "ws", "opening", F.coalesce("specific", none).alias("specific")), members


def leaks(docs: DataFrame, items: DataFrame, words_per_pass: int = WORDS_PER_PASS) -> DataFrame:
    """``doc_id, item_id, words, score, passage`` for every document (``doc_id, text``) that holds an item (``item_id, text``).

    Null, empty and short texts hold nothing; of repeated item ids one text counts, and each of several items of the same words is
    reported. Texts come to the driver in passes of about ``words_per_pass`` words, which changes no result; documents are never
    shuffled or collected.
    """
    spark = docs.sparkSession
    ship(spark)
    texts, members = item_texts(items)
    texts = cut(texts)
    total = texts.agg(F.coalesce(F.sum(F.size("ws")), F.lit(0))).first()[0]
    passes = max(1, -(-total // words_per_pass))
    out = None
    for p in range(passes):
        rows = texts.filter(F.pmod(F.xxhash64("text_id"), F.lit(passes)) == p).collect()
        sent = spark.sparkContext.broadcast(ItemTexts([tuple(r) for r in rows]))

        def run(batches, sent=sent):
            own = sent.value
            for b in batches:
                found = [(ids[k], *x) for ids, own_texts in _parts(b["doc_id"], b["text"]) for k, *x in own.leaks_in(own_texts)]
                yield pd.DataFrame(found, columns=["doc_id", "text_id", "words", "score", "passage"])

        one = spread(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, text_id long, words int, score int, passage string")
        out = one if out is None else out.unionByName(one)
    return out.join(checked_broadcast(cut(members)), "text_id").select("doc_id", "item_id", "words", "score", "passage")


def corpus_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: documents that hold it and the longest passage; items that did not leak count 0."""
    n = corpus_leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest"))
    items = table(spark, sf_dir, "test_items").select("item_id", "suite").dropDuplicates(["item_id"])
    return items.join(n, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("longest", F.lit(0)).alias("longest"))

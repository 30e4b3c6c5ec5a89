"""Chunking and the text of an entity. Character chunks are Columns; sentences and tokens go through Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.session import ship


def by_chars(df: DataFrame, text: str, size: int, overlap: int = 0) -> DataFrame:
    """One row per chunk: ``chunk_no, chunk, char_offset, char_length`` beside the other columns; null and empty texts give none."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    step = max(size - overlap, 1)
    n = F.length(text)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    rows = df.filter(n > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("chunk_no") * step
    return rows.withColumn("char_offset", start).withColumn("chunk", F.substring(F.col(text), start + 1, F.lit(size))).withColumn("char_length", F.length("chunk"))


def sentence_chunks(text: str, size: int) -> list[tuple[int, str]]:
    """``(offset, chunk)``: whole sentences (ending in ``. ! ?`` or a line end) as long as they fit; a longer sentence is one chunk."""
    out: list[tuple[int, str]] = []
    current, start, at = [], 0, 0
    have = 0
    for s in re.findall(r"[^.!?\n]*[.!?\n]|[^.!?\n]+", text):
        if have and have + len(s) > size:
            out.append((start, "".join(current)))
            current, start, have = [], at, 0
        current.append(s)
        have += len(s)
        at += len(s)
    if current:
        out.append((start, "".join(current)))
    return out


def by_sentences(df: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    ship(df.sparkSession)
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        for b in batches:
            rows = [(i, k, c, o, len(c)) for i, t in zip(b[id_col], b[text]) if t for k, (o, c) in enumerate(sentence_chunks(t, size))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_no", "chunk", "char_offset", "char_length"])

    return df.select(id_col, text).mapInPandas(run, f"`{id_col}` {kind}, chunk_no int, chunk string, char_offset int, char_length int")


def token_chunks(text: str, size: int, overlap: int, count) -> list[str]:
    """Chunks of at most ``size`` tokens as ``count`` counts them; found by bisection, trimmed, with about ``overlap`` tokens repeated."""
    if size <= 0 or count(text) <= size:
        return [text.strip() or text]
    overlap = min(max(overlap, 0), size - 1)
    out, start = [], 0
    while start < len(text):
        low, high = start + 1, len(text)
        while low < high:  # the longest piece that fits
            mid = (low + high + 1) // 2
            low, high = (mid, high) if count(text[start:mid]) <= size else (low, mid - 1)
        end = low
        if text[start:end].strip():
            out.append(text[start:end].strip())
        if end >= len(text):
            break
        nxt = end
        if overlap:
            low, high = start + 1, end
            while low < high:  # the earliest place from which no more than the overlap is repeated
                mid = (low + high) // 2
                low, high = (low, mid) if count(text[mid:end]) <= overlap else (mid + 1, high)
            nxt = low
        start = nxt
    return out or [text.strip() or text]


def by_tokens(df: DataFrame, id_col: str, text: str, size: int, overlap: int = 0, count=None) -> DataFrame:
    """Chunks by a token counter (words by default)."""
    ship(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    count = count or (lambda t: len(t.split()))

    def run(batches):
        for b in batches:
            rows = [(i, k, c) for i, t in zip(b[id_col], b[text]) if t for k, c in enumerate(token_chunks(t, size, overlap, count))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_no", "chunk"])

    return df.select(id_col, text).mapInPandas(run, f"`{id_col}` {kind}, chunk_no int, chunk string")


def entity_text(labels: Column, properties: dict[str, Column]) -> Column:
    """``labels: a, b`` and one ``key: value`` line per property that is not null, in order of key; ``node`` if there is nothing."""
    lines = [F.when(F.size(labels) > 0, F.concat(F.lit("labels: "), F.concat_ws(", ", labels)))]
    lines += [F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in sorted(properties.items())]
    text = F.concat_ws("\n", *lines)
    return F.when(text == "", "node").otherwise(text)


def mean_vector(v: Column, weight: float = 1.0) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x) * weight / F.size(v)


def normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def softmax(v: Column) -> Column:
    m = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - m))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def batch_nearest(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """``id, neighbour, score``: the nearest other row of ``vectors (id, vector)`` for each of ``queries (id, vector)``, by cosine; ties by id.

    A stated set of queries against all rows. Queries come to every task in blocks of 1,000 as a broadcast, each vector is read once per
    block, and only the best of each partition is shuffled. Vectors of another length than the query, null and all-zero ones are left out.
    """
    from functools import reduce

    from graphweft.functions.scalars import cosine
    from graphweft.session import cut

    numbered = cut(queries.select("id", "vector").filter(F.col("vector").isNotNull()).dropDuplicates(["id"]))
    blocks = max(1, -(-numbered.count() // 1_000))
    v = vectors.select(F.col("id").alias("neighbour"), F.col("vector").alias("other")).filter(F.col("other").isNotNull())

    def one(k: int) -> DataFrame:
        part = numbered if blocks == 1 else numbered.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
        near = v.join(F.broadcast(part), (F.col("id") != F.col("neighbour")) & (F.size("vector") == F.size("other")))
        near = near.select("id", "neighbour", cosine(F.col("vector"), F.col("other")).alias("score")).filter(F.col("score").isNotNull() & ~F.isnan("score"))
        return near.groupBy("id").agg(F.max("score").alias("score"), F.min_by("neighbour", F.struct(-F.col("score"), F.col("neighbour"))).alias("neighbour")).select("id", "neighbour", "score")

    return reduce(DataFrame.unionByName, [one(k) for k in range(blocks)])

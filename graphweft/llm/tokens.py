"""Encoding of the corpus with a public byte-level BPE vocabulary.

The library ``tiktoken`` encodes with a local rank file; the driver reads the file and broadcasts its bytes (below 1 MB), each worker
process builds the encoder once. Long texts are cut before a space that stands between two characters that are no white space: the
pre-splitting pattern starts a new piece at every such space, so the ids of the parts are the ids of the whole. Decoding joins the
raw bytes of all ids before it reads them as UTF-8, as one character may be spread over several ids.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.session import ship, spread, table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the vocabulary's pre-splitting pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space this long are one piece by the pattern; they are encoded without it, as the library's matcher overflows on them.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}")
#: Texts above this many characters are encoded in parts of about this size.
PART_CHARS = 100_000

_encoders: dict = {}


def read_ranks(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> bytes:
    with open(f"{folder}/{vocabulary}.tiktoken", "rb") as f:
        return f.read()


def encoder(ranks: bytes):
    """The encoder of a rank file, once per process."""
    key = hash(ranks)
    if key not in _encoders:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _encoders[key]


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """``text`` cut at safe boundaries into parts of at least ``size`` characters (the last may be shorter)."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        while cut != -1 and (cut + 1 >= len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        out.append(text[start:cut])
        start = cut
    out.append(text[start:])
    return out


def encode_text(enc, text: str | None, size: int = PART_CHARS) -> list[int]:
    """Ids without special tokens; what looks like one is ordinary text. Null and empty texts give no ids."""
    if not text:
        return []
    if len(text) <= min(size, 2_000):
        return enc.encode_ordinary(text)
    out: list[int] = []
    start = 0
    for run in LONG_RUN.finditer(text):
        # The last character of a run stays with the text that follows.
        end = run.end() - (run.end() < len(text))
        for p in parts(text[start : run.start()], size):
            out.extend(enc.encode_ordinary(p))
        out.extend(enc._encode_single_piece(text[run.start() : end]))
        start = end
    for p in parts(text[start:], size):
        out.extend(enc.encode_ordinary(p))
    return out


def decode_ids(enc, ids) -> str:
    return b"".join(enc.decode_single_token_bytes(int(i)) for i in ids).decode("utf-8", errors="replace")


def encode(df: DataFrame, column: str = "text", out: str = "ids", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without ``column`` and with ``out array<int>``; a column of the name ``out`` is replaced. No shuffle, rows stay in place."""
    spark = df.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(folder, vocabulary))
    keep = [c for c in df.columns if c not in (column, out)]
    src = spread(df.select(*keep, F.col(column).alias("__text")))
    schema = src.drop("__text").withColumn(out, F.array().cast("array<int>")).schema

    def run(batches):
        enc = encoder(ranks.value)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                s = b.slice(lo, 500)
                ids = [np.asarray(encode_text(enc, t), np.int32) for t in s.column("__text").to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*s.columns[:-1], lists], names=[*keep, out])

    return src.mapInArrow(run, schema)


def decode(df: DataFrame, column: str = "ids", out: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without ``column`` and with ``out string``: the text of the ids; a null list gives null, an empty one the empty text."""
    spark = df.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(folder, vocabulary))
    keep = [c for c in df.columns if c not in (column, out)]
    src = df.select(*keep, F.col(column).alias("__ids"))
    schema = src.drop("__ids").withColumn(out, F.lit("").cast("string")).schema

    def run(batches):
        enc = encoder(ranks.value)
        for b in batches:
            texts = [None if x is None else decode_ids(enc, x) for x in b.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*keep, out])

    return src.mapInArrow(run, schema)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p6_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and characters per source and type of the corpus, and how many texts do not come back from their ids."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_type", F.coalesce("text", F.lit("")).alias("text"))
    ids = encode(docs.withColumn("copy", F.col("text")))
    back = decode(ids.withColumn("n", F.size("ids").cast("long")), out="again")
    return back.groupBy("source", "doc_type").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.sum(F.length("copy").cast("long")).alias("chars"), F.count_if(F.col("copy") != F.col("again")).alias("broken"))

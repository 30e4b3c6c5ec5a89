"""BM25 full-text search over any table.

Postings are one row per document and term with its frequency, made by ``explode`` and one aggregation; document frequencies and
lengths come from the same postings. A query joins its few terms, which are broadcast, with the postings: only matching rows are
scored and shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: BM25 constants, and weight, shortest token and number of terms of prefix expansion.
K1, B = 1.2, 0.75
PREFIX_WEIGHT, PREFIX_LENGTH, PREFIX_TERMS = 0.8, 3, 32
#: Stop words.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of at least two bytes, without stop words; null gives none."""
    parts = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: (F.octet_length(t) >= 2) & ~t.isin(*STOP_WORDS))


def index_text(columns: list[str]) -> Column:
    return F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in columns])


def postings(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``id, term, tf, len``: one row per document and term."""
    t = df.select(F.col(f"`{id_col}`").alias("id"), tokens(text).alias("t")).withColumn("len", F.size("t"))
    return t.select("id", "len", F.explode("t").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def query_terms(query: str, lexicon: DataFrame, expand: bool = True) -> DataFrame:
    """``term, weight``: 1 per occurrence in the query, and 0.8 for each of up to 32 terms a token is the beginning of, in term order.

    At most a query's own words and 32 terms for each: few enough to broadcast.
    """
    spark = lexicon.sparkSession
    found = _found(query)
    own = spark.createDataFrame([(t, 1.0) for t in found], "term string, weight double")
    long = [t for t in found if len(t.encode()) >= PREFIX_LENGTH]
    if expand and long:
        occurrences = spark.createDataFrame([(k, t) for k, t in enumerate(long)], "k int, token string")
        hits = lexicon.join(F.broadcast(occurrences), F.startswith("term", F.col("token")) & (F.col("term") != F.col("token")))
        w = Window.partitionBy("k").orderBy("term")
        own = own.unionByName(hits.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= PREFIX_TERMS).select("term", F.lit(PREFIX_WEIGHT).alias("weight")))
    return own.groupBy("term").agg(F.sum("weight").alias("weight"))


def _found(query: str) -> list[str]:
    import re

    return [t for t in (x.lower() for x in re.findall(r"[^\W_]+", query)) if len(t.encode()) >= 2 and t not in STOP_WORDS]


def bm25(df: DataFrame, id_col: str, text: Column, query: str, expand: bool = True) -> DataFrame:
    """``id, score`` of the documents with any query term, not sorted. Documents without tokens count in N, not in the lengths' sum.

    Only tokens the query can reach (its own, and those it is a beginning of) are exploded and shuffled; the other tokens count for the
    length of their document alone.
    """
    wanted = _found(query)
    if not wanted:
        return df.select(F.col(f"`{id_col}`").alias("id"), F.lit(0.0).alias("score")).limit(0)
    long = [t for t in wanted if len(t.encode()) >= PREFIX_LENGTH] if expand else []

    def reached(t: Column) -> Column:
        out = t.isin(*wanted)
        for w in long:
            out = out | F.startswith(t, F.lit(w))
        return out

    docs = df.select(F.col(f"`{id_col}`").alias("id"), tokens(text).alias("t"))
    stats = docs.agg(F.count("*").alias("docs"), F.avg(F.size("t")).alias("avg_len"))
    p = docs.select("id", F.size("t").alias("len"), F.explode(F.filter("t", reached)).alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    df_of = p.groupBy("term").agg(F.count("*").alias("df"))
    terms = query_terms(query, df_of.select("term"), expand)
    weighted = df_of.join(F.broadcast(terms), "term").crossJoin(F.broadcast(stats))
    idf = F.greatest(F.lit(0.0), F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weighted = weighted.select("term", (F.col("weight") * idf).alias("w"), "avg_len")
    hit = p.join(F.broadcast(weighted), "term")
    tf = F.col("tf").cast("double")
    score = F.col("w") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return hit.groupBy("id").agg(F.sum(score).alias("score")).filter(F.col("score") > 0)


def token_matches(df: DataFrame, id_col: str, text: Column, query: str) -> DataFrame:
    """``id, matches``: how many of the query's distinct tokens each document has."""
    import re

    wanted = sorted({t.lower() for t in re.findall(r"[^\W_]+", query) if len(t.encode()) >= 2} - set(STOP_WORDS))
    n = F.size(F.array_intersect(tokens(text), F.array(*map(F.lit, wanted)).cast("array<string>")))
    return df.select(F.col(f"`{id_col}`").alias("id"), n.cast("long").alias("matches")).filter(F.col("matches") > 0)


def lexical_seeds(df: DataFrame, id_col: str, text: Column, limit: int) -> DataFrame:
    """``id, idf``: the documents with the rarest terms, by their highest inverse document frequency, then id."""
    p = postings(df, id_col, text)
    docs = df.agg(F.count("*").alias("docs"))
    idf = p.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(docs)).select("term", F.greatest(F.lit(0.0), F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))
    return p.join(idf, "term").groupBy("id").agg(F.max("idf").alias("idf")).orderBy(F.desc("idf"), "id").limit(limit)

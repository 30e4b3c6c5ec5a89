"""Vector search, fusion of ranked lists and diversity reranking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.functions.scalars import cosine, euclidean
from graphweft.session import ship

#: Fixed value: the constant of reciprocal rank fusion.
RRF_K = 60


def knn(df: DataFrame, id_col: str, vector_col: str, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """``id, score``: the ``k`` nearest rows; cosine similarity or ``1 / (1 + distance)``, ties by id. Rows of another length are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(f"`{vector_col}`")
    score = cosine(v, q) if metric == "cosine" else 1 / (1 + euclidean(v, q))
    return df.select(F.col(f"`{id_col}`").alias("id"), score.alias("score")).filter(F.col("score").isNotNull() & ~F.isnan("score")).orderBy(F.desc("score"), "id").limit(k)


def rescore(candidates: DataFrame, vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """``id, score`` of the candidates (``id``) by the stored vectors (``id, vector``): exact cosine, the best ``k``."""
    return knn(vectors.join(candidates.select("id").distinct(), "id", "left_semi"), "id", "vector", query, k)


def ranked(hits: DataFrame) -> DataFrame:
    """Adds ``rank`` from 1 by score, then id. Meant for result lists that were cut to a limit."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def rrf(lists: dict[str, DataFrame], weights: dict[str, float] | None = None, k: float = RRF_K, min_score: float = 0.0) -> DataFrame:
    """``id, rrf_score, best_score, <name>_rank ...`` of several ranked lists ``id, score, rank``, best first.

    Each list adds ``weight / (k + rank)``; ties go by best score, then id. An item absent from a list has rank 0 there.
    """
    weights = weights or {}
    rows = None
    for name, df in lists.items():
        part = df.select("id", "score", "rank", F.lit(name).alias("source"), (F.lit(float(weights.get(name, 1.0))) / (max(k, 1) + F.greatest("rank", F.lit(1)))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    ranks = [F.coalesce(F.max(F.when(F.col("source") == n, F.col("rank"))), F.lit(0)).alias(f"{n}_rank") for n in lists]
    out = rows.groupBy("id").agg(F.sum("part").alias("rrf_score"), F.max("score").alias("best_score"), *ranks)
    return out.filter(F.col("rrf_score") >= min_score).orderBy(F.desc("rrf_score"), F.desc("best_score"), "id")


def mmr_order(scores: np.ndarray, vectors: list, lam: float) -> list[int]:
    """Greedy maximal marginal relevance over a result list; items without a vector have similarity 0 to all."""
    n = len(scores)
    if n <= 1 or lam >= 1:
        return list(range(n))
    size = max((len(v) for v in vectors if v is not None), default=1)
    x = np.array([v if v is not None and len(v) == size else [0.0] * size for v in vectors], float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.where(norm > 0, x / np.maximum(norm, 1e-12), 0)
    closest, left, out = np.zeros(n), np.ones(n, bool), []
    for _ in range(n):
        value = np.where(left, lam * scores - (1 - lam) * closest, -np.inf)
        pick = int(value.argmax())
        out.append(pick)
        left[pick] = False
        closest = np.maximum(closest, x @ x[pick])
    return out


def mmr(hits: DataFrame, group: str, lam: float = 0.7) -> DataFrame:
    """``hits (group, id, score, vector)`` with ``new_rank`` per group; groups are result lists of limited length."""

    ship(hits.sparkSession)

    def rerank(pdf):
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        order = mmr_order(pdf["score"].to_numpy(float), list(pdf["vector"]), lam)
        pdf["new_rank"] = 0
        pdf.loc[order, "new_rank"] = range(1, len(pdf) + 1)
        return pdf[[group, "id", "score", "new_rank"]]

    kinds = dict(hits.dtypes)
    return hits.select(group, "id", "score", "vector").groupBy(group).applyInPandas(rerank, f"`{group}` {kinds[group]}, id {kinds['id']}, score double, new_rank long")


def rerank_with(hits: DataFrame, text: str, scorer) -> DataFrame:
    """Rerank by an external scorer: a function of a pandas Series of texts to a Series of scores (a cross encoder, for example)."""
    from pyspark.sql.functions import pandas_udf

    score = pandas_udf(scorer, "double")
    return hits.withColumn("final_score", score(F.col(text))).orderBy(F.desc("final_score"), "id")


def redact(hits: DataFrame, labels: Column, denied: list[str], columns: list[str]) -> DataFrame:
    """Null the given columns of hits that carry a denied label."""
    bad = F.arrays_overlap(labels, F.array(*map(F.lit, denied)).cast("array<string>"))
    for c in columns:
        hits = hits.withColumn(c, F.when(~F.coalesce(bad, F.lit(False)), F.col(c)))
    return hits


def hydrate(hits: DataFrame, entities: DataFrame, denied_labels: list[str] = (), denied_sources: list[str] = (), redacted: list[str] = (), require: bool = False) -> DataFrame:
    """``hits (id, label, sources, ...)`` with the ``labels`` and other columns of ``entities (id, labels, ...)``.

    Hits with a denied label or source are left out, as are those without an entity if one is required; without one the label of the hit counts.
    ``redacted`` names columns, or fields of struct columns by path, that become null; what is not there is ignored. Of repeated entities any counts.
    """
    out = hits.join(entities.dropDuplicates(["id"]), "id", "inner" if require else "left")
    labels = F.coalesce("labels", F.array("label"))
    none = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    out = out.withColumn("labels", labels).filter(~F.coalesce(F.arrays_overlap("labels", none(denied_labels)), F.lit(False)) & ~F.coalesce(F.arrays_overlap("sources", none(denied_sources)), F.lit(False)))
    for path in redacted:
        column, _, rest = path.partition(".")
        if column not in out.columns or column in hits.columns:
            continue
        kind = out.schema[column].dataType
        try:
            field = T.StructType([out.schema[column]])
            for part in path.split("."):
                field = field[part].dataType
        except (KeyError, TypeError):
            continue
        empty = F.lit(None).cast(field)
        out = out.withColumn(column, F.col(column).withField(rest, empty) if rest else F.lit(None).cast(kind))
    return out

"""Most similar vectors by randomly rotated one-bit codes.

Each unit vector is padded to a multiple of 64 dimensions and turned by a random rotation that depends on the dimension only; its code is
the signs of what lies between it and the centroid of its cell, 16 bytes for 96 or 128 dimensions, with three correction scalars; in
:func:`similar_pairs` a second bit for each dimension tells large values from small ones.
Against a query that is quantised to four bits per dimension the inner product is estimated from counts of common bits; the error of
the estimate is bounded with the scalars (the closer both are to the centroid, the tighter), and only vectors whose upper bound
reaches what is asked for are reranked with the stored vectors.

:func:`similar_pairs` finds the pairs above a similarity among the ten most similar of every vector: exact copies are first merged,
then vectors are sorted into cells around centroids that are fitted on a bounded sample (``SAMPLE`` vectors a collection); the codes
of a vector, not the vector, go to its nearest cells, the more of them the more cells there are (:func:`reach`), and as a query it
looks into its nearest one. Cells around which the vectors lie so close together that their order is finer than the codes are one
crowd (:func:`crowds`): its vectors themselves are compared, all with all. What grows beyond ``BLOCK`` rows is cut into blocks.

:func:`nearest` gives the ten most similar vectors for a stated set of queries by comparing their codes with all codes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweft.session import cut, discard, settle, ship, table

#: Vectors per collection on which centroids are fitted; vectors per cell aimed at; most cells of a collection; cells a code goes to,
#: for each doubling of the number of cells.
SAMPLE, PER_CELL, MAX_CELLS, PROBES = 40_000, 1_200, 8_192, 2
#: Rows of a cell that one task compares at once; in a crowd, CROWD_BLOCKS times as many.
BLOCK, CROWD_BLOCKS = 8_192, 4
#: Queries that one task of :func:`nearest` compares at once.
QUERIES = 8_192
#: Cells are one crowd if the mean similarity of their vectors is less than this below the similarity asked for; rounding of single precision.
SLACK, ROUNDING = 0.1, 2e-6
#: Best levels of two bits for normally distributed values, and where the larger one begins.
LEVELS, LARGE = (0.4528, 1.51), 0.9816
#: The bounds lie this many standard deviations from the estimate: against the similarity asked for, and against a query's k-th best.
EPSILON, EPSILON_KTH = 3.0, 1.9
#: An exact copy is visible to others if it is among this many first ids of its group (k + 1: enough for k neighbours).
K = 10

CODE = "coll int, cell int, bb int, qb int, role byte, codes binary"


def usable(v: Column, dims: Column) -> Column:
    """Of the right length, finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dims) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with the greatest ``order`` of each key. Only keys and order are shuffled; keys with one version need no join."""
    last = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_m"), F.min(F.struct(*order)).alias("_l")).filter(F.col("_m") != F.col("_l")).select(*keys, "_m")
    return df.join(last, keys, "left").filter(F.col("_m").isNull() | (F.struct(*order) == F.col("_m"))).drop("_m")


def collections(spark: SparkSession, sf_dir: str, dims: int = 96) -> DataFrame:
    """Every usable vector: ``field, space, id, vec``. Exact copies of a row may stand twice.

    ``vector_entries``: the latest version of each (space, id), by updated_at then entry_id, with the dimensions its row names;
    ``named_embeddings`` and ``chunk_embeddings``: ``dims`` dimensions; of a node with several lives the vectors of the latest one
    count. Null keys, ids and maps have no vectors.
    """
    e = table(spark, sf_dir, "vector_entries").select("space", "id", "updated_at", "entry_id", F.col("dimensions").alias("d"), F.col("vector").alias("vec"))
    e = _newest(e.filter(F.col("id").isNotNull() & F.col("space").isNotNull()), ["space", "id"], ["updated_at", "entry_id"])
    e = e.filter(usable(F.col("vec"), F.col("d"))).select(F.lit("vector_entries").alias("field"), "space", "id", "vec")
    n = table(spark, sf_dir, "nodes").select("id", "created_at_unix_ms", "updated_at_unix_ms", "named_embeddings", "chunk_embeddings")
    n = n.filter(F.col("id").isNotNull() & ((F.size("named_embeddings") > 0) | (F.size("chunk_embeddings") > 0)))
    n = _newest(n, ["id"], ["created_at_unix_ms", "updated_at_unix_ms"])
    named = F.transform(F.map_entries("named_embeddings"), lambda x: F.struct(F.lit("named_embeddings").alias("field"), x["key"].alias("space"), F.col("id").alias("id"), x["value"].alias("vec")))
    chunks = F.transform("chunk_embeddings", lambda v, i: F.struct(F.lit("chunk_embeddings").alias("field"), F.lit("").alias("space"), F.concat("id", F.lit("#"), i.cast("string")).alias("id"), v.alias("vec")))
    empty = F.array().cast("array<struct<field:string,space:string,id:string,vec:array<float>>>")
    own = n.select(F.inline(F.concat(F.coalesce(named, empty), F.coalesce(chunks, empty))))
    return e.unionByName(own.filter(usable(F.col("vec"), F.lit(dims))))


def rotation(dim: int) -> np.ndarray:
    """The random rotation for vectors of ``dim`` dimensions, padded to a multiple of 64; the same on every machine."""
    size = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:dim].astype(np.float32)


def encode(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows of uint64 words) and the cosine between each code's vector and the turned vector it stands for."""
    words = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
    size = np.maximum(np.linalg.norm(turned, axis=1), 1e-12)
    return words, np.maximum(np.abs(turned).sum(1) / size / np.sqrt(turned.shape[1]), 1e-3).astype(np.float32)


def encode_finer(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits a dimension, the signs and which values are large, by row; the cosine as in :func:`encode`."""
    size = np.maximum(np.linalg.norm(turned, axis=1), 1e-12)
    large = np.abs(turned) > LARGE * size[:, None] / np.sqrt(turned.shape[1])
    level = np.where(large, LEVELS[1], LEVELS[0])
    bits = np.concatenate([np.packbits(b, axis=1, bitorder="little") for b in (turned > 0, large)], 1)
    return bits, np.maximum((np.abs(turned) * level).sum(1) / size / np.sqrt((level**2).sum(1)), 1e-3).astype(np.float32)


def decode_finer(codes: np.ndarray, size: int) -> np.ndarray:
    """The vectors of length 1 for which the codes of :func:`encode_finer` stand."""
    bits = np.unpackbits(codes.reshape(-1, size // 8), axis=1, bitorder="little").reshape(len(codes), 2, size)
    out = (bits[:, 0].astype(np.float32) * 2 - 1) * np.where(bits[:, 1] > 0, np.float32(LEVELS[1]), np.float32(LEVELS[0]))
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def quantise(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Four bit planes (n, 4, words), lower end and step of each query."""
    low = turned.min(1, keepdims=True)
    step = np.maximum((turned.max(1, keepdims=True) - low) / 15, 1e-12)
    u = np.clip(np.rint((turned - low) / step), 0, 15).astype(np.uint8)
    planes = np.stack([np.packbits((u >> j) & 1, axis=1, bitorder="little").view(np.uint64) for j in range(4)], axis=1)
    return planes, low[:, 0].astype(np.float32), step[:, 0].astype(np.float32)


def estimate(planes: np.ndarray, low: np.ndarray, step: np.ndarray, codes: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of the queries with the unit vectors of the codes (queries x codes), and the standard deviation of each
    code's estimate for a query of length 1."""
    size = codes.shape[1] * 64
    dot = np.zeros((len(planes), len(codes)), np.float32)
    for j in range(4):
        common = np.zeros(dot.shape, np.uint8)
        for w in range(codes.shape[1]):
            common += np.bitwise_count(planes[:, j, w, None] & codes[None, :, w])
        dot += np.float32(1 << j) * common
    ones = np.bitwise_count(codes).sum(1).astype(np.float32)
    total = size * low + step * sum((1 << j) * np.bitwise_count(planes[:, j]).sum(1).astype(np.float32) for j in range(4))
    dot *= 2 * step[:, None]
    dot += 2 * low[:, None] * ones[None] - total[:, None]
    dot /= np.float32(np.sqrt(size)) * scale[None]
    return dot, np.sqrt(np.maximum(1 - scale**2, 0)) / scale / np.sqrt(size - 1)


def _matrix(vecs) -> np.ndarray:
    x = np.array(list(vecs), dtype=np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def fit(sample: np.ndarray, cells: int, rounds: int = 3) -> np.ndarray:
    """Centroids: a random choice of the sample, moved to the mean direction of their cells."""
    centres = sample[np.random.default_rng(7).choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(sample, max(1, len(sample) // 1024))])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres


def merge_copies(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of identical vectors ``(field, space, gid, vec, rep, n)``, and the members ``(field, space, gid, id)`` of groups with more than one id.

    Two hashes of 64 bits tell vectors apart: that two of a billion collections' different vectors share both is less likely than one in 10^9.
    Only ids and hashes of all rows are regrouped besides one vector per group and input partition.
    """
    x = vectors.withColumn("_h", F.struct(F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(1), "vec").alias("b")))
    groups = x.groupBy("field", "space", "_h").agg(F.min_by("vec", "id").alias("vec"), F.min("id").alias("rep"), F.max("id").alias("_last"))
    groups = settle(groups.select("field", "space", F.col("_h.a").alias("h1"), F.col("_h.b").alias("h2"), "vec", "rep", "_last").withColumn("gid", F.monotonically_increasing_id()))
    several = groups.filter(F.col("rep") != F.col("_last")).select("field", "space", F.struct(F.col("h1").alias("a"), F.col("h2").alias("b")).alias("_h"), "gid")
    members = x.select("field", "space", "_h", "id").join(several, ["field", "space", "_h"]).select("field", "space", "gid", "id").distinct()
    return groups, members


def reach(cells: int, probes: int) -> int:
    """Cells to which a code goes."""
    return min(cells, max(4, math.ceil(probes * math.log2(max(cells, 1)))))


def crowds(sample: np.ndarray, centres: np.ndarray, least: float) -> np.ndarray:
    """A number for each cell, equal for the cells of a crowd: those linked by pairs of cells whose vectors, one of each cell, have a
    mean similarity of ``least`` or hardly less."""
    near = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(sample, max(1, len(sample) // 1024))])
    mean = np.zeros_like(centres)
    np.add.at(mean, near, sample)
    mean /= np.maximum(np.bincount(near, minlength=len(centres)), 1)[:, None]
    label = np.full(len(centres), -1)
    for first in range(len(centres)):
        front = np.array([first]) if label[first] < 0 else np.zeros(0, int)
        label[front] = first
        while len(front):
            free = np.flatnonzero(label < 0)
            close = np.zeros(len(free), bool)
            for part in np.array_split(front, -(-len(front) // 512)):
                close |= (mean[part] @ mean[free].T >= least - SLACK).any(0)
            front = free[close]
            label[front] = first
    return label


class _Model:
    """Rotation and centroids of a collection, the centroids of a crowd side by side; blocks of each cell or crowd."""

    def __init__(self, dim: int, centres: np.ndarray, label: np.ndarray, probes: int):
        order = np.argsort(label, kind="stable")
        self.turn, self.centres = rotation(dim), centres[order]
        self.starts = np.flatnonzero(np.diff(label[order], prepend=-1))
        self.crowd = np.diff(self.starts, append=len(order)) > 1
        self.reach = reach(len(self.starts), probes)
        self.own = (self.centres**2).sum(1)
        self.nb = self.nq = np.ones(len(self.starts), int)

    def near(self, x: np.ndarray) -> np.ndarray:
        """The closest cells or crowds of each vector, the closest first."""
        score = x @ self.centres.T - self.own / 2  # as the centroids are not of one length
        return _top(np.maximum.reduceat(score, self.starts, axis=1) if self.crowd.any() else score, self.reach)

    def measure(self, sample: np.ndarray, n: int, block: int) -> None:
        """Blocks of codes and of queries, by the sample's share of each cell."""
        near = np.concatenate([self.near(part) for part in np.array_split(sample, max(1, len(sample) // 1024))])
        rows = np.where(self.crowd, CROWD_BLOCKS * block, block) * len(sample) / n
        self.nb, self.nq = (np.maximum(1, np.ceil(np.bincount(c.ravel(), minlength=len(self.starts)) / rows)).astype(int) for c in (near, near[:, 0]))


def _models(groups: DataFrame, least: float, probes: int, sample: int, per_cell: int, max_cells: int, block: int) -> dict[tuple, _Model]:
    """The model of each collection. Those of more than one cell are fitted on at most ``sample`` vectors each, all in one job, a collection
    in one task; their centroids come to the driver, one for ``per_cell`` vectors."""
    counts = groups.groupBy("field", "space").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d"))
    known = {(r["field"], r["space"]): (r["n"], r["d"]) for r in counts.collect()}
    out = {key: _Model(d, np.zeros((1, d), np.float32), np.zeros(1, int), probes) for key, (n, d) in known.items()}
    several = [(f, sp, min(1.0, sample / n), int(min(max_cells, n // per_cell)), d) for (f, sp), (n, d) in known.items() if min(max_cells, n // per_cell) > 1]
    if not several:
        return out

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf.sort_values("gid")["vec"].iloc[:sample])
        centres = fit(x, min(int(pdf["cells"].iloc[0]), len(x)))
        label = crowds(x, centres, least)
        m = _Model(x.shape[1], centres, label, probes)
        m.measure(x, int(pdf["n"].iloc[0]), block)
        packed = [np.ascontiguousarray(v).tobytes() for v in (centres, label.astype(np.int64), m.nb.astype(np.int64), m.nq.astype(np.int64))]
        return pd.DataFrame({"field": pdf["field"].iloc[:1], "space": pdf["space"].iloc[:1], **{k: [v] for k, v in zip(("centres", "label", "nb", "nq"), packed)}})

    chosen = groups.sparkSession.createDataFrame(several, "field string, space string, share double, cells int, d int")
    mine = groups.join(F.broadcast(chosen), ["field", "space"]).filter(F.pmod(F.xxhash64("gid"), F.lit(1_000_000)) < (F.col("share") * 1_000_000).cast("int") + 1)
    mine = mine.join(F.broadcast(counts.select("field", "space", "n")), ["field", "space"]).select("field", "space", "gid", "vec", "cells", "n")
    for r in mine.groupBy("field", "space").applyInPandas(fitted, "field string, space string, centres binary, label binary, nb binary, nq binary").collect():
        d = known[r["field"], r["space"]][1]
        m = _Model(d, np.frombuffer(r["centres"], np.float32).reshape(-1, d), np.frombuffer(r["label"], np.int64), probes)
        m.nb, m.nq = np.frombuffer(r["nb"], np.int64), np.frombuffer(r["nq"], np.int64)
        out[r["field"], r["space"]] = m
    return out


def _packed(gid: np.ndarray, rest: np.ndarray, *scalars: np.ndarray) -> np.ndarray:
    """A row of bytes for each vector: its gid, its scalars (float32), the rest (code or vector)."""
    head = [np.ascontiguousarray(gid, np.int64)[:, None].view(np.uint8), *(np.ascontiguousarray(c, np.float32)[:, None].view(np.uint8) for c in scalars)]
    return np.concatenate([*head, np.ascontiguousarray(rest.reshape(len(gid), -1)).view(np.uint8)], 1)


def _unpacked(rows, width: int, n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Gids, what follows the scalars (bytes) and the ``n`` scalars of packed rows of ``width`` bytes."""
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, width)
    at = 8 + 4 * n
    scalars = np.ascontiguousarray(raw[:, 8:at]).view(np.float32)
    return np.ascontiguousarray(raw[:, :8]).view(np.int64)[:, 0], np.ascontiguousarray(raw[:, at:]), list(scalars.T)


def _coded(models: list):
    """Rows for the cells, those of one cell and block packed together. Role 0, in the nearest cells: code, cosine of the code, length
    from the centroid, product with the centroid. Role 1, in the nearest: bit planes as a query, their lower end and step, length from
    and product with the centroid. Roles 2 and 3, the same in a crowd: the unit vector."""

    def rows(batches):
        at = {key: k for k, (key, _) in enumerate(models)}
        for batch in batches:
            for key, g in batch.groupby(["field", "space"], sort=False):
                m = models[at[key]][1]
                parts: dict[tuple, list[np.ndarray]] = {}

                def put(cells, role, gid, packed):
                    """Each row to its cells: to its own block there, and to all blocks of the other role."""
                    mine, others = (m.nb, m.nq) if role in (0, 2) else (m.nq, m.nb)
                    block = ((gid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % mine[cells]
                    key = cells.astype(np.int64) * (int(mine.max()) + 1) + block
                    order = np.argsort(key, kind="stable")
                    for i in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                        c, b = int(cells[i[0]]), int(block[i[0]])
                        for o in range(int(others[c])):
                            parts.setdefault((c, *((b, o) if role in (0, 2) else (o, b)), role), []).append(packed[i])

                for lo in range(0, len(g), 1024):
                    s = g.iloc[lo : lo + 1024]
                    x, gid = _matrix(s["vec"]), s["gid"].to_numpy()
                    t, near = x @ m.turn, m.near(x)
                    for k in range(near.shape[1]):
                        in_crowd = m.crowd[near[:, k]]
                        i = np.flatnonzero(~in_crowd)
                        if len(i):
                            cells = near[i, k]
                            centre = m.centres[m.starts[cells]]
                            r = t[i] - centre @ m.turn
                            codes, scale = encode_finer(r)
                            length, product = np.linalg.norm(r, axis=1), (x[i] * centre).sum(1)
                            put(cells, 0, gid[i], _packed(gid[i], codes, scale, length, product))
                            if k == 0:
                                planes, low, step = quantise(r)
                                put(cells, 1, gid[i], _packed(gid[i], planes, low, step, product - m.own[m.starts[cells]], length))
                        i = np.flatnonzero(in_crowd)
                        if len(i):
                            whole = _packed(gid[i], x[i])
                            put(near[i, k], 2, gid[i], whole)
                            if k == 0:
                                put(near[i, k], 3, gid[i], whole)
                keys = list(parts)
                yield pd.DataFrame({"coll": at[key], **{n: [q[j] for q in keys] for j, n in enumerate(("cell", "bb", "qb", "role"))}, "codes": [np.concatenate(parts[q]).tobytes() for q in keys]})[["coll", "cell", "bb", "qb", "role", "codes"]]

    return rows


def _top(score: np.ndarray, p: int) -> np.ndarray:
    """Columns of the ``p`` highest scores of each row, the highest first."""
    part = np.argpartition(-score, p - 1, axis=1)[:, :p]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(score, part, 1), axis=1, kind="stable"), 1)


def _estimated(base, query, size: int, least: float, k: int):
    """Yields (query gids, code gids) of pairs whose upper bound reaches ``least`` and the k-th best lower bound of the query."""
    bid, codes, (scale, length, with_centre) = _unpacked(base, 20 + size // 4, 3)
    qid, planes, (low, step, own, away) = _unpacked(query, 24 + size // 2, 4)
    bits = np.unpackbits(planes.reshape(-1, size // 8), axis=1, bitorder="little").reshape(len(qid), 4, size)
    turned = low[:, None] + step[:, None] * sum(np.float32(1 << j) * bits[:, j] for j in range(4))
    sigma = np.sqrt(np.maximum(1 - scale**2, 0)) / scale / np.float32(np.sqrt(size - 1)) * length
    # The upper bound as one product: the estimate, the products with the centroid, and the error of both.
    right = np.concatenate([decode_finer(codes, size) * (length / scale)[:, None], with_centre[:, None], np.ones((len(bid), 1), np.float32), sigma[:, None]], 1).T.copy()
    left = np.concatenate([turned, np.ones((len(qid), 1), np.float32), own[:, None], np.float32(EPSILON) * away[:, None]], 1)
    block = max(1, 2_000_000 // len(bid))
    for lo in range(0, len(qid), block):
        upper = left[lo : lo + block] @ right
        i, j = np.nonzero(upper >= least)
        error, upper = away[lo + i] * sigma[j], upper[i, j]
        other = qid[lo + i] != bid[j]
        i, j, error, upper = i[other], j[other], error[other], upper[other]
        lower = upper - np.float32(EPSILON + EPSILON_KTH) * error
        order = np.lexsort((-lower, i))
        first = np.searchsorted(i, np.arange(len(left[lo : lo + block])))
        many = np.flatnonzero(np.bincount(i, minlength=len(first)) > k)
        kth = np.full(len(first), -9, np.float32)
        kth[many] = lower[order[first[many] + k - 1]]
        want = upper - np.float32(EPSILON - EPSILON_KTH) * error >= kth[i]
        yield qid[lo + i[want]], bid[j[want]]


def _crowded(base, query, dim: int, least: float, k: int):
    """Yields (query gids, gids) of the k most similar of each query, and those as similar but for rounding."""
    bid, vecs, _ = _unpacked(base, 8 + 4 * dim, 0)
    qid, asked, _ = _unpacked(query, 8 + 4 * dim, 0)
    right, left = vecs.view(np.float32).T.copy(), asked.view(np.float32)
    order = np.argsort(bid)
    me = order[np.minimum(np.searchsorted(bid[order], qid), len(bid) - 1)]
    block = max(1, 2_000_000 // len(bid))
    for lo in range(0, len(qid), block):
        sims = left[lo : lo + block] @ right
        own = np.flatnonzero(bid[me[lo : lo + block]] == qid[lo : lo + block])
        sims[own, me[lo + own]] = -9
        bound = np.full(len(sims), least, np.float32)
        if len(bid) > k:
            bound = np.maximum(bound, np.partition(sims, -k, axis=1)[:, -k])
        i, j = np.nonzero(sims >= bound[:, None] - np.float32(ROUNDING))
        yield qid[lo + i], bid[j]


def _candidates(dims: list[int], least: float, k: int):
    """Pairs of a cell or crowd that may reach ``least`` and be among the ``k`` best of the query."""

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        role, codes, dim = pdf["role"], pdf["codes"], dims[pdf["coll"].iloc[0]]
        found = []
        if (role == 0).any() and (role == 1).any():
            found += _estimated(codes[role == 0], codes[role == 1], -(-dim // 64) * 64, least, k)
        if (role == 2).any() and (role == 3).any():
            found += _crowded(codes[role == 2], codes[role == 3], dim, least, k)
        m = np.concatenate([np.stack(p, 1) for p in found]) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"coll": pdf["coll"].iloc[0], "x": m.min(1, initial=2**63 - 1), "y": m.max(1, initial=-(2**63))})

    return pairs


def _cosine(a: Column, b: Column) -> Column:
    def dot(u, v):
        return F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)

    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def similar_pairs(vectors: DataFrame, least: float = 0.8, k: int = K, probes: int = PROBES, sample: int = SAMPLE, per_cell: int = PER_CELL, max_cells: int = MAX_CELLS, block: int = BLOCK) -> DataFrame:
    """Unordered pairs ``field, space, id_a, id_b, similarity`` with cosine >= ``least`` of which one is among the ``k`` nearest of the other.

    ``vectors`` has ``field, space, id, vec``, all usable and of one length per collection. Equal similarities go by ascending id. The
    similarities are exact; that a pair is seen at all is approximate (see the README for the measured recall). An empty input gives
    no pairs.
    """
    spark = vectors.sparkSession
    ship(spark)
    groups, members = merge_copies(vectors)
    models = sorted(_models(groups, least, probes, sample, per_cell, max_cells, block).items())
    rows = groups.select("field", "space", "gid", "vec").mapInPandas(_coded(models), CODE)
    found = rows.groupBy("coll", "cell", "bb", "qb").applyInPandas(_candidates([len(m.turn) for _, m in models], least, k), "coll int, x long, y long")
    found = found.distinct()
    vec = groups.select("gid", "vec", "rep")  # the same for both ends, so that it is shuffled once
    near = found.join(vec.select(F.col("gid").alias("x"), F.col("vec").alias("vx"), F.col("rep").alias("rx")), "x")
    near = near.join(vec.select(F.col("gid").alias("y"), F.col("vec").alias("vy"), F.col("rep").alias("ry")), "y")
    near = near.withColumn("similarity", _cosine(F.col("vx"), F.col("vy"))).filter(F.col("similarity") >= least)
    name = [F.get(F.array(*[F.lit(key[k]) for key, *_ in models]).cast("array<string>"), F.col("coll")) for k in (0, 1)]
    near = near.select(name[0].alias("field"), name[1].alias("space"), "x", "y", "rx", "ry", "similarity")
    near = cut(near)
    members = cut(members)
    discard(groups)

    # The first k + 1 ids of each group of copies; a row number with a small limit is cut before the shuffle.
    w = Window.partitionBy("field", "space", "gid").orderBy("id")
    first = members.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    seen = first.select(F.col("gid").alias("g"), F.col("id").alias("other"))

    def spread(df: DataFrame, gid: str, rep: str, name: str) -> DataFrame:
        """One row per visible member of the group on one side."""
        one = seen.select(F.col("g").alias(gid), F.col("other").alias(name))
        return df.join(one, gid, "left").withColumn(name, F.coalesce(name, rep))

    between = spread(spread(near, "x", "rx", "a"), "y", "ry", "b").select("field", "space", "a", "b", "similarity")
    within = members.join(first.select("gid", F.col("id").alias("b"), "r"), "gid").filter(F.col("id") != F.col("b")).select("field", "space", F.col("id").alias("a"), "b", F.lit(1.0).alias("similarity"))
    both = between.unionByName(between.select("field", "space", F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionByName(within)
    rank = Window.partitionBy("field", "space", "a").orderBy(F.col("similarity").desc(), F.col("b").asc())
    best = both.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= k)
    return best.groupBy("field", "space", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).agg(F.max("similarity").alias("similarity"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = 20_000) -> DataFrame:
    """For each row of ``queries`` its ``k`` most similar rows of ``vectors``: ``field, space, id, neighbour, similarity, rank``.

    Both have ``field, space, id, vec``. All vectors are compared by code, in blocks of about ``block`` vectors against blocks of about
    ``QUERIES`` queries, so that the vectors are sent once for so many queries; those that the bounds cannot rule out are reranked within the block. Equal similarities go by ascending id; a
    vector is no neighbour of itself. Repeated ids count once.
    """
    spark = vectors.sparkSession
    ship(spark)
    sizes = {(r["field"], r["space"]): r["n"] for r in vectors.groupBy("field", "space").agg(F.count("*").alias("n")).collect()}
    asked = {(r["field"], r["space"]): r["n"] for r in queries.groupBy("field", "space").agg(F.count("*").alias("n")).collect()}

    cuts = spark.createDataFrame([(f, p, max(1, -(-n // block)), max(1, -(-asked.get((f, p), 0) // QUERIES))) for (f, p), n in sizes.items()] or [("", "", 1, 1)], "field string, space string, nb int, nq int")
    vectors, queries = (df.select("field", "space", "id", "vec").join(F.broadcast(cuts), ["field", "space"]) for df in (vectors, queries))
    nb, nq = F.col("nb"), F.col("nq")
    cols = ["field", "space", "id", "vec"]
    base = vectors.select(*cols, F.lit(0).alias("role"), F.pmod(F.xxhash64("id"), nb).cast("int").alias("bb"), F.explode(F.sequence(F.lit(0), nq - 1)).alias("qb"))
    ask = queries.select(*cols, F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), nb - 1)).alias("bb"), F.pmod(F.xxhash64("id"), nq).cast("int").alias("qb"))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["role", "id"])
        b, q = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
        rows = []
        if len(b) and len(q):
            x, y = _matrix(b["vec"]), _matrix(q["vec"])
            turn = rotation(x.shape[1])
            codes, scale = encode(x @ turn)
            bid, qid = b["id"].to_numpy(), q["id"].to_numpy()
            at = {v: i for i, v in enumerate(bid)}
            step_q = max(1, 2_000_000 // len(b))
            for lo in range(0, len(q), step_q):
                part = y[lo : lo + step_q]
                est, sigma = estimate(*quantise(part @ turn), codes, scale)
                half = EPSILON * sigma
                for i in range(len(part)):
                    me = at.get(qid[lo + i])
                    if me is not None:
                        est[i, me] = -9
                lower = est - half
                kth = -np.partition(-lower, k - 1, axis=1)[:, k - 1] if len(b) > k else np.full(len(part), -9)
                for i in range(len(part)):
                    j = np.nonzero((est[i] + half >= kth[i]) & (est[i] > -8))[0]
                    sim = x[j].astype(np.float64) @ part[i].astype(np.float64)
                    keep = np.lexsort((bid[j], -sim))[:k]
                    rows.extend((qid[lo + i], bid[j[t]], float(sim[t])) for t in keep)
        out = pd.DataFrame(rows, columns=["id", "neighbour", "similarity"])
        return out.assign(field=pdf["field"].iloc[0], space=pdf["space"].iloc[0])[["field", "space", "id", "neighbour", "similarity"]]

    near = base.unionByName(ask).groupBy("field", "space", "bb", "qb").applyInPandas(scan, "field string, space string, id string, neighbour string, similarity double")
    w = Window.partitionBy("field", "space", "id").orderBy(F.col("similarity").desc(), F.col("neighbour").asc())
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(collections(spark, sf_dir)).select("field", "space", "id_a", "id_b")


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors for every vector whose node number is divisible by 100, against all vectors."""
    v = cut(collections(spark, sf_dir))
    number = F.regexp_extract("id", r"node-([0-9]+)", 1).try_cast("long")
    return nearest(v, v.filter(number % 100 == 0)).withColumn("similarity", F.round("similarity", 5))

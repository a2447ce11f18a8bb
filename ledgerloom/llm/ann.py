"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index: a vector minus the centre, made a unit vector, is rotated by a fixed random orthogonal matrix; its signs are packed
into bits, next to its residual norm and its inner product with its own code (the correction scalar). Search: the inner
product of a query with a code, divided by the correction, estimates the inner product with the vector; an error bound of
EPSILON standard errors says which vectors may be among the nearest, and those are reranked on the original vectors.

All rows are indexed. Queries are matched with all rows in blocks: rows are dealt by hash into buckets of about ROWS, queries
into blocks of QUERIES; each pair of a bucket and a block is one task's work and yields at most k rows a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.runtime import materialize, prepare_python

ROWS = 16_384
QUERIES = 8_192
EPSILON = 1.9
SEED = 5


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, residual norm and correction of the rows of x. A row at the centre has norm 0 and correction 1."""
    r = (x - centre) @ turn
    norm = np.linalg.norm(r, axis=1)
    bits = r > 0
    fix = np.abs(r).sum(axis=1) / np.where(norm > 0, norm, 1) / np.sqrt(x.shape[1])
    return np.packbits(bits, axis=1), norm, np.where(norm > 0, fix, 1.0)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x and y."""
    return np.einsum("ij,ij->i", x, y)


def search_block(ids, x, bits, norm, fix, qids, q, centre, turn, k, epsilon=EPSILON):
    """(query number, row number, score) of the k best rows for each query among those that the bounds leave."""
    dim = x.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    spread = np.sqrt(np.maximum(0, 1 - fix**2)) / fix * epsilon / np.sqrt(max(1, dim - 1)) * norm
    base, scale = x.shape[0], (norm / fix / np.sqrt(dim)).astype(np.float32)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 22) // max(1, base))
    turned = q @ turn
    offset = q @ centre
    length = np.linalg.norm(q, axis=1)
    for a in range(0, len(q), step):
        b = min(len(q), a + step)
        guess = (turned[a:b].astype(np.float32) @ signs.T) * scale + offset[a:b, None].astype(np.float32)
        own = np.equal(qids[a:b, None], ids[None])
        guess[own] = -np.inf
        m = min(4 * k, base)
        first = np.argpartition(-guess, m - 1, axis=1)[:, :m]
        who = np.repeat(np.arange(b - a), m)
        s = exact(x[first.ravel()], q[a:b][who]).reshape(b - a, m)
        s[~np.isfinite(np.take_along_axis(guess, first, axis=1))] = -np.inf
        low = -np.partition(-s, min(k, m) - 1, axis=1)[:, min(k, m) - 1]  # the k-th best that is already known
        low = np.where(np.isfinite(low), low, -np.inf)
        high = guess + (length[a:b, None] * spread[None]).astype(np.float32)
        may = (high >= (low - 1e-6 * (1 + np.abs(low)))[:, None].astype(np.float32)) & ~own
        who, row = np.nonzero(may)
        score = np.empty(len(who))
        for c in range(0, len(who), 1 << 16):
            d = slice(c, c + (1 << 16))
            score[d] = exact(x[row[d]], q[a:b][who[d]])
        order = np.lexsort((ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        best = place < k
        out.append((who[best] + a, row[best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _index(centre: np.ndarray, turn: np.ndarray):
    def run(pdfs):
        for pdf in pdfs:
            x = np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), len(centre))
            bits, norm, fix = encode(x, centre, turn)
            yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "bits": [b.tobytes() for b in bits], "norm": norm, "fix": fix})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """id and v (array of double) of the vectors that take part, one row an id."""
    x = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != float("inf")), F.lit(False)))
    x = x.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda e: e != 0))
    return x.groupBy("id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, k: int = 20, query_mod: int = 20, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each vector whose vec_id is divisible by query_mod.

    Nearness is the inner product in double precision of the original vectors, largest first, ties to the smaller vec_id.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without a vec_id;
    rows of one vec_id count once (the smallest vector of them), and of vectors of several lengths those of the most
    frequent one (ties: the longest) take part. A query is never its own neighbour; with fewer than k others all are
    returned. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare_python(spark, 4096)
    good = materialize(usable(vectors))
    dims = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    dim, n = dims
    good = good.where(F.size("v") == dim)

    def sums(pdfs):
        total, count = np.zeros(dim), 0
        for pdf in pdfs:
            total += np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), dim).sum(axis=0)
            count += len(pdf)
        yield pd.DataFrame({"d": np.arange(dim), "s": total, "n": count})

    mean = good.select("v").mapInPandas(sums, "d int, s double, n long").groupBy("d").agg(F.sum("s") / F.sum("n")).toPandas()
    centre = mean.sort_values("d").iloc[:, 1].to_numpy()  # dim rows
    turn = rotation(dim)
    index = materialize(good.mapInPandas(_index(centre, turn), "id long, v array<double>, bits binary, norm double, fix double"))
    buckets = max(1, round(n / ROWS))
    n_queries = index.where(F.col("id") % query_mod == 0).count()
    blocks = max(1, -(-n_queries // QUERIES))
    rows = index.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = index.where(F.col("id") % query_mod == 0).select("id", "v")
    queries = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int"))
    queries = queries.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q = (np.array(p["v"].tolist(), dtype=np.float64).reshape(len(p), dim) for p in (left, right))
        bits = np.frombuffer(b"".join(left["bits"]), dtype=np.uint8).reshape(len(left), -1)
        ids, qids = left["id"].to_numpy(), right["id"].to_numpy()
        who, row, score = search_block(ids, x, bits, left["norm"].to_numpy(), left["fix"].to_numpy(), qids, q, centre, turn, k, epsilon)
        return pd.DataFrame({"query_id": qids[who], "vec_id": ids[row], "score": score})

    pairs = rows.groupBy("block", "bucket").cogroup(queries.groupBy("block", "bucket"))
    found = pairs.applyInPandas(search, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

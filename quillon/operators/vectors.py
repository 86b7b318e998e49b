"""Exact nearest neighbours and the fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries that are broadcast for a scan, and those whose scores are worked on together.
SCAN_QUERIES, BLOCK_QUERIES = 8192, 256


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def similarity(v: Column, q: Column, kind: str) -> Column:
    """The score that a search gives: (1 + cos) / 2 (1 / 2 for a zero vector), 1 / (1 + d²) or (1 + dot) / 2."""
    if kind == "cosine":
        return (1 + F.coalesce(F.try_divide(_dot(v, q), F.sqrt(_dot(v, v) * _dot(q, q))), F.lit(0.0))) / 2
    if kind == "l2":
        return 1 / (1 + F.aggregate(F.zip_with(v, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return (1 + _dot(v, q)) / 2


def knn(df: DataFrame, vector: list[float], kind: str, k: int) -> DataFrame:
    """The k nearest rows: scores are computed in the scan, a top-n keeps k rows a task."""
    q = F.array(*(F.lit(float(x)) for x in vector))
    score = F.round(similarity(F.col("embedding").cast("array<double>"), q, kind), 6)
    return df.select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def knn_each(df: DataFrame, queries: DataFrame, kind: str, k: int) -> DataFrame:
    """query_id, vec_id and score of the k nearest rows of each query (both vec_id, embedding), exactly.

    Each task scores its rows by matrix products and returns k rows a query. Null embeddings take no part;
    the cosine of a zero vector is 0.
    """
    df, queries = (x.where("embedding is not null").select("vec_id", "embedding") for x in (df, queries))
    scans = max(1, -(-queries.count() // SCAN_QUERIES))
    dealt = queries.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(scans)))
    found = []
    for g in range(scans):
        own = dealt.where(F.col("g") == g).collect()
        if own:
            shared = df.sparkSession.sparkContext.broadcast(([r["vec_id"] for r in own], np.array([r["embedding"] for r in own], np.float64)))
            found.append(df.mapInArrow(lambda batches, shared=shared: _nearest(batches, *shared.value, kind, k), "query_id long, vec_id long, score double"))
    if not found:
        return df.where("false").select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return reduce(DataFrame.union, found).withColumn("r", rank).where(F.col("r") <= k).drop("r")


def _nearest(batches: Iterator[pa.RecordBatch], query_ids: list[int], q: np.ndarray, kind: str, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of a task for each query, by rounded score and then by id."""
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
    least = np.full(len(q), -np.inf)
    squares = (q * q).sum(axis=1)
    for whole in batches:
        for at in range(0, len(whole), 1000):
            batch = whole.slice(at, 1000)
            ids = batch.column(0).to_numpy()
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            own = (v * v).sum(axis=1)
            for a in range(0, len(q), BLOCK_QUERIES):
                dot, theirs = q[a : a + BLOCK_QUERIES] @ v.T, squares[a : a + BLOCK_QUERIES, None]
                if kind == "cosine":
                    norm = np.sqrt(theirs * own)
                    score = (1 + np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)) / 2
                elif kind == "l2":
                    score = 1 / (1 + np.maximum(theirs + own - 2 * dot, 0))
                else:
                    score = (1 + dot) / 2
                score = np.round(score, 6)
                open_ = score >= least[a : a + BLOCK_QUERIES, None]
                for n in np.flatnonzero(open_.any(axis=1)).tolist():
                    s = np.concatenate((best[a + n][0], score[n][open_[n]]))
                    i = np.concatenate((best[a + n][1], ids[open_[n]]))
                    order = np.lexsort((i, -s))[:k]
                    best[a + n] = s[order], i[order]
                    if len(order) == k:
                        least[a + n] = s[order[-1]]
    size = [len(s) for s, _ in best]
    if sum(size):
        columns = np.repeat(np.array(query_ids, np.int64), size), np.concatenate([i for _, i in best]), np.concatenate([s for s, _ in best])
        whole = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "vec_id", "score"])
        for at in range(0, len(whole), 10_000):
            yield whole.slice(at, 10_000)


def rrf(lists: list[DataFrame], window: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists (id, score): each gives 1 / (k + rank) to its first `window` rows."""
    tops = []
    for df in lists:
        top = df.orderBy(F.desc("score"), "id").limit(window)  # bounded before it is ranked
        tops.append(top.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("r")))
    every = reduce(DataFrame.union, tops)
    return every.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("r"))), 9).alias("score"))

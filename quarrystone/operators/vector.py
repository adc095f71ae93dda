"""Exact vector search and the pseudo-relevance centroid."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import vectors as V
from ..lineage import cut, join_bounded
from .pools import of_queries

#: Query vectors per matrix product, and on the driver at a time (at 64 dimensions 25 MB).
QUERY_BLOCK, HELD = 1024, 50_000


def knn(queries: DataFrame, data: DataFrame, k: int, strict: bool = False) -> DataFrame:
    """(query_id, doc, score, rank): the ``k`` nearest of ``data`` (doc, embedding) by cosine for each of ``queries`` (query_id, embedding).

    The stated queries go in blocks against all rows: each task keeps its k best per query by one
    matrix product per batch, so k rows per task and query are shuffled. Beyond HELD queries, counted
    first, that many at a time are answered and written out. Ties go to the smaller doc; zero vectors
    score 0; rows whose length differs from the queries' are left out, or with ``strict`` end the job.
    """
    if strict:
        dims = queries.where("embedding is not null").agg(F.max(F.size("embedding"))).first()[0]
        fits = F.when(F.size("embedding") == F.lit(dims), True).otherwise(F.raise_error(F.lit("a vector has another length than the queries'")).cast("boolean"))
        data = data.where(F.col("embedding").isNull() | fits)
    parts = -(-queries.count() // HELD)
    if parts > 1:
        share = lambda i: queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
        done = [cut(_knn(share(i), data, k)) for i in range(parts)]
        return reduce(DataFrame.unionByName, done)
    return _knn(queries, data, k)


def _knn(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    rows = [(r.query_id, r.embedding) for r in queries.where("embedding is not null").orderBy("query_id").toLocalIterator()]
    out: DataFrame | None = None
    spark = data.sparkSession
    for lo in range(0, max(len(rows), 1), QUERY_BLOCK):
        block = rows[lo : lo + QUERY_BLOCK]
        ids = np.array([i for i, _ in block], np.int64)
        q = _unit(np.array([e for _, e in block], np.float64)) if block else np.zeros((0, 1))
        shared = spark.sparkContext.broadcast((ids, q))
        part = data.select(F.col("doc").cast("long").alias("doc"), "embedding").where(F.size("embedding") == q.shape[1]).mapInArrow(_nearest(shared, k), "query_id long, doc long, score double")
        out = part if out is None else out.unionByName(part)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc"))
    return out.withColumn("rank", place).where(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _nearest(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        docs, best = np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), -np.inf)
        for batch in batches:
            own = batch.column(0).to_numpy()
            x = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)) if len(own) else np.zeros((0, q.shape[1]))
            if not len(own) or not len(ids):
                continue
            scores = np.round(np.hstack((best, q @ x.T)), 12)
            cutoff = np.partition(scores, -k, axis=1)[:, -k]
            for i in range(len(ids)):
                at = np.flatnonzero(scores[i] >= cutoff[i])
                names = np.where(at < k, docs[i][np.minimum(at, k - 1)], own[np.maximum(at - k, 0)])
                order = np.lexsort((names, -scores[i][at]))[:k]
                best[i], docs[i] = scores[i][at[order]], names[order]
        some = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, some.sum(1))), pa.array(docs[some]), pa.array(np.round(best[some], 12))], ["query_id", "doc", "score"])

    return run


def centroid_scores(hits: DataFrame, ranked: DataFrame, k: int = 5, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, ix, score): cosine of each hit's vector with the mean vector of the ``k`` best-ranked hits that have one.

    ``hits`` has (query_id, ix, embedding), or ``pool`` instead of query_id and ``queries`` (query_id, pool) beside it; ``ranked`` has
    (query_id, ix, rank); hits without a vector score null, as do queries without any.
    """
    if queries is None:
        hits = hits.withColumnRenamed("query_id", "pool")
        queries = hits.select(F.col("pool").alias("query_id"), "pool").distinct()
    some = hits.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("pool", "ix", "embedding")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "ix"))
    near = of_queries(some.select("pool", "ix"), queries).join(ranked.select("query_id", "ix", "rank"), ["query_id", "ix"]).withColumn("_n", place).where(F.col("_n") <= k)
    top = some.join(near.select("query_id", "pool", "ix"), ["pool", "ix"])
    parts = top.select("query_id", "pool", F.posexplode("embedding").alias("pos", "x")).groupBy("query_id", "pool", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = cut(parts.groupBy("query_id", "pool").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("mean")))  # one entry per dimension
    score = join_bounded(some.repartition("pool", "ix"), mean, "pool", rows=HELD).select("query_id", "ix", V.cosine("embedding", "mean").alias("score"))
    return of_queries(hits.select("pool", "ix"), queries).select("query_id", "ix").join(score, ["query_id", "ix"], "left")

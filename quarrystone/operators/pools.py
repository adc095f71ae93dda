"""Hits that several queries share, counted once.

A pool is a set of hits. Where ``hits`` has a column ``pool`` instead of ``query_id``, ``queries`` has one too, and all
queries of a pool have the pool's hits; else each query has hits of its own. Texts are read once for a pool, not once for each query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..lineage import cut, join_bounded, written


def pooled(hits: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """hits with ``pool`` and queries with (query_id, pool, query); queries that are missing, but have hits, ask nothing."""
    if "pool" in hits.columns:
        return hits, queries
    own = hits.select("query_id").distinct().join(queries, "query_id", "left")
    return hits.withColumnRenamed("query_id", "pool"), own.withColumn("pool", F.col("query_id"))


def of_queries(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """``rows`` (pool, ...) for each query of the pool: adds query_id."""
    return rows.join(queries.select("query_id", "pool"), "pool")


def counted(texts: DataFrame, by: list[str], words: Column, wanted: DataFrame | None = None) -> DataFrame:
    """(*by, dl, m) of each row of ``texts``: its words and their array of (term, tf), of ``wanted`` (pool, term) only if given. Written out.

    Texts are dealt out by ``by``, which names a text, so that words are counted where they are read.
    """
    rows = texts.repartition(*by).select(*by, words.alias("_w")).select(*by, F.size("_w").alias("dl"), F.explode_outer("_w").alias("term"))
    if wanted is not None:
        known = cut(wanted.select("pool", "term").distinct().withColumn("_k", F.lit(True)))
        rows = join_bounded(rows, known, ["pool", "term"], "left").withColumn("term", F.when(F.col("_k"), F.col("term")))
    tf = rows.groupBy(*by, "dl", "term").agg(F.count("*").alias("tf"))
    return written(tf.groupBy(*by, "dl").agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("m")))[0]


def postings(rows: DataFrame) -> DataFrame:
    """``counted`` with a row for each term: term and tf instead of m."""
    return rows.select(*(c for c in rows.columns if c != "m"), F.inline("m"))

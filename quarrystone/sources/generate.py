"""Synthetic inputs for benchmarks, from ranges and hashes, repeatable at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TOPICS = ("fasting", "sleep", "exercise", "diet", "stress", "memory", "ageing", "glucose", "inflammation", "rhythm")
WORDS = ("study", "effect", "group", "control", "trial", "result", "sample", "method", "effects", "human", "mice", "model", "change", "level", "analysis", "review")


def _pick(words: tuple[str, ...], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(by, F.lit(len(words))) + 1).cast("int"))


def paragraphs(spark: SparkSession, n: int, least: int = 100, most: int = 500, seed: int = 42) -> DataFrame:
    """(doc_id, text): ``n`` texts of ``least`` to ``most`` characters that begin with a topic by doc_id % 10."""
    i = F.col("id")
    count = F.lit(most // 4)
    words = F.transform(F.sequence(F.lit(1), count), lambda k: _pick(WORDS, F.xxhash64(F.lit(seed), i, k)))
    length = F.pmod(F.xxhash64(F.lit(seed), i), F.lit(most - least + 1)) + least
    text = F.concat_ws(" ", _pick(TOPICS, i), F.array_join(words, " "))
    return spark.range(n).select(i.alias("doc_id"), F.substr(text, F.lit(1), length.cast("int")).alias("text"))


def vectors(spark: SparkSession, n: int, dims: int = 384, seed: int = 42) -> DataFrame:
    """(doc_id, embedding): ``n`` unit vectors from hashes."""
    raw = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda k: F.xxhash64(F.lit(seed), F.col("id"), k).cast("double") / 2.0**63)
    rows = spark.range(n).select(F.col("id").alias("doc_id"), raw.alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("doc_id", F.transform("v", lambda x: (x / length).cast("float")).alias("embedding"))

"""The corpus pipeline: STAGES in order, each over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarrystone.lineage import written
from quarrystone.llm import bpe, langid, minhash, mixing, secret_scan


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go: null texts, no letters, or a score below 0.3. Empty in, empty out."""
    return langid.drop_unidentified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id; null doc_ids and blank texts stay."""
    return minhash.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kinds; every document stays, null texts as they are."""
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target shares of sources, languages and topics stays; nulls are categories of their own."""
    topics = mixing.topics_of_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return mixing.mix_documents(docs, topics).where("sampled").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded bytes; a null text has no tokens."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("language_id", language_id), ("minhash_near_dedup", near_dedup), ("secret_scan", secrets), ("mixing", mixing_stage), ("byte_bpe", encode)]

#: SQL cannot express the stages (a fitted classifier, signatures, raking, merges of a tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``. Each stage but the last is written to the shared folder and read again, so none runs twice."""
    docs, drop = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, drop_next = written(stage(spark, docs, sf_dir))
        if drop:
            drop()
        drop = drop_next
    return STAGES[-1][1](spark, docs, sf_dir)

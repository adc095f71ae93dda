"""The queries opN_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, embed_dedup, langid, licenses, merkle, minhash, mixing, secret_scan, templates, topk, url_filter, warc


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL by rules and a list of single URLs."""
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.production_rules(spark), url_filter.listed_urls(spark))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents: similarity 0.85 or more on five-word shingles."""
    return minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85, 100)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all vectors: equal labels and a cosine of 0.93 or more."""
    return embed_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived in dictionary-compressed WARC files and read back."""
    read = warc.archive_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: the base kinds and those that the method adds."""
    return secret_scan.digest(secret_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all other vectors for every hundredth one."""
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 10, 100)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices of every document."""
    return licenses.licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    return langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and a draw for every document, by source, language and the label of its vector."""
    topics = mixing.topics_of_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    mixed = mixing.mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), topics)
    return mixed.select("row.doc_id", "row.source", "row.lang", "topic", "tokens", "weight", "probability", "sampled", "gap")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by a public byte-level vocabulary."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by the templates of the hosts."""
    return templates.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents, checked after some of them are tampered with."""
    return merkle.verify_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_minhash_near_dedup, op3_embedding_near_dedup, op4_warc, op5_secret_scan, op6_exact_top_k, op7_license_scan, op8_language_id, op9_mixing, op10_byte_bpe, op11_html_extraction, op12_merkle_manifest)}
ORACLE: dict[str, str] = {
    "op1_url_filter": url_filter.oracle(),
    "op2_minhash_near_dedup": minhash.oracle(),
    "op3_embedding_near_dedup": embed_dedup.oracle(),
    "op4_warc": warc.oracle(),
    "op5_secret_scan": secret_scan.oracle(),
    "op6_exact_top_k": topk.oracle(),
    "op11_html_extraction": templates.oracle(),
    "op12_merkle_manifest": merkle.oracle(),
}

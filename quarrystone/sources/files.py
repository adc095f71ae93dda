"""Readers and writers of the pipeline's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from .tables import SCHEMAS


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet", mode: str = "PERMISSIVE") -> DataFrame:
    """A file of one of the pipeline's tables in its declared schema; ``mode`` says what malformed records do."""
    return spark.read.format(fmt).option("mode", mode).schema(SCHEMAS[name]).load(path)


def read_many(spark: SparkSession, paths: list[str], name: str, fmt: str = "json") -> DataFrame:
    """Several searches' results as one table with variant_ix and hit_ix, the order of arrival; missing files are left out."""
    reader = spark.read.format(fmt).option("ignoreMissingFiles", "true").schema(SCHEMAS[name])
    parts = [reader.load(p).withColumn("variant_ix", F.lit(i)).withColumn("hit_ix", F.monotonically_increasing_id()) for i, p in enumerate(paths) if _exists(spark, p)]
    out = parts[0] if parts else spark.createDataFrame([], SCHEMAS[name] + ", variant_ix int, hit_ix long")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A golden set: a JSON array of (input, actual_output, retrieval_context)."""
    return spark.read.option("multiLine", True).schema(SCHEMAS["golden"]).json(path)


def write_golden(df: DataFrame, path: str) -> None:
    """A golden set as JSON lines, one file per partition."""
    df.select("input", "actual_output", "retrieval_context").write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, path: str, min_chars: int = 500, suffix: str = "*.html") -> DataFrame:
    """Raw files below ``path`` with their text and a status: ok, too_short or empty."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", True).load(path)
    text = T.html_text(F.expr("make_valid_utf8(cast(content as string))"))
    return raw.select("path", "length", text.alias("text")).withColumn("status", F.when(T.is_blank("text"), "empty").when(F.length("text") < min_chars, "too_short").otherwise("ok"))


def export_sources(chunks: DataFrame) -> DataFrame:
    """Per query_id the numbered list of its sources, by rank: ``1. title (url)`` on lines of their own."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), T.first_filled("paper_title", F.lit("Unknown title")), F.lit(" ("), F.coalesce(T.first_filled("pdf_url"), F.lit("")), F.lit(")"))
    entry = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))  # at most the ranks that were kept
    return chunks.groupBy("query_id").agg(F.array_join(F.transform(entry, lambda e: e["line"]), "\n").alias("sources"))

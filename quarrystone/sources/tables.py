"""Tables by name, and the paper, query and passage views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T

#: Schemas of the pipeline's own tables, for readers that are given files of them.
SCHEMAS = {
    "papers": "paper_id string, title string, abstract string, year int, citation_count bigint, influential_citation_count bigint, open_access_pdf struct<url:string>, external_ids map<string,string>, url string, venue string, authors array<struct<name:string>>, embedding array<float>",
    "passages": "paper_id string, text string, text_source string, title string, url string, year int, venue string, citation_count bigint, influential_citation_count bigint",
    "chunks": "paper_id string, chunk_index int, text string, paper_title string, citation_count bigint, year int, venue string, influential_citation_count bigint, pdf_url string, section string, embedding array<float>",
    "answers": "query_id bigint, answer string, n_passages int",
    "golden": "input string, actual_output string, retrieval_context array<string>",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_papers(documents: DataFrame) -> DataFrame:
    """Documents as papers. Attributes that the table lacks are derived from the id by formula."""
    d = F.col("doc_id")
    first = F.regexp_extract("text", r"^[^\n.]*", 0)
    return documents.select(
        d.alias("ix"),
        F.concat(F.lit("P"), d.cast("string")).alias("paper_id"),
        F.substring(first, 1, 80).alias("title"),
        F.col("text").alias("abstract"),
        F.when(d % 11 != 0, (F.lit(1990) + d % 35)).cast("int").alias("year"),
        F.when(d % 13 != 0, d * 7919 % 5000).alias("citation_count"),
        (d * 31 % 300).alias("influential_citation_count"),
        F.when(d % 4 != 0, F.concat(F.lit("https://papers.example.org/"), d.cast("string"), F.lit(".pdf"))).alias("pdf_url"),
        F.col("source").alias("venue"),
        "lang",
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` as papers."""
    return as_papers(table(spark, sf_dir, "documents"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as queries: query_id and all words of the text."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(T.tokens("text"), " ").alias("query"))

"""Evidence packs for a table of questions: what a batch of answers is later written from.

    python -m jobs.evidence_packs --tables DIR --output DIR [--config FILE] [--master local[8]]

Reads ``documents``, ``embeddings`` and ``benchmark`` (the questions) below --tables. Each question's
documents are found by words (BM25) and by vectors, fused by reciprocal ranks, and chosen so that few come
from one source; the sources' quality verdicts go along. Writes, below --output,

* ``evidence``: query_id, final_rank, doc, venue, title, text, rrf_score, venue_passed; partitioned by lang
* ``packs``: query_id, n_documents and the numbered context that a model is given.

Both are replaced as a whole, so a rerun, also after a failure, leaves the same rows.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrystone.lineage import cut, join_bounded
from quarrystone.operators import answers, gate, keyword, ranking, vector
from quarrystone.session import session
from quarrystone.sources.tables import as_papers, questions, table

from .common import arguments, config_of

log = logging.getLogger("jobs.evidence_packs")
EVIDENCE = "query_id long, final_rank long, doc long, venue string, title string, text string, rrf_score double, venue_passed boolean, lang string"


def verdicts(papers: DataFrame, vectors: DataFrame, settings: dict) -> DataFrame:
    """(venue, venue_passed): the quality gate over each venue's papers, where only long abstracts count."""
    held = papers.withColumn("abstract", F.when(F.length("abstract") >= settings["long_abstract_chars"], F.col("abstract")))
    rows = held.join(vectors.select(F.col("vec_id").alias("ix"), "embedding"), "ix", "left")
    judged = gate.verdict(gate.metrics(rows, ["venue"], (settings["vector_dims"],)), min_papers=settings["min_papers"], min_abstract=settings["min_abstract_coverage"])
    return judged.select("venue", F.col("passed").alias("venue_passed"))


def evidence(spark: SparkSession, tables: str, settings: dict) -> DataFrame:
    """The rows of ``evidence``; questions without any hit have none."""
    documents, vectors = table(spark, tables, "documents"), table(spark, tables, "embeddings")
    asked = questions(spark, tables)
    log.info("read %d documents, %d vectors, %d questions", documents.count(), vectors.count(), asked.count())
    # A question's vector is the one with its id.
    points = asked.join(vectors, F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
    near = vector.knn(points, vectors.select(F.col("vec_id").alias("doc"), "embedding"), settings["pool"])
    by_words = keyword.okapi_topk(documents, asked, settings["pool"], "doc_id")
    papers = as_papers(documents)
    fused = cut(ranking.fuse(near, by_words, settings["fused"]))
    # The lists are short, the papers are not: what is looked up is counted, then broadcast or shuffled.
    found = cut(join_bounded(papers.select(F.col("ix").alias("doc"), "venue", "title", F.col("abstract").alias("text"), "lang"), fused, "doc"))
    chosen = ranking.diverse(found, settings["per_question"], settings["per_source"], "venue")
    judged = chosen.join(verdicts(papers, vectors, settings), "venue", "left")
    return judged.select("query_id", F.col("final_rank").cast("long").alias("final_rank"), "doc", "venue", "title", "text", F.round("score", 9).alias("rrf_score"), "venue_passed", "lang")


def run(spark: SparkSession, tables: str, output: str, settings: dict) -> dict[str, int]:
    """Writes both tables below ``output`` and returns the numbers of their rows."""
    evidence(spark, tables, settings).repartition("lang", "query_id").write.mode("overwrite").partitionBy("lang").parquet(f"{output}/evidence")
    rows = read(spark, output)
    packs = answers.context(rows.select("query_id", F.col("final_rank").alias("rank"), "text")).join(rows.groupBy("query_id").agg(F.count("*").alias("n_documents")), "query_id")
    packs.write.mode("overwrite").parquet(f"{output}/packs")
    written = {"evidence": rows.count(), "packs": spark.read.parquet(f"{output}/packs").count()}
    log.info("wrote %(evidence)d rows of evidence and %(packs)d packs to " + output.replace("%", "%%"), written)
    return written


def read(spark: SparkSession, output: str) -> DataFrame:
    """The evidence that a run left."""
    return spark.read.schema(EVIDENCE).parquet(f"{output}/evidence")


def main(argv: Sequence[str] | None = None) -> None:
    args = arguments(__doc__.splitlines()[0], {"tables": "folder of the input tables", "output": "folder for the results"}, argv)
    spark = session("evidence_packs", args.master)
    try:
        run(spark, args.tables, args.output, config_of(__file__, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

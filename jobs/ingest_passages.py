"""Takes new papers into the passage store, incrementally.

    python -m jobs.ingest_passages --papers DIR --output DIR --checkpoint DIR [--config FILE] [--master local[8]]

--papers is a folder of Parquet files that grows, or a pattern of such (``documents``: doc_id, text, lang, source). A file
stream with a checkpoint takes only files that no earlier run has taken, then ends. Each micro-batch

* leaves out papers whose id was taken before, and of an id's rows in the batch the first by its text's hash,
* gives each other paper a status: empty; repeat_title, if an earlier paper, or one of a smaller id in the
  batch, has its title; too_short, of which the abstract is one passage; or ok, which is cut into windows,
* writes ``passages`` (paper_id, chunk_index, text), partitioned by batch_id and venue, and ``ledger``
  (paper_id, ix, title_key, status, n_passages, venue), partitioned by batch_id.

A batch only ever replaces the partitions of its own number and looks only at ledgers of smaller ones. A batch
that is repeated after a failure therefore leaves what it would have left at once. Papers of equal titles keep
the one that came first, so how files are dealt to batches matters there, and nowhere else.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrystone.functions import text as T
from quarrystone.lineage import cut, join_weighed
from quarrystone.operators import ingest
from quarrystone.session import session
from quarrystone.sources.tables import as_papers

from .common import arguments, config_of

log = logging.getLogger("jobs.ingest_passages")
PAPERS = "doc_id long, text string, lang string, source string"
PASSAGES = "paper_id string, chunk_index int, text string, batch_id long, venue string"
LEDGER = "paper_id string, ix long, title_key string, status string, n_passages long, venue string, batch_id long"
WHOLE = 2**31 - 1


def ledger(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(f"{output}/ledger")


def passages(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(PASSAGES).parquet(f"{output}/passages")


def fresh_papers(batch: DataFrame, earlier: DataFrame) -> DataFrame:
    """One row (ix, paper_id, title_key, venue, text) for each id of the batch that ``earlier`` does not have."""
    rows = as_papers(batch).select("ix", "paper_id", T.title_key("title").alias("title_key"), "venue", F.col("abstract").alias("text")).where("ix is not null")
    # Rows of one id are reduced before they are shuffled.
    first = rows.groupBy("paper_id").agg(F.min_by(F.struct("ix", "title_key", "venue", "text"), F.struct(F.xxhash64("text"), "venue")).alias("r")).select("paper_id", "r.*")
    return first.join(earlier.select("paper_id"), "paper_id", "left_anti")


def with_status(papers: DataFrame, earlier: DataFrame, min_chars: int) -> DataFrame:
    """Adds status to ``papers``, which must be held: its titles are first counted, then joined by weight, for many papers may share one."""
    titled = F.coalesce(F.col("title_key") != "", F.lit(False))
    owners = papers.where(titled & ~T.is_blank("text")).groupBy("title_key").agg(F.min("ix").alias("owner"), F.count("*").alias("weight"))
    before = earlier.where(titled & F.col("status").isin("ok", "too_short")).select("title_key").distinct().withColumn("_before", F.lit(True))
    owner = F.when(F.col("_before"), F.lit(None).cast("long")).otherwise(F.col("owner")).alias("owner")
    known = cut(owners.join(before, "title_key", "left").select("title_key", owner, "weight", F.lit(True).alias("_known")))
    joined = join_weighed(papers, known, "title_key", "weight", "left")
    repeated = F.coalesce(F.col("_known"), F.lit(False)) & ~F.coalesce(F.col("owner") == F.col("ix"), F.lit(False))
    status: Column = F.when(T.is_blank("text"), "empty").when(repeated, "repeat_title").when(F.length("text") < min_chars, "too_short").otherwise("ok")
    return joined.withColumn("status", status).drop("owner", "_known")


def cut_passages(judged: DataFrame, size: int, overlap: int) -> DataFrame:
    """(paper_id, venue, chunk_index, text): windows of whole texts that are ok, and one passage of a short one."""
    kept = judged.select("paper_id", "venue", "text", "status")
    windows = ingest.token_windows(kept.where("status = 'ok'").drop("status"), size, overlap, WHOLE)
    short = kept.where("status = 'too_short'").select("paper_id", "venue", F.lit(0).alias("chunk_index"), "text")
    return windows.unionByName(short)


def take(batch: DataFrame, batch_id: int, output: str, settings: dict) -> None:
    """Writes what one micro-batch brings."""
    spark = batch.sparkSession
    earlier = ledger(spark, output).where(F.col("batch_id") < batch_id)
    papers = fresh_papers(batch, earlier).persist()
    try:
        n = papers.count()
        judged = with_status(papers, earlier, settings["min_full_text_chars"])
        found = cut_passages(judged, settings["chunk_size"], settings["chunk_overlap"]).withColumn("batch_id", F.lit(batch_id).cast("long"))
        writer = found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "venue")
        writer.parquet(f"{output}/passages")
        counts = passages(spark, output).where(F.col("batch_id") == batch_id).groupBy("paper_id").agg(F.count("*").alias("n_passages"))
        rows = judged.drop("text").join(counts, "paper_id", "left").select("paper_id", "ix", "title_key", "status", F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages"), "venue", F.lit(batch_id).cast("long").alias("batch_id"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{output}/ledger")
        done = ledger(spark, output).where(F.col("batch_id") == batch_id).groupBy("status").agg(F.count("*").alias("n"), F.sum("n_passages").alias("p")).collect()
        log.info("batch %d: %d new papers, %s", batch_id, n, ", ".join(f"{r['n']} {r['status']} with {r['p']} passages" for r in sorted(done)) or "nothing written")
    finally:
        papers.unpersist()


def run(spark: SparkSession, papers: str, output: str, checkpoint: str, settings: dict) -> dict[str, int]:
    """Takes all files of ``papers`` that the checkpoint has not seen, waits for the stream's end, and returns what the store holds."""
    for name, schema, by in (("passages", PASSAGES, ["batch_id", "venue"]), ("ledger", LEDGER, ["batch_id"])):
        # So that the first batch finds an empty table.
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*by).parquet(f"{output}/{name}")
    arriving = spark.readStream.schema(PAPERS).option("maxFilesPerTrigger", settings["max_files_per_batch"]).parquet(papers)
    stream = arriving.writeStream.foreachBatch(lambda batch, i: take(batch, i, output, settings)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    finally:
        stream.stop()
    held = ledger(spark, output)
    total = {"papers": held.count(), "passages": passages(spark, output).count()}
    log.info("%s now holds %d papers and %d passages", output, total["papers"], total["passages"])
    return total


def read(spark: SparkSession, output: str) -> DataFrame:
    """The whole store: a row per passage, and one with nulls per paper without any."""
    held = ledger(spark, output).select("paper_id", "venue", "status", "n_passages")
    return held.join(passages(spark, output).select("paper_id", "chunk_index", "text"), "paper_id", "left")


def main(argv: Sequence[str] | None = None) -> None:
    names = {"papers": "folder of Parquet files that grows", "output": "folder of the store", "checkpoint": "folder of the stream's checkpoint"}
    args = arguments(__doc__.splitlines()[0], names, argv)
    spark = session("ingest_passages", args.master)
    try:
        run(spark, args.papers, args.output, args.checkpoint, config_of(__file__, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

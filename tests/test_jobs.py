"""The two jobs: against SQL, over growing input, after failures, and from the command line."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, evidence_packs, ingest_passages, queries
from tests.comparing import connection, rows_of, rows_of_sql

ROOT = Path(__file__).resolve().parent.parent
SETTINGS = common.config_of(ingest_passages.__file__)
SMALL = SETTINGS | {"chunk_size": 8, "chunk_overlap": 2, "min_full_text_chars": 20}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(connection(sf_dir), queries.ORACLE[name])


def add(spark, folder, rows):
    spark.createDataFrame(rows, ingest_passages.PAPERS).coalesce(1).write.mode("append").parquet(folder)


def windows(text, size=8, overlap=2):
    words = text.split()
    return [" ".join(words[i : i + size]) for i in range(0, max(len(words) - overlap - 1, 0) + 1, size - overlap)]


def store(spark, folder):
    return sorted((tuple(r) for r in ingest_passages.read(spark, folder).select("paper_id", "venue", "status", "n_passages", "chunk_index", "text").collect()), key=repr)


def files(folder):
    return sorted(str(p) for p in Path(folder).rglob("*.parquet"))


def test_only_new_files_are_taken(spark, tmp_path):
    papers, out, mark = (str(tmp_path / n) for n in ("papers", "out", "mark"))
    long = "alpha title. " + " ".join(f"w{i}" for i in range(30))
    add(spark, papers, [(1, long, "en", "s"), (2, "tiny one", "en", None), (3, " \n ", "de", "s"), (4, None, "de", "t")])
    first = ingest_passages.run(spark, papers, out, mark, SMALL)
    expected = [("P1", "s", "ok", len(windows(long)), i, w) for i, w in enumerate(windows(long))]
    expected += [("P2", None, "too_short", 1, 0, "tiny one"), ("P3", "s", "empty", 0, None, None), ("P4", "t", "empty", 0, None, None)]
    assert store(spark, out) == sorted(expected, key=repr) and first == {"papers": 4, "passages": len(windows(long)) + 1}
    before = files(out)
    assert ingest_passages.run(spark, papers, out, mark, SMALL) == first and files(out) == before
    # Growth: a known id with another text, a known title, a title twice in one file, an id twice, and a new paper.
    other = "beta title. " + " ".join(f"v{i}" for i in range(12))
    add(spark, papers, [(1, "changed " * 9, "en", "s"), (5, long.upper(), "en", "s"), (7, other + " later", "en", "s"), (6, other, "en", "s"), (8, "gamma", "en", "u"), (8, "gamma", "en", "u"), (9, "\nno title but a text of some length here", "en", "u"), (10, "\nno title either but another text here", "en", "u")])
    ingest_passages.run(spark, papers, out, mark, SMALL)
    expected += [("P6", "s", "ok", len(windows(other)), i, w) for i, w in enumerate(windows(other))]
    expected += [("P5", "s", "repeat_title", 0, None, None), ("P7", "s", "repeat_title", 0, None, None), ("P8", "u", "too_short", 1, 0, "gamma")]
    for i, text in ((9, "no title but a text of some length here"), (10, "no title either but another text here")):
        expected += [(f"P{i}", "u", "ok", len(windows(text)), j, w) for j, w in enumerate(windows(text))]
    assert store(spark, out) == sorted(expected, key=repr)
    assert set(before) <= set(files(out))  # what was there is not written again


def test_files_in_several_batches_give_the_same_store(spark, sf_dir, tmp_path):
    papers = str(tmp_path / "papers")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    for lo in (0, 70, 140):
        rows.where((F.col("doc_id") >= lo) & (F.col("doc_id") < lo + 70 if lo < 140 else F.lit(True)) & (F.col("doc_id") >= lo)).coalesce(1).write.mode("append").parquet(papers)
        ingest_passages.run(spark, papers, str(tmp_path / "a"), str(tmp_path / "ma"), SETTINGS | {"max_files_per_batch": 1})
    whole = str(tmp_path / "whole")
    rows.coalesce(1).write.parquet(whole)
    ingest_passages.run(spark, whole, str(tmp_path / "b"), str(tmp_path / "mb"), SETTINGS)
    assert store(spark, str(tmp_path / "a")) == store(spark, str(tmp_path / "b"))


def test_a_batch_that_failed_half_way_is_done_again(spark, tmp_path, monkeypatch):
    papers, out, mark = (str(tmp_path / n) for n in ("papers", "out", "mark"))
    add(spark, papers, [(1, "one title. " + "word " * 30, "en", "s"), (2, "two title. " + "word " * 9, "en", "t")])
    whole, take = [], ingest_passages.take

    def fails(batch, batch_id, output, settings):
        take(batch, batch_id, output, settings)
        whole.append(store(spark, output))
        raise RuntimeError("lost after the tables were written, before the batch was committed")

    monkeypatch.setattr(ingest_passages, "take", fails)
    with pytest.raises(Exception, match="lost after"):
        ingest_passages.run(spark, papers, out, mark, SMALL)
    monkeypatch.setattr(ingest_passages, "take", take)
    ingest_passages.run(spark, papers, out, mark, SMALL)
    assert store(spark, out) == whole[0] and {r[0] for r in whole[0]} == {"P1", "P2"}


def test_an_empty_folder_gives_empty_tables(spark, tmp_path):
    (tmp_path / "papers").mkdir()
    assert ingest_passages.run(spark, str(tmp_path / "papers"), str(tmp_path / "out"), str(tmp_path / "mark"), SMALL) == {"papers": 0, "passages": 0}


def test_evidence_is_replaced_as_a_whole_and_settings_are_kept(spark, sf_dir, tmp_path):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    out, settings = str(tmp_path / "out"), common.config_of(evidence_packs.__file__)
    spark.createDataFrame([(1, "stale")], "query_id long, lang string").write.partitionBy("lang").parquet(f"{out}/evidence")
    written = evidence_packs.run(spark, sf_dir, out, settings)
    rows = evidence_packs.read(spark, out)
    assert written["evidence"] == rows.count() and rows.where("lang = 'stale'").count() == 0
    packs = {r["query_id"]: r for r in spark.read.parquet(f"{out}/packs").collect()}
    for q, own in packs.items():
        texts = [r["text"] for r in rows.where(F.col("query_id") == q).orderBy("final_rank").collect()]
        assert own["n_documents"] == len(texts) and own["context"] == "\n---\n".join(f"[{i}] {t}" for i, t in enumerate(texts, 1))
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))


def test_config_files(tmp_path):
    own = tmp_path / "own.json"
    own.write_text(json.dumps({"chunk_size": 7}))
    assert common.config_of(ingest_passages.__file__, str(own)) == SETTINGS | {"chunk_size": 7}
    own.write_text(json.dumps({"chunk_sice": 7}))
    with pytest.raises(ValueError, match="chunk_sice"):
        common.config_of(ingest_passages.__file__, str(own))


def test_command_line(spark, tmp_path):
    papers, out = str(tmp_path / "papers"), str(tmp_path / "out")
    add(spark, papers, [(1, "one title. " + "word " * 200, "en", "s")])
    command = [sys.executable, "-m", "jobs.ingest_passages", "--papers", papers, "--output", out, "--checkpoint", str(tmp_path / "mark"), "--master", "local[2]"]
    for _ in range(2):
        done = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(ROOT)}, timeout=300)
        assert done.returncode == 0 and "now holds 1 papers and 1 passages" in done.stderr, done.stderr[-2000:]
    assert store(spark, out)[0][:4] == ("P1", "s", "ok", 1)

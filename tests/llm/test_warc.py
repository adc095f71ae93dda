import gzip  # noqa: F401
import hashlib
import io
import os

import pytest

from quarrystone.llm import warc
from tests.comparing import connection, rows_of, rows_of_sql

SCHEMA = "page_id long, url string, html string"


def pages():
    big = "<p>" + "same text over and over " * 20
    return [(5, "http://a/", big), (3, "http://b/\r\nx: y", big), (9, None, big), (4, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", big), (None, "u", "only null ids " * 20), (None, "u", "only null ids " * 20), (11, "u", "é😀" * 400_000), (3, "z", big), (12, "u", "WARC/1.1\r\n\r\n" * 30), (13, "u", "y" * 99), (14, "u", "y" * 99), (15, "u", "é" * 50), (16, "u", "é" * 50)]


def test_records_and_files(spark, tmp_path):
    rows = spark.createDataFrame([(*p, "x", "x") for p in pages()], SCHEMA + ", payload string, digest string")
    manifest = warc.write_archives(rows.repartition(3), str(tmp_path))
    assert sum(r.n_records for r in manifest.collect()) == len(pages())
    got = warc.read_archives(spark, manifest, str(tmp_path)).collect()
    assert len(got) == len(pages())
    raw = {hashlib.sha256((h or "").encode()).hexdigest(): len((h or "").encode()) for _, _, h in pages()}
    assert all(r.payload_bytes == raw[r.payload_digest] for r in got)
    big = [r for r in got if r.payload_bytes == len(pages()[0][2].encode())]
    assert sum(r.record_type == "response" for r in big) == 1 and all(r.page_id == 3 for r in big if r.record_type == "response")
    assert sorted(str(r.page_id) for r in big if r.record_type == "revisit") == ["3", "5", "9", "None"] and {r.refers_to for r in big if r.record_type == "revisit"} == {3}
    kind = {r.page_id: r.record_type for r in got}
    assert [kind[i] for i in (4, 2, 7, 8, 13, 14, 15, 16)] == ["response"] * 7 + ["revisit"]
    assert sorted(r.record_type for r in got if r.payload_bytes == len("only null ids " * 20)) == ["response", "revisit"]
    for name in (f for f in os.listdir(tmp_path) if f.endswith(".zst")):
        with open(tmp_path / name, "rb") as f:
            assert int.from_bytes(f.read(4), "little") == warc.DICTIONARY_FRAME
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".tmp")]


def test_each_record_is_a_frame_of_its_own():
    import zstandard

    samples = [f"<html><body>page {i} of many similar pages {i * 7}</body></html>".encode() * 3 for i in range(300)]
    dictionary = warc.train_dictionary(samples)
    assert dictionary[:4] == b"\x37\xa4\x30\xec"
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out, dictionary)
    places = []
    for i, s in enumerate(samples[:5]):
        places.append(out.tell())
        writer.add(warc.record("resource", "0", "d", {"n": str(i)}, s))
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    assert samples[3] in plain.decompress(out.getvalue()[places[3] : places[4]])
    out.seek(0)
    assert [(h["n"], b) for h, b in warc.read_archive(out)] == [(str(i), s) for i, s in enumerate(samples[:5])]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(b"\0" * 20)))


def test_archives_rotate(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rows = spark.createDataFrame([(i, "u", os.urandom(3000).hex()) for i in range(40)], SCHEMA).coalesce(1)
    manifest = warc.write_archives(rows, str(tmp_path))
    assert manifest.count() >= 1
    assert {r.page_id for r in warc.read_archives(spark, manifest, str(tmp_path)).collect()} == set(range(40))


def test_sql_and_empty(spark, sf_dir):
    got = warc.archive_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("archive")
    assert rows_of(got) == rows_of_sql(connection(sf_dir), warc.oracle())
    assert warc.archive_and_read(spark.createDataFrame([], SCHEMA)).count() == 0

"""WARC archives compressed with a shared dictionary, and their reader.

Every task streams its records into archives ``part-<task>-<n>.warc.zst``: a leading skippable frame
(0x184D2A5D) holds the Zstandard dictionary, then each record is a frame of its own, so any record can
be read alone. The dictionary is trained on a bounded sample of the records to be archived, headers and
revisits included. Payloads that occur before are written as revisit records. Archives are written under a temporary name and
moved when complete, so a task that is run again replaces its own files; the manifest of a finished
write is what readers go by.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._common import cut, join_weighed, sample_keys, shared_dir, text_batches

DICTIONARY_FRAME = 0x184D2A5D
ARCHIVE_BYTES = 64 << 20  # compressed size at which a task starts its next archive
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 1 << 16, 1 << 16
LEAST_REVISIT = 100  # payloads below this size are never revisits
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _filesystem(folder: str):
    """(pyarrow filesystem, path) of a folder given as a path or URI."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder)


def _clean(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record(kind: str, record_id: str, date: str, headers: dict[str, str], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{record_id}>", "WARC-Date": date} | headers | {"Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in fields.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def page_record(row: dict, name: str, date: str) -> bytes:
    """The response or revisit record of a row; ``name`` tells apart records that no payload names."""
    payload = row["payload"]
    of = lambda text: str(uuid.UUID(hashlib.sha256(text.encode()).hexdigest()[:32]))
    first = of(f"response {row['digest']}")
    headers = {"WARC-Target-URI": row["url"] or "urn:none", "WARC-Payload-Digest": f"sha256:{row['digest']}", "X-Payload-Length": str(len(payload))}
    if row["page_id"] is not None:
        headers["X-Page-ID"] = str(row["page_id"])
    headers["Content-Type"] = "application/http; msgtype=response"
    if row["revisit"]:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:uuid:{first}>"}
        if row["refers_to"] is not None:
            headers["X-Refers-To-Page-ID"] = str(row["refers_to"])
        return record("revisit", of(f"revisit {name}"), date, headers, HTTP)
    return record("response", first if len(payload) >= LEAST_REVISIT else of(f"response {name}"), date, headers, HTTP + payload)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary of the samples; empty where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


class ArchiveWriter:
    """Writes records, each as a frame, behind a frame that holds the dictionary."""

    def __init__(self, out, dictionary: bytes, level: int = 6):
        import zstandard

        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.out, self.size = out, 0
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True, write_checksum=True)
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, one: bytes) -> None:
        self._put(self.compressor.compress(one))


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, read as a stream."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary frame")
    dictionary = source.read(size)
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    plain = zstandard.ZstdDecompressor(dict_data=known).stream_reader(source, read_across_frames=True)
    stream = io.BufferedReader(plain, 1 << 16)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        length = int(headers["Content-Length"])
        block = stream.read(length)
        if len(block) != length or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield headers, block


def _write(folder: str, dictionary, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, root = _filesystem(folder)
        done: list[tuple[str, int, int]] = []
        out = writer = None
        count = total = 0

        def close():
            out.close()
            name = f"part-{task.partitionId():06d}-{len(done):04d}.warc.zst"
            files.move(temporary, f"{root}/{name}")
            done.append((name, count, writer.size))

        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    temporary = f"{root}/.{task.taskAttemptId()}-{len(done)}.tmp"
                    out = files.open_output_stream(temporary, compression=None)
                    writer, count = ArchiveWriter(out, dictionary.value), 0
                    writer.add(record("warcinfo", str(uuid.UUID(int=(task.partitionId() << 32) + len(done))), date, {"Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                writer.add(page_record(row, f"{task.partitionId()} {total}", date))
                count, total = count + 1, total + 1
                if writer.size >= ARCHIVE_BYTES:
                    close()
                    writer = None
        if writer is not None:
            close()
        if done:
            names, counts, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "n_records", "n_bytes"])

    return run


def _read(folder: str):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with files.open_input_stream(f"{root}/{archive}", compression=None) as source:
                    for headers, block in read_archive(source):
                        kind = headers["WARC-Type"]
                        if kind not in ("response", "revisit"):
                            continue
                        digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"])
                        if kind == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            size, found = len(payload), hashlib.sha256(payload).hexdigest()
                            if found != digest:
                                raise ValueError(f"{archive}: a payload does not have its digest")
                        page, to = (int(headers[h]) if h in headers else None for h in ("X-Page-ID", "X-Refers-To-Page-ID"))
                        rows.append((page, size, digest, kind, to, archive))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


class Plan:
    """What becomes of each row of ``pages`` (page_id, url, html): the payloads that repeat are found once."""

    def __init__(self, pages: DataFrame):
        payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
        self.rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
        large = self.rows.where(F.octet_length("payload") >= LEAST_REVISIT).select("page_id", F.sha2("payload", 256).alias("digest"))
        firsts = large.groupBy("digest", "page_id").agg(F.count("*").alias("n")).groupBy("digest").agg(F.sum("n").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n"))).alias("first"))
        self.copies = cut(firsts.where("n > 1").select("digest", F.col("first.page_id").alias("first"), F.coalesce(F.col("first.n"), "n").alias("n_first"), "n"))
        seen = self.copies.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.count_if(F.col("n_first") > 1).alias("tied")).first()
        self.size, self.tied = (seen.n, seen["all"]), seen.tied

    def records(self, rows: DataFrame) -> DataFrame:
        """page_id, url, payload, digest, revisit and refers_to of some of ``rows``."""
        rows = rows.withColumn("digest", F.sha2("payload", 256))
        joined = join_weighed(rows, self.copies, "digest", "n", "left", rows=100_000, size=self.size)  # about 150 bytes a row
        joined = joined.withColumn("n_first", F.when(F.octet_length("payload") >= LEAST_REVISIT, F.col("n_first"))).withColumn("turn", F.lit(1))
        if self.tied:  # rows that repeat the first page_id with its payload: one of them is the response
            many = F.coalesce(F.col("n_first") > 1, F.lit(False)) & F.col("page_id").eqNullSafe(F.col("first"))
            turn = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url"))
            joined = joined.where(~many).unionByName(joined.where(many).withColumn("turn", turn))
        later = F.col("n_first").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("first")) | (F.col("turn") > 1))
        return joined.select("page_id", "url", "payload", "digest", later.alias("revisit"), F.when(later, F.col("first")).alias("refers_to"))

    def dictionary(self, date: str) -> bytes:
        """Trained on the records, revisits included, of a sample of bounded number and size; a larger payload lends its beginning."""
        h = F.xxhash64("page_id", "url")
        keys = sample_keys(self.rows.select("page_id", "url"), h, SAMPLE_ROWS)
        some = self.rows.withColumn("_h", h).join(F.broadcast(keys), "_h").drop("_h").limit(2 * SAMPLE_ROWS)  # SAMPLE_ROWS keys
        shown = self.records(some).withColumn("payload", F.substring("payload", 1, SAMPLE_BYTES)).collect()
        rows = sorted((r.asDict() for r in shown), key=lambda r: (r["digest"], str(r["page_id"]), str(r["url"])))
        return train_dictionary([page_record(r | {"payload": bytes(r["payload"]), "url": (r["url"] or "")[:SAMPLE_BYTES]}, str(i), date) for i, r in enumerate(rows)])


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) below ``folder``; returns the manifest (archive, n_records, n_bytes).

    Of equal payloads of at least LEAST_REVISIT bytes the one with the smallest page_id is a
    response, the others are revisits of it. A null html is an empty payload, a null url is
    recorded as urn:none; a row with a null page_id has no id in its record and revisits equal
    payloads that have one. Of rows that repeat both page_id and payload one is the response.
    Payloads of any size are archived whole; other columns are left out; no rows, no archives.
    """
    spark = pages.sparkSession
    text_batches(spark)
    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    plan = Plan(pages)
    dictionary = spark.sparkContext.broadcast(plan.dictionary(date))  # at most DICTIONARY_BYTES
    return cut(plan.records(plan.rows).mapInArrow(_write(folder, dictionary, date), "archive string, n_records long, n_bytes long"))


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """A row per page record of the manifest's archives: page_id, payload_bytes, payload_digest, record_type, refers_to, archive.

    Response payloads are checked against their digests; a damaged archive raises.
    """
    names = manifest.select("archive")
    return names.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "archive").mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Archives ``pages`` in the cluster's shared folder and reads the archives back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read_archives(spark, write_archives(pages, folder), folder)


def oracle() -> str:
    """DuckDB SQL for the page records, without the archives."""
    return f"""
with p as (select page_id, coalesce(encode(html), ''::blob) as b from pages),
d as (select page_id, octet_length(b) as n, sha256(b) as digest from p),
f as (select digest, min(page_id) as first from d where n >= {LEAST_REVISIT} group by digest)
select page_id, n as payload_bytes, d.digest as payload_digest,
       case when page_id <> first then 'revisit' else 'response' end as record_type,
       case when page_id <> first then first end as refers_to
from d left join f on d.digest = f.digest and n >= {LEAST_REVISIT}"""

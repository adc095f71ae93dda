"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file gives each token's bytes. For the library, bytes are written as the usual printable
characters; every split of a token into two known tokens becomes a merge at the token's rank, and
a match that is itself a token is taken whole, so results equal those of rank-based merging. Token
byte lengths turn ids into byte offsets, and a running count of character starts turns those into
character offsets. Decoding looks ids up in the byte table; a character split over tokens comes out
whole because bytes are joined before they are read as UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import text_batches

#: Characters and matches per call of the library; a longer match is encoded alone and whole.
CALL_CHARS, CALL_MATCHES = 1 << 16, 4096
#: Bytes that a worker's remembered matches may take (about 130 for each and its characters); beyond that it starts
#: afresh. Matches over LONGEST characters are never remembered.
KNOWN_BYTES, LONGEST = 24 << 20, 64


def byte_characters() -> dict[int, str]:
    """Byte value -> the printable character that stands for it."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(lines: str) -> dict[bytes, int]:
    """The rank file's text: a base64 token and its rank on each line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines.splitlines() if line)}


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, lines: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(lines)
        shown = byte_characters()
        name = {t: "".join(shown[b] for b in t) for t in ranks}
        merges = [(name[t[:i]], name[t[i:]]) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        top = max(ranks.values(), default=-1) + 1
        by_id = [b""] * top
        for t, r in ranks.items():
            by_id[r] = t
        self.length = np.array([len(t) for t in by_id], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text, every text whole.

        Texts are cut into the pattern's matches; each distinct match that is not known yet goes to
        the library once, and the ids of a text are those of its matches in order.
        """
        out = []
        for text in texts:
            matches = self.pattern.findall(text)
            if self.known_bytes > KNOWN_BYTES:
                self.known.clear()
                self.known_bytes = 0
            own = self._learn(list({m for m in matches if m not in self.known}))
            ids = b"".join([self.known[m] if m in self.known else own[m] for m in matches]) if own else b"".join(map(self.known.__getitem__, matches))
            out.append(np.frombuffer(ids, "<u4"))
        return out

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        """Encodes ``fresh`` and remembers it; returns what is too long for that."""
        own, lo = {}, 0
        while lo < len(fresh):
            hi, size = lo, 0
            while hi < len(fresh) and hi < lo + CALL_MATCHES and (hi == lo or size + len(fresh[hi]) <= CALL_CHARS):
                size += len(fresh[hi])
                hi += 1
            for m, e in zip(fresh[lo:hi], self.tokenizer.encode_batch(fresh[lo:hi], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4").tobytes()
                if len(m) > LONGEST:
                    own[m] = ids
                else:
                    self.known[m] = ids
                    self.known_bytes += 130 + 4 * len(m)
            lo = hi
        return own

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 character of each token; a token inside a character covers the whole character."""
        ends = np.cumsum(self.length[ids])
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char[ends - self.length[ids]], char[ends - 1] + 1

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``; ids outside the table raise IndexError."""
        n = self.length[ids]
        to = np.cumsum(n) - n
        return self.bytes[np.repeat(self.begin[ids] - to, n) + np.arange(int(n.sum()))].tobytes()


@lru_cache(maxsize=2)
def codec(lines: str, pattern: str) -> Codec:
    """One codec per worker process."""
    return Codec(lines, pattern)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    at = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat).cast(kind))


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _encode(lines: str, pattern: str, offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(lines, pattern)
        for batch in _texts(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = own.encode(texts)
            columns = [batch.column(0), _lists(ids, pa.int32())]
            if offsets:
                spans = [own.offsets(t, i) for t, i in zip(texts, ids)]
                columns += [_lists([s[k] for s in spans], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "starts", "ends"][: len(columns)])

    return run


def _decode(lines: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(lines, pattern)
        for batch in _texts(batches):
            lists = batch.column(1)
            flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            decoded = [own.decode(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], ["doc_id", "decoded"])

    return run


def _digests(lines: str, pattern: str, with_ids: bool):
    encode, decode = _encode(lines, pattern, True), _decode(lines, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for coded in encode(batches):
            for back in decode([coded]):
                at = coded.column(1).offsets.to_numpy()
                flat = coded.column(1).values.to_numpy().astype("<u4")
                of_ids = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:])]
                of_bytes = [hashlib.sha256(x).hexdigest() for x in back.column(1).to_pylist()]
                starts, ends = (coded.column(c).values.to_numpy().astype("<u4") for c in (2, 3))
                of_offsets = [hashlib.sha256(starts[a:b].tobytes() + ends[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:])]
                columns = [coded.column(0), pa.array(np.diff(at), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string()), pa.array(of_offsets, pa.string()), coded.column(1)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256", "ids"]
                n = len(names) - (not with_ids)
                yield pa.RecordBatch.from_arrays(columns[:n], names[:n])

    return run


def _rank_file(path: str) -> str:
    with open(path) as f:
        return f.read()


def _narrow(docs: DataFrame) -> DataFrame:
    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = True) -> DataFrame:
    """Encodes every whole text of ``docs`` (doc_id, text): doc_id, ids and, if asked for, starts and ends.

    ``path`` is a rank file that the driver can read; it travels with the tasks. ``starts`` and
    ``ends`` are character offsets into the text. Null and empty texts give empty arrays; a null
    doc_id stays null; repeated rows are encoded each; other columns are left out; an empty table
    gives an empty result.
    """
    extra = ", starts array<int>, ends array<int>" if offsets else ""
    return _narrow(docs).mapInArrow(_encode(_rank_file(path), pattern, offsets), f"doc_id long, ids array<int>{extra}")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Decodes (doc_id, ids): doc_id, decoded (bytes) and text (the bytes as UTF-8).

    Empty or null arrays give no bytes. Ids that cut a character in two give its bytes as they are;
    in ``text`` such a fragment is the replacement character.
    """
    filled = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    raw = filled.mapInArrow(_decode(_rank_file(path), pattern), "doc_id long, decoded binary")
    return raw.withColumn("text", F.expr("make_valid_utf8(cast(decoded as string))"))


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, SHA-256 of the ids, of the decoded bytes and of the offsets, and the ids if asked for.

    Cases are handled as in ``encode``; ids, and all starts followed by all ends, are hashed as little-endian unsigned 32-bit integers.
    """
    return _narrow(docs).mapInArrow(_digests(_rank_file(path), pattern, with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string" + ", ids array<int>" * with_ids)

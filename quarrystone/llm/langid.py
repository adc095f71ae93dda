"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (n = 1 to 4, the blended spectrum) that
both hold, each counted once, divided by the geometric mean of their own numbers. A long text would
hold nearly every n-gram of every language, so texts are taken in pieces of PIECE characters, with
presence and kernel by piece; a text's score is the mean over all its pieces, weighted by length.
N-grams are hashed to DIMS bins, of which a piece can fill one in sixteen. Labelled pieces are
projected on landmarks (Nystroem), and a ridge regression is fitted for each language against the
rest. As the kernel is an inner product of presence vectors, (presence x landmarks') x coefficients is
taken as presence x (landmarks' x coefficients): a batch of pieces is scored by one product of its
sparse presence matrix with the languages' weights. Fitting takes a bounded sample of labelled rows
(``per_language``, ``rows``), a piece of each; scoring reads every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ._common import text_batches

DIMS, ORDERS, PIECE = 1 << 18, 4, 4096
ROWS, CHARS = 256, 1 << 17  # texts and characters hashed at a time; a longer text alone
MARK_BLOCK = 4096  # bins multiplied at a time when fitting
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    """Code point -> its lower-case code point if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low[0])
    return out


class Pieces:
    """The presence matrix of the pieces of some texts, by its non-zero places.

    ``bins`` holds the sorted bins of piece p at ``at[p]:at[p + 1]``, ``row`` its text, ``size`` its characters.
    """

    def __init__(self, bins: np.ndarray, at: np.ndarray, row: np.ndarray, size: np.ndarray):
        self.bins, self.at, self.row, self.size = bins, at, row, size


def presence(texts: list[str | None]) -> Pieces:
    """The pieces of ``texts`` that have a letter; A-Z and all other letters in lower case, runs of other characters as one blank."""
    fold = _tables()
    joined = " ".join(t or "" for t in texts) + " "
    code = fold[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    row = np.repeat(np.arange(len(texts)), [len(t or "") + 1 for t in texts])
    keep = (code != 0) | (np.concatenate(([1], code[:-1])) != 0)
    keep[np.flatnonzero(np.diff(row, prepend=-1))] = True
    code, row = code[keep], row[keep]
    start = np.searchsorted(row, np.arange(len(texts)))
    fresh = np.flatnonzero((np.arange(len(row)) - start[row]) % PIECE == 0) if len(row) else np.empty(0, np.int64)
    piece = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(row))))
    letters = np.bincount(piece[code != 0], minlength=len(fresh))
    kind = np.uint32 if len(fresh) < (1 << 32) // DIMS else np.uint64
    base, ends = piece.astype(kind) * kind(DIMS), np.flatnonzero(np.diff(row))  # last character of each text but the last
    h, keys = np.zeros(len(code), np.uint32), []
    for n in range(1, ORDERS + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + (code[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        key = base[:m] + (mixed >> np.uint32(14))
        over = (ends[:, None] - np.arange(n - 1)).reshape(-1)
        keys.append(np.delete(key, over[(over >= 0) & (over < m) & (row[over.clip(0)] != row[(over + n - 1).clip(0, len(row) - 1)])]) if n > 1 else key)
    key = np.sort(np.concatenate(keys)) if keys else np.empty(0, kind)
    key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
    own = (key // kind(DIMS)).astype(np.int64)
    used = letters > 0
    key, own = key[used[own]], own[used[own]]
    at = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(fresh))[used]))).astype(np.int64)
    return Pieces((key % kind(DIMS)).astype(np.int64), at, row[fresh][used], letters[used])


def _portions(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of about CHARS characters at a time."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= CHARS):
            size += len(texts[hi] or "")
            hi += 1
        yield lo, texts[lo:hi]
        lo = hi


def packed(bins: np.ndarray) -> bytes:
    """Sorted bins as compressed steps."""
    return zlib.compress(np.diff(bins, prepend=0).astype("<u4").tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), "<u4").astype(np.int64))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lang, text) -> (key, lang, bits): the bins of one piece of each text, picked by the key."""
    for batch in batches:
        keys, texts, out = batch.column(0).to_numpy(), batch.column(2).to_pylist(), [None] * batch.num_rows
        for lo, part in _portions(texts):
            found = presence(part)
            first = np.searchsorted(found.row, np.arange(len(part)))
            count = np.bincount(found.row, minlength=len(part))
            for r in np.flatnonzero(count).tolist():
                p = int(first[r] + (int(keys[lo + r]) >> 8) % int(count[r]))
                out[lo + r] = packed(found.bins[found.at[p] : found.at[p + 1]])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["key", "lang", "bits"])


class Model:
    """Languages, the bins that some landmark holds, and their weight for each language."""

    def __init__(self, languages: list[str], bins: np.ndarray, weights: np.ndarray):
        self.languages, self.weights = languages, np.vstack((weights, np.zeros((1, len(languages)), np.float32)))
        self.place = np.full(DIMS, len(bins), np.int32)  # bins of no landmark only count in the norm
        self.place[bins] = np.arange(len(bins))

    def piece_scores(self, found: Pieces) -> np.ndarray:
        """One row for each piece, one column for each language."""
        if not len(found.row):
            return np.zeros((0, len(self.languages)))
        sums = np.add.reduceat(self.weights[self.place[found.bins]], found.at[:-1], axis=0, dtype=np.float64)
        return sums / np.sqrt(np.diff(found.at))[:, None]

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(a row for each text, the mean over its pieces; whether it has a letter)."""
        out, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        for lo, part in _portions(texts):
            found = presence(part)
            weight = np.bincount(found.row, found.size, minlength=len(part))
            letters[lo : lo + len(part)] = weight > 0
            share = found.size / weight[found.row]
            for c, own in enumerate(self.piece_scores(found).T):
                out[lo : lo + len(part), c] = np.bincount(found.row, own * share, minlength=len(part))
        return out, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and a score from 0 to 1 of each text; UNKNOWN and 0 without letters."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        raw, letters = self.scores(texts)
        share = np.exp(8 * (raw - raw.max(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
        return names, np.where(letters, share[np.arange(len(best)), best], 0.0)


def solve(bits: list[bytes], labels: list[str], landmarks: int = 64, ridge: float = 1e-3) -> Model:
    """Fits the model to packed pieces; ``landmarks`` per language are the first ones of each."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.empty(0, np.int64), np.zeros((0, 0), np.float32))
    rows = [unpacked(b) for b in bits]
    which = np.array([languages.index(v) for v in labels])
    marks = np.concatenate([np.flatnonzero(which == c)[:landmarks] for c in range(len(languages))])
    bins = np.unique(np.concatenate([rows[m] for m in marks]))
    length = np.sqrt(np.array([len(r) for r in rows], np.float64))
    # Common bins of all pieces and the landmarks, by dense products over a block of bins at a time.
    own = np.concatenate(rows)
    place = np.searchsorted(bins, own).clip(max=len(bins) - 1)
    known = bins[place] == own
    line, place = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[known], place[known]
    order = np.argsort(place, kind="stable")
    line, place = line[order], place[order]
    both = np.zeros((len(rows), len(marks)))
    for lo in range(0, len(bins), MARK_BLOCK):
        a, b = np.searchsorted(place, (lo, lo + MARK_BLOCK))
        x = np.zeros((len(rows), MARK_BLOCK), np.float32)
        x[line[a:b], place[a:b] - lo] = 1
        both += x @ x[marks].T
    near = both / np.outer(length, length[marks])
    weight = 1 / np.bincount(which)[which]  # each language counts alike
    target = (which[:, None] == np.arange(len(languages))).astype(np.float64)
    left = near.T @ (near * weight[:, None]) + ridge * len(languages) * near[marks] + 1e-8 * np.eye(len(marks))
    coefficients = np.linalg.solve(left, near.T @ (target * weight[:, None])) / length[marks][:, None]
    weights = np.zeros((len(bins), len(languages)), np.float32)
    for m, c in zip(marks, coefficients):
        weights[np.searchsorted(bins, rows[m])] += c.astype(np.float32)
    return Model(languages, bins, weights)


def fit(docs: DataFrame, per_language: int = 300, landmarks: int = 64, rows: int = 6000) -> Model:
    """Fits on about ``per_language`` rows of each language of ``docs`` (doc_id, text, lang), taken by a hash of doc_id and lang.

    Rows with a null text, lang or doc_id, or no letter, teach nothing; a long text teaches one of its
    pieces, picked by the hash. Every language is learnt; with more than ``rows`` / ``per_language`` of
    them each has fewer rows and landmarks, 8 at least. Rows are counted first, so that a
    language's share of the hashes holds about twice what is wanted, however many rows it has. Only
    pieces of bounded size come to the driver.
    """
    text_batches(docs.sparkSession)
    known = docs.where("text is not null and lang is not null and doc_id is not null").select(F.xxhash64(F.col("doc_id").cast("long"), "lang").alias("key"), "lang", F.col("text").cast("string").alias("text"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    if not counts:
        return solve([], [])
    share = max(8, min(per_language, rows // len(counts)))
    wanted = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 2 * share / r.n)) for r in counts], "lang string, share double")
    fair = known.select("key", "lang").join(F.broadcast(wanted), "lang").where((F.col("share") >= 1) | (F.col("key").cast("double") < F.col("share") * 2.0**64 - 2.0**63))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = fair.select("key", "lang").distinct().select("key", place.alias("_n")).where(F.col("_n") <= share).select("key")
    taught = known.join(F.broadcast(chosen), "key").mapInArrow(_bits, "key long, lang string, bits binary").where("bits is not null")
    got = sorted(taught.groupBy("key", "lang").agg(F.min("bits").alias("bits")).collect(), key=lambda r: (r.key, r.lang))
    return solve([bytes(r.bits) for r in got], [r.lang for r in got], min(landmarks, share))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                names, score = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(row, lang_pred, score) of each row of ``docs``; ``row`` is a struct of all its columns, whatever their names.

    Null texts and texts without letters get ``und`` and 0; long texts are read whole; repeated rows
    are scored each; an empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most DIMS x languages
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predict(shared), schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that teach nothing: crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the rows that are not held out, then predicts all: doc_id, held_out, lang_pred, score.

    Null texts and texts without letters are ``und`` with score 0; a null doc_id is not held out and
    teaches nothing; repeated rows are scored each, very long texts whole; other columns are left out;
    where nothing can be learnt all are ``und``; empty in, empty out.
    """
    model = fit(docs.where(~held_out()))
    ids = docs.select("doc_id", "text")
    return predict(ids, model).select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """``docs`` without the rows that have no letters or whose language scores below ``least``, all columns as they were; cases as in ``identify``."""
    model = fit(docs.where(~held_out()))
    return predict(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")

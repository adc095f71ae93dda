"""Shared plumbing of the training-data operators.

* ``text_batches``   -- keeps the Arrow batches of long texts small
* ``components``     -- connected components, tied within tasks, then by alternating large/small stars
* ``star_edges``     -- ties the members of every bucket together
* ``block_groups``   -- splits clusters of any size into bounded groups
* ``ShingleHasher``  -- word and word-shingle hashing over Arrow buffers
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..lineage import cut, join_bounded, join_weighed, shared_dir, written  # noqa: F401

#: Edges that one task ties together at a time (16 MB).
TASK_EDGES = 1 << 20


def text_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Sets the session's Arrow batches to ``rows`` rows and ``size`` bytes at most: texts are long, and a batch is held several times over."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(key, most)


def hash_share(h: Column, share: float) -> Column:
    """Whether a 64-bit hash lies in the lowest ``share`` of all values."""
    return h < F.lit(min(2**63 - 1, int(-(2**63) + share * 2.0**64))) if share < 1 else F.lit(True)


def sample_keys(df: DataFrame, h: Column, n: int) -> DataFrame:
    """One column ``_h``: about the ``n`` smallest values of the hash ``h`` over all rows of ``df``.

    The rows are counted first, so that only about 2n hashes, not n of each task, reach the driver.
    """
    count = df.count()
    return df.select(h.alias("_h")).where(hash_share(F.col("_h"), 2 * n / max(count, 1))).distinct().orderBy("_h").limit(n)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v: the smaller) -> one edge for each node but the smallest of its component among these edges, to that smallest one."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(x):
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    rest = np.flatnonzero(root != np.arange(len(ids)))
    yield from pa.table({"u": ids[rest], "v": ids[root[rest]]}).to_batches(max_chunksize=1 << 16)


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): one row (node, component) per node, component the smallest id.

    Each task ties together the about TASK_EDGES edges that it holds. If there are several, alternating large-star /
    small-star rounds follow: each aggregates a minimum per node (combined before the shuffle) and joins it back; minima
    of nodes with many edges are broadcast, so no hub's edges meet in one task and no neighbourhood is ever gathered.
    A round is a dozen stages, whose plans, task binaries and metrics the driver holds, however few the edges are.
    Null ids and loops are ignored; empty in, empty out. ``rows`` is a bound of the edges where the caller knows one (see ``cut``).
    """
    a, b = F.col("a"), F.col("b")
    now = cut(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), rows)
    most = now.count() if rows is None else rows  # no round has more edges than the one before, nor more nodes than twice as many
    while True:
        tasks = max(1, -(-most // TASK_EDGES))
        now = cut(now.coalesce(tasks).mapInArrow(_roots, "u long, v long"))
        if tasks == 1:
            break
        both = now.select("u", "v", F.lit(1).alias("_up")).unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("_up")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"), F.sum("_up").alias("up")).select("u", F.least("u", "m").alias("m"), "degree", "up"), 2 * most)
        # Done when every node is a root, or has one edge, which leads to a root.
        nodes, ends, open_ = least.agg(F.count("*"), F.coalesce(F.sum("degree"), F.lit(0)), F.count_if((F.col("up") > 0) & (F.col("degree") > 1))).first()
        if not open_:
            break
        most, least, size = ends // 2, least.drop("up"), (nodes, ends)
        large = cut(join_weighed(both.where("v > u").drop("_up"), least, "u", "degree", size=size).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), most)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        moved = join_weighed(large, lowest, "u", "degree", size=size).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), most)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def star_edges(buckets: DataFrame) -> DataFrame:
    """Of rows (key, id, b): edges (a, b), some repeated, that tie all ids of a key together; a row with ``b`` is such an edge itself.

    Rows are shuffled once, whatever their number: no counted table of keys is joined back to them. So that no key's
    rows pile up in one task, whoever makes them ties ids of a key that it holds at a time by edges of its own, which
    have keys of their own, and sends on one id of them.
    """
    head = F.min(F.when(F.col("b").isNull(), F.col("id"))).over(Window.partitionBy("key"))
    return buckets.select(F.col("id").alias("a"), F.coalesce("b", head).alias("b")).where("a <> b")


def block_groups(members: DataFrame, block: int, volume: int = 1 << 62, pairs: bool = True) -> DataFrame:
    """Deals clusters out to groups of bounded size, so that every comparable pair shares exactly one group.

    ``members`` has (cluster, id, band) and, if wished, n (what the row weighs, else 1) and kind (0 or 1,
    else 0); only ids in the same or adjacent bands need to meet, and two of kind 1 need not. A cluster of
    at most ``block`` rows and ``volume`` weight is one group. A larger one is cut by band and kind
    and then, by a hash of the id, into sub-blocks of about that size; a group is a pair of
    sub-blocks, or without ``pairs`` one sub-block. Returns the rows with ``grp``, the group's name;
    ``part``, 0 or 1 for the sides of a pair, 2 where all rows are on one side; and ``whole``, whether
    the group is a whole cluster.
    """
    own = {"n": F.lit(1).cast("long"), "kind": F.lit(0)}
    rows = members.withColumns({c: x for c, x in own.items() if c not in members.columns}).withColumn("_place", F.xxhash64("cluster", "band", "kind"))
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("rows") / block), F.ceil(F.col("weight") / volume))
    units = cut(rows.groupBy("cluster", "band", "kind", "_place").agg(F.count("*").alias("rows"), F.sum("n").alias("weight")).withColumn("parts", parts))
    whole = units.groupBy("cluster").agg(((F.sum("rows") <= block) & (F.sum("weight") <= volume)).alias("whole"))
    # At most three bands of two kinds.
    near = units.select("cluster", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("_at"), F.struct("band", "kind", "parts").alias("x")).groupBy("cluster", F.col("_at").alias("band")).agg(F.collect_list("x").alias("near"))
    info = cut(units.join(near, ["cluster", "band"]).join(whole, "cluster").select("_place", "parts", "near", "whole", "rows"), units.count())
    dealt = join_weighed(rows, info, "_place", "rows").withColumn("_s", F.pmod(F.xxhash64("id"), F.col("parts")))
    me = F.struct(F.col("band").cast("long").alias("b"), F.col("kind").cast("int").alias("k"), F.col("_s").alias("s"))
    entry = lambda g, p: F.struct(g.alias("grp"), F.lit(p).alias("part"))
    if not pairs:
        groups = F.array(entry(F.xxhash64("cluster", me), 2))
    else:
        met = F.filter("near", lambda x: (F.col("kind") == 0) | (x["kind"] == 0))
        others = F.flatten(F.transform(met, lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["parts"] - 1), lambda t: F.struct(x["band"].cast("long").alias("b"), x["kind"].cast("int").alias("k"), t.alias("s")))))
        groups = F.transform(others, lambda o: F.when(o == me, entry(F.xxhash64("cluster", me, me), 2)).when(o > me, entry(F.xxhash64("cluster", me, o), 0)).otherwise(entry(F.xxhash64("cluster", o, me), 1)))
    return dealt.select(*members.columns, "whole", F.inline(F.when(F.col("whole"), F.array(entry(F.xxhash64("cluster"), 2))).otherwise(groups)))


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Yields one table per run of equal keys; the batches are sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        at = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(at[:-1], at[1:]):
            held.append(batch.slice(lo, hi - lo))
            if hi < len(keys):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over positions 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


# ---------------------------------------------------------------- hashing of words

_P, _GOLD = (1 << 61) - 1, np.uint64(0x9E3779B97F4A7C15)
_R = 0x1E3779B97F4A7C15 % _P
_RI = pow(_R, -1, _P)


def _fold(x: np.ndarray) -> np.ndarray:
    """``x`` modulo 2^61 - 1, up to the modulus itself once."""
    return (x & np.uint64(_P)) + (x >> np.uint64(61))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, of numbers below it, by halves of 31 bits."""
    half = np.uint64((1 << 31) - 1)
    au, ad, bu, bd = a >> np.uint64(31), a & half, b >> np.uint64(31), b & half
    mid = ad * bu + au * bd
    out = _fold(((au * bu) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << np.uint64(31)) + ad * bd)
    return np.where(out >= np.uint64(_P), out - np.uint64(_P), out)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(r: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = _times(out[:m], np.uint64(pow(r, k, _P)))
        k += m
    return out


class ShingleHasher:
    """64-bit hashes of the words and word shingles of texts, computed on whole Arrow buffers.

    A word is a run of bytes other than space and \\x09-\\x0D; A-Z count as a-z. A word's hash is a
    polynomial over its bytes modulo the prime 2^61 - 1 (modulo a power of two, words that alternate like
    Thue's would collide), taken as a difference of prefix sums, then mixed; a shingle's hash
    combines its words' hashes by position. All steps are array operations.
    """

    CHUNK = 1 << 19  # bytes of text handled at a time; a longer text is handled alone

    def __init__(self, width: int = 5):
        self.width = width
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        self.blank = np.zeros(256, bool)
        self.blank[[32, *range(9, 14)]] = True
        self.high = self.low = self.inv = np.empty(0, np.uint64)
        self.place = mix(np.arange(1, 64, dtype=np.uint64) * _GOLD) | np.uint64(1)

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, bytes, row offsets) of runs of rows of about CHUNK bytes; nulls are empty."""
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.empty(0, np.uint8)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + self.CHUNK, "right")) - 1)
            hi = min(hi, len(texts))
            yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi

    def polynomials(self, byte: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The polynomial of each run ``start`` to ``end`` of the numbers ``byte``, modulo 2^61 - 1."""
        n = len(byte)
        if n + 1 > len(self.inv):
            size = max(self.CHUNK + 1, n + 1)
            power, self.inv = _powers(_R, size), _powers(_RI, size)
            self.high, self.low = power >> np.uint64(30), power & np.uint64((1 << 30) - 1)
        sums, parts = np.zeros(n + 1, np.uint64), []
        for half in (self.high, self.low):  # sums of a word's halves stay below 2^64, however long the text is
            np.cumsum(byte * half[:n], out=sums[1:])
            parts.append(_fold(sums[end] - sums[start]))
        high = _fold(parts[0])
        whole = _fold(_fold(((high << np.uint64(30)) & np.uint64(_P)) + (high >> np.uint64(31))) + parts[1])
        return _times(_fold(whole), self.inv[start])

    def words(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word hashes, first word of each row and the total) of the rows ``offs`` in ``data``."""
        n = len(data)
        byte = self.fold[data].astype(np.uint64) + np.uint64(1)
        word = ~self.blank[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:n]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:n]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        h = self.polynomials(byte, start, end)
        return mix(h + (end - start).astype(np.uint64) * _GOLD), np.searchsorted(start, offs)

    def shingles(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct shingle hashes row by row, first of each row and the total)."""
        h, at = self.words(data, offs)
        n, k = np.diff(at), self.width
        m = np.maximum(len(h) - k + 1, 0)
        s = np.zeros(m, np.uint64)
        for j in range(k):
            s += h[j : j + m] * self.place[j]
        keep = np.zeros(m, bool)
        rows = np.flatnonzero(n >= k)
        mark = np.zeros(m + 1, np.int64)
        np.add.at(mark, at[rows], 1)
        np.add.at(mark, at[rows + 1] - k + 1, -1)
        keep = np.cumsum(mark[:-1]) > 0
        s = mix(s[keep] + np.uint64(k))
        count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
        out = np.empty(int(count.sum()), np.uint64)
        to = np.concatenate(([0], np.cumsum(count)))
        own = np.repeat(n >= k, count)
        out[own] = s
        for r in np.flatnonzero((n > 0) & (n < k)):
            w = h[at[r] : at[r + 1]]
            out[to[r]] = mix((w * self.place[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))[0]
        for lo, hi in zip(to[:-1].tolist(), to[1:].tolist()):
            if hi - lo > 1:
                out[lo:hi].sort()
        fresh = np.ones(len(out), bool)
        fresh[1:] = out[1:] != out[:-1]
        fresh[to[:-1][count > 0]] = True
        kept = np.concatenate(([0], np.cumsum(fresh)))
        return out[fresh], kept[to]

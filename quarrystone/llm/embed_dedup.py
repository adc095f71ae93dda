"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; the nearest axis
and its sign are a hash. ``k`` hashes form a table's key, and with multiprobe a vector also files
itself under its next most likely keys (the second-nearest axis where it is closest to the first).
``k`` grows with the logarithm of the number of vectors, so buckets stay small, and the number of
tables and probes grows with ``k``: in simulation on random pairs of cosine 0.93 between 99.9 and
100 % share a key. Members of a bucket are all compared with each other, by vectors rounded to bytes
whose rounding errors are kept, so that no pair at the threshold is lost; buckets of more than a block
are compared with their smallest id first, and the members beyond the threshold from it then with
each other in blocks. Links at about the threshold tie vectors, and what hangs together is a cluster. Clusters are
compared completely, in double precision, by matrix products over bounded blocks that return a count
of links per vector and a spanning forest, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ._common import block_groups, components, cut, grouped, join_bounded, join_weighed, mix

BLOCK = 1024
#: Buckets of at most this many rows are compared row by row offset, others by matrix products.
SMALL = 8
HEAD = np.dtype([("scale", "<f4"), ("error", "<f4")])


def usable(vector: str = "embedding") -> Column:
    """Whether a vector can be compared: not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def tables_for(n: int, dims: int) -> tuple[int, int, int]:
    """(hashes per key, tables, probes besides the first) for ``n`` vectors."""
    k = max(2, math.ceil(math.log(max(n, 2)) / math.log(2 * max(dims, 2))))
    return k, 2 * k + 4, min(k + 2, 2**k - 1)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, scaled to keep lengths."""
    h, (n, d) = 1, x.shape
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def normalised(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bucket_keys(vectors: np.ndarray, k: int, tables: int, probes: int) -> np.ndarray:
    """One row of tables * (1 + probes) keys for each vector; equal dimensions in all rows."""
    n, dims = vectors.shape
    d = 1 << max(1, (dims - 1).bit_length())
    unit = np.zeros((n, d))
    unit[:, :dims] = normalised(vectors)
    swaps = np.array([s for s in product((0, 1), repeat=k) if any(s)])
    weight = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.empty((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        first, second, gap = (np.empty((n, k), kind) for kind in (np.int64, np.int64, np.float64))
        for j in range(k):
            random, y = np.random.default_rng((t, j, d)), unit
            for _ in range(3):
                y = hadamard(y * random.choice([-1.0, 1.0], d))
            size = np.abs(y)
            axes = np.argpartition(-size, 1, axis=1)[:, :2]
            near = np.take_along_axis(size, axes, 1)
            axes = np.where((near[:, :1] >= near[:, 1:]), axes, axes[:, ::-1])
            codes = axes + d * (np.take_along_axis(y, axes, 1) < 0)
            first[:, j], second[:, j], gap[:, j] = codes[:, 0], codes[:, 1], np.abs(near[:, 0] - near[:, 1]) ** 2
        name = lambda codes: mix((codes.astype(np.uint64) * weight).sum(1, dtype=np.uint64) + np.uint64(t << 40 | d))
        out[:, t, 0] = name(first)
        order = np.argsort(gap @ swaps.T, axis=1)
        for p in range(probes):
            out[:, t, 1 + p] = name(np.where(swaps[order[:, p]] == 1, second, first))
    return out.reshape(n, -1)


def _matrix(lists) -> tuple[np.ndarray, np.ndarray]:
    """(flat components, offsets) of an Arrow list column, as doubles."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat, np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))


def _keys(k: int, tables: int, probes: int, rows: int = 2048):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                flat, at = _matrix(part.column("v"))
                salt = part.column("salt").to_numpy().view(np.uint64)
                dims = np.diff(at)
                for d in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == d)
                    x = flat[(at[own][:, None] + np.arange(d)).reshape(-1)].reshape(len(own), d)
                    keys = bucket_keys(x, k, tables, probes)
                    keys = mix(keys ^ mix(salt[own] ^ mix(np.uint64([d])))[:, None]).view(np.int64)
                    ids = part.column("id").to_numpy()[own]
                    short = pa.array(sketches(x), pa.binary()).take(pa.array(np.repeat(np.arange(len(own)), keys.shape[1])))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, keys.shape[1])), pa.array(keys.reshape(-1)), short], ["id", "key", "short"])

    return run


def sketches(vectors: np.ndarray) -> list[bytes]:
    """Each vector at length one as bytes: its step, the length of the rounding error, one signed byte a component."""
    unit = normalised(vectors)
    head = np.empty(len(unit), HEAD)
    head["scale"] = np.abs(unit).max(axis=1) / 127
    scale = head["scale"].astype(np.float64)[:, None]
    steps = np.clip(np.rint(unit / scale), -127, 127)
    head["error"] = np.linalg.norm(unit - scale * steps, axis=1) * (1 + 1e-6)
    return [h.tobytes() + q.tobytes() for h, q in zip(head, steps.astype(np.int8))]


def read_sketches(short: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rounded vectors, errors) of sketches; shorter ones are filled up with zeros."""
    size = pc.binary_length(short).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer(b"".join(short.to_pylist()), np.uint8)
    if (size != size[0]).any():
        wide = np.zeros((len(size), size.max()), np.uint8)
        wide[np.arange(size.max()) < size[:, None]] = flat
    else:
        wide = flat.reshape(len(size), -1)
    head = np.ascontiguousarray(wide[:, : HEAD.itemsize]).view(HEAD)[:, 0]
    return wide[:, HEAD.itemsize :].view(np.int8) * head["scale"].astype(np.float64)[:, None], head["error"].astype(np.float64)


def _tie(threshold: float, block: int):
    """Of buckets (rows sorted by key): edges (a, b) that tie all pairs at the threshold, and the rows (id, key) of buckets beyond ``block``."""
    floor = threshold - 1e-9

    def ties(key: np.ndarray, ids: np.ndarray, short: pa.Array) -> np.ndarray:
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(at, len(key)))
        many = np.flatnonzero(np.repeat(size, size) > 1)
        if not len(many):
            return np.empty((0, 2), np.int64)
        key, ids, (x, error) = key[many], ids[many], read_sketches(short.take(pa.array(many)))
        at, size = np.append(0, np.cumsum(size[size > 1])), size[size > 1]
        few, out = np.repeat(size <= SMALL, size), []
        for gap in range(1, SMALL):
            a = np.flatnonzero((key[gap:] == key[:-gap]) & few[gap:])
            b = a + gap
            a, b = (v[np.einsum("ij,ij->i", x[a], x[b]) + error[a] + error[b] + 3 * error[a] * error[b] >= floor] for v in (a, b))
            out.append(np.stack((np.maximum(ids[a], ids[b]), np.minimum(ids[a], ids[b])), 1))
        for lo, hi in zip(at[:-1][size > SMALL].tolist(), at[1:][size > SMALL].tolist()):
            e, own = error[lo:hi], ids[lo:hi]
            near = x[lo:hi] @ x[lo:hi].T + e[:, None] + e + 3 * np.outer(e, e) >= floor
            np.fill_diagonal(near, False)
            left = near.any(1)
            while left.any():
                found = front = np.arange(hi - lo) == left.argmax()
                while front.any():
                    front = near[front].any(0) & ~found
                    found = found | front
                left &= ~found
                least = own[found].min()
                out.append(np.stack((own[found], np.full(int(found.sum()), least)), 1))
        edges = np.concatenate(out)
        return np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a, b, crowded):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), crowded))], ["a", "b", "crowded"])

        held, crowded = [], None  # the last bucket so far, and a bucket already beyond the block
        for batch in _ended(batches):
            if batch is not None:
                held.append(batch)
            if not held:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            key = whole.column("key").to_numpy()
            end = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
            size = np.bincount(np.cumsum(np.append(0, key[1:] != key[:-1])))
            over = np.repeat(size > block, size) | (key == crowded if crowded is not None else False)
            done = np.arange(len(key)) < end
            ids = whole.column("id").to_numpy()
            if over.any():
                yield rows(ids[over], key[over], True)
                crowded = key[-1] if over[-1] else crowded
            fit = np.flatnonzero(done & ~over)
            edges = ties(key[fit], ids[fit], whole.column("short").take(pa.array(fit)))
            if len(edges):
                yield rows(edges[:, 0], edges[:, 1], False)
            held = [whole.slice(end)] if batch is not None and not over[-1] else []

    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches that have rows, then None."""
    yield from (b for b in batches if b.num_rows)
    yield None


def _classes(near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of each set of rows and columns that the true cells of ``near`` tie together; each row and column is looked at once."""
    left = near.any(1)
    while left.any():
        row, column = np.arange(len(left)) == left.argmax(), np.zeros(near.shape[1], bool)
        front = row
        while front.any():
            reached = near[front].any(0) & ~column
            column |= reached
            front = near[:, reached].any(1) & ~row
            row = row | front
        left &= ~row
        yield np.flatnonzero(row), np.flatnonzero(column)


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "grp"):
            flat, at = _matrix(group.column("v"))
            unit = normalised(flat.reshape(group.num_rows, -1))
            ids, part, copies = (group.column(c).to_numpy() for c in ("id", "part", "copies"))
            a, b = (np.flatnonzero(part != 1), np.flatnonzero(part != 0)) if (part != 2).any() else (np.arange(len(ids)),) * 2
            near = unit[a] @ unit[b].T >= threshold
            one = (part == 2).all()
            if one:
                np.fill_diagonal(near, False)
            links = np.zeros(len(ids), np.int64)
            links[a] += near @ copies[b]
            if not one:
                links[b] += near.T @ copies[a]
            root = np.arange(len(ids))
            for rows, columns in _classes(near):
                found = np.concatenate((a[rows], b[columns]))
                root[found] = found.min()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(ids[root])], ["id", "links", "root"])

    return run


def _tied_in_crowded(crowded: DataFrame, classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """Edges (a, b) that tie all pairs at the threshold in buckets (key, id) of any size.

    Members within two steps of the threshold's angle from the bucket's smallest id are tied to it. A member
    within one step has all its partners within two and is settled; the others are compared in blocks.
    """
    wide = math.cos(min(math.pi, 2 * math.acos(max(-1.0, min(1.0, threshold))))) - 1e-9
    scaled = classes.select("id", F.transform("v", lambda x: x / F.array_max(F.transform("v", F.abs))).alias("w"))
    unit = scaled.select("id", F.transform("w", lambda x: x / F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, y: s + y * y))).alias("u"))
    side = lambda n: unit.select(F.col("id").alias(n), F.col("u").alias(f"u{n}"))
    cosine = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    heads = crowded.groupBy("key").agg(F.min("id").alias("b"))
    stars = crowded.join(heads, "key").where("id <> b").select("key", F.col("id").alias("a"), "b")
    judged = cut(stars.join(side("a"), "a").join(side("b"), "b").select("key", "a", "b", cosine.alias("cosine")))
    rest = judged.where(F.col("cosine") < threshold + 1e-9).select(F.col("a").alias("id"), F.col("key").alias("cluster"), F.lit(0).alias("band"))
    dealt = cut(block_groups(rest, block).select("id", "grp", "part"))
    groups = join_bounded(classes.select("id", "v", "copies"), dealt, "id").repartition("grp").sortWithinPartitions("grp")
    near = groups.mapInArrow(_compare(threshold), "id long, links long, root long").select(F.col("id").alias("a"), F.col("root").alias("b"))
    return judged.where(F.col("cosine") >= wide).select("a", "b").unionByName(near)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id, embedding, label).

    Vectors of equal label and length whose cosine is at least ``threshold`` are linked. Vectors that
    are null, empty, zero or hold null or non-finite components, and rows with a null label or
    vec_id, link with nothing. ``component_id`` is the smallest vec_id reachable, the row's own
    if none (null for a null vec_id, which is kept). Equal vectors of a label are compared as one
    with a number of copies. Rows that repeat a vec_id count as rows of their own in ``n_links`` and
    belong to one node in the components. Other columns are left out; empty in, empty out.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label"))
    fit = rows.withColumn("ok", usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = cut(fit.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")).select(F.xxhash64("label", "v").alias("id"), "vec_id", "copies", "v", F.xxhash64("label").alias("salt")))
    shape = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    k, tables, probes = tables_for(shape.n, shape.d or 1)
    files = classes.select("id", "v", "salt").mapInArrow(_keys(k, tables, probes), "id long, key long, short binary")
    found = cut(files.repartition("key").sortWithinPartitions("key").mapInArrow(_tie(threshold, block), "a long, b long, crowded boolean"))
    tied = found.where("not crowded").select("a", "b")
    crowded = found.where("crowded").select(F.col("a").alias("id"), F.col("b").alias("key"))
    if not crowded.isEmpty():
        tied = tied.unionByName(_tied_in_crowded(crowded, classes, threshold, block))
    members = components(tied).select(F.col("node").alias("id"), F.col("component").alias("cluster"), F.lit(0).alias("band"))
    dealt = cut(block_groups(members, block).select("id", "grp", "part"))
    groups = join_bounded(classes.select("id", "v", "copies"), dealt, "id").repartition("grp").sortWithinPartitions("grp")
    compared = cut(groups.mapInArrow(_compare(threshold), "id long, links long, root long"))
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(compared.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = cut(classes.select("id", "vec_id", "copies").join(joined.withColumnRenamed("node", "id"), "id", "left").join(links, "id", "left").select("id", "vec_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component")))
    least = cut(named.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("size")))
    found = cut(join_weighed(named, least, "component", "size").select("id", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"))
    placed = join_weighed(fit.select("vec_id", F.when(F.col("ok"), F.xxhash64("label", "v")).alias("id")), found, "id", "copies", "left")
    # A vec_id with several vectors ties their components together.
    twice = cut(placed.where("component_id is not null").groupBy("vec_id").agg(F.min("component_id").alias("b"), F.max("component_id").alias("_top")).where("b <> _top").select("vec_id", "b"))
    out = placed.withColumn("component", F.lit(None).cast("long"))
    if not twice.isEmpty():
        again = components(join_bounded(placed, twice, "vec_id").select(F.col("component_id").alias("a"), "b"))
        out = placed.join(again.select(F.col("node").alias("component_id"), "component"), "component_id", "left")
    label = F.coalesce("component", "component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), label.alias("component_id"), F.coalesce(F.col("vec_id") == label, F.lit(True)).alias("kept"))


def oracle(threshold: float = 0.93) -> str:
    """DuckDB SQL for ``near_duplicates`` by comparing all vectors of a label."""
    return f"""
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings
  where embedding is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= {threshold}),
n as (select a as vec_id, count(*) as n from l group by a),
r(vec_id, root) as (select vec_id, vec_id from embeddings union select l.b, r.root from r join l on l.a = r.vec_id),
m as (select vec_id, min(root) as component_id from r group by vec_id)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from embeddings join m using (vec_id) left join n using (vec_id)"""

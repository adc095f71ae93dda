"""Exact top-k search by inner product: a Voronoi kNN join.

Pivots, about the square root of the rows, are data vectors taken by a hash of their id. Queries and
data belong to the cell of their nearest pivot. A cell's queries are parted into rings by their
distance from the pivot c, so that an outlier loosens the bounds of few others; a ring's summary is
its radius u and a bound t that the k-th best score of each of its queries reaches, found by scoring the
queries against the k + 1 vectors nearest to each pivot. By q.x <= c.x + |q - c||x| a data vector x
can only matter to a ring with c.x + u|x| >= t. Neighbouring cells form groups of about QUERIES queries;
data are replicated to the groups of rings that they can matter to. Summaries of the data cells rule out
whole pairs of cells, and bound how much data a group gets, hence its number of slices. Groups are
solved locally: a slice's data are streamed past a block of queries, each of which keeps its k best
from its own bound on; a last step merges the slices. The bounds are as good as the data allow:
clustered vectors are replicated rarely, evenly spread ones to all groups, as in a nested loop by blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._common import cut, grouped, mix

#: Queries of a block, data of a slice and of a matrix product, pivots at most; they change the work, not the results.
QUERIES, SLICE, TILE, PIVOTS = 4096, 16_384, 512, 1024
#: Shares of a cell's queries that the inner rings hold, in cells of at least RINGED queries.
RINGS, RINGED = (0.5, 0.9, 0.99), 64
LOW, HIGH = -(2**63), 2**63 - 1
SCORED = "query_id long, vec_id long, score long, beyond string"


def matrix(lists, dims: int) -> np.ndarray:
    """An Arrow list column as rows of ``dims`` doubles; shorter lists end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), dims))
    at = np.repeat(np.arange(len(n)) * dims - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n, n) + np.arange(int(n.sum()))
    out.reshape(-1)[at] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as doubles, which hold it exactly, or infinity where it is too large."""
    with np.errstate(over="ignore"):
        return np.floor(x * 1024.0)


def _exact(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as Python's integers."""
    return np.array([[int(v) * 1024 if abs(v) >= 2.0**53 else math.floor(v * 1024) for v in row] for row in x.tolist()], object).reshape(x.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of floor(1024 * x) of the rows of a and b: exact, int64 where all fit it, else Python's integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    u, v = scaled(a), scaled(b)
    with np.errstate(over="ignore"):
        largest = float(np.abs(u).max()) * float(np.abs(v).max()) * a.shape[1]
    if largest < 2.0**53:
        return (u @ v.T).astype(np.int64)
    if largest < 2.0**62:
        return u.astype(np.int64) @ v.astype(np.int64).T
    half = math.sqrt(2.0**62 / a.shape[1])
    big_a, big_b = np.abs(u).max(1) >= half, np.abs(v).max(1) >= half
    out = np.empty((len(a), len(b)), object)
    out[np.ix_(~big_a, ~big_b)] = u[~big_a].astype(np.int64) @ v[~big_b].astype(np.int64).T
    if big_a.any():
        out[big_a] = np.dot(_exact(a[big_a]), _exact(b).T)
    if big_b.any():
        out[:, big_b] = np.dot(_exact(a), _exact(b[big_b]).T)
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, in order."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(scores) > k:
        cutoff = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cutoff)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def beyond(score: int) -> str | None:
    """A text by which scores outside 64 bits sort; None for all others."""
    if LOW <= score <= HIGH:
        return None
    digits = str(abs(score))
    return f"{len(digits):04}{digits}" if score > 0 else f"{9999 - len(digits):04}" + "".join(chr(105 - ord(c)) for c in digits)


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivot of each row, the first of equals."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.argmin((pivots**2).sum(1) - 2 * (x @ pivots.T), axis=1)


class Cells:
    """The summaries: of each ring of queries its cell, radius, bound and group; of each data cell its reach."""

    def __init__(self, pivots: np.ndarray, cell: np.ndarray, radius: np.ndarray, bound: np.ndarray, group: np.ndarray, reach: np.ndarray):
        self.pivots, self.cell, self.radius, self.bound, self.group = pivots, cell, radius, bound, group
        self.groups = int(group.max()) + 1 if len(group) else 0
        with np.errstate(over="ignore", invalid="ignore"):
            length = np.linalg.norm(pivots, axis=1)
            most = (pivots @ pivots.T)[cell] + length[cell][:, None] * reach + radius[:, None] * (length + reach)
            slack = 1e-9 * (1 + (length[cell] + radius)[:, None] * (length + reach))
            self.may = ~(most + slack < bound[:, None])  # rings x data cells
        self.length = length

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        """The most data that each group can get, where the data cells have ``rows``."""
        return np.array([rows[self.may[self.group == g].any(0)].sum() for g in range(self.groups)], np.int64)

    def needed(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For each row of x, of data cell ``own``, which groups need it."""
        out = np.zeros((len(x), self.groups), bool)
        with np.errstate(over="ignore", invalid="ignore"):
            inner, size = x @ self.pivots.T, np.linalg.norm(x, axis=1)[:, None]
            for g in range(self.groups):
                r = np.flatnonzero(self.group == g)
                c, u = self.cell[r], self.radius[r]
                slack = 1e-9 * (1 + (self.length[c] + u) * size)
                out[:, g] = (self.may[np.ix_(r, own)].T & ~(inner[:, c] + u * size + slack < self.bound[r])).any(1)
        return out


def _assign(dims: int, pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scaled(matrix(batch.column("v"), dims))
            cell = nearest(x, pivots)
            with np.errstate(over="ignore", invalid="ignore"):
                far = np.linalg.norm(x - pivots[cell], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(np.where(np.isnan(far), np.inf, far))], ["vec_id", "v", "cell", "far"])

    return run


def _bounds(dims: int, known_ids: np.ndarray, known: np.ndarray, k: int):
    """Adds to each query a score that its k-th best among the known vectors of others reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = np.linalg.norm(known, axis=1).max(initial=0.0)
        for batch in batches:
            x, ids = scaled(matrix(batch.column("v"), dims)), batch.column("vec_id").to_numpy()
            bound = np.full(len(x), -np.inf)
            if len(known) >= k:
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = x @ known.T
                    scores[(ids[:, None] == known_ids) | np.isnan(scores)] = -np.inf
                    least = np.partition(scores, len(known) - k, axis=1)[:, len(known) - k]
                    bound = least - 1e-9 * (1 + np.linalg.norm(x, axis=1) * longest)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(np.isfinite(bound), bound, -np.inf))], [*batch.schema.names, "bound"])

    return run


def _name(group: np.ndarray, turn: np.ndarray, part: np.ndarray) -> np.ndarray:
    parts = (x.astype(np.uint64) for x in (group, turn, part))
    return mix(sum((x << np.uint64(s) for x, s in zip(parts, (0, 14, 36))), np.uint64(0)) + np.uint64(1)).view(np.int64)


def _replicate(dims: int, shared, blocks: np.ndarray, slices: np.ndarray):
    """Each data row to the query blocks of the groups that need it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE):
                part = batch.slice(lo, TILE)
                row, group = np.nonzero(shared.value.needed(scaled(matrix(part.column("v"), dims)), part.column("cell").to_numpy()))
                again = blocks[group]
                row, group = np.repeat(row, again), np.repeat(group, again)
                turn = np.arange(len(row)) - np.repeat(np.cumsum(again) - again, again)
                side = mix(part.column("vec_id").to_numpy().view(np.uint64))[row] % slices[group].astype(np.uint64)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(_name(group, turn, side)), pa.array(np.ones(len(row), np.int32)), taken.column("vec_id"), taken.column("v"), pa.array(np.zeros(len(row)))], ["grp", "side", "vec_id", "v", "bound"])

    return run


def _ask(group_of: np.ndarray, blocks: np.ndarray, slices: np.ndarray):
    """Each query to every slice of its group, in one of the group's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = group_of[batch.column("cell").to_numpy()]
            again = slices[group]
            row = np.repeat(np.arange(batch.num_rows), again)
            part = np.arange(len(row)) - np.repeat(np.cumsum(again) - again, again)
            ids = batch.column("vec_id").to_numpy().view(np.uint64)
            turn = (mix(ids + np.uint64(77)) % blocks[group].astype(np.uint64))[row]
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(_name(group[row], turn, part)), pa.array(np.zeros(len(row), np.int32)), taken.column("vec_id"), taken.column("v"), taken.column("bound")], ["grp", "side", "vec_id", "v", "bound"])

    return run


class _Block:
    """A block of queries, each with the k best of the data seen so far."""

    def __init__(self, dims: int, k: int):
        self.k, self.q, self.ids, self.least = k, np.empty((0, dims)), np.empty(0, np.int64), np.empty(0)
        self.kept: list[np.ndarray] = []
        self.names: list[np.ndarray] = []

    def ask(self, x: np.ndarray, ids: np.ndarray, bound: np.ndarray) -> None:
        self.q, self.ids, self.least = np.vstack((self.q, x)), np.concatenate((self.ids, ids)), np.concatenate((self.least, bound))
        self.kept += [np.empty(0, np.int64)] * len(ids)
        self.names += [np.empty(0, np.int64)] * len(ids)

    def see(self, x: np.ndarray, ids: np.ndarray) -> None:
        for lo in range(0, len(ids) if len(self.ids) else 0, TILE):
            scores, own = products(self.q, x[lo : lo + TILE]), ids[lo : lo + TILE]
            hit = (scores >= self.least[:, None]) & (own != self.ids[:, None])
            for i in np.flatnonzero(hit.any(1)).tolist():
                both, names = np.concatenate((self.kept[i], scores[i][hit[i]])), np.concatenate((self.names[i], own[hit[i]]))
                at = best(both, names, self.k)
                self.kept[i], self.names[i] = both[at], names[at]
                if len(at) == self.k:
                    self.least[i] = max(self.least[i], float(both[at[-1]]) * (1 - 1e-9 if both[at[-1]] > 0 else 1 + 1e-9) if abs(both[at[-1]]) < 2**1000 else -np.inf)

    def answer(self) -> pa.RecordBatch:
        n = [len(i) for i in self.names]
        scores = [int(x) for kept in self.kept for x in kept.tolist()]
        names = np.concatenate(self.names) if self.names else np.empty(0, np.int64)
        columns = [pa.array(np.repeat(self.ids, n), pa.int64()), pa.array(names, pa.int64()), pa.array([min(HIGH, max(LOW, x)) for x in scores], pa.int64()), pa.array(map(beyond, scores), pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "beyond"])


def _solve(dims: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, _Block(dims, k)
        for batch in batches:  # sorted by grp and side: a group's queries come before its data
            for part in grouped(iter([batch]), "grp"):
                grp = part.column("grp")[0].as_py()
                if grp != now:
                    if len(block.ids):
                        yield block.answer()
                    now, block = grp, _Block(dims, k)
                x, ids, asking = matrix(part.column("v"), dims), part.column("vec_id").to_numpy(), part.column("side").to_numpy() == 0
                if asking.any():
                    block.ask(x[asking], ids[asking], part.column("bound").to_numpy()[asking])
                block.see(x[~asking], ids[~asking])
        if len(block.ids):
            yield block.answer()

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The ``k`` highest inner products of each query with all other rows of ``vectors`` (vec_id, embedding).

    Queries are the rows whose vec_id is divisible by ``every``. Vectors are floor(1024 * x); scores and
    ranks are exact whatever the components' size, but a score outside 64 bits is shown as the nearest
    64-bit number. Returns query_id, rank (from 1), vec_id, score; fewer than ``k`` rows where there are
    fewer candidates; ties go to the smaller vec_id. Rows with a null vec_id, a null vector or null or
    non-finite components take no part; shorter vectors count as ending in zeros. Rows that repeat a
    vec_id are candidates each; a query's own vec_id is never its candidate, and of several vectors under
    one queried vec_id the smallest is the query. Other columns are left out; an empty table gives an
    empty result.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    data = cut(vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")))
    asked = F.col("vec_id") % every == 0
    shape = data.agg(F.max(F.size("v")).alias("dims"), F.count_if(asked).alias("queries"), F.count("*").alias("n")).first()
    if not shape.queries:
        return data.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    dims = max(shape.dims, 1)
    dense = lambda rows: scaled(np.array([[*r.v, *[0.0] * (dims - len(r.v))] for r in rows], float).reshape(len(rows), dims))
    pivots = dense(data.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(min(PIVOTS, math.isqrt(shape.n - 1) + 1)).collect())
    pivots = pivots[np.isfinite(pivots).all(1)] if np.isfinite(pivots).all(1).any() else np.zeros((1, dims))
    placed = cut(data.mapInArrow(_assign(dims, pivots), "vec_id long, v array<double>, cell int, far double"))
    # Summaries: bounded by the pivots, whatever the data's size.
    place = F.row_number().over(Window.partitionBy("cell").orderBy("far", "vec_id"))
    close = placed.withColumn("_n", place).where(F.col("_n") <= k + 1).select("vec_id", "v").collect()
    known_ids, first = np.unique(np.array([row.vec_id for row in close], np.int64), return_index=True)
    known = dense([close[i] for i in first])
    reach, held = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for cell, far, n in placed.groupBy("cell").agg(F.max("far"), F.count("*")).collect():
        reach[cell], held[cell] = far, n
    queries = placed.where(asked).groupBy("vec_id").agg(F.min(F.struct("v", "cell", "far")).alias("q")).select("vec_id", "q.*")
    queries = cut(queries.mapInArrow(_bounds(dims, known_ids, known, k), "vec_id long, v array<double>, cell int, far double, bound double"))
    edges = queries.groupBy("cell").agg(F.when(F.count("*") >= RINGED, F.percentile_approx("far", list(RINGS))).alias("edges"))
    ring = F.size(F.filter(F.coalesce("edges", F.array().cast("array<double>")), lambda e: F.col("far") > e)).alias("ring")
    rings = queries.join(F.broadcast(edges), "cell").groupBy("cell", ring).agg(F.max("far").alias("far"), F.min("bound").alias("bound"), F.count("*").alias("n")).orderBy("cell", "ring").collect()  # a few for each pivot
    heads = pivots[: -(-shape.queries // QUERIES)]
    group_of = nearest(pivots, heads)
    cell, radius, bound = (np.array([r[i] for r in rings], t) for i, t in ((0, np.int64), (2, float), (3, float)))
    cells = Cells(pivots, cell, radius, bound, group_of[cell], reach)
    asks = np.bincount(group_of[cell], [r.n for r in rings], minlength=cells.groups)
    blocks, slices = np.maximum(1, np.ceil(asks / QUERIES)).astype(np.int64), np.maximum(1, -(-cells.sizes(held) // SLICE))
    schema = "grp long, side int, vec_id long, v array<double>, bound double"
    shared = data.sparkSession.sparkContext.broadcast(cells)
    rows = queries.mapInArrow(_ask(group_of, blocks, slices), schema).unionByName(placed.mapInArrow(_replicate(dims, shared, blocks, slices), schema))
    local = rows.repartition("grp").sortWithinPartitions("grp", "side").mapInArrow(_solve(dims, k), SCORED)
    last = F.coalesce("beyond", F.when(F.col("score") < 0, ":").otherwise(""))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), last.desc(), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 10, every: int = 100) -> str:
    """DuckDB SQL for ``top_k`` over ``embeddings``, by brute force over the stated query set."""
    return f"""
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) as bigint) as score
      from (select vec_id, min(e) as e from v where vec_id % {every} = 0 group by vec_id) q join v d on d.vec_id <> q.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= {k}"""

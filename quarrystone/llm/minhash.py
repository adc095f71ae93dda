"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document's signature is 60 b-bit MinHash symbols (b = 16) of its word-shingle set. Signatures are
split into 10 chunks of 6 symbols. By the pigeonhole principle two signatures that differ in at most
19 symbols have a chunk with at most one differing symbol; each document therefore files itself
under every chunk with every single symbol left out (60 keys), and all pairs under that distance
share a key. Pairs above the distance are found too unless all chunks have two errors or more: at
similarity 0.85 three in ten million are missed, at 0.8 two in a hundred thousand.

Documents that share keys are not paired up. They form clusters (components of the trees that tie the
members of a bucket to its smallest id), which are confirmed on full shingle sets in groups of bounded size:

1. Every document is compared once, with the at most BLOCK documents of its sub-block. A cluster
   that is no larger than a block is done.
2. In larger clusters one document for each group found so far meets those of other blocks, again and
   again while that halves their number.
3. What still lies outside a cluster's largest group is compared with all of the cluster, first by
   signatures; texts are read only of documents that have a partner within FAR symbols in the block.
   Large groups of copies are not compared within themselves again.

In a group a prefix filter on the rarest shingles picks the documents with any partner, posting
lists give the exact overlaps, and only a spanning forest of confirmed links leaves the task.
Documents are dealt out by set size (a band holds sizes within the threshold's ratio, so only
adjacent bands meet) and by hash, so a cluster of any size goes over bounded tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import Forest, ShingleHasher, block_groups, components, cut, grouped, join_bounded, join_weighed, mix, star_edges, text_batches

CHUNKS, WIDTH = 10, 6
SYMBOLS = CHUNKS * WIDTH
#: Documents and shingles of a block, the symbols in which documents may differ to be read once more: a pair at
#: similarity 0.85 differs in more with a probability of 1 in 100 million, one at 0.8 of 5 in a million.
BLOCK, VOLUME, FAR = 256, 1 << 19, 27
SIGNED = "doc_id long, n_shingles long, digest binary, sign binary"


def _functions() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * SYMBOLS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return seeds[:SYMBOLS] | np.uint64(1), seeds[SYMBOLS:]


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16-bit symbols, one row of SYMBOLS for each non-empty set ``sets[at[i]:at[i + 1]]``."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, SYMBOLS), np.uint16)
    if len(full):
        for k, (a, b) in enumerate(zip(*_functions())):
            out[full, k] = mix(np.minimum.reduceat(sets * a + b, at[full])) >> np.uint64(48)
    return out


def deletion_keys(signs: np.ndarray) -> np.ndarray:
    """For each signature its CHUNKS * WIDTH keys: a chunk's symbols without one of them."""
    s = signs.astype(np.uint64).reshape(len(signs), CHUNKS, WIDTH)
    keys = np.empty((len(signs), CHUNKS, WIDTH), np.uint64)
    for c in range(CHUNKS):
        for o in range(WIDTH):
            rest = [s[:, c, j] for j in range(WIDTH) if j != o]
            four = rest[0] | rest[1] << np.uint64(16) | rest[2] << np.uint64(32) | rest[3] << np.uint64(48)
            keys[:, c, o] = mix(mix(four) ^ (rest[4] + np.uint64((c * WIDTH + o + 1) << 20)))
    return keys.reshape(len(signs), SYMBOLS)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher = ShingleHasher(width)
        for batch in batches:
            for lo, hi, data, offs in hasher.chunks(batch.column(1)):
                sets, at = hasher.shingles(data, offs)
                digests = [xxhash.xxh3_128_digest(sets[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
                signs = [x.tobytes() for x in signatures(sets, at)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "digest", "sign"])

    return run


def read_signs(signs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signs), np.uint16).reshape(len(signs), SYMBOLS)


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sign) -> rows (key, id, b) for ``star_edges``: one for each key of a batch with its smallest id, and an edge (id, b) for each other id of a key."""
    for batch in batches:
        if batch.num_rows:
            keys = deletion_keys(read_signs(batch.column(1).to_pylist())).reshape(-1)
            ids = np.repeat(batch.column(0).to_numpy(), SYMBOLS)
            order = np.lexsort((ids, keys))
            first = np.concatenate(([True], np.diff(keys[order]) != 0))
            heads = np.sort(order[first])  # as they came, for an id's rows in a row take less room
            rest = order[~first]
            ties = np.unique(np.stack([ids[rest], ids[order[first]][np.cumsum(first) - 1][~first]]), axis=1)
            ties = ties[:, ties[0] != ties[1]]
            key = np.concatenate([keys[heads], mix(ties[0].view(np.uint64) * np.uint64(SYMBOLS) ^ mix(ties[1].view(np.uint64)))]).view(np.int64)
            b = pa.array(np.concatenate([np.zeros(len(heads), np.int64), ties[1]]), mask=np.arange(len(key)) < len(heads))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate([ids[heads], ties[0]])), b], ["key", "id", "b"])


def block_links(sets: list[np.ndarray], left: np.ndarray, num: int, den: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with den * |a & b| >= num * |a | b|.

    ``left`` tells the sides apart: -1 marks rows that meet all rows, 0 and 1 rows that only meet
    the other side. Exact; a pair is not evaluated once both ends are connected, be it by ``known``,
    which names each row's group so far.
    """
    n = np.array([len(s) for s in sets])
    shingles, code, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    at = np.concatenate(([0], np.cumsum(n)))
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(code, kind="stable")
    posting, begin = owner[order], np.concatenate(([0], np.cumsum(freq)))
    forest, links = Forest(len(sets)), []
    if known is not None:
        for x, y in enumerate(np.unique(known, return_index=True)[1][np.unique(known, return_inverse=True)[1]].tolist()):
            forest.join(x, y)
    for x in np.flatnonzero(n).tolist():  # a blank text has no shingles
        codes = code[at[x] : at[x + 1]]
        prefix = n[x] - -(-num * n[x] // den) + 1  # an overlap of num/den of |x| leaves none of the prefix's complement
        rare = codes[np.argpartition(freq[codes], prefix - 1)[:prefix]] if prefix < n[x] else codes
        if freq[rare].max() < 2:
            continue
        reach = np.unique(np.concatenate([posting[begin[c] : begin[c + 1]] for c in rare[freq[rare] > 1].tolist()]))
        fits = (reach != x) & (n[reach] * den >= num * n[x]) & (n[x] * den >= num * n[reach]) & ((left[reach] != left[x]) | (left[x] < 0))
        reach = reach[fits]
        mine = forest.find(x)
        reach = [y for y in reach.tolist() if forest.find(y) != mine]
        if not reach:
            continue
        if len(reach) <= 8:
            both = {y: len(np.intersect1d(codes, code[at[y] : at[y + 1]], assume_unique=True)) for y in reach}
        else:
            counts = np.bincount(np.concatenate([posting[begin[c] : begin[c + 1]] for c in codes.tolist()]), minlength=len(sets))
            both = {y: int(counts[y]) for y in reach}
        for y, k in both.items():
            if den * k >= num * (n[x] + n[y] - k) and forest.join(x, y):
                links.append((x, y))
    return links


def _verify(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ShingleHasher(width)
        for group in grouped(batches, "grp"):
            if group.num_rows < 2:
                continue
            sets: list[np.ndarray] = []
            for text in group.column("text").chunks:
                for _, _, data, offs in hasher.chunks(text):
                    flat, at = hasher.shingles(data, offs)
                    sets += [flat[a:b] for a, b in zip(at[:-1], at[1:])]
            part, ids, known = (group.column(c).to_numpy() for c in ("part", "id", "comp"))
            links = block_links(sets, np.where(part == 2, -1, part), num, den, known)
            if links:
                a, b = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return run


def _partners(num: int, den: int):
    """Of groups (grp, part, id, comp, n, sign): the rows with a partner that is near by signature, of like size and in another comp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "grp"):
            signs = read_signs(group.column("sign").to_pylist())
            part, comp, n = (group.column(c).to_numpy() for c in ("part", "comp", "n"))
            a, b = (np.flatnonzero(part != 1), np.flatnonzero(part != 0)) if (part != 2).any() else (np.arange(len(part)),) * 2
            same = np.zeros((len(a), len(b)), np.uint8)
            for k in range(SYMBOLS):
                same += signs[a, k][:, None] == signs[b, k]
            sizes = (n[a][:, None] * den >= num * n[b]) & (n[b] * den >= num * n[a][:, None])
            near = (same >= SYMBOLS - FAR) & sizes & (comp[a][:, None] != comp[b])
            found = np.zeros(len(part), bool)
            found[a[near.any(1)]] = True
            found[b[near.any(0)]] = True
            rows = group.select(["id", "grp", "part", "comp"]).filter(pa.array(found)).combine_chunks()
            yield from rows.to_batches()

    return run


def _confirm(classes: DataFrame, members: DataFrame, verify, block: int) -> DataFrame:
    """Edges (a, b) that tie all linked ids of ``members`` (id, cluster, band, n); ``verify`` compares groups (id, grp, part, comp)."""
    alone = F.col("id").alias("comp")
    dealt = cut(block_groups(members, block, VOLUME, pairs=False))
    links = cut(verify(dealt.select("id", "grp", "part", alone)))
    rest = dealt.where("not whole").select(members.columns)
    if rest.isEmpty():
        return links
    last, most = None, rest.count()
    while True:
        found = components(links, links.count()).select(F.col("node").alias("id"), F.col("component").alias("comp"))
        rows = cut(rest.join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id")), most)
        heads = cut(rows.groupBy("cluster", "band", "comp").agg(F.min(F.struct("id", "n")).alias("x")).select("cluster", "band", "x.id", "x.n"), most)
        now = heads.count()
        if last is not None and now > last / 2:
            break
        last = now
        links = cut(links.unionByName(verify(block_groups(heads, block, VOLUME, pairs=False).select("id", "grp", "part", alone))))
    sizes = rows.groupBy("cluster", "comp").agg(F.count("*").alias("k"))
    largest = cut(sizes.groupBy("cluster").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("size")).select("cluster", F.col("top.comp").alias("top"), "size"), most)
    kinds = join_weighed(rows, largest, "cluster", "size").withColumn("kind", (F.col("comp") == F.col("top")).cast("int")).drop("top")
    pairs = cut(block_groups(kinds, block, VOLUME).select("id", "grp", "part", "comp"))
    if pairs.isEmpty():
        return links
    signed = pairs.join(classes.select("id", "n", "sign"), "id").select("grp", "part", "id", "comp", "n", "sign")
    near = cut(signed.repartition("grp").sortWithinPartitions("grp").mapInArrow(_partners(num=verify.num, den=verify.den), "id long, grp long, part int, comp long"))
    return links.unionByName(verify(near))


class _Verify:
    """Reads the texts of groups (id, grp, part, comp) and returns edges (a, b)."""

    def __init__(self, rows: DataFrame, width: int, num: int, den: int):
        self.rows = rows.withColumnRenamed("doc_id", "id").where("id is not null")
        self.width, self.num, self.den = width, num, den

    def __call__(self, dealt: DataFrame) -> DataFrame:
        texts = join_bounded(self.rows, cut(dealt), "id").select("grp", "part", "id", "comp", "text")
        return texts.repartition("grp").sortWithinPartitions("grp").mapInArrow(_verify(self.width, self.num, self.den), "a long, b long")


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, block: int = BLOCK) -> DataFrame:
    """Adds n_shingles, component_id and kept to each row of ``docs`` (doc_id, text); other columns are left out.

    Documents whose shingle sets have a Jaccard similarity of at least num / den are linked;
    ``component_id`` is the smallest doc_id reachable and ``kept`` marks the row whose own it is.
    Null or blank texts have n_shingles 0 and no link; texts with fewer than ``width`` words are
    one shingle. A null doc_id gives a null component_id and is kept, and links nothing. Rows that
    repeat a doc_id count as one document with all their texts, and all are returned. An empty
    table gives an empty result. ``num / den`` may be lowered to about 0.75 before the keys miss
    one link in two thousand.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(rows.mapInArrow(_sign(width), SIGNED))
    filed = signed.where("doc_id is not null and n_shingles > 0")
    # Equal sets are one class; its smallest doc_id stands for it.
    classes = cut(filed.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("sign").alias("sign")))
    clusters = components(star_edges(classes.select("id", "sign").mapInArrow(_file, "key long, id long, b long")))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9).alias("band")
    # An id that stands for several classes weighs as its largest in each of their bands.
    sized = classes.groupBy("id", band).agg(F.max("n").alias("n"))
    members = cut(clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")).join(sized, "id"))
    links = _confirm(classes, members, _Verify(rows, width, num, den), block)
    # A doc_id with several texts ties their classes together.
    twice = cut(filed.groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").select("doc_id"))
    if not twice.isEmpty():
        placed = cut(join_bounded(filed.select("doc_id", "digest"), twice, "doc_id").join(classes.select("digest", "id"), "digest"))
        heads = placed.groupBy("doc_id").agg(F.min("id").alias("b"))
        links = links.unionByName(placed.join(heads, "doc_id").select(F.col("id").alias("a"), "b"))
    linked = components(links)
    names = cut(classes.select("digest", "copies", F.col("id").alias("node")).join(linked, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"), "copies").where("copies > 1 or component_id <> node"))
    filled = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("digest"))
    out = join_weighed(signed.select("doc_id", "n_shingles", filled.alias("digest")), names, "digest", "copies", "left")
    label = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", label.alias("component_id"), F.coalesce(F.col("doc_id") == label, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, all columns as they were.

    The document with the smallest doc_id stays. Rows with a null doc_id, and null or blank texts, are
    in no group and stay; rows that repeat a doc_id are one document and stay or go together. Very long
    texts are read whole; column names cannot clash; an empty table gives an empty result.
    """
    gone = cut(near_duplicates(docs, num, den, width).where("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    small = gone.count() <= 400_000
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"] == gone["_gone"], "left_anti")


def oracle(num: int = 85, den: int = 100) -> str:
    """DuckDB SQL for ``near_duplicates`` by counting common shingles of all documents that share one."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') as k from documents),
s as (select doc_id, list_distinct(case when len(k) = 0 then [] when len(k) < 5 then [array_to_string(k, ' ')] else list_transform(range(1, len(k) - 3), lambda i: array_to_string(k[i:i + 4], ' ')) end) as s from w),
p as (select doc_id, len(s) as n, unnest(s) as x from s),
o as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as c from p a join p b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from o where {den} * c >= {num} * (na + nb - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, root) as (select doc_id, doc_id from s union select e.b, r.root from r join e on e.a = r.doc_id),
m as (select doc_id, min(root) as component_id from r group by doc_id)
select doc_id, len(s) as n_shingles, component_id, doc_id = component_id as kept from s join m using (doc_id)"""

"""A Merkle manifest of a dataset: one tree per group of rows, one tree over the groups' roots.

For every parent the concatenated hashes of its children are stored, the parent's preimage. A proof
is made by joining a leaf with the preimages of its ancestors: the leaf's own slot of 64 characters is
cut out of its parent's preimage, the parent's out of the next, and what is left are the siblings. A
changed leaf is folded by putting the new hash into that slot and hashing again, up to the root.

Trees are built in rounds of ``HEIGHT`` levels: a task holds a run of ``FANOUT ** HEIGHT`` nodes of one
tree, so that a tree of any size is shared out, and 10^12 leaves take four rounds. Positions come from a
range partitioning of all rows, so no group is ever sorted by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ._common import join_weighed, written

#: Children of a node, and levels that one round builds: a task's group has at most 2 ** 10 nodes.
FANOUT, HEIGHT = 2, 10
#: Characters of a digest.
SLOT = 64
#: What a leaf is hashed from, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes of the value, a colon, and the value; numbers are decimal."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(fields: dict[str, Column]) -> Column:
    """The digest of a row: SHA-256 of its encoded fields, as lower-case hex."""
    return F.sha2(F.concat(*(encoded(c) for c in fields.values())), 256)


def levels(n: int, fanout: int) -> int:
    """Levels above ``n`` leaves: 0 for a lone one."""
    up = 0
    while n > 1:
        n, up = -(-n // fanout), up + 1
    return up


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """Adds ``ix``, the place from 0 of every row in the order ``by`` over all rows.

    Rows are dealt out by ranges; a range counts for itself and starts from what the ranges before it
    hold (one number per range reaches the driver). Equal rows may go to several ranges, for where they
    came from decides ties: no repeated row is one task's work.
    """
    spread = rows.withColumn("_from", F.monotonically_increasing_id())
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held, _ = written(spread.repartitionByRange(*by, "_from").sortWithinPartitions(*by, "_from").select("*", F.spark_partition_id().alias("_range"), at.alias("_at")))
    sizes = held.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect()  # one row per range
    starts, total = [], 0
    for r in sizes:
        starts.append((r["_range"], total))
        total += r["n"]
    base = rows.sparkSession.createDataFrame(starts, "_range int, _start long")
    return held.join(F.broadcast(base), "_range").withColumn("ix", F.col("_start") + F.col("_at")).drop("_range", "_start", "_at", "_from")


@dataclass
class Trees:
    """Trees over nodes (tree, idx, digest, n): the rounds' preimages and the roots.

    ``rounds[r]`` has a row (tree, block, level, idx, preimage) for every parent that round r made: its
    level above the leaves, its place in that level, and the run of nodes it belongs to. ``roots`` has
    (tree, digest, n).
    """

    fanout: int
    height: int
    rounds: list[DataFrame]
    roots: DataFrame

    @property
    def preimages(self) -> DataFrame | None:
        """(tree, level, idx, preimage) of all parents; None where no tree has two leaves."""
        out = None
        for r in self.rounds:
            part = r.select("tree", "level", "idx", "preimage")
            out = part if out is None else out.unionByName(part)
        return out


def _parents(low: int, fanout: int, height: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What makes the parents of a run of nodes of level ``low``, ``height`` levels of them at most."""

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        n, row = int(pdf["n"].iloc[0]), list(pdf["digest"])
        first, out = int(pdf["idx"].iloc[0]), []
        for level in range(low + 1, min(low + height, levels(n, fanout)) + 1):
            first //= fanout
            made = ["".join(row[i : i + fanout]) for i in range(0, len(row), fanout)]
            out += [(level, first + i, p) for i, p in enumerate(made)]
            row = [hashlib.sha256(p.encode()).hexdigest() for p in made]
        found = pd.DataFrame(out, columns=["level", "idx", "preimage"])
        return found.assign(tree=pdf["tree"].iloc[0], block=pdf["block"].iloc[0], n=n)

    return up


def build(nodes: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> Trees:
    """The trees over materialised ``nodes`` (tree, idx, digest, n): idx counts a tree's leaves from 0, n is their number.

    Every ``fanout`` consecutive nodes become one parent while a level has several; a last run may be
    shorter, down to one node. A lone leaf is its own root. Empty in, empty out.
    """
    block, done = fanout**height, []
    most = nodes.agg(F.max("n")).first()[0] or 0
    roots = nodes.where("n = 1").select("tree", "digest", "n")
    now = nodes.where("n > 1").select("tree", "idx", "digest", "n")
    for r in range(-(-levels(most, fanout) // height)):
        keyed = now.withColumn("block", F.floor(F.col("idx") / block))
        made, _ = written(keyed.groupBy("tree", "block").applyInPandas(_parents(r * height, fanout, height), "tree long, block long, level int, idx long, preimage string, n long"))
        done.append(made)
        top = made.groupBy("tree", "block").agg(F.max("level").alias("level"))
        tops, _ = written(made.join(top, ["tree", "block", "level"]).select("tree", "level", "idx", F.sha2("preimage", 256).alias("digest"), "n"))
        # A tree is done where its top level has one node.
        whole = F.ceil(F.col("n") / F.pow(F.lit(float(fanout)), F.col("level"))) <= 1
        roots = roots.unionByName(tops.where(whole).select("tree", "digest", "n"))
        now = tops.where(~whole).select("tree", "idx", "digest", "n")
    return Trees(fanout, height, done, written(roots)[0])


PATH = "pre array<string>, slots array<int>"


def _descend(nodes: DataFrame, parents: DataFrame, above: DataFrame, low: int, fanout: int, height: int) -> DataFrame:
    """Joins ``nodes`` (tree, idx of level ``low``) with the preimages of their ancestors: those in ``parents``, which are of one round, then those of ``above`` (tree, block, pre, slots).

    Adds pre and slots, from the parent upwards. A group is a run of at most fanout ** height nodes with
    its parents and one path.
    """
    names = nodes.columns
    keyed = nodes.withColumn("block", F.floor(F.col("idx") / fanout**height))
    none = F.array().cast("array<string>"), F.array().cast("array<int>")
    ancestors = parents.select("tree", "block", "level", "idx", "preimage", none[0].alias("pre"), none[1].alias("slots")).unionByName(
        above.select("tree", "block", F.lit(0).alias("level"), F.lit(0).cast("long").alias("idx"), F.lit("").alias("preimage"), "pre", "slots")
    )

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        stored, rest, rest_slots, top = {}, [], [], low
        for level, idx, preimage, pre, slots in zip(right["level"], right["idx"], right["preimage"], right["pre"], right["slots"]):
            if level:
                stored[level, idx] = preimage
                top = max(top, level)
            else:
                rest, rest_slots = list(pre), list(slots)
        pres, places = [], []
        for idx in left["idx"]:
            own, slots = [], []
            for level in range(low + 1, top + 1):
                slots.append(int(idx % fanout))
                idx //= fanout
                own.append(stored[level, idx])
            pres.append(own + rest)
            places.append(slots + rest_slots)
        return left[names].assign(pre=pres, slots=places)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", " + PATH
    return keyed.groupBy("tree", "block").cogroup(ancestors.groupBy("tree", "block")).applyInPandas(join, schema)


def paths(leaves: DataFrame, trees: Trees, above: DataFrame | None = None) -> DataFrame:
    """``leaves`` (tree, idx and others) with pre and slots: the preimages of all ancestors and the slot that leads to the leaf in each.

    ``above`` (tree, pre, slots) goes on from the trees' roots. The top round's nodes are joined first,
    so a leaf joins one run of parents and one path, not a row per level.
    """
    block = trees.fanout**trees.height
    empty = [F.array().cast("array<string>").alias("pre"), F.array().cast("array<int>").alias("slots")]
    above = (trees.roots.select("tree", *empty) if above is None else above).withColumn("block", F.lit(0).cast("long"))
    for r in range(len(trees.rounds) - 1, 0, -1):
        below = trees.rounds[r - 1]
        done = below.groupBy("tree", "block").agg(F.max("level").alias("level"), F.max("n").alias("n"))
        # Runs of the round below whose tree goes on here; the other trees end below with the path they came with.
        goes_on = done.where(F.col("n") > float(block) ** r).select("tree", F.col("block").alias("idx"))
        own = trees.rounds[r]
        here = above.join(own.select("tree").distinct(), "tree", "left_semi")
        found = _descend(goes_on, own, here, r * trees.height, trees.fanout, trees.height).select("tree", F.col("idx").alias("block"), "pre", "slots")
        above = written(above.join(own.select("tree").distinct(), "tree", "left_anti").select("tree", "block", "pre", "slots").unionByName(found))[0]
    if not trees.rounds:
        return leaves.join(above.drop("block"), "tree")
    return _descend(leaves, trees.rounds[0], above, 0, trees.fanout, trees.height)


def siblings() -> Column:
    """What is left of the preimages ``pre`` when the slots ``slots`` are cut out of them, from the parent upwards."""
    left = lambda p, s: F.concat(F.substring(p, F.lit(1), s * SLOT), F.substring(p, s * SLOT + SLOT + 1, F.length(p)))
    return F.zip_with("pre", "slots", left)


def fold(digest: Column) -> Column:
    """The root that ``digest`` leads to when it takes the slots ``slots`` of the preimages ``pre``."""
    steps = F.zip_with("pre", "slots", lambda p, s: F.struct(F.substring(p, F.lit(1), s * SLOT).alias("a"), F.substring(p, s * SLOT + SLOT + 1, F.length(p)).alias("b")))
    return F.aggregate(steps, digest, lambda now, x: F.sha2(F.concat(x["a"], now, x["b"]), 256))


@dataclass
class Manifest:
    """A dataset's manifest: leaves (tree, idx, n, leaf and the kept columns), the groups' trees and the tree over them, and the root."""

    leaves: DataFrame
    groups: DataFrame
    trees: Trees
    top: Trees
    root: str | None

    def proofs(self) -> DataFrame:
        """The leaves with subroot, and pre and slots from the leaf to the root of the dataset."""
        if self.root is None:
            return self.leaves.select("*", F.lit("").alias("subroot"), F.array().cast("array<string>").alias("pre"), F.array().cast("array<int>").alias("slots"))
        tops = paths(self.groups.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx")), self.top)
        above = tops.select(F.col("idx").alias("tree"), "pre", "slots")
        found = paths(self.leaves, self.trees, above)
        roots = self.trees.roots.select("tree", F.col("digest").alias("subroot"), F.col("n").alias("_weight"))
        return join_weighed(found, roots, "tree", "_weight")

    def write(self, path: str) -> None:
        """Stores the preimages of all parents and the roots below ``path`` as Parquet; an earlier manifest there is replaced."""
        for name, trees in (("groups", self.trees), ("top", self.top)):
            trees.roots.write.mode("overwrite").parquet(f"{path}/{name}/roots")
            if trees.preimages is not None:
                trees.preimages.write.mode("overwrite").parquet(f"{path}/{name}/preimages")


def manifest(docs: DataFrame, by: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None, fanout: int = FANOUT, height: int = HEIGHT) -> Manifest:
    """The manifest of ``docs``: a tree per value of ``by`` (null is a value), leaves by ``order``, groups by their value's bytes, null first.

    Rows with equal ``order`` (and null ones, which come first) are ordered by their digests; equal rows
    are leaves of their own. Null fields, empty and long texts are hashed as they are. ``changed`` gives
    other values of fields; its digest is kept as ``changed``. Other columns of ``docs`` are not read.
    """
    own = {c: F.col(c) for c in fields}
    other = leaf_hash(own | (changed or {}))
    read = docs.select(F.col(by).cast("string").alias("group"), F.col(order).alias("order"), leaf_hash(own).alias("leaf"), other.alias("changed"))
    placed, _ = written(numbered(written(read)[0], "group", "order", "leaf"))
    # A null group has a key of its own, so that joins see it.
    key = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit("-"))
    sizes = placed.groupBy(key.alias("key")).agg(F.min("ix").alias("start"), F.count("*").alias("n"), F.first("group").alias("group"))
    groups, _ = written(numbered(written(sizes)[0], "start").withColumnRenamed("ix", "tree"))
    at = join_weighed(placed.withColumn("key", key).drop("group"), groups.select("key", "tree", "start", "n", F.col("n").alias("_weight")), "key", "_weight")
    leaves, _ = written(at.select("tree", (F.col("ix") - F.col("start")).alias("idx"), "n", "order", "leaf", "changed"))
    trees = build(leaves.select("tree", "idx", F.col("leaf").alias("digest"), "n"), fanout, height)
    count = groups.count()
    nodes = trees.roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(count).cast("long").alias("n"))
    top = build(nodes, fanout, height)
    last = top.roots.first()
    return Manifest(leaves, groups, trees, top, last["digest"] if last else None)


def verify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row, where every seventh doc_id by CRC-32 has its n_chars tampered with."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    made = manifest(docs, changed={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    root = F.lit(made.root).cast("string")
    rows = made.proofs().select("order", "leaf", "subroot", F.sha2(F.array_join(siblings(), ""), 256).alias("proof_sha256"), fold(F.col("changed")).alias("folded_root"))
    return rows.select(F.col("order").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def oracle() -> str:
    """The same rows as DuckDB SQL: levels by recursion, CRC-32 bit by bit."""
    enc = lambda c: f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')"
    leaf = lambda n: "sha256(" + " || ".join(enc(n if c == "n_chars" else c) for c in FIELDS) + ")"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda v, u: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)"
    codes = "list_transform(range(1, length(cast(doc_id as varchar)) + 1), lambda i: cast(ascii(substr(cast(doc_id as varchar), i, 1)) as bigint))"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: {bits}), 4294967295)"

    def tree(name: str, source: str) -> str:
        return f"""{name} as (select g, 0 as level, idx, digest from {source} union all
  select g, level + 1, idx // 2, sha256(string_agg(digest, '' order by idx)) from (select *, count(*) over (partition by g) as c from {name}) where c > 1 group by g, level, idx // 2)"""

    return f"""with recursive hashed as (select doc_id, lang, {leaf('n_chars')} as leaf, {leaf(f"(n_chars + case when {crc} % 7 = 0 then 1 else 0 end)")} as changed from documents),
leaves as (select *, dense_rank() over (order by lang nulls first) - 1 as g, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, row_number() over () as r from hashed),
base as (select g, idx, leaf as digest from leaves),
{tree('lower', 'base')},
tops as (select g, arg_max(digest, level) as digest from lower group by g),
heights as (select g, max(level) as h from lower group by g),
over_ as (select 0 as g, g as idx, digest from tops),
{tree('upper', 'over_')},
whole as (select max(level) as h, arg_max(digest, level) as root from upper),
nodes as (select g, level, idx, digest from lower union all select -1, level, idx, digest from upper),
steps as (select r, level as step, l.g, level, idx >> level as at from leaves l join heights using (g), unnest(range(h)) as u(level) union all
  select r, h + level, -1, level, l.g >> level from leaves l join heights using (g), unnest(range((select h from whole))) as u(level)),
sides as (select s.r, s.step, s.at % 2 as own, n.digest as other from steps s left join nodes n on n.g = s.g and n.level = s.level and n.idx = xor(s.at, 1)),
proofs as (select r, string_agg(other, '' order by step) as proof from sides group by r),
folding as (select r, 0 as step, changed as digest from leaves union all
  select f.r, f.step + 1, sha256(case when s.own = 1 then coalesce(other, '') || digest else digest || coalesce(other, '') end) from folding f join sides s on s.r = f.r and s.step = f.step),
folded as (select r, arg_max(digest, step) as folded_root from folding group by r)
select doc_id, leaf, tops.digest as subroot, root, sha256(coalesce(proof, '')) as proof_sha256, folded_root, folded_root = root as verified
from leaves join tops using (g) join folded using (r) left join proofs using (r), whole"""


"""An inverted index in blocks with their greatest scores, and top-k search that skips what cannot reach the k best.

Documents are dealt out to shards by a hash of their id. The index has, for each shard and term, blocks of
BLOCK postings by falling score part (the part of BM25 that depends on no query), each with its
greatest part, and for each term its document frequency and its CHAMPIONS best postings anywhere.

A search first takes, for each query, a floor of its k-th best score from the champions. Every shard then
reads of a query's terms only the blocks that can lift a document to the floor: terms whose greatest parts
together stay below it bring no candidates, and are looked up for the candidates of the others. What a
shard sends on has reached the floor, so few rows more than k for each query are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..lineage import cut, join_bounded, written

#: Postings of a block, documents of a shard (its postings of one term are 0.5 MB at most), best postings kept by term.
BLOCK, SHARD_DOCS, CHAMPIONS = 128, 32_768, 128
#: Terms of a query that its floor is taken from: those that can count most.
FLOOR_TERMS = 8
#: Rows (query, term) that are held by each worker at a time.
HELD_TERMS = 200_000
#: Scores within this of the floor still count as reaching it, so that the order of additions decides nothing.
SLACK = 1e-9


@dataclass
class Index:
    """blocks (shard, term, block, greatest, docs, parts), terms (term, df, greatest, champions) and the number of documents."""

    blocks: DataFrame
    terms: DataFrame
    n_docs: int

    def write(self, path: str) -> None:
        """Stores the index below ``path``, blocks in a folder per shard; an index that is there is replaced."""
        self.blocks.repartition("shard").sortWithinPartitions("shard", "term", "block").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/blocks")
        self.terms.withColumn("n_docs", F.lit(self.n_docs).cast("long")).write.mode("overwrite").parquet(f"{path}/terms")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        terms = spark.read.parquet(f"{path}/terms")
        first = terms.select("n_docs").first()
        return Index(spark.read.parquet(f"{path}/blocks"), terms.drop("n_docs"), first["n_docs"] if first else 0)


def build(posted: DataFrame, n_docs: int, part: Column, shard_docs: int = SHARD_DOCS, champions: int = CHAMPIONS) -> Index:
    """The index of ``posted`` (doc, term and what ``part`` reads) over ``n_docs`` documents; postings of repeated documents add up. Empty in, empty out."""
    shards = max(1, -(-n_docs // shard_docs))
    rows = posted.select("doc", "term", part.alias("part"), F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int").alias("shard"))
    # By falling part, ties by id; a shard's documents bound the list.
    listed = rows.groupBy("shard", "term").agg(F.sort_array(F.collect_list(F.struct((-F.col("part")).alias("p"), "doc"))).alias("all"))
    starts = F.sequence(F.lit(0), F.size("all") - 1, F.lit(BLOCK))
    cut_up = listed.select("shard", "term", F.posexplode(F.transform(starts, lambda i: F.slice("all", i + 1, BLOCK))).alias("block", "b"))
    parts = F.transform("b", lambda x: -x["p"])
    blocks, _ = written(cut_up.select("shard", "term", "block", F.element_at(parts, 1).alias("greatest"), F.transform("b", lambda x: x["doc"]).alias("docs"), parts.alias("parts")))
    sizes = blocks.groupBy("term").agg(F.sum(F.size("docs")).cast("long").alias("df"), F.max("greatest").alias("greatest"))
    # A term's best postings lie in its first blocks; a limit by task goes before the shuffle.
    first = blocks.where(F.col("block") * BLOCK < champions).select("term", F.explode(F.arrays_zip("parts", "docs")).alias("x")).select("term", F.col("x.parts").alias("part"), F.col("x.docs").alias("doc"))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("part"), "doc"))
    best = first.withColumn("_n", place).where(F.col("_n") <= champions).groupBy("term").agg(F.collect_list(F.struct("part", "doc")).alias("champions"))
    terms, _ = written(sizes.join(best, "term"))
    return Index(blocks, terms, n_docs)


def floors(index: Index, weighted: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): k documents at least score so much, as the champions of the query's heaviest terms show; 0 where they are fewer."""
    heavy = weighted.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.col("w") * F.col("greatest")), "term"))).where(F.col("_n") <= FLOOR_TERMS)
    known = heavy.join(index.terms.select("term", "champions"), "term").select("query_id", "w", F.explode("champions").alias("c"))
    least = known.groupBy("query_id", "c.doc").agg(F.sum(F.col("w") * F.col("c.part")).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    kth = least.withColumn("_n", place).where(F.col("_n") == k).select("query_id", F.col("score").alias("floor"))
    return weighted.select("query_id").distinct().join(kth, "query_id", "left").select("query_id", F.coalesce("floor", F.lit(0.0)).alias("floor"))


class Shard:
    """One shard's postings of the wanted terms: documents by place, each term's places and parts by falling part."""

    def __init__(self, blocks: pd.DataFrame):
        blocks = blocks.sort_values(["term", "block"])
        lists = [np.asarray(d, np.int64) for d in blocks["docs"]]
        self.docs = np.unique(np.concatenate(lists)) if lists else np.empty(0, np.int64)
        self.terms: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.sorted: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        names, parts = list(blocks["term"]), list(blocks["parts"])
        lo = 0
        for hi in range(1, len(names) + 1):
            if hi == len(names) or names[hi] != names[lo]:
                places, held = np.searchsorted(self.docs, np.concatenate(lists[lo:hi])), np.concatenate([np.asarray(p, np.float64) for p in parts[lo:hi]])
                once, which = np.unique(places, return_inverse=True)
                if len(once) < len(places):
                    held = np.bincount(which, held)
                    order = np.argsort(-held, kind="stable")
                    places, held = once[order], held[order]
                self.terms[names[lo]] = places, held
                lo = hi

    def at(self, term: str, places: np.ndarray) -> np.ndarray:
        """The term's parts at sorted ``places``; 0 where it does not occur."""
        if term not in self.sorted:
            own, parts = self.terms[term]
            order = np.argsort(own)
            self.sorted[term] = own[order], parts[order]
        own, parts = self.sorted[term]
        i = np.minimum(np.searchsorted(own, places), len(own) - 1)
        return np.where(own[i] == places, parts[i], 0.0)

    def search(self, query: list[tuple[str, float]], floor: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings that were scored): the ``k`` best that reach ``floor``, ties to the smaller document."""
        held = sorted((w * self.terms[t][1][0], t, w) for t, w in query if w > 0 and t in self.terms)
        most = np.array([m for m, _, _ in held])
        sums, scored = np.cumsum(most), 0
        if not held or sums[-1] < floor - SLACK * max(1.0, floor):
            return np.empty(0, np.int64), np.empty(0), 0
        # The shard's own best postings may lift the floor: their documents are scored in full where that is little work.
        seeds = np.unique(np.concatenate([self.terms[t][0][:BLOCK] for _, t, _ in held[-FLOOR_TERMS:]]))
        if len(seeds) >= k and len(seeds) * len(held) * 4 < sum(len(self.terms[t][0]) for _, t, _ in held):
            known = np.zeros(len(seeds))
            for _, t, w in held:
                found = self.at(t, seeds)
                known += w * found
                scored += int(np.count_nonzero(found))
            floor = max(floor, float(np.partition(known, -k)[-k]))
        floor = floor - SLACK * max(1.0, floor)
        few = int(np.searchsorted(sums, floor)) if floor > 0 else 0
        score = np.zeros(len(self.docs))
        for bound, t, w in held[few:][::-1]:
            places, parts = self.terms[t]
            least = (floor - (sums[-1] - bound)) / w
            n = int(np.searchsorted(-parts, -least, "right")) if least > 0 else len(parts)
            n = min(len(parts), -(-n // BLOCK) * BLOCK)
            score[places[:n]] += w * parts[:n]
            scored += n
        left = np.flatnonzero(score > 0)
        for i in range(few - 1, -1, -1):
            left = left[score[left] + sums[i] >= floor]
            if not len(left):
                break
            found = self.at(held[i][1], left)
            score[left] += held[i][2] * found
            scored += int(np.count_nonzero(found))
        left = left[score[left] >= floor]
        order = np.lexsort((self.docs[left], -np.round(score[left], 9)))[:k]
        return self.docs[left][order], score[left][order], scored


def _answer(asked, k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        shard, out = Shard(blocks), []
        for query, (floor, terms) in asked.value.items():
            docs, scores, scored = shard.search(terms, floor, k)
            # The count of postings goes along in a row of its own.
            out.append(pd.DataFrame({"query_id": query, "doc": np.append(docs, -1), "score": np.append(scores, -1.0), "scored": np.append(np.zeros(len(docs), np.int64), scored)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "doc": [], "score": [], "scored": []})

    return run


def search(index: Index, weighted: DataFrame, k: int, counts: bool = False) -> DataFrame:
    """(query_id, doc, score): of each query the documents that reach its floor, the ``k`` best among them; of ``weighted`` (query_id, term, w).

    Only postings of the queries' terms leave the index, once for all queries. The queries are held by
    the workers, HELD_TERMS of their terms at a time. With ``counts`` (query_id, scored) comes instead:
    how many postings were scored.
    """
    spark = weighted.sparkSession
    asked = cut(join_bounded(weighted, cut(index.terms.select("term", "greatest")), "term").where("w > 0"))
    ready = cut(asked.join(floors(index, asked, k), "query_id").select("query_id", "term", "w", "floor"))
    turns = max(1, -(-ready.count() // HELD_TERMS))
    out = None
    for turn in range(turns):
        own = ready.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn)
        table: dict[int, tuple[float, list[tuple[str, float]]]] = {}
        for r in own.toLocalIterator():
            table.setdefault(r["query_id"], (r["floor"], []))[1].append((r["term"], r["w"]))
        wanted = own.select("term").distinct()
        blocks = index.blocks.join(F.broadcast(wanted), "term", "left_semi")  # at most HELD_TERMS rows
        part = blocks.groupBy("shard").applyInPandas(_answer(spark.sparkContext.broadcast(table), k), "query_id long, doc long, score double, scored long")
        out = part if out is None else out.unionByName(part)
    if counts:
        return out.groupBy("query_id").agg(F.sum("scored").alias("scored"))
    found = out.where("score > 0").select("query_id", "doc", "score")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc"))
    return found.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")

"""Fusion of signals, composite ranking, stratified and diverse selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..lineage import cut, join_bounded, tidy, written
from . import keyword, latent, pools, vector

RRF_K = 60
#: Weights of relevance, authority and recency by intent.
INTENT_WEIGHTS = {"general": (0.60, 0.35, 0.05), "news": (0.50, 0.0, 0.50), "foundational": (0.40, 0.60, 0.0)}
#: Scores are compared at this many digits, so that the order of additions cannot split ties.
DIGITS = 9
#: The four signals of relevance.
RELEVANCE = ("bm25_rank", "tfidf_rank", "lsa_rank", "centroid_rank")


def dense(score: str, by: str = "query_id") -> Column:
    """The dense rank by falling score; nulls share the worst rank."""
    return F.dense_rank().over(Window.partitionBy(by).orderBy(F.round(score, DIGITS).desc_nulls_last()))


def fuse(a: DataFrame, b: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two lists (query_id, doc, rank): query_id, doc, rank_a, rank_b, score, rank of the ``k`` best.

    Ties keep the first list's order, then the second's.
    """
    left, right = (x.select("query_id", "doc", F.col("rank").alias(n)) for x, n in ((a, "rank_a"), (b, "rank_b")))
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    both = left.join(right, ["query_id", "doc"], "full_outer").withColumn("score", part("rank_a") + part("rank_b"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("rank_a"), F.asc_nulls_last("rank_b"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def authority(papers: DataFrame) -> DataFrame:
    """Adds authority = log10(max(influential citations, 0.3 x citations) + 1)."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    return papers.withColumn("authority", F.log10(F.greatest(count("influential_citation_count"), count("citation_count") * 0.3) + 1))


def recency(papers: DataFrame, this_year: int | None = None, decay: float = 0.1) -> DataFrame:
    """Adds recency = exp(-decay x age), 0 without a year; by default age counts from the current year. Its rank does not depend on that."""
    now = F.year(F.current_date()) if this_year is None else F.lit(this_year)
    return papers.withColumn("recency", F.coalesce(F.exp((F.col("year") - now) * decay), F.lit(0.0)))


def spread(column: str, by: str = "query_id") -> Column:
    """1 for the least and 0 for the greatest value of a query, linear between; 0.5 if all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return 1 - F.when(high == low, 0.5).otherwise((F.col(column) - low) / (high - low))


#: What the ranks are made of, and what they are named by.
_READ = ("pool", "ix", "title", "abstract", "year", "citation_count", "influential_citation_count", "embedding", "intent")


@tidy
def ranks(hits: DataFrame, queries: DataFrame, names: tuple[str, ...] = RELEVANCE, stop: tuple[str, ...] = T.STOP_WORDS) -> DataFrame:
    """(query_id, pool, ix), authority, recency and the dense ranks bm25_rank, tfidf_rank, centroid_rank, authority_rank, recency_rank and, if in ``names``, lsa_rank.

    One row per (query_id, ix); all windows are by query or pool (see ``pools``; without one, a query is its own). Texts and vectors
    are written out once and stay behind: no signal carries them along, and they go when the ranks are there. ``stop`` are the stop words of the TF-IDF and latent-semantic
    signals. A column ``intent``, of hits or queries, is kept.
    """
    hits, queries = pools.pooled(hits, queries)
    hits, drop = written(hits.select(*(c for c in _READ if c in hits.columns)))
    queries, drops = cut(queries), [drop]

    def ranked(scored: DataFrame, rank: str) -> DataFrame:
        rows, drop = written(scored.withColumn(rank, dense("score")).drop("score"))
        drops.append(drop)
        return rows

    bm25 = ranked(keyword.lucene_of_hits(hits, queries), "bm25_rank")
    tfidf = ranked(keyword.tfidf_of_hits(hits, queries, stop), "tfidf_rank")
    near = ranked(vector.centroid_scores(hits, bm25.withColumnRenamed("bm25_rank", "rank"), queries=queries), "centroid_rank")
    more = [bm25, tfidf, near]
    if "lsa_rank" in names:
        more.append(ranked(latent.lsa_of_hits(hits, queries, stop=stop), "lsa_rank"))
    priors = recency(authority(hits)).withColumn("authority_rank", dense("authority", "pool")).withColumn("recency_rank", dense("recency", "pool")).drop(*(set(_READ) - {"pool", "ix", "intent"}))
    rows = priors.join(queries.drop("query"), "pool")
    for other in more:
        rows = rows.join(other, ["query_id", "ix"])
    rows, _ = written(rows)
    for drop in drops:
        drop()
    return rows


def _whole(hits: DataFrame, ranked: DataFrame, few: bool = False) -> DataFrame:
    """``ranked`` with all columns of ``hits``; if it has ``few`` rows, it is counted first, so that texts need not be shuffled."""
    by = "pool" if "pool" in hits.columns else "query_id"
    ranked = ranked.drop(*({"pool", "intent"} & set(hits.columns) - {by}), *({"pool"} - {by}))
    return join_bounded(hits, cut(ranked), [by, "ix"]) if few else hits.join(ranked, [by, "ix"])


def signals(hits: DataFrame, queries: DataFrame, names: tuple[str, ...] = RELEVANCE, stop: tuple[str, ...] = T.STOP_WORDS) -> DataFrame:
    """hits with their ``ranks``."""
    return _whole(hits, ranks(hits, queries, names, stop))


def relevance(ranked: DataFrame, names: tuple[str, ...] = RELEVANCE, rrf_k: int = RRF_K) -> DataFrame:
    """Adds rrf_score, the sum of the reciprocal ranks ``names``, and its dense rank rrf_rank."""
    total = sum((1.0 / (rrf_k + F.col(n)) for n in names[1:]), 1.0 / (rrf_k + F.col(names[0])))
    return ranked.withColumn("rrf_score", total).withColumn("rrf_rank", dense("rrf_score"))


def composite(ranked: DataFrame, top_k: int = 50, weights: dict[str, float] | None = None) -> DataFrame:
    """The ``top_k`` hits of each query by weighted relevance, authority and recency, ties to the smaller ix.

    ``weights`` may give any of relevance, authority and recency, the others being the general ones.
    Without it weights come from the column ``intent`` if there is one, else they are the general ones.
    """
    intent = F.col("intent") if "intent" in ranked.columns else F.lit("general")

    def weight(i: int) -> Column:
        if weights is not None:
            return F.lit(float(weights.get(("relevance", "authority", "recency")[i], INTENT_WEIGHTS["general"][i])))
        chosen = F.lit(INTENT_WEIGHTS["general"][i])
        for name, w in INTENT_WEIGHTS.items():
            chosen = F.when(intent == name, F.lit(w[i])).otherwise(chosen)
        return chosen

    parts = {"relevance_score": "rrf_rank", "authority_score": "authority_rank", "recency_score": "recency_rank"}
    for name, rank in parts.items():
        ranked = ranked.withColumn(name, spread(rank))
    total = sum((weight(i) * F.col(n) for i, n in enumerate(list(parts)[1:], 1)), weight(0) * F.col("relevance_score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("final_score", DIGITS)), "ix"))
    return ranked.withColumn("final_score", total).withColumn("final_rank", place).where(F.col("final_rank") <= top_k)


def rank_papers(hits: DataFrame, queries: DataFrame, top_k: int = 50, weights: dict[str, float] | None = None) -> DataFrame:
    """The full ranker: hits (query_id, ix, title, abstract, year, citation counts, embedding) against queries (query_id, query); or both by ``pools``."""
    return _whole(hits, composite(relevance(ranks(hits, queries)), top_k, weights), few=True)


def stratified(ranked: DataFrame, total: int = 50) -> DataFrame:
    """From lists per sub-query (query_id, sub_ix, doc, rank): total div n slots each, every doc once, in sub-query order."""
    n = F.max("sub_ix").over(Window.partitionBy("query_id")) + 1
    kept = ranked.withColumn("_n", n).where(F.col("rank") <= F.floor(F.lit(total) / F.col("_n"))).drop("_n")
    place = F.row_number().over(Window.partitionBy("query_id", "doc").orderBy("sub_ix", "rank"))
    once = kept.withColumn("_p", place).where("_p = 1").drop("_p")
    return once.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("sub_ix", "rank")))


def diverse(ranked: DataFrame, k: int = 12, per_group: int = 3, group: str = "paper_id", by: str = "query_id") -> DataFrame:
    """The ``k`` best with at most ``per_group`` of a group, filled up with the skipped ones: adds final_rank."""
    name = F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit("unknown"))
    nth = F.row_number().over(Window.partitionBy(by, name).orderBy("rank"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("_nth") > per_group, "rank"))
    return ranked.withColumn("_nth", nth).withColumn("final_rank", place).where(F.col("final_rank") <= k).drop("_nth")

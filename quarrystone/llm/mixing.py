"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents are added up to cells of (source, language, topic). Raking scales the cells' token weights
to the target share of each source, each language and each topic in turn until all three agree. No
document can be taken more than once, so a document's probability is its cell's weight times one factor
for all: ``keep``, or less where the largest weight would otherwise lead to a probability above 1. The
expected tokens of the sample then have the target marginals. Only weights above 1 / ``least``, where
almost nothing could be taken besides the rarest category, are trimmed in each round; the remaining gap is
returned. The draw is a hash of the doc_id against the probability: repeatable, and independent of partitioning.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ._common import cut, join_weighed, written

log = logging.getLogger(__name__)
DIMENSIONS = ("source", "lang", "topic")
#: Cells that are raked on the driver at most (about 200 bytes each).
LOCAL_CELLS = 100_000
#: What a null category is called inside a cell.
MISSING = "\u0000missing"


def tempered(cells: DataFrame, dimension: str, alpha: float) -> DataFrame:
    """Target shares in proportion to each category's tokens to the power ``alpha``: (category, share)."""
    sums = cells.groupBy(F.col(dimension).alias("category")).agg(F.sum("tokens").cast("double").alias("n")).where("n > 0")
    power = sums.select("category", F.pow("n", F.lit(alpha)).alias("p"))
    return power.crossJoin(F.broadcast(power.agg(F.sum("p").alias("all")))).select("category", (F.col("p") / F.col("all")).alias("share"))  # one row on the right


def rake(cells: DataFrame, targets: dict[str, DataFrame], keep: float, rounds: int = 100, within: float = 1e-4, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """Adds ``weight`` to ``cells`` (source, lang, topic, tokens), raked to ``targets`` (category, share) by dimension, and ``gap``.

    Categories without a target get weight 0; a dimension without targets is left alone. Ends when
    every marginal is within ``within`` of its target, when weights are trimmed and the largest deviation
    does not fall by a hundredth, or after ``rounds``. ``gap`` is the largest relative deviation of a
    marginal then; one beyond ``within`` is logged too. At most ``local_cells`` cells, with no more targets,
    all counted first, are raked on the driver; more of them by the same steps as joins and sums over
    the cluster.
    """
    size = cells.agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).first()
    goals = {d: t.select("category", (F.col("share") * float(size.tokens or 0)).alias("goal")) for d, t in targets.items()}
    if not size.tokens:
        return cells.withColumn("weight", F.lit(1.0)).withColumn("gap", F.lit(0.0))
    goals = {d: cut(g) for d, g in goals.items()}
    small = size.n <= local_cells and all(g.count() <= local_cells for g in goals.values())
    return (_rake_here if small else _rake_there)(cells, goals, keep, rounds, within)


class _Progress:
    """Tells when raking is done, and reports the gap where it ends short of the targets."""

    def __init__(self, within: float, rounds: int):
        self.within, self.left, self.last = within, rounds, None

    def over(self, gap: float | None, trimmed: bool) -> bool:
        self.left -= 1
        met = gap is None or gap < self.within
        stuck = not met and trimmed and self.last is not None and gap > 0.99 * self.last
        self.last = gap
        if not met and (stuck or not self.left):
            log.warning("raking ends at a gap of %.3g from the targets: %s", gap, "weights are trimmed" if trimmed else "no rounds are left")
        return met or stuck


def _rake_here(cells: DataFrame, goals: dict[str, DataFrame], keep: float, rounds: int, within: float) -> DataFrame:
    rows = cells.select(*DIMENSIONS, "tokens").collect()
    tokens, weight = np.array([r.tokens for r in rows], float), np.ones(len(rows))
    sides = []
    for dimension, goal in goals.items():
        wanted = {r.category: r.goal for r in goal.collect()}
        names = sorted({r[dimension] for r in rows})
        place = {c: i for i, c in enumerate(names)}
        sides.append((np.array([place[r[dimension]] for r in rows]), np.array([wanted.get(c, 0.0) for c in names])))
    progress = _Progress(within, rounds)
    for _ in range(rounds):
        gaps = []
        for at, wanted in sides:
            have = np.bincount(at, tokens * weight, minlength=len(wanted))
            ratio = np.divide(wanted, have, out=np.zeros_like(have), where=have > 0)[at]
            weight = weight * ratio
            gaps.append(ratio)
        alive = weight > 0
        gap = max((float(np.abs(g[alive] - 1).max()) for g in gaps if alive.any()), default=None)
        trimmed = bool((weight > 1 / keep).any())
        weight = np.minimum(weight, 1 / keep)
        if progress.over(gap, trimmed):
            break
    schema = ", ".join(f"{d} string" for d in DIMENSIONS) + ", tokens long, weight double, gap double"
    return cells.sparkSession.createDataFrame([(*(r[d] for d in DIMENSIONS), r.tokens, float(w), progress.last or 0.0) for r, w in zip(rows, weight)], schema)


def _rake_there(cells: DataFrame, goals: dict[str, DataFrame], keep: float, rounds: int, within: float) -> DataFrame:
    now, drop = written(cells.withColumn("weight", F.lit(1.0)))
    progress = _Progress(within, rounds)
    for _ in range(rounds):
        off = []
        for dimension, goal in goals.items():
            sums = now.groupBy(F.col(dimension).alias("category")).agg(F.sum(F.col("tokens") * F.col("weight")).alias("have"))
            ratio = sums.join(goal, "category", "left").select(F.col("category").alias(dimension), F.when(F.col("have") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("have")).otherwise(0.0).alias("_ratio"))
            off.append(f"_off_{dimension}")
            now = now.join(ratio, dimension).withColumn("weight", F.col("weight") * F.col("_ratio")).withColumnRenamed("_ratio", off[-1])
        worst = F.max(F.when(F.col("weight") > 0, F.array_max(F.array(*(F.abs(F.col(c) - 1) for c in off)))))
        now, drop_next = written(now.withColumn("_over", F.col("weight") > 1.0 / keep).withColumn("weight", F.least("weight", F.lit(1.0 / keep))))
        drop()
        drop = drop_next
        gap, trimmed = now.agg(worst, F.bool_or("_over")).first()
        now = now.drop(*off, "_over")
        if progress.over(gap, bool(trimmed)):
            break
    return now.select(*DIMENSIONS, "tokens", "weight", F.lit(progress.last or 0.0).alias("gap"))


def chance(doc_id: Column, text: Column, seed: int = 9) -> Column:
    """A number in [0, 1) from the doc_id, or from the text where that is null."""
    h = F.coalesce(F.when(doc_id.isNotNull(), F.xxhash64(F.lit(seed), doc_id)), F.xxhash64(F.lit(seed), F.lit("text"), text))
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def mix_documents(docs: DataFrame, topics: DataFrame | None = None, targets: dict[str, DataFrame] | None = None, alpha: float = 0.7, keep: float = 0.8, least: float = 0.05) -> DataFrame:
    """A struct ``row`` of all columns of ``docs`` (doc_id, text, lang, source) with topic, tokens, weight, probability, sampled and gap.

    ``topics`` has (doc_id, topic); of several topics of a document the smallest counts. ``targets``
    has (category, share) for any of source, lang and topic; others follow ``tempered`` shares.
    The expected share of all tokens that is taken is the largest up to ``keep`` for which the targets are
    met, but at least ``least`` before trimming. ``gap`` is the largest deviation of a marginal of the
    weights from its target: near 0 where the targets are met, more where trimming or missing categories
    do not allow that. Null sources, languages and topics are categories of their own; null and blank
    texts have no tokens and are drawn by their cell's weight, 1 in a cell without tokens.
    Rows that repeat a doc_id are drawn alike; the input's columns stay inside ``row``, so no name can
    clash; an empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in ("source", "lang")),
        F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long").alias("tokens"), chance(F.col("doc_id").cast("long"), text).alias("chance"),
    )
    if topics is None:
        rows = rows.withColumn("topic", F.lit(MISSING))
    else:
        named = cut(topics.where("doc_id is not null and topic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("topic").cast("string")).alias("topic"), F.count("*").alias("_n")))
        rows = join_weighed(rows, named, "doc_id", "_n", "left").withColumn("topic", F.coalesce("topic", F.lit(MISSING)))
    rows = rows.withColumn("cell", F.concat_ws("\u0001", *DIMENSIONS))
    cells = cut(rows.groupBy("cell", *DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    goals = {d: (targets or {}).get(d) or tempered(cells, d, alpha) for d in DIMENSIONS}
    raked = rake(cells.select(*DIMENSIONS, "tokens"), goals, least)
    most = raked.where("tokens > 0").agg(F.max("weight")).first()[0] or 1.0
    factor = min(keep, 1.0 / max(most, 1.0))
    raked = raked.select(*DIMENSIONS, F.when(F.col("tokens") > 0, F.col("weight")).otherwise(1.0).alias("weight"), "gap")
    weights = cut(cells.select("cell", *DIMENSIONS, "docs").join(raked, list(DIMENSIONS)).select("cell", "docs", "weight", "gap"))
    drawn = join_weighed(rows, weights, "cell", "docs").withColumn("probability", F.least(F.lit(1.0), F.col("weight") * factor))
    return drawn.select("row", F.nullif("topic", F.lit(MISSING)).alias("topic"), "tokens", "weight", "probability", (F.col("chance") < F.col("probability")).alias("sampled"), "gap")


def topics_of_vectors(vectors: DataFrame) -> DataFrame:
    """(doc_id, topic): the label of the vector with the document's id."""
    return vectors.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("topic"))

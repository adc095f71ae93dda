"""Union and first-seen deduplication of search hits; arrival order is (variant_ix, hit_ix)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..lineage import cut

ARRIVAL = ("variant_ix", "hit_ix")


def usable_hits(hits: DataFrame) -> DataFrame:
    """Hits with an id, a title and a full-text link."""
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return hits.where(filled("paper_id") & filled("title") & filled("pdf_url"))


def first_seen(hits: DataFrame, key: Column | str, by: Sequence[str] = (), order: Sequence[str] = ARRIVAL) -> DataFrame:
    """The first hit of each ``key`` within ``by``, in arrival order; never an arbitrary survivor."""
    key = F.col(key) if isinstance(key, str) else key
    place = F.row_number().over(Window.partitionBy(*by, key).orderBy(*order))
    return hits.withColumn("_place", place).where("_place = 1").drop("_place")


def union_variants(variants: Sequence[DataFrame]) -> DataFrame:
    """The variants' hits one after the other; variant_ix is the place in ``variants``."""
    parts = [v.withColumn("variant_ix", F.lit(i)) for i, v in enumerate(variants)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def dedup_hits(hits: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Usable hits, once per id and then once per title key. Equal to the greedy pass if an id always has one title."""
    once = first_seen(usable_hits(hits), "paper_id", by)
    return first_seen(once, T.title_key("title"), by)


def dedup_hits_strict(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """The greedy pass itself: a hit stays if neither its id nor its title key was seen on a hit that stayed.

    In rounds: of the hits that are left, those stay that come first of their id and of their title, and
    all hits with an id or title that stayed go. Ends after as many rounds as the longest chain of hits that
    wait for each other, few in practice; no query's hits are gathered in one task.
    """
    left = cut(usable_hits(hits).withColumn("_key", T.title_key("title")))
    place = lambda c: F.row_number().over(Window.partitionBy(by, c).orderBy(*ARRIVAL, "paper_id", "_key"))
    kept: list[DataFrame] = []
    while not left.isEmpty():
        kept.append(cut(left.withColumn("_a", place("paper_id")).withColumn("_b", place("_key")).where("_a = 1 and _b = 1").drop("_a", "_b")))
        for c in ("paper_id", "_key"):
            left = left.join(kept[-1].select(by, c), [by, c], "left_anti")
        left = cut(left)
    out = left
    for part in kept:
        out = out.unionByName(part)
    return out.drop("_key")


def without(hits: DataFrame, seen: DataFrame, on: Sequence[str]) -> DataFrame:
    """Hits that are not in ``seen``."""
    return hits.join(seen, list(on), "left_anti")

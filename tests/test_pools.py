"""Hits that several queries share give what each query's own copy of them gives, and their texts are counted once."""

import pytest
from pyspark.sql import functions as F

from quarrystone import lineage
from quarrystone.operators import ingest, keyword, latent, pools, ranking, vector
from quarrystone.plans import retrieval
from tests.test_latent import corpus

PAPER = "pool long, ix long, title string, abstract string, year int, citation_count long, influential_citation_count long, embedding array<float>"


def shared(spark):
    """Pools 1 and 2 with two queries each, one of a query that asks nothing; pool 3 has no query, query 9 no hits."""
    rows = [(p, i, t[:25] if i % 7 else None, t if i % 5 else None, 1990 + i % 30, i * 13 % 50, i % 4, [float(i % 3), 1.0, float(p)] if i % 2 else None) for p in (1, 2, 3) for i, t in enumerate(corpus(60, 3, 8, p))]
    asked = [(10, 1, "t0w1 t0w1 t1w3"), (11, 1, "t2w5 absent"), (20, 2, "t1w2 t0w4"), (21, 2, None), (9, 8, "t0w1")]
    return spark.createDataFrame(rows, PAPER), spark.createDataFrame(asked, "query_id long, pool long, query string")


def read(rows):
    return {(r[0], r[1]): [None if x is None else round(x, 7) for x in r[2:]] for r in rows.collect()}


def test_a_pool_equals_hits_of_each_query(spark):
    hits, asked = shared(spark)
    own = hits.join(asked.select("query_id", "pool"), "pool").drop("pool")
    single = asked.drop("pool")
    for f in (keyword.lucene_of_hits, keyword.tfidf_of_hits, latent.lsa_of_hits):
        got = read(f(hits, asked).select("query_id", "ix", "score"))
        assert got == read(f(own, single).select("query_id", "ix", "score")) and len(got) == 240 and any(x[0] > 0.1 for x in got.values())
    names = ("query_id", "ix", *ranking.RELEVANCE, "authority_rank", "recency_rank")
    assert read(ranking.ranks(hits, asked).select(*names)) == read(ranking.signals(own, single).select(*names))


def test_texts_are_counted_once_for_a_pool(spark, monkeypatch):
    hits, asked = shared(spark)
    seen = []
    real = pools.counted
    monkeypatch.setattr(pools, "counted", lambda texts, *a, **k: seen.append(texts.count()) or real(texts, *a, **k))
    keyword.lucene_of_hits(hits, asked)
    assert seen == [180]


@pytest.mark.parametrize("limit", [("WHOLE_ENTRIES", 0), ("WHOLE_TERMS", 0)])
def test_one_task_equals_blocks(spark, monkeypatch, limit):
    hits, asked = shared(spark)
    exact = read(latent.lsa_of_hits(hits, asked, 4).select("query_id", "ix", "score"))
    for name, value in (("EXACT_HITS", 0), ("BLOCK_HITS", 25), ("TILE", 8), ("WHOLE_STEP", 11)):
        monkeypatch.setattr(latent, name, value)
    whole = read(latent.lsa_of_hits(hits, asked, 4).select("query_id", "ix", "score"))
    monkeypatch.setattr(latent, *limit)
    blocks = read(latent.lsa_of_hits(hits, asked, 4).select("query_id", "ix", "score"))
    for k, (x,) in exact.items():
        assert abs(x - whole[k][0]) < 1e-6 and abs(x - blocks[k][0]) < 1e-6


def test_answers_of_a_pool_equal_those_of_each_query(spark):
    hits, asked = shared(spark)
    hits = hits.selectExpr("*", "concat('P', pool, '-', ix) as paper_id", "'u' as pdf_url").where("pool <> 2 or ix < 20")  # pool 2 fails the gate
    asked = asked.where("pool <> 3").selectExpr("query_id", "pool", "query as final_rephrase")
    own = hits.join(asked.select("query_id", "pool"), "pool").drop("pool")
    got, want = ({r.query_id: r for r in retrieval.answer_queries(q, h, 3).collect()} for q, h in ((asked, hits), (asked.drop("pool"), own)))
    assert got == want and len(got) == 5 and got[10].n_passages > 0 and got[20].reason.startswith("insufficient") and got[9].reason == "no hits"


def searching(spark, asked):
    """A search of two places by turns, which notes what it is asked; every third query's first searches find too little."""
    texts = corpus(90, 3, 8, 5)
    rows = [(p, i, f"P{i % 80}", f"{p} {i % 70} {t[:25]}", t if i % 9 else None, 1990 + i % 30, i * 13 % 50, i % 4, "u" if i % 10 else None, [float(i % 3), 1.0, float(p)] if i % 2 else None) for p in (0, 1) for i, t in enumerate(texts)]
    papers = spark.createDataFrame(rows, "place int, hit_ix int, paper_id string, title string, abstract string, year int, citation_count long, influential_citation_count long, pdf_url string, embedding array<float>")

    def search(variants):
        asked.append(sorted((r.query_id, r.variant_ix) for r in variants.collect()))
        few = (F.col("query_id") % 3 == 0) & F.lit(len(asked) % 2 == 1)
        return variants.withColumn("place", F.pmod(F.col("query_id") + F.col("variant_ix"), F.lit(2)).cast("int")).drop("query").join(papers, "place").where(~few | (F.col("hit_ix") < 5)).drop("place")

    return search


def test_queries_of_the_same_searches_are_searched_once_and_share_hits(spark):
    cols = "query_id long, query string, strategy string, intent_type string, final_rephrase string, primary string, broad string, alternative string, sub_queries array<string>"
    q = spark.createDataFrame([(i, f"t0w{i}", "expansion", ("news", "general")[i % 2], f"t{i % 3}w1 t0w{i % 8}", "p", "b", "a", ["t0w1 t1w2", "t2w3", "t1w1"] if i % 4 == 2 else []) for i in range(12)], cols)
    same = F.struct((F.col("query_id") % 3 == 0).alias("few"), F.pmod(F.col("query_id") + F.col("variant_ix"), F.lit(2)).alias("place"))
    asked, alone = [], []
    got = [x.collect() for x in retrieval.discover(q, searching(spark, asked), 3, 10, same=same)]
    want = [x.collect() for x in retrieval.discover(q, searching(spark, alone), 3, 10)]
    order = lambda rows: sorted((sorted(r.asDict().items()) for r in rows), key=str)
    assert order(got[0]) == order(want[0]) and order(got[1]) == order(want[1]) and len(got[1]) == 12
    assert {r.refined for r in got[1] if r.query_id % 3 == 0} == {True} and {r.query_id for r in got[0]} == set(range(12))
    # Two places, few hits or many, three variants or as many sub-queries: four pools, and of refined ones two.
    assert [len({i for i, _ in x}) for x in asked] == [4, 2] and [len({i for i, _ in x}) for x in alone] == [12, 4]


def test_full_texts_are_not_shuffled_for_a_few_candidates(spark):
    texts = spark.range(1000).selectExpr("concat('P', id) as paper_id", "repeat('x ', 400) as text")
    ranked = spark.createDataFrame([(1, f"P{i}", i, "u") for i in range(20)], "query_id long, paper_id string, rank int, pdf_url string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chosen = ingest.choose_full_text(ranked, texts)
        plan = chosen._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and sorted(r.paper_id for r in chosen.collect()) == [f"P{i}" for i in range(5)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shuffles_of_a_tidy_plan_go_with_its_writes(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    seen = []

    @lineage.tidy
    def plan(rows, fail=False):
        seen.append(spark.conf.get(setting))
        if fail:
            raise ValueError("failed")
        return lineage.written(rows.repartition(3, "id"))[0]

    assert plan(spark.range(50)).count() == 50 and spark.conf.get(setting) == before
    with pytest.raises(ValueError):
        plan(spark.range(1), fail=True)
    assert seen == ["true", "true"] and spark.conf.get(setting) == before

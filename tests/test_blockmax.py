"""Block-max search against full scoring, and how little it scores."""

import random
from collections import Counter, defaultdict
from math import log

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrystone.functions import text as T
from quarrystone.operators import blockmax, keyword

STOPS = ["the", "of", "and", "to", "in"]


def corpus(n, seed=3, words=400):
    """Texts of stop words and, less often, rarer words."""
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(STOPS) if rng.random() < 0.5 else f"w{int(words * rng.random() ** 3)}" for _ in range(rng.randint(0, 40)))) for i in range(n)]


def brute(docs, queries, k):
    """The k best of each query by scoring every document."""
    tokens = {i: t.lower().split() for i, t in docs if t is not None} | {i: [] for i, t in docs if t is None}
    tf = {i: Counter(t) for i, t in tokens.items()}
    df = Counter(w for c in tf.values() for w in c)
    n, mean = len(docs), sum(map(len, tokens.values())) / max(len(docs), 1)
    raw = {w: log(n - c + 0.5) - log(c + 0.5) for w, c in df.items()}
    floor = max(0.0, 0.25 * sum(raw.values()) / max(len(raw), 1))
    idf = {w: floor if x < 0 else x for w, x in raw.items()}
    out = {}
    for q, text in queries:
        asked = Counter(text.lower().split())
        score = {i: sum(m * idf.get(w, 0) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * len(tokens[i]) / mean)) for w, m in asked.items() if c[w]) for i, c in tf.items()}
        out[q] = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return out


QUERIES = [(1, "the"), (2, "the of and"), (3, "w1 w2 the"), (4, "w399 w398 w7 w7 of"), (5, "nothing at all"), (6, ""), (7, "THE w0 w0 w5 w9 w11 and to in of")]


@pytest.mark.parametrize("k,shard_docs", [(1, 1000), (7, 90), (40, 64), (200, 50)])
def test_equals_full_scoring(spark, k, shard_docs):
    docs = corpus(300) + [(300, None), (301, ""), (302, "the of and"), (303, "the of and"), (304, "w1 w2 the")]
    rows, asked = spark.createDataFrame(docs, "ix long, text string"), spark.createDataFrame(QUERIES, "query_id long, query string")
    posted = keyword.postings(rows, T.tokens("text"))
    mean = posted.agg(F.sum("tf")).first()[0] / len(docs)
    index = blockmax.build(posted, len(docs), F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / mean)), shard_docs, champions=20)
    got = defaultdict(list)
    for r in sorted(keyword.okapi_topk(rows, asked, k, index=index).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["doc"], round(r["score"], 9)))
    expected = brute(docs, QUERIES, k)
    assert {q: [(d, pytest.approx(s, abs=1e-8)) for d, s in rows] for q, rows in expected.items()} == dict(got)


def weighted(spark, index, queries):
    asked = keyword.query_terms(spark.createDataFrame(queries, "query_id long, query string"), T.tokens("query"))
    return asked.join(keyword.okapi_idf(index.terms.select("term", "df"), index.n_docs), "term").select("query_id", "term", (F.col("qtf") * F.greatest("idf", F.lit(0.0))).alias("w"))


def test_stop_words_beside_rare_ones_are_hardly_scored(spark):
    docs = corpus(6000, words=30_000)
    index = keyword.okapi_index(spark.createDataFrame(docs, "ix long, text string"))
    rare = [w for w, c in Counter(w for _, t in docs for w in set(t.split())).items() if c in (12, 13)][:6]
    queries = [(i, f"the of {w}") for i, w in enumerate(rare)] + [(10, "the"), (11, "and")]
    asked = weighted(spark, index, queries)
    full = {r["query_id"]: r["n"] for r in asked.where("w > 0").join(index.terms, "term").groupBy("query_id").agg(F.sum("df").alias("n")).collect()}
    scored = {r["query_id"]: r["scored"] for r in blockmax.search(index, asked, 10, counts=True).collect()}
    assert len(full) == len(queries) and all(scored[q] * 10 < n for q, n in full.items())
    # No more than a few rows beside the k best of a query leave the shards.
    sent = blockmax.search(index, asked, 10).groupBy("query_id").count().collect()
    assert all(r["count"] == 10 for r in sent)


def test_an_index_is_stored_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame(corpus(200), "ix long, text string")
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    index = keyword.okapi_index(rows)
    for _ in range(2):
        index.write(str(tmp_path / "index"))
    read = blockmax.Index.read(spark, str(tmp_path / "index"))
    assert read.n_docs == 200 and read.blocks.count() == index.blocks.count()
    key = lambda df: sorted((r["query_id"], r["rank"], r["doc"], round(r["score"], 9)) for r in df.collect())
    assert key(keyword.okapi_topk(rows, asked, 9, index=read)) == key(keyword.okapi_topk(rows, asked, 9))


def test_queries_in_several_turns(spark, monkeypatch):
    rows = spark.createDataFrame(corpus(150), "ix long, text string")
    queries = [(i, f"w{i} the w{i + 1} of") for i in range(30)]
    asked = spark.createDataFrame(queries, "query_id long, query string")
    monkeypatch.setattr(blockmax, "HELD_TERMS", 17)
    got = {(r["query_id"], r["rank"]): r["doc"] for r in keyword.okapi_topk(rows, asked, 5).collect()}
    assert got == {(q, i): d for q, best in brute(corpus(150), queries, 5).items() for i, (d, _) in enumerate(best, 1)}


def test_no_documents_and_repeated_ones(spark):
    asked = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    assert keyword.okapi_topk(spark.createDataFrame([], "ix long, text string"), asked, 5).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a a"), (2, "a"), (3, "c")], "ix long, text string")
    best = keyword.okapi_topk(twice, spark.createDataFrame([(1, "c a")], "query_id long, query string"), 2).orderBy("rank").collect()
    assert [r["doc"] for r in best] == [1, 3]


def test_shard_skips_blocks_below_the_floor():
    n = 10_000
    parts = np.linspace(2.5, 0.1, n)
    blocks = pd.DataFrame([{"term": "t", "block": i // 128, "docs": list(range(i, min(i + 128, n))), "parts": list(parts[i : i + 128])} for i in range(0, n, 128)])
    docs, scores, scored = blockmax.Shard(blocks).search([("t", 2.0), ("none", 9.0)], 2.0 * parts[200], 10)
    assert list(docs) == list(range(10)) and scores[0] == 5.0 and scored <= 3 * 128 + 128

"""Latent-semantic scores against a dense singular value decomposition, by both of their ways."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.functions import text as T
from quarrystone.operators import latent, ranking

SCHEMA = "query_id long, ix long, title string, abstract string"


def dense(texts, query, components, stop=T.STOP_WORDS):
    """The scores by plain numpy, over the same terms."""
    split = lambda t: [w for w in t.lower().replace(":", " ").split() if len(w) > 1 and w not in stop]
    docs = [split(t) for t in texts]
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    terms = sorted(w for w, c in df.items() if 5 <= c <= 0.8 * len(docs))
    x = np.array([[d.count(w) * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w in terms] for d in [*docs, split(query)]])
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.where(length > 0, length, 1)
    _, s, vt = np.linalg.svd(x[:-1], full_matrices=False)
    k = min(components, len(terms) - 1)
    y = x @ vt[:k][s[:k] > 1e-5].T
    both = np.linalg.norm(y[:-1], axis=1) * np.linalg.norm(y[-1])
    return np.where(both > 1e-12, y[:-1] @ y[-1] / np.where(both > 1e-12, both, 1), 0.0)


def corpus(n, topics, words, seed, long=30):
    rng = random.Random(seed)
    vocabulary = [[f"t{t}w{i}" for i in range(words)] for t in range(topics)]
    return [" ".join(rng.choice(vocabulary[i % topics]) if rng.random() < 0.9 else rng.choice(rng.choice(vocabulary)) for _ in range(long)) for i in range(n)]


def scores(spark, texts, query, components, parts=3, **more):
    rows = [(1, i, t, None) for i, t in enumerate(texts)]
    q = spark.createDataFrame([(1, query)], "query_id long, query string")
    got = latent.lsa_of_hits(spark.createDataFrame(rows, SCHEMA).repartition(parts), q, components, **more).collect()
    out = {r.ix: r.score for r in got}
    assert len(out) == len(got) == len(texts)
    return np.array([out[i] for i in range(len(texts))])


@pytest.fixture
def small_blocks(monkeypatch):
    """Every query is a large one, of many blocks and tiles."""
    for name, value in (("EXACT_HITS", 0), ("BLOCK_HITS", 40), ("BLOCK_ENTRIES", 1500), ("TILE", 64)):
        monkeypatch.setattr(latent, name, value)


def test_few_hits_equal_a_dense_decomposition(spark):
    texts = [*corpus(150, 5, 20, 1), "", "unknownword"]
    query = "t0w1 t0w2 t3w4 never"
    assert np.abs(scores(spark, texts, query, 5) - dense(texts, query, 5)).max() < 1e-6


@pytest.mark.parametrize("topics,words,components", [(5, 20, 5), (6, 70, 6), (6, 70, 100)])
def test_many_hits_equal_a_dense_decomposition(spark, small_blocks, topics, words, components):
    """Fewer terms than the basis has columns; more of them, with a gap after the topics; fewer hits than it has columns."""
    texts = [*corpus(400 if components < 100 else 220, topics, words, 2), "", "unknownword", "the of"]
    query = "t0w1 t0w2 t3w4 never"
    want = dense(texts, query, components)
    got = scores(spark, texts, query, components)
    assert np.abs(got - want).max() < 1e-6 and got[-3:].tolist() == [0, 0, 0] and got.max() > 0.5


def test_both_ways_agree_on_several_queries(spark, monkeypatch):
    texts, other = corpus(90, 4, 15, 3), corpus(130, 3, 25, 4)
    rows = [(1, i, t, None) for i, t in enumerate(texts)] + [(2, i, None, t) for i, t in enumerate(other)] + [(3, 0, "alone", "alone"), (4, 0, None, None)]
    hits = spark.createDataFrame(rows, SCHEMA)
    # Query 4 asks nothing, 5 has no hits, 2 asks for words that no hit has.
    q = spark.createDataFrame([(1, "t0w1 t2w3"), (2, "absent"), (3, "alone"), (4, None), (5, "t0w1")], "query_id long, query string")
    read = lambda: {(r.query_id, r.ix): r.score for r in latent.lsa_of_hits(hits, q, 4).collect()}
    exact = read()
    for name, value in (("EXACT_HITS", 100), ("BLOCK_HITS", 50)):
        monkeypatch.setattr(latent, name, value)
    mixed = read()  # query 1 by one way, query 2 by the other
    monkeypatch.setattr(latent, "EXACT_HITS", 0)
    blocks = read()
    assert exact.keys() == mixed.keys() == blocks.keys() and len(exact) == len(rows)
    assert max(max(abs(exact[k] - mixed[k]), abs(exact[k] - blocks[k])) for k in exact) < 1e-6
    assert all(exact[k] == 0 for k in exact if k[0] != 1) and max(exact.values()) > 0.5


def test_sizes_and_settings(spark, small_blocks):
    """Sizes, by which blocks are dealt out, are those of the weights; the batch size is restored."""
    texts = corpus(600, 4, 30, 5, 12)
    rows = spark.createDataFrame([(1, i, t, "") for i, t in enumerate(texts)], SCHEMA)
    found = rows.select("query_id", F.lit(False).alias("asked"), "ix", T.content_words("title").alias("t"))
    weights, sizes = latent.weights_of_hits(found)
    size = sizes.first()
    assert size.hits == 600 and size.entries == weights.selectExpr("sum(size(js))").first()[0]
    assert weights.selectExpr("max(abs(aggregate(xs, 0d, (s, x) -> s + x * x) - 1))").first()[0] < 1e-9
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.abs(scores(spark, texts, "t0w1", 4) - dense(texts, "t0w1", 4)).max() < 1e-6
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_stop_words_are_a_parameter(spark):
    texts = [t + " however" * (i % 2) for i, t in enumerate(corpus(60, 3, 8, 6))]
    longer = (*T.STOP_WORDS, "however")
    query = "however t0w1"
    want = dense(texts, query, 3, longer)
    assert np.abs(scores(spark, texts, query, 3, stop=longer) - want).max() < 1e-6
    assert np.abs(scores(spark, texts, query, 3) - dense(texts, query, 3)).max() < 1e-6
    assert np.abs(dense(texts, query, 3) - want).max() > 0.01
    rows = spark.createDataFrame([(1, i, t, "", 2000, 1, 1, None) for i, t in enumerate(texts)], f"{SCHEMA}, year int, citation_count long, influential_citation_count long, embedding array<float>")
    q = spark.createDataFrame([(1, query)], "query_id long, query string")
    with_it, without = ({r.ix: (r.lsa_rank, r.tfidf_rank) for r in ranking.signals(rows, q, stop=s).collect()} for s in (T.STOP_WORDS, longer))
    assert with_it != without


@pytest.mark.parametrize("terms", [1 << 17, 150])
def test_a_pool_of_one_task_is_not_shuffled_word_by_word(spark, monkeypatch, terms):
    """Its task counts and weighs the words; Spark counts only terms, where words alone do not tell that they are few."""
    texts = [*corpus(300, 5, 20, 7), "", "unknownword", "the of"]
    query = "t0w1 t0w2 t3w4 never"
    want = dense(texts, query, 5)
    monkeypatch.setattr(latent, "EXACT_HITS", 0)
    monkeypatch.setattr(latent, "WHOLE_TERMS", terms)
    monkeypatch.setattr(latent, "_weights", lambda found: pytest.fail("a row for each word"))
    assert np.abs(scores(spark, texts, query, 5) - want).max() < 1e-6

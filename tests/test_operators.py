"""Operators on small cases with known results."""

import json
import math
import random

import numpy as np
import pytest

from quarrystone.functions import text as T, vectors as V
from quarrystone.operators import answers, dedup, gate, ingest, keyword, limits, ranking, vector
from quarrystone.plans import catalog, retrieval
from quarrystone.session import Settings
from quarrystone.sources import tables
from pyspark.sql import functions as F

ANSWERS = [
    ("[1] and [2]", 3, True, [1, 2], []), ("[1] and [5]", 3, False, [1, 5], [5]), ("[0]", 3, False, [0], [0]), ("none", 3, True, [], []), ("", 3, True, [], []), ("(1) [A] {1}", 3, True, [], []),
    ("[1] [1] [2]", 3, True, [1, 2], []), ("[4] [10] [0]", 3, False, [0, 4, 10], [0, 4, 10]), ("[1]", 0, False, [1], [1]), ("[1] [50] [100] [101]", 100, False, [1, 50, 100, 101], [101]), (None, 3, True, [], []),
    ("[99999999999999999999]", 3, False, [99999999999999999999], [99999999999999999999]),
]


def test_citations(spark):
    rows = spark.createDataFrame([(i, a, n) for i, (a, n, *_) in enumerate(ANSWERS)], "i long, answer string, n_passages int")
    got = {r.i: r for r in answers.verify(rows).collect()}
    for i, (_, _, valid, found, bad) in enumerate(ANSWERS):
        assert (got[i].valid, list(map(int, got[i].found)), list(map(int, got[i].invalid))) == (valid, found, bad)
    assert got[3].reason == "No citations found in answer."
    rate = answers.validity_rate(answers.verify(rows)).first()
    assert rate.n_answers == len(ANSWERS) and rate.n_valid == sum(v for _, _, v, *_ in ANSWERS)


def test_clean_citations(spark):
    row = spark.createDataFrame([("x 【1†source】 [2†L1-L3] end",)], "t string").select(T.clean_citations("t").alias("t")).first()
    assert row.t == "x [1] [2] end"


def gate_rows(n, abstracts, vectors):
    return [("q", "text" if i < abstracts else None if i % 2 else "  ", [0.5] * 4 if i < vectors else ([float("nan")] * 4 if i % 2 else None)) for i in range(n)]


@pytest.mark.parametrize("n,abstracts,vectors,passed", [(30, 25, 30, True), (20, 20, 20, False), (30, 30, 10, True), (30, 15, 15, False)])
def test_gate(spark, n, abstracts, vectors, passed):
    rows = spark.createDataFrame(gate_rows(n, abstracts, vectors), "query_id string, abstract string, embedding array<float>")
    r = gate.verdict(gate.metrics(rows, ["query_id"], (4,))).first()
    assert r.passed is passed and r.abstract_coverage == pytest.approx(abstracts / n) and r.embedding_coverage == pytest.approx(vectors / n)
    assert r.reason == "Quality gate passed" if passed else "insufficient paper count" in r.reason or "low abstract coverage" in r.reason


def test_refinement(spark):
    first, second = (spark.createDataFrame([("a", x), ("b", x)], "query_id string, x int") for x in (1, 2))
    passed = spark.createDataFrame([("a", True), ("b", False)], "query_id string, passed boolean")
    assert {(r.query_id, r.x) for r in gate.refine(first, second, passed).collect()} == {("a", 1), ("b", 2)}


def test_dedup(spark):
    hits = [("q", v, h, p, t, u) for v, h, p, t, u in [(0, 0, "42", "T one", "u"), (0, 1, "42", "T one", "u"), (0, 2, "43", "t ONE ", "u"), (1, 0, "44", "other", None), (1, 1, "44", "other", "u"), (2, 0, "45", "", "u"), (2, 1, None, "x", "u"), (2, 2, "", "x", "u")]]
    df = spark.createDataFrame(hits, "query_id string, variant_ix int, hit_ix int, paper_id string, title string, pdf_url string")
    for f in (dedup.dedup_hits, dedup.dedup_hits_strict):
        assert [(r.paper_id, r.variant_ix, r.hit_ix) for r in f(df).orderBy("variant_ix", "hit_ix").collect()] == [("42", 0, 0), ("44", 1, 1)]


def test_overlapping_variants(spark):
    parts = [spark.range(a, a + 100).selectExpr("'q' as query_id", "id as hit_ix", "concat('P', id) as paper_id", "concat('title ', id) as title", "'u' as pdf_url") for a in (0, 50, 100)]
    assert dedup.dedup_hits(dedup.union_variants(parts)).count() == 200


def hits_of(spark, rows):
    return spark.createDataFrame(rows, "query_id long, ix long, title string, abstract string, year int, citation_count long, influential_citation_count long, embedding array<float>")


def test_ranker_prefers_newer_and_keeps_ties_in_order(spark):
    q = spark.createDataFrame([(1, "fasting and sleep")], "query_id long, query string")
    same = hits_of(spark, [(1, i, "fasting", "sleep study", 2020, 10, 1, [1.0, 0.0]) for i in range(5)])
    got = ranking.rank_papers(same, q).orderBy("final_rank").collect()
    assert [r.ix for r in got] == list(range(5)) and len({r.final_score for r in got}) == 1
    two = hits_of(spark, [(1, 0, "fasting", "sleep", 2015, 10, 1, None), (1, 1, "fasting", "sleep", 2024, 10, 1, None), (1, 2, None, None, None, None, None, None)])
    assert [r.ix for r in ranking.rank_papers(two, q).orderBy("final_rank").collect()][:2] == [1, 0]
    assert ranking.rank_papers(hits_of(spark, []), q).count() == 0
    many = hits_of(spark, [(1, i, f"t{i}", "a", 2000 + i, i, i, None) for i in range(15)])
    assert ranking.rank_papers(many, q, 10).count() == 10


def test_diversity(spark):
    rows = [(1, g, i + 1) for i, g in enumerate("AAAAB")]
    df = spark.createDataFrame(rows, "query_id long, paper_id string, rank int")
    pick = lambda k: [r.paper_id for r in ranking.diverse(df, k).orderBy("final_rank").collect()]
    assert pick(4) == list("AAAB") and pick(5) == list("AAABA")


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id long, doc long, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "query_id long, doc long, rank int")
    got = ranking.fuse(a, b, 5).orderBy("rank").collect()
    assert [r.doc for r in got] == [20, 10, 30] and got[0].score == pytest.approx(1 / 62 + 1 / 61)
    assert all(0 < r.score <= 2 / 61 for r in got)


def test_okapi_includes_documents_without_a_match(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["fasting helps", "sleep well", "nothing here", "fasting and fasting", ""])], "ix long, text string")
    q = spark.createDataFrame([(1, "Fasting"), (2, "absent word")], "query_id long, query string")
    got = keyword.okapi_topk(docs, q, 4).orderBy("query_id", "rank").collect()
    assert [r.doc for r in got if r.query_id == 1] == [3, 0, 1, 2] and [r.doc for r in got if r.query_id == 2] == [0, 1, 2, 3]


def test_knn_equals_plain_search(spark):
    rng = random.Random(1)
    data = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(200)]
    q = [(i, data[i][1]) for i in range(5)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / n if (n := math.hypot(*a) * math.hypot(*b)) else 0.0
    got = vector.knn(spark.createDataFrame(q, "query_id long, embedding array<float>"), spark.createDataFrame(data, "doc long, embedding array<float>").repartition(3), 7).orderBy("query_id", "rank").collect()
    want = [(i, d) for i, v in q for d, _ in sorted(((d, round(cos(v, w), 9)) for d, w in data), key=lambda x: (-x[1], x[0]))[:7]]
    assert [(r.query_id, r.doc) for r in got] == want


def test_valid_vectors(spark):
    rows = [([0.0] * 4, True), ([0.0] * 3, False), (None, False), ([0.0, None, 0.0, 0.0], False), ([0.0, float("inf"), 0.0, 0.0], False)]
    got = spark.createDataFrame([(v,) for v, _ in rows], "v array<float>").select(V.is_valid("v", (4,)).alias("ok")).collect()
    assert [r.ok for r in got] == [ok for _, ok in rows]


def test_lsa_ranks_the_topic_first(spark):
    rows = [(1, i, "sleep rest night" if i % 2 else "diet food energy", "sleep night dream" if i % 2 else "food diet meal", 2000, 1, 1, None) for i in range(12)]
    q = spark.createDataFrame([(1, "dream sleep")], "query_id long, query string")
    got = {r.ix: r.score for r in retrieval.lsa_of_hits(hits_of(spark, rows), q).collect()}
    assert min(got[i] for i in got if i % 2) > max(got[i] for i in got if not i % 2)
    one = retrieval.lsa_of_hits(hits_of(spark, rows[:1]), q).first()
    assert one.score == 0


def test_windows_and_sentences(spark):
    df = spark.createDataFrame([("p", "a b c d e f g h i"), ("q", "  "), ("r", None)], "paper_id string, text string")
    assert [r.text for r in ingest.token_windows(df, 5, 2).orderBy("chunk_index").collect()] == ["a b c d e", "d e f g h", "g h i"]
    text = "One two three. Four five! Six seven eight nine? Ten."
    for size, overlap in ((4, 0), (6, 3), (100, 10)):
        chunks = ingest.pack_sentences(text, size, overlap)
        assert all(len(c.split()) <= size for c in chunks) and chunks[0].startswith("One")
        if not overlap:
            assert " ".join(chunks).split() == text.split()
    assert ingest.pack_sentences("w " * 30, 8, 2)[0] == " ".join(["w"] * 8)
    assert ingest.sentence_chunks(df, 5, 2).count() >= 2


def test_embedding(spark):
    rows = spark.createDataFrame([(0, "a b"), (1, ""), (2, None), (3, "c " * 900)], "i long, text string")
    got = {r.i: r.embedding for r in ingest.embed(rows, dims=8, batch=2).collect()}
    assert not any(got[1]) and not any(got[2]) and any(got[0]) and len(got) == 4
    again = {r.i: r.embedding for r in ingest.embed(rows, dims=8, batch=64).collect()}
    assert got == again
    with pytest.raises(Exception, match="shape"):
        ingest.embed(rows, dims=8, model=lambda texts: [[0.0] * 3 for _ in texts]).collect()
    mixed = spark.createDataFrame([(0, "a", [1.0] * 8), (1, "b", None), (2, "c", [1.0])], "i long, text string, embedding array<float>")
    assert all(len(r.embedding) == 8 for r in ingest.fill_embeddings(mixed, 8).collect())


def test_full_text_upgrade(spark):
    ranked = spark.createDataFrame([(1, f"p{i}", "u" if i != 2 else None, i) for i in range(20)], "query_id long, paper_id string, pdf_url string, rank int")
    texts = spark.createDataFrame([(f"p{i}", "x" * (600 if i % 2 else 10)) for i in range(20)], "paper_id string, text string")
    full = ingest.choose_full_text(ranked, texts)
    assert sorted(r.paper_id for r in full.collect()) == ["p1", "p3", "p5", "p7", "p9"]
    base = spark.createDataFrame([(1, "p1", "abs"), (1, "p2", "abs"), (1, "p4", " ")], "query_id long, paper_id string, text string")
    got = {r.paper_id: r.text_source for r in ingest.upsert_full_text(base, full).collect()}
    assert got == {"p1": "pdf", "p2": "abstract", "p3": "pdf", "p5": "pdf", "p7": "pdf", "p9": "pdf"}


def test_optimised_query(spark):
    good = '{"strategy":"expansion","intent_type":"news","final_rephrase":"r","primary":"p","broad":"b","alternative":"a"}'
    rows = [("q0", good), ("q1", f"text ```json {good} ``` more"), ("q2", f"```json\n{good}\n```"), ("q3", "broken {"), ("q4", None), ("q5", ""), ("q6", '{"strategy":"decomposition","final_rephrase":"r","sub_queries":["x","y"]}'), ("q7", '{"strategy":"decomposition","final_rephrase":"r","sub_queries":["x"]}')]
    got = {r.query: r for r in answers.parse_optimized(spark.createDataFrame(rows, "query string, reply string")).collect()}
    assert [got[q].parsed for q, _ in rows] == [True, True, True, False, False, False, True, True]
    assert got["q3"].primary == "q3" and got["q0"].intent_type == "news" and got["q6"].sub_queries == ["x", "y"] and got["q6"].intent_type == "general"
    asked = answers.search_variants(answers.parse_optimized(spark.createDataFrame([(1, *rows[0]), (2, *rows[6])], "query_id long, query string, reply string")))
    assert sorted((r.query_id, r.variant_ix, r.query) for r in asked.collect()) == [(1, 0, "p"), (1, 1, "b"), (1, 2, "a"), (2, 0, "x"), (2, 1, "y")]


def test_replies_in_many_forms():
    fields = {"final_rephrase": "r", "primary": "p", "broad": "b", "alternative": "a"}
    read = lambda x: answers.optimised(x)
    whole = (None, None, "r", "p", "b", "a", [])
    assert read(json.dumps(fields)) == read(repr(fields)) == read(f"so: {fields!r}.") == read("{'final_rephrase': 'r', 'primary': 'p', 'broad': 'b', 'alternative': 'a',}") == whole
    assert read(json.dumps(fields | {"primary": ["a", "b", 1, None]}))[3] == "a b 1 None" and read(repr(fields | {"broad": ("x", "y")}))[4] == "x y"
    assert read(repr(fields | {"strategy": None, "intent_type": "news"}))[:2] == (None, "news")
    assert read("{'final_rephrase': 'it\\'s \\u00e9\\n', 'primary': 'p', 'broad': 'b', 'alternative': 'a'}")[2] == "it's \u00e9\n"
    one = {"strategy": "decomposition", "final_rephrase": "r", "sub_queries": ["s"]}
    assert read(json.dumps(one))[6] == ["s"] and read(repr(one | {"sub_queries": ("s", "t")}))[6] == ["s", "t"]
    nothing = (None,) * 7
    for bad in (None, "", "{", "}{", "[1]", "7", "{'a': null}", json.dumps(one | {"sub_queries": []}), json.dumps(one | {"sub_queries": ["s", 1]}), json.dumps(fields | {"broad": 3}), json.dumps(fields | {"final_rephrase": None}), "{" * 5000, "{'a': __import__('os')}", "{" + "[" * 3000):
        assert read(bad) == nothing, bad


def test_context(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "c")], "query_id long, rank int, text string")
    assert answers.context(rows).first().context == "[1] a\n---\n[2] b\n---\n[3] c"


def test_rate_limit(spark):
    times = [0, 10, 20, 30, 40, 50, 3599, 3600, 3611]
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate(times)] + [(100, 2, 5)], "event_id long, user_id long, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.event_id: r.admitted for r in limits.admit(rows).collect()}
    assert [got[i] for i in range(9)] == [True] * 5 + [False, False, True, True] and got[100]
    cool = {r.event_id: r.admitted for r in limits.admit(rows, cooldown=15).collect()}
    assert [cool[i] for i in range(5)] == [True, False, True, False, True]
    assert {r.event_id: r.n_recent for r in limits.sliding_count(rows, 30).collect()}[3] == 4


def test_stage_report(spark):
    rows = spark.createDataFrame([(1, "search", 1.0, None), (1, "rank", 2.0, None), (2, "search", 1.0, "down"), (3, "rank", 1.0, "bad")], "query_id long, stage string, seconds double, error string")
    got = {r.query_id: r for r in answers.stage_report(rows).collect()}
    assert [got[i].status for i in (1, 2, 3)] == [200, 503, 500] and got[1].total_s == 3 and got[1].timing == {"rank": 2.0, "search": 1.0}


def test_small_functions(spark):
    from quarrystone.functions import scalars

    row = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [100.0, 100.0]], [1, 1, 0], float("nan"))], "t array<array<double>>, m array<int>, x double")
    got = row.select(scalars.masked_mean("t", "m", 2).alias("a"), scalars.masked_mean("t", F.array(F.lit(0), F.lit(0), F.lit(0)), 2).alias("z"), scalars.nan_to_null("x").alias("n")).first()
    assert got.a == [2.0, 3.0] and got.z == [0.0, 0.0] and got.n is None
    assert scalars.public_row(spark.createDataFrame([(1, None, "s")], "a int, b int, secret string"), "secret").first().json == '{"a":1}'
    checked = spark.createDataFrame([("",)], "paper_id string").select(gate.check_inputs())
    with pytest.raises(Exception, match="no id"):
        checked.collect()


def test_stratified_slots(spark):
    rows = [(1, s, d, r + 1) for s in range(2) for r, d in enumerate(range(s * 20, s * 20 + 30))]
    got = ranking.stratified(spark.createDataFrame(rows, "query_id long, sub_ix int, doc long, rank int")).orderBy("final_rank").collect()
    assert [r.doc for r in got] == list(range(0, 25)) + list(range(25, 45)) and len({r.doc for r in got}) == len(got)


def test_pipeline_keeps_a_row_for_every_query(spark):
    q = spark.createDataFrame([(1, "sleep and fasting", None), (2, "nothing found", None)], "query_id long, query string, reply string")
    hits = spark.createDataFrame([(1, i, f"P{i}", f"sleep title {i}", f"fasting text {i} " * 30, 2000 + i, 5, 1, "u", [0.5] * 8) for i in range(30)], "query_id long, ix long, paper_id string, title string, abstract string, year int, citation_count long, influential_citation_count long, pdf_url string, embedding array<float>")
    got = {r.query_id: r for r in retrieval.answer_queries(answers.parse_optimized(q), hits, 8).collect()}
    assert got[1].passed and got[1].n_passages == 12 and got[1].context.startswith("[1] ") and not got[2].passed and got[2].context == ""


def test_relevance_has_four_signals(spark):
    rng = random.Random(4)
    topics = ["solar cell panel energy light".split(), "protein enzyme binding fold cell".split()]
    texts = [" ".join(rng.choice(topics[i % 2]) for _ in range(9)) for i in range(14)]
    rows = [("paper", i, text) for i, text in enumerate(texts)]
    hits = spark.createDataFrame([(1, i, t, a, 2000 + i, 5 * i, i, [1.0, float(i % 5)]) for t, i, a in rows], "query_id long, ix long, title string, abstract string, year int, citation_count long, influential_citation_count long, embedding array<double>")
    q = spark.createDataFrame([(1, "solar energy light")], "query_id long, query string")
    got = {r.ix: r for r in ranking.relevance(ranking.signals(hits, q)).collect()}
    # Latent space by a plain singular value decomposition.
    docs = [("paper " + t).split() for t in texts]
    terms = sorted(w for w in {w for d in docs for w in d} if 5 <= sum(w in d for d in docs) <= 0.8 * len(docs))
    x = np.array([[d.count(w) * (math.log((1 + len(docs)) / (1 + sum(w in e for e in docs))) + 1) for w in terms] for d in [*docs, "solar energy light".split()]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, s, vt = np.linalg.svd(x[:-1], full_matrices=False)
    y = x @ vt[: min(100, len(terms) - 1)][s[: min(100, len(terms) - 1)] > 1e-5].T
    cosine = np.round(y[:-1] @ y[-1] / np.linalg.norm(y[:-1], axis=1) / np.linalg.norm(y[-1]), 9)
    place = {c: i + 1 for i, c in enumerate(sorted(set(cosine), reverse=True))}
    assert len(place) > 3 and [got[i].lsa_rank for i in range(14)] == [place[c] for c in cosine]
    fused = {i: sum(1 / (60 + r[n]) for n in ("bm25_rank", "tfidf_rank", "lsa_rank", "centroid_rank")) for i, r in got.items()}
    assert all(abs(got[i].rrf_score - fused[i]) < 1e-12 for i in got)
    order = {c: i + 1 for i, c in enumerate(sorted({round(x, 9) for x in fused.values()}, reverse=True))}
    assert all(got[i].rrf_rank == order[round(fused[i], 9)] for i in got)


def test_whole_texts_and_questions(spark, sf_dir):
    asked = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    whole = {r.query_id: r["query"] for r in tables.questions(spark, sf_dir).collect()}
    assert whole == {i: " ".join(t.lower().split()) for i, t in asked.items()} and max(len(t.split()) for t in whole.values()) > 8
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    lists = {}
    for r in catalog._fused(spark, sf_dir).where("rank <= 5").orderBy("rank").collect():
        if r.doc in texts:  # some vectors have no document
            lists.setdefault(r.query_id, []).append((r.rank, texts[r.doc]))
    got = {r.query_id: r.context for r in catalog.QUERIES["context_string"](spark, sf_dir).collect()}
    assert got == {q: "\n---\n".join(f"[{i}] {t}" for i, t in found) for q, found in lists.items()}
    size = {f"P{i}": len(t) for i, t in texts.items()}
    assert all(r.n_chars == size[r.paper_id] for r in catalog.QUERIES["base_bonus_upsert"](spark, sf_dir).collect())


def test_composite_of_four_signals_written_out(spark, sf_dir):
    """From the six ranks on, in plain Python; the latent-semantic ranks have a test of their own."""
    rows = ranking.signals(catalog._hits(spark, sf_dir).where("query_id < 6"), tables.questions(spark, sf_dir)).select("query_id", "ix", *ranking.RELEVANCE, "authority_rank", "recency_rank").collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    places = lambda xs: [sorted(set(xs), reverse=True).index(x) + 1 for x in xs]
    spread = lambda xs: [0.5 if max(xs) == min(xs) else 1 - (x - min(xs)) / (max(xs) - min(xs)) for x in xs]
    for name, weights, k in (("composite_rank", [(0.6, 0.35, 0.05)] * 3, 50), ("composite_rank_by_intent", [(0.6, 0.35, 0.05), (0.5, 0.0, 0.5), (0.4, 0.6, 0.0)], 20)):
        want = set()
        for q, hits in by.items():
            fused = places([round(sum(1 / (60 + r[n]) for n in ranking.RELEVANCE), 9) for r in hits])
            parts = [spread(fused), spread([r.authority_rank for r in hits]), spread([r.recency_rank for r in hits])]
            final = [sum(w * p[i] for w, p in zip(weights[q % 3], parts)) for i in range(len(hits))]
            order = sorted(range(len(hits)), key=lambda i: (-round(final[i], 9), hits[i].ix))
            want |= {(q, hits[i].ix, round(final[i], 5), n + 1) for n, i in enumerate(order[:k])}
        got = {(r.query_id, r.ix, round(r.final_score, 5), r.final_rank) for r in catalog.QUERIES[name](spark, sf_dir).where("query_id < 6").collect()}
        assert {x[:2] + x[3:] for x in got} == {x[:2] + x[3:] for x in want} and all(abs(a[2] - b[2]) < 2e-5 for a, b in zip(sorted(got), sorted(want)))


def test_weights_of_a_call(spark):
    q = spark.createDataFrame([(1, "sleep")], "query_id long, query string")
    hits = hits_of(spark, [(1, 0, "sleep", "sleep", 2024, 0, 0, None), (1, 1, "sleep", "sleep", 2000, 900, 90, None)])
    first = lambda **w: ranking.rank_papers(hits, q, 1, w or None).first().ix
    assert first() == 1 and first(relevance=0.0, authority=0.0, recency=1.0) == 0 and first(recency=1.0) == 0


def test_no_reranker_keeps_the_first(spark):
    rows = spark.createDataFrame([(1, i, "a b", "a" if i else "a b", i + 1) for i in range(4)], "query_id long, doc long, query string, text string, rank int")
    got = ingest.rerank(rows, 2).orderBy("rerank_rank").collect()
    assert [(r.doc, r.rerank_score) for r in got] == [(0, None), (1, None)]


def test_a_failing_model_leaves_rows_without_vectors(spark):
    def shaky(texts):
        if "bad" in texts:
            raise RuntimeError("down")
        return [[1.0] * 4 for _ in texts]

    rows = spark.createDataFrame([(0, "good"), (1, "bad"), (2, None)], "i long, text string").coalesce(1)
    got = {r.i: r.embedding for r in ingest.embed(rows, dims=4, batch=1, model=shaky, pause=0).collect()}
    assert got[0] == [1.0] * 4 and got[1] is None and got[2] == [0.0] * 4
    with pytest.raises(Exception, match="down"):
        ingest.embed(rows, dims=4, batch=1, model=shaky, pause=0, degrade=False).collect()
    chunks = spark.createDataFrame([(1, 1, "sleep well", [1.0, 0.0]), (1, 2, "sleep more sleep", None)], "query_id long, chunk long, text string, embedding array<float>")
    q = spark.createDataFrame([(1, "sleep", None)], "query_id long, query string, embedding array<float>")
    assert {r.doc for r in retrieval.retrieve(chunks, q, 5).collect()} == {1, 2}


def test_normaliser_finds_vectors_links_and_ids(spark):
    base = "ix long, paper_id string, title string, abstract string, year int, citation_count long, influential_citation_count long, open_access_pdf struct<url:string>, url string, venue string"
    row = (7, None, None, "a", 2000, None, None, None, "http://u", "v")
    for extra, value, want in (("embedding struct<vector:array<float>>", ([1.0],), [1.0]), ("embedding struct<specter_v2:array<float>>", ([2.0],), [2.0]), ("`embedding.specter_v1` array<float>", [3.0], [3.0]), ("embedding array<float>", [4.0], [4.0]), ("x int", 1, [])):
        r = retrieval.normalise(spark.createDataFrame([(*row, value)], f"{base}, {extra}")).first()
        assert list(r.embedding) == want and r.paper_id == "paper_7" and r.pdf_url == "http://u" and r.title == "" and r.authors == [] and r.external_ids == {} and r.citation_count == 0


def test_checks_of_inputs(spark):
    rows = spark.createDataFrame([("a", [1.0]), ("b", None), ("c", [])], "paper_id string, v array<float>")
    assert rows.where(gate.check_inputs("paper_id", "v", (1,))).count() == 3
    with pytest.raises(Exception, match="length"):
        rows.where(gate.check_inputs("paper_id", "v", (2,))).collect()


def test_questions_without_marks(spark):
    rows = spark.createDataFrame([("Question: a? Answer: b",), ("Why so?\nBecause\nof it",), ("no question",)], "t string")
    q, a = answers.question_and_answer("t")
    assert [tuple(r) for r in rows.select(q, a).collect()] == [("a?", "b"), ("Why so?", "Because\nof it"), ("", "")]


def test_settings_and_progress(spark):
    from quarrystone.plans.progress import Progress

    assert Settings.read({"QUARRYSTONE_RERANK_TOP_K": "3"}) == Settings(rerank_top_k=3)
    with pytest.raises(ValueError):
        Settings.read({"QUARRYSTONE_RRF_K": "x"})
    heard = []
    progress = Progress(lambda name, s, e: heard.append((name, s is None, e)))
    with progress.stage("search"):
        pass
    with pytest.raises(KeyError), progress.stage("rank"):
        raise KeyError("k")
    assert heard == [("search", True, None), ("search", False, None), ("rank", True, None), ("rank", False, "'k'")]
    report = answers.stage_report(progress.rows(spark)).first()
    assert set(report.timing) == {"search", "rank"} and report.status == 500


def test_long_queues_and_groups(spark):
    from quarrystone.functions import scalars

    rows = spark.createDataFrame([(i, "a" if i % 7 else None, (i * 37) % 100, float(i % 5)) for i in range(300)], "event_id long, kind string, ts int, value double")
    got = {r.event_id: r.position for r in limits.queue_positions(rows, "kind").collect()}
    for kind in (True, False):
        order = sorted((r for r in rows.collect() if (r.kind is None) == kind), key=lambda r: (r.ts, r.event_id))
        assert [got[r.event_id] for r in order] == list(range(1, len(order) + 1))
    shares = scalars.share_of_max(rows, "value", "kind")
    assert shares.columns == rows.columns + ["share"] and {(r.value, r.share) for r in shares.collect()} == {(float(v), v / 4) for v in range(5)}
    assert rows.select(scalars.new_id().alias("u")).distinct().count() == 300


def test_greedy_dedup_equals_the_loop(spark):
    rng = random.Random(3)
    for n in (40, 400):
        hits = [("q", 0, i, f"P{rng.randrange(n // 3)}", f"t{rng.randrange(n // 3)}", "u") for i in range(n)]
        df = spark.createDataFrame(hits, "query_id string, variant_ix int, hit_ix int, paper_id string, title string, pdf_url string")
        ids, titles, want = set(), set(), []
        for _, _, i, p, t, _ in hits:
            if p not in ids and t not in titles:
                ids.add(p)
                titles.add(t)
                want.append(i)
        assert sorted(r.hit_ix for r in dedup.dedup_hits_strict(df).collect()) == want


def test_many_queries_of_vectors_go_in_parts(spark, monkeypatch):
    monkeypatch.setattr(vector, "HELD", 3)
    data = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(30)], "doc long, embedding array<float>")
    q = data.where("doc < 8").selectExpr("doc as query_id", "embedding")
    show = lambda df: sorted((r.query_id, r["rank"], r.doc) for r in df.collect())
    got = show(vector.knn(q, data, 4))
    monkeypatch.setattr(vector, "HELD", 100)
    assert got == show(vector.knn(q, data, 4, strict=True)) and len(got) == 32
    with pytest.raises(Exception, match="length"):
        vector.knn(q, data.unionByName(spark.createDataFrame([(99, [1.0])], data.schema)), 4, strict=True).collect()


def test_discovery_refines_once_and_ranks_by_sub_query(spark):
    reply = lambda **x: __import__("json").dumps({"final_rephrase": "sleep text", **x})
    q = spark.createDataFrame([(1, "one", reply(strategy="expansion", primary="p", broad="b", alternative="a")), (2, "two", reply(strategy="expansion", primary="rare", broad="b", alternative="a")), (3, "three", reply(strategy="decomposition", sub_queries=["sleep title 3", "fasting text 9"])), (4, "four", reply(strategy="expansion", primary="none", broad="none", alternative="none"))], "query_id long, query string, reply string")
    asked = []

    def search(variants):
        asked.append(sorted((r.query_id, r.variant_ix, r["query"]) for r in variants.collect()))
        n = F.when(F.col("query") == "rare", 3).when(F.col("query").isin("none", "four"), 0).when((F.col("query_id") == 2) & F.lit(len(asked) < 2), 2).otherwise(40)
        rows = variants.withColumn("hit_ix", F.explode(F.sequence(F.lit(0), n))).where(F.col("hit_ix") < n)
        i = F.col("hit_ix").cast("string")
        return rows.select("query_id", "variant_ix", "hit_ix", F.concat(F.lit("P"), i).alias("paper_id"), F.concat(F.lit("sleep title "), i).alias("title"), F.concat(F.lit("fasting text "), i).alias("abstract"), (F.lit(1990) + F.col("hit_ix") % 30).alias("year"), F.lit(1).cast("long").alias("citation_count"), F.lit(1).cast("long").alias("influential_citation_count"), F.lit("u").alias("pdf_url"), F.array(F.lit(0.5), F.lit(0.5)).cast("array<float>").alias("embedding"))

    ranked, verdict = retrieval.discover(answers.parse_optimized(q), search, 2, top_k=10)
    got = {r.query_id: r for r in verdict.collect()}
    assert [(got[i].passed, got[i].refined) for i in (1, 2, 3, 4)] == [(True, False), (True, True), (True, False), (False, True)] and got[4].reason == "no hits"
    assert [x for x in asked[1] if x[0] == 2] == [(2, 0, "b"), (2, 1, "a"), (2, 2, "two")] and {x[0] for x in asked[1]} == {2, 4}
    lists = {}
    for r in ranked.orderBy("query_id", "final_rank").collect():
        lists.setdefault(r.query_id, []).append(r.paper_id)
    assert len(lists[1]) == 10 and 5 <= len(lists[3]) <= 10 and len(set(lists[3])) == len(lists[3]) and set(lists) == {1, 2, 3}
    texts = spark.createDataFrame([(f"P{i}", f"whole text {i} " * 100) for i in range(40)], "paper_id string, text string")
    queries = answers.parse_optimized(q).select("query_id", F.col("final_rephrase").alias("query"))
    out = {r.query_id: r for r in retrieval._answers(queries, ranked, verdict, 2, Settings(), texts, None, None).collect()}
    assert "whole text" in out[1].context and out[1].answer is None and out[4].answer == answers.NO_PASSAGES

import random

import numpy as np
import pyarrow as pa

from quarrystone.llm import _common as C, minhash


def sets_of(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, num, den):
    """doc_id -> smallest reachable doc_id, by comparing all pairs."""
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, sets_of(t)) for i, t in rows if i is not None]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def family(rng, base, n, rate):
    out = []
    for _ in range(n):
        words = list(base)
        for k in range(len(words)):
            if rng.random() < rate:
                words[k] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for size in (8, 30, 120, 400):
        base = [rng.choice(vocabulary) for _ in range(size)]
        texts += family(rng, base, 40, 0.01) + family(rng, base, 20, 0.03)
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(1, 80))]) for _ in range(120)]  # a passage that many share
    texts += ["same words again and again here"] * 50 + ["two words", "Two  WORDS", "", None]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85, 100, block=16).collect()}
    want = brute(rows, 85, 100)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets_of(t)) and r.kept == (want[i] == i) for (i, t) in rows for r in [got[i]])


def test_small_blocks_and_default_threshold_agree(spark):
    rng = random.Random(8)
    base = [f"q{rng.randrange(300)}" for _ in range(90)]
    rows = list(enumerate(family(rng, base, 120, 0.012)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 80, 100)
    for block in (8, 4096):
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, block=block).collect()} == want


def test_pigeonhole_keys():
    """Signatures that differ in 15 symbols share a key wherever the differences are."""
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, (1, minhash.SYMBOLS), dtype=np.uint16)
        b = a.copy()
        at = rng.choice(minhash.SYMBOLS, 2 * minhash.CHUNKS - 1, replace=False)
        b[0, at] ^= 1
        assert set(minhash.deletion_keys(a)[0]) & set(minhash.deletion_keys(b)[0])


def test_messy_rows(messy):
    got = minhash.near_duplicates(messy, 85, 100).collect()
    assert len(got) == messy.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.n_shingles for r in by[1]] == [2, 2] and all(r.kept and r.component_id == 1 for r in by[1])
    assert all(r.component_id is None and r.kept for r in by[None])
    assert by[2][0].n_shingles == by[3][0].n_shingles == by[4][0].n_shingles == 0 and by[4][0].kept
    assert by[6][0].component_id == 5 and not by[6][0].kept
    assert by[8][0].component_id == 7 and not by[8][0].kept and by[7][0].n_shingles == 977
    kept = minhash.drop_near_duplicates(messy)
    assert kept.columns == messy.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, None, 4, 5, 7, 9, 10}


def test_one_id_with_two_texts_ties_their_groups(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    docs = spark.createDataFrame([(5, a), (5, b), (9, b), (3, "z z z z z q"), (7, a)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()} == {(5, 5), (9, 5), (3, 3), (7, 5)}


def test_empty(no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.drop_near_duplicates(no_docs).count() == 0


def test_sql(spark, sf_dir):
    from tests.comparing import connection, rows_of, rows_of_sql

    assert rows_of(minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85, 100)) == rows_of_sql(connection(sf_dir), minhash.oracle())


def test_a_repeated_doc_id_may_have_a_blank_text(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (2, text + " more"), (2, "  "), (2, None), (3, text + " other"), (3, ""), (4, "alone here")]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80, 100).collect()}
    want = brute([(i, t) for i, t in rows if t and t.strip()], 80, 100)
    assert len(got) == 6 and all(got[i, n][0] == want[i] for i, n in got if n)


def thue(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_collide_modulo_powers_of_two_are_unlike(spark):
    """The Thue-Morse word and its complement have equal polynomials modulo 2^64, whatever the base."""
    rows = [(i, thue(n, *letters)) for i, (n, letters) in enumerate((n, x) for n in (1024, 2048, 4096) for x in ("ab", "ba"))]
    rows += [(10, thue(2048) + " one two three four"), (11, thue(2048, "b", "a") + " one two three four"), (12, thue(2048).upper() + " one two three four")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85, 100).collect()}
    assert got == brute(rows, 85, 100) and got[12] == 10 and len(set(got.values())) == 8


def test_a_key_of_many_documents_leaves_a_batch_once():
    """Near copies that share all keys: a row for each key and an edge for each other document, not a row for each key of each."""
    sign = np.arange(minhash.SYMBOLS, dtype=np.uint16).tobytes()
    ids = [7 + 3 * i for i in range(500)][::-1]
    (out,) = minhash._file([pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([sign] * 500, pa.binary())], ["id", "sign"])])
    rows = out.to_pylist()
    assert [r["id"] for r in rows if r["b"] is None] == [7] * minhash.SYMBOLS
    ties = [r for r in rows if r["b"] is not None]
    assert sorted(r["id"] for r in ties) == sorted(ids)[1:] and {r["b"] for r in ties} == {7} and len({r["key"] for r in rows}) == len(rows)


def test_bucket_rows_are_shuffled_once(spark):
    """No table of keys is joined back, which a larger one could be only by a second shuffle of all rows."""
    rows = [(k, i, None) for k in range(40) for i in range(k, 200, 40)] + [(k + 1000, 41 * k, k) for k in range(1, 4)]
    edges = C.star_edges(spark.createDataFrame(rows, "key long, id long, b long"))
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {(r.a, r.b) for r in edges.collect()} == {(i, k) for k, i, b in rows if b is None and i != k} | {(41 * k, k) for k in range(1, 4)}

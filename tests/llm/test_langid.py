import zlib

from quarrystone.llm import langid


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98


def plain(text):
    """Bins of the n-grams of each piece, in plain Python."""
    wrap = lambda x: x & 0xFFFFFFFF
    codes, blank = [], False
    for c in text or "":
        if c.isalpha():
            codes.append(ord(c.lower()[0]))
        elif not codes or codes[-1]:
            codes.append(0)
    if not codes or codes[-1]:
        codes.append(0)  # the end counts as a blank
    out = []
    for lo in range(0, len(codes), langid.PIECE):
        if not any(codes[lo : lo + langid.PIECE]):
            continue
        bins = set()
        for i in range(lo, min(lo + langid.PIECE, len(codes))):
            h = 0
            for n in range(1, langid.ORDERS + 1):
                if i + n > len(codes):
                    break
                h = wrap(wrap(h * 0x01000193) + wrap((codes[i + n - 1] + n) * 0x9E3779B1))
                bins.add(wrap((h ^ (h >> 15)) * 0x85EBCA6B) >> 14)
        out.append(bins)
    return out


def test_scores_equal_the_kernel_written_out():
    """N-grams, presence kernel, landmarks and ridge regression with Python sets instead of matrices."""
    import numpy as np

    texts = ["the cat sat on the mat", "a dog and the hat", "der Hund und die Katze!", "das ist ein Haus", "le chat et la souris", "une maison dans la ville"]
    labels = ["en", "en", "de", "de", "fr", "fr"]
    sets = [plain(t)[0] for t in texts]
    model = langid.solve([langid.packed(np.array(sorted(s))) for s in sets], labels, landmarks=1, ridge=1e-2)
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    order = sorted(set(labels))
    marks = [sets[labels.index(c)] for c in order]
    near, own = np.array([[kernel(a, m) for m in marks] for a in sets]), np.array([[kernel(a, m) for m in marks] for a in marks])
    y = np.array([[float(v == c) for c in order] for v in labels]) / 2
    alpha = np.linalg.solve(near.T @ near / 2 + 1e-2 * 3 * own + 1e-8 * np.eye(3), near.T @ y)
    scores, letters = model.scores(texts)
    assert letters.all() and np.allclose(scores, near @ alpha, atol=1e-4)
    long = " ".join(texts * 400)
    pieces = plain(long)
    assert len(pieces) > 5
    length = [sum(c != " " and c.isalpha() for c in _codes(long)[lo : lo + langid.PIECE]) for lo in range(0, len(_codes(long)), langid.PIECE)]
    want = np.average([[kernel(p, m) for m in marks] for p in pieces] @ alpha, axis=0, weights=length)
    assert np.allclose(model.scores([long])[0][0], want, atol=1e-4)


def _codes(text):
    import re

    return re.sub(r"[\W\d_]+", " ", text) + " "


def test_presence_equals_plain_python():
    texts = ["Ab cd", "aB, CD", None, "", "12 !", "é ÜX 日本語 😀 ß", " lead", "x" * 9000, "a" * 4095 + " b", "zz 1 zz" * 3000]
    found = langid.presence(texts)
    want = [(i, bins) for i, t in enumerate(texts) for bins in plain(t)]
    assert found.row.tolist() == [i for i, _ in want]
    assert [set(found.bins[a:b].tolist()) for a, b in zip(found.at[:-1], found.at[1:])] == [b for _, b in want]
    assert (langid.unpacked(langid.packed(found.bins[: found.at[1]])) == found.bins[: found.at[1]]).all()


def test_long_texts_keep_their_language(spark, sf_dir):
    import random

    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    by = {}
    for r in docs.where(langid.held_out()).collect():
        by.setdefault(r.lang, []).append(r.text)
    letters = random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=100_000)
    for lang, texts in by.items():
        own = " ".join(texts)
        own = (own + " ") * (1 + 1_000_000 // len(own))
        names, score = model.predict([own, own[:300_000] + "".join(letters)])
        assert names == [lang, lang] and score[0] > 0.9


def test_many_languages_are_all_learnt(spark):
    words = ["".join(chr(97 + (i * 7 + j * j * (i % 11 + 1)) % 26) for j in range(6)) for i in range(300)]
    rows = [(i * 10 + k, " ".join([w] * 5), f"l{i:03}") for i, w in enumerate(words) for k in range(2)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 300


def test_messy_rows(messy):
    got = langid.identify(messy).collect()
    assert len(got) == messy.count()
    und = [r for r in got if r.lang_pred == "und"]
    assert {r.doc_id for r in und} == {2, 3, 4, 9, None} and all(r.score == 0 for r in und)
    assert not [r for r in got if r.doc_id is None and r.held_out]
    kept = langid.drop_unidentified(messy, 0.0)
    assert kept.columns == messy.columns and {r.doc_id for r in kept.collect()} == {1, 5, 6, 7, 8, 10, None}


def test_without_anything_to_learn(spark, no_docs):
    assert langid.identify(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs).first().lang_pred == "und"

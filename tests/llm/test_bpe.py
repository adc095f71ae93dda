import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from quarrystone.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    with open(PATH) as f:
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})


def texts():
    rng = random.Random(2)
    alphabet = "aab'sStT  \n\t\r　é漢字😀½٣_-.<|endoftext|>‍́ß\x00\x0b\x85 "
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    out += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(30)) for _ in range(500)]
    return out + ["", "a" * 2000, "ab" * 5000, " " * 300, "<|endoftext|>", "word " * 50_000]


def test_ids_equal_rank_merging_and_decode_exactly(reference):
    own = bpe.Codec(open(PATH).read(), PATTERN)
    for t, ids in zip(texts(), own.encode(texts())):
        assert ids.tolist() == reference.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_offsets_cover_characters():
    own = bpe.Codec(open(PATH).read(), PATTERN)
    for text in ("a漢字😀é", "plain text", "😀😀"):
        ids = own.encode([text])[0]
        starts, ends = own.offsets(text, ids)
        raw = [own.decode(ids[i : i + 1]) for i in range(len(ids))]
        for s, e, r in zip(starts, ends, raw):
            assert r in text[s:e].encode()


def test_round_trip_of_messy_rows(messy, reference):
    got = bpe.round_trip(messy, PATH, PATTERN, with_ids=True).collect()
    want = sorted((str(r.doc_id), r.text or "") for r in messy.collect())
    assert sorted(str(r.doc_id) for r in got) == [i for i, _ in want]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in got) == sorted((i, digest(t)) for i, t in want)
    import numpy as np

    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert {r.doc_id: r.ids for r in got}[5] == reference.encode_ordinary("one two")


def test_encode_then_decode_with_split_characters(spark):
    docs = spark.createDataFrame([(1, "漢字 text"), (2, None), (3, "")], "doc_id long, text string")
    encoded = bpe.encode(docs, PATH, PATTERN)
    assert encoded.columns == ["doc_id", "ids", "starts", "ends"]
    back = {r.doc_id: r for r in bpe.decode(encoded, PATH, PATTERN).collect()}
    assert back[1].text == "漢字 text" and back[2].text == "" and bytes(back[3].decoded) == b""
    cut = encoded.where("doc_id = 1").selectExpr("doc_id", "slice(ids, 1, 1) as ids")
    part = bpe.decode(cut, PATH, PATTERN).first()
    assert "漢".encode().startswith(bytes(part.decoded)) and (part.text == "漢" or "�" in part.text)


def test_empty(no_docs):
    assert bpe.round_trip(no_docs, PATH, PATTERN).count() == 0 and bpe.encode(no_docs, PATH, PATTERN).count() == 0


def test_round_trip_has_offsets(spark):
    cases = ["a漢字😀é", "plain text", "", "word " * 500]
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    spans = {r.doc_id: r for r in bpe.encode(rows, PATH, PATTERN).collect()}
    for r in bpe.round_trip(rows, PATH, PATTERN).collect():
        raw = b"".join(x.to_bytes(4, "little") for x in [*spans[r.doc_id].starts, *spans[r.doc_id].ends])
        assert r.offsets_sha256 == hashlib.sha256(raw).hexdigest()

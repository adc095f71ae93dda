import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quarrystone.llm import merkle
from quarrystone.llm.queries import op12_merkle_manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    out = ""
    for c in merkle.FIELDS:
        v = row[c]
        if v is None:
            out += "-"
        else:
            v = str(v + more) if c == "n_chars" else str(v)
            out += f"{len(v.encode())}:{v}"
    return h(out)


def levels_of(digests, fanout):
    out = [digests]
    while len(out[-1]) > 1:
        row = out[-1]
        out.append([h(*row[i : i + fanout]) for i in range(0, len(row), fanout)])
    return out


def steps(levels, at, fanout):
    """The siblings before and after the node's own digest, level by level."""
    out = []
    for row in levels[:-1]:
        first = at // fanout * fanout
        out.append((row[first:at], row[at + 1 : first + fanout]))
        at //= fanout
    return out


def brute(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof, folded, verified) by plain loops."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {g: levels_of([leaf(r) for r in groups[g]], fanout) for g in order}
    top = levels_of([trees[g][-1][0] for g in order], fanout) if order else [[None]]
    out = []
    for place, g in enumerate(order):
        for at, r in enumerate(groups[g]):
            way = steps(trees[g], at, fanout) + steps(top, place, fanout)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            now = leaf(r, int(hit and r["n_chars"] is not None))
            for a, b in way:
                now = h(*a, now, *b)
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], h(*(x for a, b in way for x in a + b)), now, now == top[-1][0]))
    return sorted(out, key=repr)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def got(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("n", [1, 2, 7, 33, 70])
def test_trees_of_any_size_equal_plain_loops(spark, n):
    langs = [None, "en", "de", "zz", "é", ""]
    docs = spark.createDataFrame([(i * 3, f"text {i}", langs[i * i % 6 % (1 + n // 3)], None if i % 5 == 0 else "s", None if i % 4 == 0 else i) for i in range(n)], SCHEMA)
    assert got(merkle.verify_documents(docs)) == brute(rows_of(docs))


@pytest.mark.parametrize("fanout,height", [(2, 2), (3, 1), (2, 1), (4, 2)])
def test_several_rounds_and_other_fanouts(spark, fanout, height):
    docs = spark.createDataFrame([(i, f"t{i}", "en" if i % 5 else "fr", "s", i) for i in range(90)], SCHEMA)
    made = merkle.manifest(docs, fanout=fanout, height=height)
    rows = made.proofs().select(F.col("order").alias("doc_id"), "leaf", "subroot", F.lit(made.root).alias("root"), F.sha2(F.array_join(merkle.siblings(), ""), 256).alias("proof"), merkle.fold(F.col("leaf")).alias("folded")).collect()
    expected = {r[0]: r for r in brute(rows_of(docs), fanout)}
    assert len(rows) == 90
    for r in rows:
        assert tuple(r)[:5] == expected[r["doc_id"]][:5] and r["folded"] == made.root


def test_preimages_hash_to_what_their_parents_store(spark):
    docs = spark.createDataFrame([(i, "x" * i, "en", "s", i) for i in range(21)], SCHEMA)
    trees = merkle.manifest(docs, height=2).trees
    stored = {(r["level"], r["idx"]): r["preimage"] for r in trees.preimages.collect()}
    assert len(stored) == 11 + 6 + 3 + 2 + 1
    for (level, idx), text in stored.items():
        up = stored.get((level + 1, idx // 2))
        assert up is None or up[64 * (idx % 2) : 64 * (idx % 2) + 64] == h(text)


def test_messy_rows_each_get_a_proof(spark, messy):
    docs = messy.withColumn("n_chars", F.length("text").cast("long"))
    assert got(merkle.verify_documents(docs)) == brute(rows_of(docs))


def test_one_change_breaks_only_the_changed_rows_proof(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", i) for i in range(40)], SCHEMA)
    out = merkle.verify_documents(docs).collect()
    for r in out:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)
    assert any(not r["verified"] for r in out)


def test_empty_table(spark, no_docs):
    out = merkle.verify_documents(no_docs)
    assert set(NAMES) <= set(out.columns) and out.count() == 0


def test_manifest_is_written_and_read_back(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", "en" if i % 2 else None, "s", i) for i in range(9)], SCHEMA)
    made = merkle.manifest(docs)
    for _ in range(2):
        made.write(str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m/top/roots")).first()["digest"] == made.root
    assert spark.read.parquet(str(tmp_path / "m/groups/preimages")).count() == made.trees.preimages.count()


def test_query_equals_plain_loops(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(op12_merkle_manifest(spark, sf_dir)) == brute(rows_of(docs))

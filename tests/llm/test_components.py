import random

import numpy as np
import pyarrow as pa
import pytest

from quarrystone.llm import _common as C


@pytest.mark.parametrize("shape", ["chain", "star", "random", "loops"])
def test_components(spark, shape):
    rng = random.Random(1)
    ids = list(range(300))
    rng.shuffle(ids)
    edges = {"chain": list(zip(ids, ids[1:])), "star": [(ids[0], x) for x in ids[1:]], "random": [(rng.choice(ids), rng.choice(ids)) for _ in range(200)], "loops": [(1, 1), (None, 2), (3, None), (4, 5), (5, 4)]}[shape]
    up = {}
    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        ra, rb = up.setdefault(a, {a}), up.setdefault(b, {b})
        if ra is not rb:
            ra |= rb
            for x in rb:
                up[x] = ra
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(s) for x, s in up.items()}


@pytest.mark.parametrize("shape", ["chain", "hubs", "random"])
def test_components_over_several_tasks(spark, shape, monkeypatch):
    """Edges that exceed one task go through the rounds, with the same result as in one task."""
    rng = random.Random(2)
    ids = [x * 7 - 900 for x in range(400)]
    rng.shuffle(ids)
    edges = {"chain": list(zip(ids, ids[1:])), "hubs": [(ids[i % 3], x) for i, x in enumerate(ids)], "random": [(rng.choice(ids), rng.choice(ids)) for _ in range(300)]}[shape]
    table = spark.createDataFrame(edges, "a long, b long")
    one = {r.node: r.component for r in C.components(table).collect()}
    monkeypatch.setattr(C, "TASK_EDGES", 16)
    assert {r.node: r.component for r in C.components(table).collect()} == one
    forest, at = C.Forest(len(ids)), {x: i for i, x in enumerate(sorted(ids))}
    for a, b in edges:
        forest.join(at[a], at[b])
    ends = {x for e in edges if e[0] != e[1] for x in e}
    assert one == {x: sorted(ids)[forest.find(at[x])] for x in ends}


def test_few_edges_take_few_jobs(spark):
    """The driver holds plans, task binaries and metrics of every stage: edges that one task can hold take no rounds of a dozen stages."""
    ids = list(range(500))
    random.Random(3).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    spark.sparkContext.setJobGroup("few", "few edges")
    try:
        found = C.components(edges)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    assert 0 < jobs <= 8
    assert found.count() == 500 and found.where("component <> 0").isEmpty()


def test_no_edges(spark):
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_block_groups_bring_all_comparable_pairs_together(spark, block):
    rows = [(c, c * 1000 + i, i % bands) for c, n, bands in ((1, 40, 4), (2, 5, 2), (3, 1, 1)) for i in range(n)]
    dealt = C.block_groups(spark.createDataFrame(rows, "cluster long, id long, band long"), block).collect()
    groups = {}
    for r in dealt:
        groups.setdefault(r.grp, []).append(r)
    met = {}
    for members in groups.values():
        for x in members:
            for y in members:
                if x.id < y.id and (x.part == 2 or x.part != y.part):
                    met[x.id, y.id] = met.get((x.id, y.id), 0) + 1
        assert block == 1000 or len(members) <= 6 * block
    band = {i: (c, b) for c, i, b in rows}
    want = {(x, y) for x in band for y in band if x < y and band[x][0] == band[y][0] and (abs(band[x][1] - band[y][1]) <= 1 or block == 1000)}
    assert want <= set(met) and all(n == 1 for n in met.values())


def test_words_and_shingles_against_strings():
    texts = ["", None, "a", "a b", "A  b\tc\nd\x0be f", " lead trail ", "x" * 5000, "é É ü", "a b c d e f"] + [" ".join(random.Random(i).choices("abcdefgh", k=i)) for i in range(60)]
    hasher = C.ShingleHasher()
    hasher.CHUNK = 64
    seen = {}
    counts = []
    for lo, hi, data, offs in hasher.chunks(pa.array(texts)):
        flat, at = hasher.shingles(data, offs)
        for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
            counts.append(b - a)
            seen[lo + i] = set(flat[a:b].tolist())
    want = []
    for t in texts:
        w = (t or "").encode().lower().split()
        want.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    assert counts == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(seen[i] & seen[j]) == len(want[i] & want[j])


def test_grouped_joins_runs_across_batches():
    batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.arange(len(k)))], ["k", "x"]) for k in ([1, 1], [], [1, 2], [2], [3])]
    assert [(t.column("k")[0].as_py(), t.num_rows) for t in C.grouped(iter(batches), "k")] == [(1, 3), (2, 2), (3, 1)]


def test_word_hashes_are_polynomials_modulo_a_prime():
    hasher = C.ShingleHasher()
    words = ["a", "zebra", "ab" * 3000, "é漢", "x" * 70_000, "a"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    got, _ = hasher.words(data, np.array([0, len(data)]))
    p = (1 << 61) - 1
    for word, h in zip(words, got):
        raw = word.encode()
        value = sum((b + 1) * pow(C._R, i, p) for i, b in enumerate(raw)) % p
        assert int(C.mix(np.array([(value + len(raw) * int(C._GOLD)) % (1 << 64)], np.uint64))[0]) == int(h)

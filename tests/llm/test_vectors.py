import math
from fractions import Fraction

import numpy as np
import pytest

from quarrystone.llm import embed_dedup, topk
from quarrystone.llm._common import Forest
from tests.comparing import connection, rows_of, rows_of_sql

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(seed=0, dims=24):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        centre = rng.normal(size=dims)
        for spread in (0.02, 0.06, 0.25):
            rows += [(centre + rng.normal(size=dims) * spread * np.linalg.norm(centre) / math.sqrt(dims) * 3).astype(np.float32) for _ in range(12)]
        rows += [centre.astype(np.float32)] * 5
    rows += [rng.normal(size=dims).astype(np.float32) for _ in range(200)]
    order = rng.permutation(len(rows))
    return [(int(i), rows[j].tolist(), int(j % 2) if j % 17 else None) for i, j in enumerate(order)]


def links_of(rows, threshold):
    ids, good = [], []
    for i, e, l in rows:
        ok = i is not None and l is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)
        ids.append(i)
        good.append((np.array(e, np.float64) / np.linalg.norm(np.array(e, np.float64)), l) if ok else None)
    return ids, [(a, b) for a in range(len(rows)) for b in range(a) if good[a] and good[b] and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= threshold]


def expected(rows, threshold):
    ids, links = links_of(rows, threshold)
    up = {i: i for i in ids}
    count = [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        count[a] += 1
        count[b] += 1
        x, y = find(ids[a]), find(ids[b])
        up[max(x, y)] = min(x, y)
    return {i: (count[k], find(i)) for k, i in enumerate(ids)}


@pytest.mark.parametrize("block", [16, 1024])
def test_near_duplicates_equal_brute_force(spark, block):
    rows = clustered()
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.93, block).collect()}
    want = expected(rows, 0.93)
    assert sum(n for n, _ in want.values()) > 500
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())  # hashing may miss a pair in a thousand
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_unusable_and_repeated_vectors(spark):
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [(1, a, 0), (2, b, 0), (3, a, 1), (4, a, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 3.0], 0), (8, [1.0, float("nan"), 3.0], 0), (9, [1.0, float("inf"), 3.0], 0), (10, [], 0), (None, a, 0), (11, a, 0), (11, a, 0), (12, [1.0, 2.0], 0), (13, [x * 1e30 for x in a], 0)]
    wide = spark.createDataFrame([(*r, "x", "x", "x", 0, "x") for r in rows], SCHEMA + ", id string, v string, key string, component_id int, copies string")
    got = {}
    for r in embed_dedup.near_duplicates(wide).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(4, 1, True)] and got[2] == [(4, 1, False)] and got[13] == [(4, 1, False)] and got[11] == [(4, 1, False)] * 2
    assert all(got[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 9, 10, 12)) and got[None] == [(0, None, True)]
    assert embed_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hash_keys_find_close_pairs():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(2000, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    shape = embed_dedup.tables_for(50_000, 64)
    a, b = (embed_dedup.bucket_keys(v, *shape) for v in (x, 0.93 * x + math.sqrt(1 - 0.93**2) * z))
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) > 0.99


def brute_top(rows, k, every):
    exact = lambda x: math.floor(Fraction(float(np.float32(x)) if abs(x) < 1e38 else float(x)) * 1024)
    data = [(i, tuple(exact(x) for x in e)) for i, e, _ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    queries = {}
    for q, v in data:
        if q % every == 0:
            queries[q] = min(v, queries.get(q, v))
    out = []
    for q, v in queries.items():
        found = sorted(((sum(a * b for a, b in zip(v, w)), d) for d, w in data if d != q), key=lambda x: (-x[0], x[1]))[:k]
        out += [(q, r + 1, d, max(-(2**63), min(2**63 - 1, s))) for r, (s, d) in enumerate(found)]
    return sorted(out)


def top_of(spark, rows, schema=SCHEMA, k=10, every=20):
    return sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, schema), k, every).select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("small", [True, False])
def test_top_k_equals_brute_force(spark, small, monkeypatch):
    if small:
        for name, value in (("QUERIES", 3), ("SLICE", 50), ("TILE", 7), ("RINGED", 4), ("PIVOTS", 9)):
            monkeypatch.setattr(topk, name, value)
    rows = clustered(3) + [(10_000, None, 1), (10_100, [1.0, None], 1), (10_200, [float("nan")] * 24, 1), (None, [1.0] * 24, 1), (10_300, [1.0] * 3, 0), (700, clustered(3)[5][1], 1)]
    rows += [(20_000 + i, [0.5] * 24, 0) for i in range(40)]  # ties
    rows += [(20_001, [0.5] * 24, 0), (20_003, [9.0] * 24, 0), (33, [7.0] * 24, 0), (33, [7.0] * 24, 0)]  # repeated rows
    assert top_of(spark, rows) == brute_top(rows, 10, 20)


@pytest.mark.parametrize("size", [1e5, 1e9, 1e200, 1.7e308])
def test_top_k_of_large_components_is_exact(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * (size / 10 if i % 3 else 1.0)).tolist(), 0) for i in range(120)] + [(500, [size, 1.0, -1.0, 0.25, 0.0, 3.0], 0), (501, [size] * 6, 0), (502, [size, size, size, size, size, size * (1 - 2**-50)], 0)]
    assert top_of(spark, rows, "vec_id long, embedding array<double>, label int") == sorted(brute_doubles(rows, 10, 20))
    assert top_of(spark, [(0, [1e5, 1.0], 0), (1, [1e5, 1.0], 0)], "vec_id long, embedding array<double>, label int") == [(0, 1, 1, 10485760001048576)]


def brute_doubles(rows, k, every):
    data = [(i, [math.floor(Fraction(x) * 1024) for x in e]) for i, e, _ in rows]
    out = []
    for q, v in data:
        if q % every == 0:
            found = sorted(((sum(a * b for a, b in zip(v, w)), d) for d, w in data if d != q), key=lambda x: (-x[0], x[1]))[:k]
            out += [(q, r + 1, d, max(-(2**63), min(2**63 - 1, s))) for r, (s, d) in enumerate(found)]
    return out


def test_top_k_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, -1.0], 0, "c"), (5, [0.5, 0.5], 0, "c"), (7, [2.0, 1e30], 0, "c")], SCHEMA + ", cell string")
    assert [(r.rank, r.vec_id) for r in topk.top_k(few).orderBy("rank").collect()] == [(1, 5), (2, 7)]
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert topk.top_k(few.where("vec_id = 5")).count() == 0


def test_cells_leave_out_what_cannot_matter():
    pivots = np.array([[1000.0, 0.0], [0.0, 1000.0]])
    cells = topk.Cells(pivots, np.array([0]), np.array([10.0]), np.array([500_000.0]), np.array([0]), np.array([2000.0, 100.0]))
    assert cells.needed(np.array([[900.0, 0.0], [100.0, 5.0]]), np.array([0, 0]))[:, 0].tolist() == [True, False]
    assert cells.may.tolist() == [[True, False]] and cells.sizes(np.array([5, 9])).tolist() == [5]


def test_little_is_replicated_in_clustered_data(monkeypatch):
    """Counted on the summaries: clusters far apart meet only their own queries."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32)) * 2000
    x = np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 32)) * 20
    cell = topk.nearest(x, centres)
    far = np.linalg.norm(x - centres[cell], axis=1)
    reach = np.array([far[cell == c].max() for c in range(40)])
    scores = x @ x.T
    bound = np.partition(scores, -11, axis=1)[:, -11]
    rings = topk.Cells(centres, np.arange(40), reach, np.array([bound[cell == c].min() for c in range(40)]), np.arange(40), reach)
    assert rings.needed(x, cell).sum() < 3 * len(x)


def test_top_k_sql(spark, sf_dir):
    assert rows_of(topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))) == rows_of_sql(connection(sf_dir), topk.oracle())


def test_near_duplicates_sql(spark, sf_dir):
    assert rows_of(embed_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))) == rows_of_sql(connection(sf_dir), embed_dedup.oracle())


@pytest.mark.parametrize("block,usual", [(64, 0.6), (1024, 0.3), (1024, 0.5), (1024, 0.6), (1024, 0.7)])
def test_near_duplicates_in_dense_data(spark, block, usual):
    rng = np.random.default_rng(8)
    base = math.sqrt(usual) * np.ones(64) / 8 + rng.normal(size=(1500, 64)) * math.sqrt(1 - usual) / 8  # one label, usual cosines of ``usual``
    close = base[:500] + rng.normal(size=(500, 64)) * 0.33 / 8
    rows = [(int(i), v.astype(np.float32).tolist(), 0) for i, v in zip(rng.permutation(2000), np.concatenate((base, close)))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.93, block).collect()}
    want = expected(rows, 0.93)
    assert sum(n for n, _ in want.values()) > 500
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


@pytest.mark.parametrize("shape, share", [((1, 1), 1.0), ((40, 40), 0.02), ((30, 55), 0.02), ((55, 30), 0.01), ((20, 20), 0.5), ((7, 9), 0.0)])
def test_classes_of_a_block(shape, share):
    rng = np.random.default_rng(7)
    for _ in range(20):
        near = rng.random(shape) < share
        forest = Forest(sum(shape))
        for x, y in zip(*np.nonzero(near)):
            forest.join(int(x), shape[0] + int(y))
        wanted = {}
        for x in range(shape[0]):
            if near[x].any():
                wanted.setdefault(forest.find(x), (set(), set()))[0].add(x)
        for y in range(shape[1]):
            if near[:, y].any():
                wanted[forest.find(shape[0] + y)][1].add(y)
        found = [(set(r.tolist()), set(c.tolist())) for r, c in embed_dedup._classes(near)]
        assert sorted(map(repr, found)) == sorted(map(repr, wanted.values()))

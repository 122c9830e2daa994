import random

import numpy as np
import pytest

from tablecare.llm import ann, knn

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=400, dims=16, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    x = (centres[rng.integers(0, 6, n)] + 0.4 * rng.standard_normal((n, dims))).astype(np.float32)
    x[50:90] = x[40]  # copies
    x[100] = 0
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    data += [(1000, None, 1), (1001, [nan] * dims, 1), (1020, [inf] + [0.0] * (dims - 1), 1), (1021, [None] + [1.0] * (dims - 1), 1), (1022, [], 1)]
    data += [(2000, [1.0, 2.0], 1), (2001, [0.5, -1.0], 1), (3000, [1e30] * dims, 1), (3001, [-1e30] * dims, 1), (3002, [5e8] + [0.0] * (dims - 1), 1), (3020, [3e8] * dims, 1), (3003, [3.4e38] * dims, 1), (None, [1.0] * dims, 1), data[45], data[60]]
    return data


def brute(data, k, exact):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in data if i is not None and v and None not in v and np.isfinite(np.array(v, np.float32)).all()]
    if exact:
        rows = [(i, np.array([int(x) for x in np.floor(64 * v)], object)) for i, v in rows]
    else:
        rows = [(i, v) for i, v in rows if v.any()]
    out = []
    for qi in sorted({i for i, _ in rows}):
        if qi % 20 == 0:
            q = min((v for i, v in rows if i == qi), key=list)
            found = sorted(((-(int if exact else float)(q @ v), i) for i, v in rows if i != qi and len(v) == len(q)))[:k]
            out += [(qi, n + 1, i, max(-(2**63), min(2**63 - 1, -s)) if exact else -s) for n, (s, i) in enumerate(found)]
    return out


@pytest.mark.parametrize("shard,block", [(4096, 4096), (64, 5)])
def test_exact_search_equals_brute_force(spark, shard, block):
    data = vectors()
    got = knn.search(spark.createDataFrame(data, SCHEMA), 20, shard_rows=shard, block=block).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(brute(data, 20, True))


@pytest.mark.parametrize("shard,block", [(4096, 4096), (64, 5)])
def test_one_bit_search_recall_and_scores(spark, shard, block):
    data = vectors()
    got = ann.search(spark.createDataFrame(data, SCHEMA), 20, shard_rows=shard, block=block).collect()
    want = brute(data, 20, False)
    score = {(q, v): s for q, _, v, s in brute(data, 10**6, False)}
    assert all(r.score == pytest.approx(score[r.query_id, r.vec_id], rel=1e-12) for r in got)
    assert len(got) == len(want)
    hit = {(r.query_id, r.vec_id) for r in got} & {(q, v) for q, _, v, _ in want}
    assert len(hit) >= 0.95 * len({(q, v) for q, _, v, _ in want})
    for q in {r.query_id for r in got}:
        own = sorted((r.rank, -r.score, r.vec_id) for r in got if r.query_id == q)
        assert [o[0] for o in own] == list(range(1, len(own) + 1)) and [o[1:] for o in own] == sorted(o[1:] for o in own)


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in ann.search(table, 20, shard_rows=512).collect()}
    data = [(r.vec_id, r.embedding, 1) for r in table.collect()]
    want = {(q, v) for q, _, v, _ in brute(data, 20, False)}
    assert len(got & want) >= 0.99 * len(want) and len(got) == len(want)


def test_scores_near_the_ends_of_a_long(spark):
    """Scores of 2^63 less or more, told apart by single units."""
    data = [(0, [2.0**25, 1.0 / 64], 1)] + [(i, [float(2**26 + (i % 3 - 1)), float(i % 5)], 1) for i in range(1, 40)] + [(i, [-float(2**27), float(i)], 1) for i in range(41, 50)]
    got = knn.search(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), 60, shard_rows=8).collect()
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v, _ in data}
    found = sorted((-sum(a * b for a, b in zip(whole[0], v, strict=True)), i) for i, v in whole.items() if i)
    assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)] == [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in found]


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert knn.search(empty).count() == 0 and ann.search(empty).count() == 0


def test_tree_prunes_and_bounds_hold():
    rng = np.random.default_rng(0)
    x = np.floor(64 * rng.standard_normal((2000, 8)))
    tree = knn.Tree(x, np.arange(2000))
    q = np.floor(64 * rng.standard_normal((5, 8)))
    reach = tree.bounds(q)
    for leaf, part in tree.leaves.items():
        assert ((q @ part.T).max(axis=1) <= reach[:, leaf]).all() and (reach[:, leaf] <= reach[:, (leaf - 1) // 2]).all()


def test_error_bounds_hold_mostly():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((3000, 64)), rng.standard_normal((50, 64))
    centre, turn = x.mean(axis=0), ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    guess, more = ann.estimate(*ann.encode(x, centre, turn), q, centre, turn)
    error = np.abs(guess - q @ x.T)
    assert (error <= more).mean() > 0.97 and abs((guess - q @ x.T).mean()) < 0.05


def test_exact_arithmetic_for_large_components(spark):
    rng = random.Random(1)
    data = [(i, [float(rng.choice([-1, 1]) * rng.randint(2**21, 2**22)) for _ in range(40)], 1) for i in range(60)]
    got = knn.search(spark.createDataFrame(data, SCHEMA), 5, shard_rows=16).collect()
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v, _ in data]
    want = []
    for qi, q in whole:
        if qi % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in whole if i != qi)[:5]
            want += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def test_scores_below_the_least_long(spark):
    """Every product of the query lies below -2^63: the whole values still decide, in every shard."""
    rng = random.Random(5)
    data = [(0, [-1e10] * 4, 1)] + [(i, [1e10 * (1 + rng.random()) for _ in range(4)], 1) for i in range(1, 300)]
    want = None
    for shard in (4096, 64):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in knn.search(spark.createDataFrame(data, SCHEMA), 20, shard_rows=shard).collect())
        want = want or sorted(brute(data, 20, True))
        assert got == want


def test_queries_near_the_float_maximum_find_all(spark):
    data = [(0, [3.3e38] * 16, 1), (20, [-3.3e38] * 16, 1)] + [(i, [random.Random(i).gauss(0, 1) for _ in range(16)], 1) for i in range(1, 200) if i % 20]
    for shard in (4096, 32):
        got = ann.search(spark.createDataFrame(data, SCHEMA), 20, shard_rows=shard).collect()
        want = {(q, v) for q, _, v, _ in brute(data, 20, False)}
        assert len(got) == 40 and len({(r.query_id, r.vec_id) for r in got} & want) >= 38


def test_queries_together_equal_one_by_one():
    rng = np.random.default_rng(3)
    centres = 64 * 8 * rng.standard_normal((40, 3))
    x = np.floor(centres[rng.integers(0, 40, 3000)] + 64 * 0.2 * rng.standard_normal((3000, 3)))
    tree, ids = knn.Tree(x, np.arange(3000) // 2), np.arange(200)
    q, least = x[:200], np.where(np.arange(200) % 3, -np.inf, 1e5)
    assert tree.exact(q).all()
    row, got, scores = tree.search_many(q, ids, 7, least)
    together = {}
    for r, i, s in zip(row.tolist(), got.tolist(), scores.tolist(), strict=True):
        together.setdefault(r, []).append((-s, i))
    many, tree.visited = tree.visited, 0
    for i in range(200):
        one = tree.search(q[i], ids[i], tree.bounds(q[i : i + 1])[0], 7, least[i])
        assert sorted(together.get(i, [])) == sorted((-s, v) for v, s in zip(*one, strict=True))
    assert many == tree.visited < 0.7 * 200 * len(tree.leaves)

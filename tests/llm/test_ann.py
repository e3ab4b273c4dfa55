import numpy as np

from driftframe.llm import ann


def brute(ids, x, k=10, every=100):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        other = np.flatnonzero(ids != ids[i])
        best = other[np.lexsort((ids[other], d[other]))][:k]
        out[ids[i]] = [(ids[b], d[b]) for b in best]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>").selectExpr("*", "'c' as leaf", "'c' as v", "'c' as score", "'c' as rank")


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 24)).astype(np.float32).astype(float)
    ids = np.arange(3000)
    got, want = found(ann.search(frame(spark, ids, x))), brute(ids, x)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.93 * 10 * len(want)
    assert all(abs(d - np.sqrt(((x[q] - x[i]) ** 2).sum())) < 1e-12 for q, v in got.items() for i, d in v)


def test_a_third_are_copies(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 8)).astype(np.float32).astype(float)
    x[::3] = x[0]
    ids = np.arange(900)
    got, want = found(ann.search(frame(spark, ids, x))), brute(ids, x)
    for q in want:
        if q % 3 == 0:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and all(d == 0 for _, d in got[q])


def test_blocks_of_a_leaf_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((600, 6)).astype(np.float32).astype(float)
    whole = found(ann.search(frame(spark, np.arange(600), x)))
    monkeypatch.setattr(ann, "MEMBERS", 16)
    monkeypatch.setattr(ann, "QUERIES", 1)
    assert found(ann.search(frame(spark, np.arange(600), x))) == whole


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 1.0, 1.0]), (None, [1.0, 2.0]), (9, [2.0, 0.0]), (200, None), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = found(ann.search(df))
    assert got == {0: [(1, 0.0), (9, 1.0), (100, 2**0.5)], 100: [(0, 2**0.5), (1, 2**0.5), (9, 5**0.5)]}
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.filter("vec_id = 0")).count() == 0


def test_walk_visits_nearer_leaves_first():
    rng = np.random.default_rng(8)
    x, ids = rng.standard_normal((2000, 5)), np.arange(2000)
    tree = ann.Tree.grown(x, rng, 96)
    (walk,) = tree.leaves(x[3:4], tree.n_leaves)
    assert len(walk) == len(set(walk)) == tree.n_leaves and set(tree.assign(x)) <= set(walk)
    low, high = (ann.calibrate(tree, x[::10], ids[::10], x, ids, recall=r) for r in (0.5, 0.99))
    assert 1 <= low < high <= tree.n_leaves


def nearest_ids(ids, x, k, every):
    out = {}
    for i in sorted({i for i in ids if i % every == 0}):
        near = {}
        for a in np.flatnonzero(ids == i):
            for j, d in zip(ids, np.sqrt(((x - x[a]) ** 2).sum(1))):
                if j != i:
                    near[j] = min(near.get(j, np.inf), d)
        out[i] = sorted(near.items(), key=lambda n: (n[1], n[0]))[:k]
    return out


def test_repeated_rows_and_ids_take_one_place(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((60, 4)).astype(np.float32).astype(float)
    x[41:50] = x[40]
    ids = np.arange(60)
    twice = (np.concatenate([ids, ids]), np.concatenate([x, x]))  # every row twice
    often = (np.concatenate([ids, np.full(15, 40)]), np.concatenate([x, x[[40] * 15]]))  # one row of a repeated vector 16 times
    other = (np.concatenate([ids, ids[1:20], ids[1:20]]), np.concatenate([x, x[1:20] + 0.01, x[1:20] - 0.01]).astype(np.float32).astype(float))  # ids with several vectors
    for i, v in (twice, often, other):
        assert found(ann.search(frame(spark, i, v), every=10)) == nearest_ids(i, v, 10, 10)


def test_nearest_keeps_k_ids():
    rng = np.random.default_rng(13)
    x, ids = rng.standard_normal((400, 6)), rng.integers(0, 40, 400)
    q, q_id = x[:50], ids[:50]
    a, b, d = ann.nearest(q, q_id, x, ids, 10)
    for i in range(50):
        near = {}
        for j, dist in zip(ids, np.sqrt(((x - q[i]) ** 2).sum(1))):
            if j != q_id[i]:
                near[j] = min(near.get(j, np.inf), dist)
        assert list(zip(ids[b[a == i]], d[a == i])) == sorted(near.items(), key=lambda n: (n[1], n[0]))[:10]


def test_offset_far_larger_than_distances():
    """Neighbours among vectors whose norm is 1e8 times their distances."""
    rng = np.random.default_rng(14)
    x, ids = 1e6 + 0.01 * rng.standard_normal((500, 16)), np.arange(500)
    a, b, d = ann.nearest(x[:40], ids[:40], x, ids, 10)
    want = brute(ids, x, every=1)
    for i in range(40):
        assert list(zip(ids[b[a == i]], d[a == i])) == want[i]
    tree = ann.Tree.grown(x, rng, 4)
    assert len(np.unique(tree.assign(x))) > tree.n_leaves // 2
    a, b, d, _ = ann.search_block(x[:40], ids[:40], x, ids, 10, 1.0)
    for i in range(40):
        assert list(zip(ids[b[a == i]], d[a == i])) == want[i]


def test_a_block_finds_the_neighbours_at_a_fraction_of_the_candidates():
    """On vectors with and without clusters: recall of the calibrated walk, and the share of candidates it compares."""
    rng = np.random.default_rng(15)
    for centres, most in ((1, 0.5), (40, 0.1)):
        x, ids = rng.standard_normal((centres, 16))[rng.integers(0, centres, 4000)] * 5 + rng.standard_normal((4000, 16)), np.arange(4000)
        a, b, _, compared = ann.search_block(x[:100], ids[:100], x, ids, 10)
        q, near, _ = ann.nearest(x[:100], ids[:100], x, ids, 10)
        truth = set(zip(q.tolist(), near.tolist()))
        assert len(truth & set(zip(a.tolist(), b.tolist()))) >= 0.95 * len(truth)
        assert compared < most * 100 * len(x)


def test_many_blocks_under_a_top(spark, monkeypatch):
    """Leaves at the top, several blocks a leaf, and trees in each."""
    monkeypatch.setattr(ann, "MEMBERS", 400)
    monkeypatch.setattr(ann, "UNSPLIT", 64)
    rng = np.random.default_rng(16)
    x, ids = (rng.standard_normal((30, 12))[rng.integers(0, 30, 3000)] * 3 + rng.standard_normal((3000, 12))).astype(np.float32).astype(float), np.arange(3000)
    got, want = found(ann.search(frame(spark, ids, x), sample=600)), brute(ids, x)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.93 * 10 * len(want)

import random

import numpy as np
import pyarrow as pa
import pytest

from driftframe.llm import components as parts
from driftframe.llm import near_dedup
from driftframe.llm.components import components, joined, union_find


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def brute(rows):
    """Smallest id reachable for each row; rows are nodes, and equal or similar enough sets are linked."""
    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[root(i)] = min(ids.get(root(i), r[0]), r[0])
    return [(r[0], len(s), ids.get(root(i), r[0]) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]


def same(docs, rows):
    got = near_dedup.group(docs).collect()
    assert sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(str, brute(rows)))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_rows(make, odd_rows):
    same(make(odd_rows), odd_rows)


def test_one_id_with_different_texts(make):
    """Texts of one id are told apart; each joins the group it belongs to, and the smallest id names it."""
    rng = random.Random(21)
    text = lambda seed: [f"w{seed}x{rng.randrange(10**6)}" for _ in range(60)]
    a, b, c = text(1), text(2), text(3)
    rows = [(2, b), (4, a), (4, b + ["more"]), (3, c), (9, a + ["end"]), (7, c + ["end"]), (1, c + ["other", "end"])]
    rows = [(i, " ".join(w), "en", "s") for i, w in rows]
    same(make(rows), rows)


def copies(n, kind, rng):
    """Copies of one text with up to twelve words replaced, deleted, or either."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(text))
            if kind == "replaced" or (kind == "mixed" and rng.random() < 0.5):
                text[at] = f"w{rng.randrange(10**9)}"
            else:
                del text[at]
        rows.append((1000 + i, " ".join(text), "en", "s"))
    return rows


@pytest.mark.parametrize("kind", ["replaced", "mixed", "deleted"])
def test_residual_pairs_grow_with_the_group(make, monkeypatch, kind):
    """What the residual join puts out grows with the group, not with its square, and nothing is lost."""
    made = []

    def counted(*args, of=near_dedup.residual):
        out = of(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "residual", counted)
    for n in (150, 300, 600):
        made.clear()
        rows = copies(n, kind, random.Random(n))
        same(make(rows), rows)
        assert sum(made) <= n


def test_group_of_near_copies_and_chains(make):
    """Copies around one original with similarities on both sides of the bound, and chains that only pairs link."""
    rng = random.Random(6)
    fresh = lambda: f"w{rng.randrange(10**6)}"
    base = [fresh() for _ in range(150)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(text))
            if rng.random() < 0.5:
                text[at] = fresh()
            else:
                del text[at]
        rows.append((1000 - i, " ".join(text), "en", "s"))
    link = [fresh() for _ in range(200)]
    for i in range(8):
        rows.append((2000 + i, " ".join(link), "en", "s"))
        for _ in range(4):
            link[rng.randrange(len(link))] = fresh()
    same(make(rows), rows)


def test_shuffled_joins_change_nothing(spark, make, odd_rows, monkeypatch):
    """Beyond the bound of its broadcasts."""
    monkeypatch.setattr(near_dedup, "MAX_BROADCAST", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        same(make(odd_rows), odd_rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for n in (5, 40, 400):
        for share in (0.5, 0.9):
            both = int(n * share)
            for _ in range(30):
                x = np.unique(rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64))
                a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:both], x[n:]]))
                sig = near_dedup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                assert (sig != near_dedup._EMPTY).all()
                errors.append((sig[0] == sig[1]).mean() - both / len(x))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045


def test_signature_does_not_depend_on_company():
    (_, elements, first), *_ = near_dedup.shingle_sets(pa.array(["a b c d e f", "", "g h", "a b c d e f"]))
    both, alone = near_dedup.signatures(elements, first), near_dedup.signatures(elements[: first[1]], first[:2])
    assert (both[0] == alone[0]).all() and (both[0] == both[3]).all() and (both[1] == near_dedup._EMPTY).all()


@pytest.mark.parametrize("per_task", [10_000, 37])
def test_components(spark, monkeypatch, per_task):
    monkeypatch.setattr(parts, "PER_TASK", per_task)
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(600, i) for i in range(601, 700)]
    want = {a: b for a, b in union_find(iter(edges)).items() if a != b}
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == want
    more = [(rng.randrange(800), rng.randrange(800)) for _ in range(60)]
    want = {a: b for a, b in union_find(iter(edges + more)).items() if a != b}
    after = joined(components(spark.createDataFrame(edges, "a long, b long")), spark.createDataFrame(more, "a long, b long"))
    assert {r["a"]: r["b"] for r in after.collect()} == want


def test_keep_one(make, odd_rows):
    docs = make(odd_rows)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.select("doc_id", "text").collect()
    assert len(rows) == len(set(rows)) == near_dedup.group(docs).filter("kept").select("doc_id", "text_key").distinct().count()


def test_empty(make):
    assert near_dedup.group(make([])).count() == 0 and near_dedup.keep_one(make([])).count() == 0

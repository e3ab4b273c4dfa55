import hashlib
import random
from collections import defaultdict

from driftframe.llm import substring_dedup as dedup


def brute(texts, size=35):
    words = [(t or "").encode().split() for t in texts]
    starts = defaultdict(list)
    for d, w in enumerate(words):
        for i in range(len(w) - size + 1):
            starts[tuple(w[i : i + size])].append((d, i))
    gone = [set() for _ in words]
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                gone[d] |= set(range(i, i + size))
    return [(len(w), len(g), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in g)).hexdigest()) for w, g in zip(words, gone)]


def same(docs, rows):
    got = sorted(tuple(str(r[c]) for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in dedup.deduplicate(docs, digest=True).collect())
    want = sorted((str(r[0]), *map(str, b)) for r, b in zip(rows, brute([r[1] for r in rows])))
    assert got == want


def test_cover_aligns_every_difference():
    gaps = {(a - b) % dedup.PERIOD for a in dedup.COVER for b in dedup.COVER}
    assert gaps == set(range(dedup.PERIOD)) and dedup.ANCHOR + dedup.PERIOD - 1 <= dedup.SIZE


def test_odd_rows(make, odd_rows):
    same(make(odd_rows), odd_rows)


def test_planted_passages_at_all_offsets(make):
    rng = random.Random(2)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(60):
        passage = fresh(rng.choice([33, 34, 35, 36, 50, 80]))
        for j in range(2):
            rows.append((2 * i + j, " ".join([*fresh(rng.randint(0, 60)), *passage, *fresh(rng.randint(0, 60))]), "en", "s"))
    loop = " ".join(fresh(7) * 30)
    rows += [(500, loop, "en", "s"), (501, "\t".join(fresh(40)) + "\n" + loop, "en", "s"), (502, "one " * 100, "en", "s"), (503, "one " * 35, "en", "s"), (504, "one " * 34, "en", "s")]
    same(make(rows).repartition(5), rows)


def test_kept_text(make):
    out = {r["doc_id"]: r for r in dedup.deduplicate(make([(1, "a  b\n" + "x " * 40 + "c", "en", "s"), (2, None, None, None)])).collect()}
    assert out[1]["kept"] == "a b c" and out[2]["kept"] == ""


def test_empty(make):
    assert dedup.deduplicate(make([]), digest=True).count() == 0


def test_hot_passages_are_carried_a_few_times_a_task_and_small_tables_change_nothing(make, monkeypatch):
    """The places of a common passage reach the count once or twice a task, whatever the number of blocks; hashes displaced from
    the table are sent again and found all the same."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(35)
    texts = [" ".join([*fresh(40), *(passage if i % 3 == 0 else fresh(35)), *fresh(20)]) for i in range(300)]
    batches = [pa.record_batch([pa.array([i], pa.int64()), pa.array([t]), pa.array([[40]], pa.list_(pa.int32()))], ["key", "text", "places"]) for i, t in enumerate(texts)]
    for seen, most in ((dedup.SEEN, 2), (1, 100)):
        monkeypatch.setattr(dedup, "SEEN", seen)
        out = pa.Table.from_batches(dedup._windows(iter(batches)))
        place = out["tail"].to_numpy().view(np.uint64) & np.uint64(dedup._MANY - 1)
        mine = (place == 40) & (out["key"].to_numpy() % 3 == 0)
        codes, n = np.unique(out["code"].to_numpy()[mine], return_counts=True)
        assert mine.sum() == 100 and n.max() <= most and (seen == 1 or len(codes) == 99)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    same(make(rows).coalesce(1), rows)

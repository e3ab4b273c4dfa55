import hashlib
import re

from driftframe.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, bench, size=8):
    own, hit, items = words(text), set(), set()
    for item, passage in bench:
        seq = words(passage)
        k = min(size, len(seq))
        for i in range(len(seq) - k + 1 if seq else 0):
            for j in range(len(own) - k + 1):
                if own[j : j + k] == seq[i : i + k]:
                    hit |= set(range(j, j + k))
                    if item is not None:
                        items.add(item)
    ids = ",".join(sorted(map(str, items)))
    return len(own), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), len(items) >= 2


def cases(odd_rows):
    t = {i: x for i, x, _, _ in odd_rows}
    bench = [(1, " ".join(t[7].split()[:12])), (2, t[3].upper()), (10, "same, id; of the TEXT another"), (11, "ß É"), (3, None), (4, " ,"), (None, " ".join(t[300].split()[50:70])), (5, " ".join(t[300].split()[55:75])), (5, "kan lo"), (6, "x" * 30000)]
    return bench


def test_against_brute_force(spark, make, odd_rows):
    bench = cases(odd_rows)
    frame = spark.createDataFrame(bench, "item_id bigint, text string").selectExpr("*", "'c' as gram", "'c' as row", "'c' as n_words")
    for limit in (decontaminate.MAX_BROADCAST, 0):
        found = decontaminate.hits(make(odd_rows), frame, max_broadcast=limit)
        assert found.count() == len(odd_rows)
    near, far = (sorted((str(r["doc_id"]), r["n_words"], sorted(map(tuple, r["spans"])), sorted(r["items"])) for r in decontaminate.hits(make(odd_rows), frame, max_broadcast=limit).collect()) for limit in (decontaminate.MAX_BROADCAST, 0))
    assert near == far and any(s for _, _, s, _ in near)
    got = decontaminate.report(make(odd_rows), frame).collect()
    want = sorted((str(i), *map(str, brute(t, bench))) for i, t, _, _ in odd_rows)
    assert sorted(tuple(str(r[c]) for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got) == want


def test_clean(spark, make):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "a b c d e f g h i")], "item_id bigint, text string")
    rows = [
        (1, "Start, One two-three FOUR five six seven eight nine. End here", "en", "s"), (2, "untouched; text", "en", "s"), (3, None, None, None), (4, "one two three four five six seven eight, a b c d e f g h", "en", "s"),
        (5, "(é) a b c d e f g h z", "en", "s"), (2, "untouched; text", "en", "s"),
    ]
    docs = make(rows)
    got = decontaminate.clean(docs, bench)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()), key=str) == sorted([(1, "Start, End here", 15), (2, "untouched; text", 15), (2, "untouched; text", 15), (3, None, None), (5, "(é) z", 5)], key=str)


def test_empty(spark, make, odd_rows):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.report(make([]), none).count() == 0
    assert all(r["n_hit"] == 0 and not r["contaminated"] for r in decontaminate.report(make(odd_rows), none).collect())

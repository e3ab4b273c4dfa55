import zlib

import numpy as np
import pyarrow as pa

from driftframe.llm import quality
from driftframe.llm.blocks import blocks

SF = "/root/testdata/sf0.01"


def test_statistics_of_one_text():
    (b,) = blocks(pa.array(["Aa bb\nbb ## 12\nAa bb", "", "x"]))
    s = dict(zip(quality.STATISTICS, quality.statistics(b)[0]))
    assert abs(s["log_words"] - np.log(8)) < 1e-9 and abs(s["word_length"] - 2) < 1e-9 and abs(s["distinct_words"] - 4 / 7) < 1e-9 and abs(s["top_word"] - 3 / 7) < 1e-9
    assert abs(s["upper"] - 2 / 14) < 1e-9 and abs(s["symbols"] - 2 / 14) < 1e-9 and abs(s["digits"] - 2 / 14) < 1e-9 and abs(s["repeated_lines"] - 1 / 3) < 1e-9
    assert (quality.statistics(b)[1] == 0).all()


def test_statistics_do_not_depend_on_blocks():
    texts = pa.array([" ".join(f"w{i % 7}" for i in range(n)) + "\nline\nline" for n in (3, 50, 0, 400)])
    whole = np.concatenate([quality.statistics(b) for b in blocks(texts)])
    assert np.allclose(whole, np.concatenate([quality.statistics(b) for b in blocks(texts, block_bytes=1)]))


def test_rules_fit_and_compile(spark):
    rng = np.random.default_rng(2)
    x = rng.random((2000, len(quality.STATISTICS)))
    y = ((x[:, 8] < 0.3) & (x[:, 2] > 0.4)).astype(float)
    model = quality.fit(x[:1500], y[:1500])
    p = 1 / (1 + np.exp(-(quality._holds(x[1500:], model.rules) @ model.weights + model.base)))
    assert ((p >= 0.5) == y[1500:]).mean() > 0.97 and 0 < len(model.rules) < 300
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[1500:1600]], ", ".join(f"{s} double" for s in quality.STATISTICS))
    assert np.allclose([r[0] for r in df.select(quality.compiled(model)).collect()], p[:100])


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    out = [r["predicted"] == r["quality"] for r in rows if r["held_out"]]
    assert sum(out) / len(out) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality")
    get = lambda l: {r["doc_id"]: r["score"] for r in quality.score(docs.limit(200), l).collect()}
    assert get(labels) == get(flipped)


def test_odd_rows(spark, make, odd_rows):
    docs = make(odd_rows)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(None, 1, 1), (5, None, 0)], "doc_id bigint, quality int, text int")
    rows = quality.score(docs, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["score"] == 0.5 for r in quality.score(docs, labels.limit(0)).collect())
    assert len({r["score"] for r in quality.score(docs, labels.filter("quality = 1")).collect()}) == 1
    assert quality.score(make([]), labels).count() == 0


def plain_statistics(text):
    """Each of ``STATISTICS`` of one text, word by word."""
    import math
    from collections import Counter

    raw = (text or "").encode()
    lines = [w for w in (line.split() for line in raw.split(b"\n")) if w]
    words = [w for line in lines for w in line]
    if not words:
        return [0.0] * len(quality.STATISTICS)
    data, count = b"".join(words), Counter(words)
    share = lambda test: sum(map(test, data)) / len(data)
    per = lambda test: sum(map(test, words)) / len(words)
    among = lambda chars: share(lambda c: c < 128 and chr(c) in chars)
    return [
        math.log1p(len(words)), len(data) / len(words), len(count) / len(words), max(count.values()) / len(words), per(lambda w: len(w) <= 3), per(lambda w: len(w) >= 15),
        share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), among("#$%&*@^~<>{}[]\\=+_/"), among(".,;:"), among("!?"), among("|"), share(lambda c: c >= 128),
        math.log1p(len(words) / len(lines)), 1 - len(set(map(tuple, lines))) / len(lines),
    ]


def test_whole_result_against_rules_read_one_by_one(spark):
    import math
    import zlib

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    odd = [(10**9, None), (10**9 + 1, ""), (10**9 + 2, " \n\t\n"), (10**9 + 3, "É\n\na b\na b\n|!? #x 12\n" * 3)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    model = quality.learn(docs, labels)
    want = {}
    for r in docs.collect():
        x, total = plain_statistics(r["text"]), model.base
        for rule, weight in zip(model.rules, model.weights):
            total += weight if all((x[f] > cut) == above for f, above, cut in rule) else 0
        want[r["doc_id"]] = (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1, 1 / (1 + math.exp(-total)), x)
    got = quality.score(docs, labels).collect()
    assert len(got) == len(want) and model.rules
    for r in got:
        held_out, score, x = want[r["doc_id"]]
        assert all(abs(r[s] - v) < 1e-9 for s, v in zip(quality.STATISTICS, x)), (r["doc_id"], x)
        assert r["held_out"] == held_out and abs(r["score"] - score) < 1e-9 and r["predicted"] == (r["score"] >= 0.5)

import random

import corpus_pipeline
from test_near_dedup import brute

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "mixing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.cut(stage(spark, before, SF))
        assert after.columns == columns and after.schema.simpleString() == docs.schema.simpleString()
        if name == "language":
            assert after.count() == before.count()
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in after.collect()} == {c for _, _, c in brute(rows)}
        if name == "decontamination":
            from driftframe.llm import decontaminate

            found = decontaminate.report(after, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert found.filter("contaminated").count() == 0
            clean = decontaminate.report(before, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("n_hit = 0").count()
            assert after.join(before, ["doc_id", "text"], "left_semi").count() == clean
        if name == "secrets":
            from driftframe.llm import secret_scan

            assert after.count() == before.count() and secret_scan.report(after).filter("spans <> ''").count() == 0
        before = after
    final = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert set(columns) <= set(final.columns) and final.filter("copies < 1").count() == 0


def test_run_agrees_with_its_stages_and_itself(spark):
    a, b = (sorted(map(str, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert a == b and len(a) > 50


def test_odd_documents(spark, make, odd_rows):
    docs = make([*odd_rows, (903, "token = abcdefghijkl", "en", "s")])
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, SF))
    assert docs.count() > 10
    empty = make([]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.cut(stage(spark, empty, SF))
    assert empty.count() == 0


def kept_by_brute_force(rows, size=5, least=80):
    """The smallest id of each group of texts whose sets of ``size`` words are similar enough."""
    split = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in (split(t) for _, t, *_ in rows)]
    kept = [r[0] for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                low, high = sorted((kept[i], kept[j]))
                kept = [low if k == high else k for k in kept]
    return set(kept)


def test_near_copies_share_four_fifths_of_five_words(spark, make):
    rng = random.Random(51)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    block, scattered, base = fresh(200), fresh(200), fresh(180)
    changed = list(scattered)
    for at in (20, 60, 100, 140, 180):
        changed[at] = "changed"
    rows = [(1, block), (2, block + fresh(42)), (3, scattered), (4, changed), (5, base)]
    for i in range(40):  # similarities on both sides of the bound
        copy = list(base)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(len(copy))] = "changed"
        rows.append((100 + i, copy + fresh(rng.randint(0, 30))))
    rows = [(i, " ".join(w), "en", "s") for i, w in rows]
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, make(rows), SF).collect()}
    assert got == kept_by_brute_force(rows) and {1, 3, 4} <= got and 2 not in got
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    assert got == kept_by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_texts_in_no_learned_language_go(spark, make):
    """Texts in languages that no label names, and keyboard noise, go; the labelled ones stay."""
    odd = [
        "zażółć gęślą jaźń i wszystkie polskie znaki w jednym zdaniu które jest dość długie żeby można było je rozpoznać bez żadnych wątpliwości nawet gdy czyta je ktoś kto nie mówi po polsku",
        "добрый день всем и добро пожаловать в наш дом сегодня вечером мы будем рады видеть вас здесь за большим столом где уже стоят чай хлеб и варенье для всех наших гостей а потом споём старые песни",
        "hyvää päivää kaikille suomalaisille ja tervetuloa meidän kotiimme tänään illalla kun sytytämme kynttilät ja luemme yhdessä kirjoja joita olemme lainanneet kirjastosta viime viikolla ystäviemme kanssa",
        " ".join("".join(random.Random(i).choices("qwxzjkvpbhg", k=7)) for i in range(40)),
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = make([(10**9 + i, t, None, "s") for i, t in enumerate(odd)]).select(docs.columns)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(extra), SF).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_stages_with_other_columns(spark, make, odd_rows):
    """Columns whose names clash with what stages use inside, or hold dots and ticks, pass through all stages."""
    from pyspark.sql import functions as F

    names = ("count", "a.b", "c`d", "most", "hub", "own", "g", "bits0", "component_id", "gram", "row", "key2")
    docs = make([*odd_rows, (903, "token = abcdefghijkl", "en", "s")])
    docs = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names) if n not in docs.columns])
    columns = set(docs.columns)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, SF))
        assert columns <= set(docs.columns)
    assert docs.count() > 10


def test_choices_among_repeated_rows_do_not_depend_on_their_order(spark, make):
    from pyspark.sql import functions as F

    docs = make([(1, "one text of some words here", "en", "s")] * 6 + [(2, "another text of other words there", "en", "s")])
    docs = docs.withColumn("other", F.monotonically_increasing_id() % 100)
    docs = corpus_pipeline.cut(docs)
    kept = [sorted(r["other"] for r in corpus_pipeline.drop_near_copies(spark, docs.orderBy(F.col("other") * s), SF).collect()) for s in (1, -1)]
    assert kept[0] == kept[1] and len(kept[0]) == 2

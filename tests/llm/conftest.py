import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside.
CLASHES = ("size", "target", "key", "n", "row", "seq", "n_words", "kind", "spans", "items", "bucket", "node", "bands", "score", "held_out", "copies", "taken", "rank", "leaf", "v", "places", "draw", "letter")


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns beside theirs whose names clash with what operators use inside."""

    def build(rows):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], SCHEMA)
        return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])

    return build


def words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, odd white space, repeated rows, copies, a very long text."""
    rng = random.Random(4)
    pool = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("n", "s", "t", "r", "", "x")]
    base = [words(rng, rng.randint(3, 90), pool) for _ in range(40)]
    rows = [(i, t, rng.choice(["en", "de", None]), f"src{i % 4}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 5] + " " + words(rng, 3, pool), "en", "src0") for i in range(10)]
    rows += [(200, None, "en", "src1"), (201, "", "en", None), (202, " \t\n ", None, None), (None, base[0], "en", "src2"), (None, None, None, None), (203, "   ß É\x0bü\x0c1", "de", "src3")]
    rows += [(3, base[3], "en", "src3")] * 3 + [(4, "another text of the same id", "en", "src0")]
    rows += [(300, words(rng, 6000, pool), "en", "src1"), (301, "x" * 30000, "en", "src1"), (302, base[7] + "\n" + base[8] + "\n" + base[7], "en", "src2"), (303, base[7].upper(), "en", None)]
    return rows

"""Secret scan with DataFrame functions only.

Three stated patterns find assignments, access keys and long hexadecimal runs. The method adds tokens that look random:
two character Markov models, one of random strings and one of ordinary identifiers and words, are trained from labelled
samples; a token's score is the mean log-likelihood ratio of its character pairs, and what scores above the threshold for
its length, learned on ordinary samples held apart, is a finding of kind ``random`` if it touches no stated one. Nothing
else decides: random letters count as well as random digits among letters, and numbers without letters are ordinary.

Spark returns the matches of a pattern without their places. Splitting the text by the same pattern gives the gaps
between them, and a running sum of gap and match lengths gives the places. One row a match, and a marker row for each
document, is shuffled by document; texts are not. All of a document's rows are sorted, never gathered per corpus.

Defined results: a null or empty text has no finding; offsets count code points, ends are exclusive; repeated rows are
scanned each; the hash of no findings is that of the empty string; empty tables give empty results; other columns are
not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftframe.llm.rows import named

#: Kinds in the order in which findings at one place are listed, with pattern, group that is measured, and its least length.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("random", r"[A-Za-z0-9+/_-]{16,}", 0, 16),
)
STATED = 3
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Common words of program identifiers.
IDENTIFIER_WORDS = (
    "account active address admin amount array async batch begin buffer build cache callback channel character class client close cluster code collection "
    "column command comment commit config connection container content context control convert count create current data database date default delete "
    "description device directory document download element email enable encoding entry error event exception execute export factory field file filter "
    "format function generate get global group handler hash header height history host image import index info input insert instance integer interface "
    "internal iterator job key label language layout length level library limit line link list load local location log long manager map master match "
    "memory message method metric model module monitor name network node number object offset operation option order output package page parameter parent "
    "parse path pattern payload permission plugin point pool position prefix previous priority process product profile project property protocol proxy "
    "query queue range read record reference release remote report request resource response result root row rule schedule schema scope score search"
).split()
#: Beginnings, stems and endings of words in some European languages.
WORD_PARTS = (
    "able age ait al an and ar ation aux be con de der ding dos el ell en ent er es est eur eux ge heit hood ie in ing ion ity keit less lich ly man ment mente mit "
    "nd ness nt oi on or os ou oui qu que re ren sch ship sion st ste str ter th the tion tre un und ung ver vor wh zu zung"
).split()
LENGTHS = (16, 18, 20, 24, 32, 48)  # from each on, a threshold of its own
FALSE_SHARE, MISSED_SHARE = 2e-4, 5e-3  # of ordinary and random tokens held apart, at each length
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", ALPHABET, ALPHABET[:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62], ALPHABET[:52], ALPHABET[:26], ALPHABET[26:52])


def _ordinary(rng: random.Random, syllables: list[str]) -> str:
    """Identifiers in the usual spellings, paths, long words, numbers, dates, and runs of one character."""
    some = lambda: rng.choice(("", "", "", "s", "ed", "er", "ing", "ion", "able")).join((rng.choice(("", "", "", "re", "un", "pre", "sub", "is", "to")) + rng.choice(IDENTIFIER_WORDS), ""))
    words = [some() for _ in range(rng.randint(2, 5))]
    number = str(rng.randint(0, 9999)) if rng.random() < 0.4 else ""
    long = "".join(rng.choice(syllables if rng.random() < 0.5 else WORD_PARTS) for _ in range(rng.randint(5, 12)))
    style = rng.randrange(15)
    if style < 5:
        return ("_".join(words) if style == 0 else words[0] + "".join(w.title() for w in words[1:]) if style == 1 else "-".join(words) if style == 2 else "_".join(words).upper() if style == 3 else "/".join(words)) + number
    if style < 12:
        return (long, long, long, long, long.title(), long.upper(), "-".join((long[: len(long) // 2], long[len(long) // 2 :])))[style - 5]
    if style == 12:
        return "".join(rng.choices("0123456789", k=rng.randint(16, 40)))
    if style == 13:
        return f"{rng.randint(1970, 2035)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}{rng.choice(('/', 'T', '_', '-'))}{rng.choice(words)}-{rng.choice(words)}"
    return rng.choice(ALPHABET) * rng.randint(16, 60)


def labelled_samples(n: int = 4000, seed: int = 5) -> list[tuple[str, int]]:
    """``n`` tokens each, of at least 16 characters, with label 1 (random) or 0 (ordinary), and runs of each character (0)."""
    rng = random.Random(seed)
    syllables = [c + v + e for c in "b c d f g h k l m n p r s t v w z ch sch st tr".split() for v in "a e i o u ei au ie".split() for e in ("", "n", "r", "s", "t", "ng")]
    out: list[tuple[str, int]] = [(c * 40, 0) for c in ALPHABET] * (n // 1000)
    most = len(out) + 2 * n
    while len(out) < most:
        token = _ordinary(rng, syllables)
        if len(token) >= 16:
            out += [(token, 0), ("".join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(16, 64))), 1)]
    return out


def _codes(token: str) -> np.ndarray:
    return np.array([_CODE[c] for c in token])


_CODE = {c: i for i, c in enumerate(ALPHABET)}
Model = tuple[np.ndarray, tuple[float, ...]]


def mean_ratio(token: str, ratio: np.ndarray) -> float:
    code = _codes(token)
    return float(ratio[code[:-1], code[1:]].mean())


def train(samples: Iterable[tuple[str, int]], apart: Iterable[tuple[str, int]]) -> Model:
    """The log-likelihood ratio of each pair of characters, and for each of ``LENGTHS`` the threshold of the mean: of the samples
    ``apart`` of that length at most ``FALSE_SHARE`` of the ordinary ones lie above it, and ``MISSED_SHARE`` of the random
    ones below it, if the former leave room."""
    counts = np.full((2, len(ALPHABET), len(ALPHABET)), 0.5)
    for token, label in samples:
        code = _codes(token)
        np.add.at(counts[label], (code[:-1], code[1:]), 1)
    steps = np.log(counts / counts.sum(2, keepdims=True))
    ratio = np.round(steps[1] - steps[0], 4)
    means: list[tuple[list[float], list[float]]] = [([], []) for _ in LENGTHS]
    for token, label in apart:
        means[sum(len(token) >= n for n in LENGTHS) - 1][label].append(mean_ratio(token, ratio))
    least = lambda low, high: max(float(np.quantile(low, 1 - FALSE_SHARE)) if low else 0.0, float(np.quantile(high, MISSED_SHARE)) if high else 0.0)
    return ratio, tuple(round(least(*m), 4) for m in means)


@lru_cache
def default_model() -> Model:
    return train(labelled_samples(), labelled_samples(30_000, 6))


def is_random(token: str, model: Model) -> bool:
    """What the Spark expression computes, for one token of at least 16 characters over ``ALPHABET``."""
    ratio, thresholds = model
    return mean_ratio(token, ratio) > thresholds[sum(len(token) >= n for n in LENGTHS) - 1]


def log_ratio(token: Column, ratio: np.ndarray) -> Column:
    """The score of a token over ``ALPHABET``."""
    table = F.expr(f"cast(split('{','.join(map(str, ratio.ravel()))}', ',') as array<double>)")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    shifted = lambda a: F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a) - 1), lambda x, y: (x - 1) * len(ALPHABET) + y)
    pairs = F.element_at(F.transform(F.array(codes), shifted), 1)
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.element_at(table, p))


def looks_random(token: Column, model: Model) -> Column:
    ratio, thresholds = model
    size = F.char_length(token)
    least = F.lit(thresholds[0])
    for n, t in zip(LENGTHS[1:], thresholds[1:]):
        least = F.when(size < n, least).otherwise(t)
    return log_ratio(token, ratio) > least * (size - 1)


def _matches(kind: int, model: Model) -> Column:
    _, pattern, group, least = KINDS[kind]
    p = F.lit(pattern)
    all_ = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", p, F.lit(0)).alias("hit"), F.regexp_extract_all("text", p, F.lit(group)).alias("value"))
    good = lambda z: F.char_length(z["value"]) >= least
    if kind == STATED:
        good = lambda z: looks_random(z["hit"], model)
    rows = F.transform(F.filter(all_, lambda z: z["hit"].isNotNull()), lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.char_length(z["gap"]).alias("gap"), F.char_length(z["hit"]).alias("size"), good(z).alias("good")))
    return F.when(F.col("text").rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,nth:int,gap:int,size:int,good:boolean>>"))


def findings(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(row, doc_id, kind, start, end)``: a row a finding, ``kind`` an index into ``KINDS``, and a row with a null kind
    for each document."""
    model = model or default_model()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    marker = F.array(F.struct(F.lit(None).cast("int").alias("kind"), F.lit(0).alias("nth"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(True).alias("good")))
    each = rows.select("row", "doc_id", F.explode(F.concat(marker, *[_matches(k, model) for k in range(len(KINDS))])).alias("m")).select("row", "doc_id", "m.*")
    each = each.repartition("row")
    so_far = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).filter("good")
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    stated = lambda c: F.when(F.col("kind") < STATED, F.col(c))
    before = F.max(stated("end")).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(stated("start")).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    placed = placed.withColumn("before", before).withColumn("after", after)
    touches = (F.coalesce("before", F.lit(0)) > F.col("start")) | (F.coalesce("after", F.col("end")) < F.col("end"))
    return placed.filter(F.col("kind").isNull() | (F.col("kind") < STATED) | ~touches).select("row", "doc_id", "kind", "start", "end")


def report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``, one row a document."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    found = findings(docs, model).groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end")))).alias("all"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    stated = F.filter("all", lambda s: s["kind"] < STATED)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(said(stated).cast("binary"), 256).alias("base_sha256"), said(F.col("all")).alias("spans"))


def redact(docs: DataFrame, model: Model | None = None, mask: str = "[secret]") -> DataFrame:
    """``docs`` with each finding, or run of overlapping ones, replaced by ``mask``; documents without one stay as they are.
    Documents are told apart by (doc_id, text); ``n_chars``, where it is a column, follows."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    found = findings(keyed.select(F.col("_key").alias("doc_id"), "text"), model).filter("kind is not null")
    before = F.max("end").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    cuts = found.withColumn("past", F.coalesce(before, F.lit(0)))
    runs = cuts.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("past"), F.struct("past", "start")))).alias("_runs"), F.max("end").alias("_end"))
    runs = runs.groupBy(F.col("doc_id").alias("_key")).agg(F.first("_runs").alias("_runs"), F.first("_end").alias("_end"))
    out = keyed.join(runs, "_key", "left")
    kept = F.array_join(F.transform("_runs", lambda r: F.concat(F.col("text").substr((r["past"] + 1).cast("int"), (r["start"] - r["past"]).cast("int")), F.lit(mask))), "")
    rest = F.col("text").substr((F.col("_end") + 1).cast("int"), F.char_length("text"))
    out = out.withColumn("text", F.when(F.col("_runs").isNull(), F.col("text")).otherwise(F.concat(kept, rest)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_runs").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[named(c) for c in docs.columns])

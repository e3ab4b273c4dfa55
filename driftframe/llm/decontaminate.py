"""Benchmark decontamination with DataFrame functions only.

The benchmark's distinct windows of ``size`` normalised words (an item of fewer words is one window) are the
hash set. It is broadcast while its measured size stays within ``MAX_BROADCAST`` bytes. Each document is read once: its
words are cut into windows, exploded inside the scan's stage and looked up; the lookup compares the windows' text, so a
hit is verified. A marker window, which no text can hold, rides along with every document and brings its word count, so
that documents without hits need no second scan. What is shuffled is one row a document plus its hits. A larger hash set
is not broadcast: documents are numbered in a written table, windows meet the set in a shuffled join by their text, and
the hits meet the documents by number; no key there is shared by many documents but the windows themselves.

Defined results: a null or wordless text has no words, no hits and is not contaminated; repeated rows are
judged each; an item without words has no window; a null item_id marks hit words but is no item; the hash of no
items is that of the empty string; empty tables give empty or clean results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftframe.durable import cut
from driftframe.llm.rows import named

SIZE = 8
MAX_BROADCAST = 128_000_000
#: Words are runs of anything but ASCII other than letters and digits.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "".join(map(chr, range(65, 91)))
_OTHER = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_FROM, _TO = _UPPER + _OTHER, _UPPER.lower() + " " * len(_OTHER)


def words(text: Column) -> Column:
    """The normalised words of a text: A-Z lower-cased, everything that separates words dropped."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), _FROM, _TO))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " +"))


def windows(seq: Column, n: Column, size: int) -> Column:
    """Structs (at, size, gram) of all windows of ``size`` words; ``at`` counts from 0."""
    every = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.struct((i - 1).alias("at"), F.lit(size).alias("size"), F.array_join(F.slice(seq, i, size), " ").alias("gram")))
    return F.when(n >= size, every).otherwise(F.array().cast("array<struct<at:int,size:int,gram:string>>"))


def benchmark_grams(bench: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct ``(gram, gram_size, item_id)``."""
    items = bench.select("item_id", words(F.col("text")).alias("seq")).withColumn("n", F.size("seq")).filter("n > 0")
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("n").alias("size"), F.array_join("seq", " ").alias("gram")))
    each = items.select("item_id", F.explode(F.when(F.col("n") < size, whole).otherwise(windows(F.col("seq"), F.col("n"), size))).alias("w"))
    return each.select(F.col("w.gram").alias("gram"), F.col("w.size").alias("gram_size"), "item_id").distinct()


def hits(docs: DataFrame, bench: DataFrame, size: int = SIZE, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row a document: ``(row, doc_id, n_words, spans, items)``; spans are (first, end) in words, items distinct ids."""
    grams = benchmark_grams(bench, size)
    bulk = F.sum(F.octet_length("gram") + F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0)) + 32)
    seen = {r["gram_size"]: r["n"] for r in grams.groupBy("gram_size").agg(bulk.alias("n")).collect()}  # at most `size` rows
    small = sum(seen.values()) <= max_broadcast
    marker = grams.sparkSession.range(1).select(F.lit("").alias("gram"), F.lit(None).cast(grams.schema["item_id"].dataType).alias("item_id"))
    keys = grams.select("gram", "item_id")
    parts = [windows(F.col("seq"), F.col("n_words"), k) for k in sorted(seen)]
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = (rows if small else cut(rows)).select("doc_id", "row", words(F.col("text")).alias("seq")).withColumn("n_words", F.size("seq"))
    if small:
        keys = F.broadcast(keys.unionByName(marker))
        parts.insert(0, F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("size"), F.lit("").alias("gram"))))
    parts = parts or [F.array().cast("array<struct<at:int,size:int,gram:string>>")]
    each = rows.select("row", "doc_id", "n_words", F.explode(F.concat(*parts)).alias("w")).select("row", "doc_id", "n_words", "w.*")
    span = F.when(F.col("size") > 0, F.struct(F.col("at").alias("first"), (F.col("at") + F.col("size")).alias("end")))
    sets = F.collect_set(span).alias("spans"), F.collect_set("item_id").alias("items")
    if small:
        return each.join(keys, "gram").groupBy("row", "doc_id", "n_words").agg(*sets)
    found = each.select("row", "at", "size", "gram").join(keys.hint("shuffle_merge"), "gram").groupBy("row").agg(*sets)
    out = rows.select("row", "doc_id", "n_words").join(found, "row", "left")
    none = lambda c: F.coalesce(c, F.array().cast(dict(found.dtypes)[c])).alias(c)
    return out.select("row", "doc_id", "n_words", none("spans"), none("items"))


def covered(spans: Column) -> Column:
    """How many words the spans cover."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["first"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["n"])


def report(docs: DataFrame, bench: DataFrame, size: int = SIZE, min_items: int = 2) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, one row a document."""
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n = F.size("items").cast("long")
    return hits(docs, bench, size).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered(F.col("spans")).cast("long").alias("n_hit"),
        n.alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (n >= min_items).alias("contaminated"),
    )


def clean(docs: DataFrame, bench: DataFrame, size: int = SIZE, min_items: int = 2) -> DataFrame:
    """``docs`` without contaminated documents, and without the hit words of the others that have any.

    Documents are told apart by (doc_id, text). Documents without a hit stay as they are, null text included; a cut
    text loses each hit word with what separates it from the next, and ``n_chars``, where it is a column, follows.
    """
    kept = [named(c) for c in docs.columns]
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    found = hits(keyed.select(F.col("_key").alias("doc_id"), "text"), bench, size).filter(F.size("spans") > 0)
    found = found.groupBy(F.col("doc_id").alias("_key")).agg(F.first("spans").alias("_spans"), F.first("items").alias("_items"))
    out = keyed.join(found, "_key", "left").filter(F.col("_spans").isNull() | (F.size("_items") < min_items))
    pieces = F.regexp_extract_all("text", F.lit(f"({WORD}[^\\x{{80}}-\\x{{10FFFF}}0-9A-Za-z]*)"), F.lit(1))
    lead = F.regexp_extract("text", r"^[^\x{80}-\x{10FFFF}0-9A-Za-z]*", 0)
    hit = F.flatten(F.transform("_spans", lambda s: F.sequence(s["first"], s["end"] - 1)))
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_pieces") - 1), hit), lambda i: F.get("_pieces", i))
    out = out.withColumn("_pieces", F.when(F.col("_spans").isNotNull(), pieces))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(rest, "")))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*kept)

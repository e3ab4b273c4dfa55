"""Mixing sources to target weights by the cube method.

Every source gets a target number of words: its weight's share of all words, at most ``max_ratio`` times
what it has, the excess reshared by weight among the others. A document of a source with target ratio
``r = target / source_size`` is taken ``floor(r)`` times for certain and once more with inclusion
probability ``frac(r)``. The cube method decides those fractional parts: it moves the vector of
probabilities along the null space of the balancing constraints (documents and words of the source), so
that both totals stay as they were while unit after unit lands on 0 or 1. Documents much larger than the rest
of their chunk land first, among themselves; what their landing is off in words is carried by the shares of the others.

Scale: a source is split into chunks of about ``CHUNK`` documents by a hash of the row, so a source with a
third of all rows is spread like any other. A chunk's flight leaves at most ``LAST`` undecided documents, of sizes
from small to large; these meet in the next level, again in chunks, until one chunk a source is left, and only there (at
most ``LAST`` documents a source) the constraints are given up: of all landings the one nearest to the words due is taken.

Defined results: a null text has size 0; the null source is a source and comes last; a document of size 0
is taken 0 words; a source without words has target 0; repeated rows are units of their own; an empty table
gives an empty result; other columns are not read. Random numbers come from a hash of the row and the seed,
so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftframe.durable import cut, ship
from driftframe.llm.rows import named, row_hash

CHUNK = 2048
LAST = 16  # documents whose landings are all looked at
LARGE = 0.005  # of a chunk's words
REPEATS = 10_000  # equal rows that one task numbers
WORD = r"[^\x20\x09-\x0D]+"


def ranked(groups: DataFrame, by: str) -> DataFrame:
    """``groups`` with ``rank`` (from 0) in the order of ``by``, nulls last, without gathering rows in one task:
    ranges are numbered inside their partition, and partitions are offset by the rows before them."""
    n = groups.sparkSession.sparkContext.defaultParallelism
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    rows = cut(groups.repartitionByRange(n, F.col(by).asc_nulls_last()).sortWithinPartitions(F.col(by).asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.withColumn("_part", part).join(F.broadcast(counts), "_part").withColumn("rank", F.col("_before") + inside).drop("_part", "_before", "_at")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_ratio: int = 3) -> DataFrame:
    """``sizes(source, size)`` to ``(source, source_size, n_docs, target)``.

    The share ``level`` of a unit of weight rises while sources that cannot take their share are set to
    their bound; the loop ends when no further source is above its bound.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    per = cut(ranked(per, "source").withColumn("weight", F.element_at(table, (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank"))
    bound = F.col("source_size") * max_ratio
    level, bounded = 0.0, -1
    while True:
        above = (bound <= F.col("weight") * level) if bounded >= 0 else F.lit(False)
        row = per.agg(
            F.sum("source_size").alias("total"),
            F.coalesce(F.sum(F.when(above, bound)), F.lit(0)).alias("spent"),
            F.sum(F.when(~above, F.col("weight"))).alias("left"),
            F.sum(above.cast("long")).alias("n"),
        ).first()
        if not row["total"] or not row["left"] or row["n"] == bounded:
            break
        bounded, level = row["n"], (row["total"] - row["spent"]) / row["left"]
    return per.withColumn("target", F.least(bound.cast("double"), F.col("weight") * F.lit(float(level)))).drop("weight")


def flight(share: np.ndarray, size: np.ndarray, draws: np.ndarray, stop: int = 2) -> np.ndarray:
    """Move ``share`` inside the unit cube, keeping ``sum(share)`` and ``sum(share * size)``, until at most
    ``stop`` (two or more) units are not 0 or 1. Three units are in hand at a time; the null space of two constraints on three units is
    the cross product of the constraints' rows, and each step lands at least one of the three."""
    out = share.astype(float).tolist()
    size, draws = size.astype(float).tolist(), draws.tolist()
    hand: list[int] = []
    eps, at, step = 1e-9, 0, 0
    undecided = sum(eps < x < 1 - eps for x in out)
    while undecided > stop:
        while len(hand) < 3 and at < len(out):
            if eps < out[at] < 1 - eps:
                hand.append(at)
            at += 1
        if len(hand) == 3:
            a, b, c = hand
            move = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if not any(move):
                move = (1.0, -1.0, 0.0)
        elif len(hand) == 2 and size[hand[0]] == size[hand[1]]:
            move = (1.0, -1.0)
        else:
            break
        up = min(((1 - out[i]) / m if m > 0 else out[i] / -m) for i, m in zip(hand, move) if m)
        down = min((out[i] / m if m > 0 else (1 - out[i]) / -m) for i, m in zip(hand, move) if m)
        by = up if draws[step % len(draws)] * (up + down) < down else -down
        step += 1
        for i, m in zip(hand, move):
            out[i] += by * m
        rest = [i for i in hand if eps < out[i] < 1 - eps]
        if len(rest) == len(hand):  # rounding kept the unit that landed off its face
            near = min(hand, key=lambda i: min(out[i], 1 - out[i]))
            out[near] = float(round(out[near]))
            rest.remove(near)
        undecided -= len(hand) - len(rest)
        hand = rest
    return np.clip(np.where(np.abs(np.round(out) - out) < eps, np.round(out), out), 0, 1)


def land(share: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of all corners of the undecided units (at most ``LAST``) the one nearest to the words still due, then to their number."""
    share, left = share.copy(), np.flatnonzero((share > 0) & (share < 1))
    if len(left):
        corners = np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1
        words, number = np.abs(corners @ size[left] - share[left] @ size[left]), np.abs(corners.sum(1) - share[left].sum())
        share[left] = corners[np.lexsort((number, np.round(words, 6)))[0]]
    return share


def _raised(share: np.ndarray, size: np.ndarray, words: float) -> np.ndarray:
    """``share`` moved evenly inside the unit cube until it stands for ``words`` more words (or as near as it can)."""
    want, low, high = share @ size + words, -1.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.clip(share + mid, 0, 1) @ size < want else (low, mid)
    return np.clip(share + high, 0, 1)


def _spread(n: int) -> np.ndarray:
    """An order of ``n`` units that leaves ``LAST - 3``, evenly spaced among them, for the end."""
    late = np.unique(np.linspace(0, n - 1, LAST - 3).astype(int))
    return np.concatenate([np.setdiff1d(np.arange(n), late), late])


def settle(share: np.ndarray, size: np.ndarray, draws: np.ndarray, last: int = LAST) -> np.ndarray:
    """A flight that leaves at most ``last`` units undecided. Units come largest first. One much larger than the rest hardly
    moves in the null space and would stay to the end, so the large ones land among themselves first."""
    share, left = share.copy(), np.flatnonzero((share > 0) & (share < 1))
    if len(left) <= last:
        return share
    large = size[left] > max(LARGE * size[left].sum(), 2 * np.median(size[left]))
    big, rest = left[large], left[~large]
    if len(big) and len(rest) > LAST:
        landed = land(flight(share[big], size[big], draws[big], LAST), size[big])
        off, share[big] = (share[big] - landed) @ size[big], landed
        share[rest] = _raised(share[rest], size[rest], off)
        left = rest
    left = left[_spread(len(left))]
    share[left] = flight(share[left], size[left], draws[left], last)
    return share


def _ordered(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values(["size", "draw", "doc_id"], ascending=[False, True, True], kind="stable")
    draws = (pdf["draw"].to_numpy().astype(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
    return pdf, pdf["share"].to_numpy(), pdf["size"].to_numpy().astype(float), draws


def _flyer(last: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, share, size, draws = _ordered(pdf)
        return pdf.assign(share=settle(share, size, draws, last))

    return fly


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, share, size, draws = _ordered(pdf)
    return pdf.assign(share=land(settle(share, size, draws), size))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_ratio: int = 3, seed: int = 7, chunk: int = CHUNK) -> DataFrame:
    """``docs(doc_id, text, source)`` to ``(doc_id, source, text_key, size, source_size, target, copies, taken)``; ``text_key``
    is a hash of the text."""
    ship(docs.sparkSession)
    row = ["doc_id", "source", "text_key", "size"]
    sizes = docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    repeats = sizes.groupBy(*row).agg(F.count("*").alias("n"))  # numbered, so that equal rows draw apart
    runs = repeats.select(*row, "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(REPEATS).cast("long"))).alias("at")).repartition("doc_id", "text_key", "at")
    sizes = runs.select(*row, F.explode(F.sequence("at", F.least(F.col("n"), F.col("at") + REPEATS - 1))).alias("nth"))
    sizes = cut(sizes.select(*row, F.xxhash64(F.lit(seed), *row, "nth").alias("draw")))
    targets = cut(source_targets(sizes, weights, max_ratio))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.struct(F.col("source").isNull().alias("null"), F.coalesce("source", F.lit("")).alias("name"))
    sizes, targets = sizes.withColumn("key", key), targets.withColumn("key", key).drop("source")
    units = (
        sizes.join(targets, "key")
        .withColumn("whole", F.floor(ratio + 1e-9))
        .withColumn("share", F.when(F.col("size") > 0, F.greatest(ratio - F.col("whole"), F.lit(0.0))).otherwise(0.0))
        .withColumn("chunk", F.pmod(F.col("draw"), F.ceil(F.col("n_docs") / chunk)))
        .select(*row, "source_size", "target", "draw", "whole", "share", "chunk")
    )
    schema = units.schema
    open_ = (F.col("share") > 0) & (F.col("share") < 1)
    done, todo = units.filter(~open_), units.filter(open_)
    while True:
        flown = cut(todo.groupBy("source", "chunk").applyInPandas(_flyer(max(2, min(LAST, chunk // 4))), schema))
        done, left = done.unionByName(flown.filter(~open_)), flown.filter(open_)
        most = left.groupBy("source").count().agg(F.max("count")).first()[0]
        if (most or 0) <= chunk:
            break
        counts = left.groupBy("source").agg(F.ceil(F.count("*") / chunk).alias("parts"))
        todo = left.join(counts, left["source"].eqNullSafe(counts["source"])).drop(counts["source"]).withColumn("chunk", F.pmod(F.shiftright("draw", 17), "parts")).select(*schema.names)
    done = done.unionByName(left.groupBy("source").applyInPandas(_land, schema))
    copies = (F.col("whole") + F.round("share")).cast("long")
    return done.select(*row, F.col("source_size").cast("long").alias("source_size"), "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The rows of ``docs`` that the mix takes at least once, all columns, with ``copies``, ``taken`` and ``target`` (in place of
    columns of these names). Rows equal in doc_id, source and text share their copies: those that come first by a hash of
    their other columns get the larger number. Only rows of such groups that get different numbers are numbered."""
    key = lambda text_key: F.struct("doc_id", "source", text_key.alias("text_key")).alias("_row")
    mine = mix(docs, **options).select(key(F.col("text_key")), "size", "copies", "target")
    most = mine.groupBy("_row").agg(F.max("copies").alias("_high"), F.min("copies").alias("_low"), (F.sum("copies") - F.count("*") * F.min("copies")).alias("_more"), F.first("size").alias("_size"), F.first("target").alias("_target"))
    rest = [c for c in docs.columns if c not in ("copies", "taken", "target")]
    own = docs.select(*[named(c) for c in rest], row_hash(docs).alias("_hash")).withColumn("_row", key(F.xxhash64("text"))).join(most, "_row")
    alike = own.filter("_high = _low").withColumn("_copies", F.col("_low"))
    nth = F.row_number().over(Window.partitionBy("_row").orderBy("_hash"))
    apart = own.filter("_high != _low").withColumn("_nth", nth).withColumn("_copies", F.when(F.col("_nth") <= F.col("_more"), F.col("_high")).otherwise(F.col("_low"))).drop("_nth")
    out = alike.unionByName(apart).filter("_copies > 0")
    return out.select(*[named(c) for c in rest], F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))

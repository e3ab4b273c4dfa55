"""Connected components of a graph given as an edge table.

Edges are dealt to tasks of at most ``PER_TASK``; each runs union-find over its own, which leaves a forest of stars. If that
was one task, it is done. Else stars are merged by alternating large-star and small-star rounds, which are joins and partial aggregates over the remaining edges, until a
round changes nothing. No node's neighbours are gathered in one place, so a hub with very many links is spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.durable import cut, ship


PER_TASK = 10_000


def union_find(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node's smallest connected node."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.setdefault(top, top)) != top:
            top = y
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = (p for batch in batches for p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    stars = [(a, b) for a, b in union_find(pairs).items() if a != b]
    yield pa.record_batch([pa.array([a for a, _ in stars], pa.int64()), pa.array([b for _, b in stars], pa.int64())], ["a", "b"])


def _down(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _down(moved.unionByName(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` to ``(a, b)``: each node that is not the smallest of its component, and that smallest one."""
    ship(edges.sparkSession)
    tasks = -(-edges.count() // PER_TASK) or 1
    now = cut(edges.repartition(tasks).mapInArrow(_forest, "a long, b long"))
    if tasks == 1:
        return now
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    before = None
    while (state := now.agg(F.count("*"), mark).first()) != before:
        before, now = state, cut(_small_star(_large_star(now)))
    return now


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """The components ``labels`` after further edges ``more``: only these edges' ends, as components, are looked at again."""
    root = lambda side: labels.select(F.col("a").alias(side), F.col("b").alias(f"{side}_root"))
    ends = more.join(root("a"), "a", "left").join(root("b"), "b", "left")
    lifted = components(cut(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))))
    moved = labels.join(lifted.select(F.col("a").alias("b"), F.col("b").alias("top")), "b", "left")
    return cut(moved.select("a", F.coalesce("top", "b").alias("b")).unionByName(lifted))

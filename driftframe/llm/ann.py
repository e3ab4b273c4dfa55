"""Nearest neighbours with a hierarchical k-means tree and best-bin-first search.

The tree has two parts, so that its leaves stay small at any number of vectors. Its top is grown on the driver from a bounded
sample (``SAMPLE`` vectors, those with the smallest hash), with as many leaves as there are blocks of ``MEMBERS`` vectors, at
most ``SAMPLE / TOP``. Every vector of the table is dealt to a leaf of the top, and each leaf in blocks of about ``MEMBERS``.
Below, each block grows the rest of the tree over all its vectors, down to leaves of ``LEAF``, in the task that searches it.

A query walks the top, and then each block of the leaves it visits there, with a priority queue: always opening the node whose
centre is nearest, and visiting leaves in that order. How many leaves it visits is calibrated: visits are widened until probes
find ``RECALL`` of their true neighbours, as brute force tells them. At the top the probes come from the part of the sample that
the tree was not grown from; in a block they are the first of its queries.

A block returns at most ``k`` ids a query, each at its smallest distance. Distances are computed in double precision on the
original vectors; what only ranks candidates is computed around a common centre, and everything within its rounding error of
the k-th is computed exactly.

Repeated rows are dropped first. Of vectors that are equal in every component, only the ``k + 1`` with the smallest ids can
then ever be among ``k`` neighbours (ties go to the smaller id), so the others are counted as found and not carried along;
that is exact.

Defined results: vectors that are null, empty, zero, or hold a null or a value that is not finite take no part, nor do rows
without vec_id, nor vectors of another length than the commonest (the longer one in a tie); a query among few vectors gets
all others; an empty table gives an empty result; repeated rows count once; rows of one vec_id with different vectors are
different candidates, of which a query gets the nearest, and none is returned for its own id; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftframe.durable import cut, ship
from driftframe.llm.sampling import smallest

K, EVERY = 10, 100
SAMPLE, BRANCHES, TOP, LEAF = 20_000, 8, 16, 4
UNSPLIT = 256  # a block with so few vectors is one leaf: its search is exact
RECALL, PROBES = 0.97, 200  # of each part
MEMBERS, QUERIES, BLOCK_PROBES = 4096, 2048, 40


@dataclass
class Tree:
    """Node i has the children ``child[i]`` (none: a leaf, numbered ``leaf[i]`` from left to right) and the centre
    ``centre[i]``, relative to ``origin``."""

    origin: np.ndarray
    child: list[list[int]] = field(default_factory=list)
    centre: list[np.ndarray] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    n_leaves: int = 0

    @classmethod
    def grown(cls, x: np.ndarray, rng: np.random.Generator, most: int) -> Tree:
        """A tree with at most ``most`` vectors a leaf."""
        tree = cls(x.mean(0) if len(x) else np.zeros(1))
        tree._grow(x - tree.origin, np.zeros(x.shape[1]), rng, most)
        return tree

    def _grow(self, x: np.ndarray, centre: np.ndarray, rng: np.random.Generator, most: int) -> int:
        me = len(self.child)
        self.child.append([])
        self.centre.append(centre)
        self.leaf.append(-1)
        if len(x) > most:
            centres, own = k_means(x, min(BRANCHES, -(-len(x) // most)), rng)
            used = np.flatnonzero(np.bincount(own, minlength=len(centres)))
            if len(used) > 1:
                self.child[me] = [self._grow(x[own == c], centres[c], rng, most) for c in used]
        if not self.child[me]:
            self.leaf[me], self.n_leaves = self.n_leaves, self.n_leaves + 1
        return me

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at each node the child whose centre is nearest."""
        x = x - self.origin
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.child[node]:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = _squares(x[rows], np.stack([self.centre[c] for c in self.child[node]])).argmin(1)
                todo += [(c, rows[near == k]) for k, c in enumerate(self.child[node])]
        return out

    def walks(self, q: np.ndarray) -> Iterator[Iterator[int]]:
        """For each row the leaves in best-bin-first order."""
        centres = np.stack(self.centre)
        for part in (q[i : i + 64] - self.origin for i in range(0, len(q), 64)):
            yield from (self._walk(far) for far in _squares(part, centres).tolist())

    def _walk(self, far: list[float]) -> Iterator[int]:
        queue = [(far[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.child[node]:
                yield self.leaf[node]
            for c in self.child[node]:
                heapq.heappush(queue, (far[c], c))

    def leaves(self, q: np.ndarray, most: int) -> Iterator[list[int]]:
        """For each row the first ``most`` leaves of its walk."""
        return (list(islice(walk, most)) for walk in self.walks(q))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _squares(x, centres).argmin(1)
        n = np.bincount(own, minlength=k)
        sums = (own == np.arange(k)[:, None]).astype(float) @ x
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres, _squares(x, centres).argmin(1)


def nearest(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its ``k`` nearest other ids, each by its nearest row, as (query row, row, distance)."""
    centre, eps, d = x.mean(0), np.finfo(float).eps, x.shape[1]
    q_near, x_near = q - centre, x - centre
    rough = _squares(q_near, x_near)
    rough[q_id[:, None] == x_id[None]] = np.inf
    by_id = np.argsort(x_id, kind="stable")
    begin = np.flatnonzero(np.diff(x_id[by_id], prepend=x_id[by_id[:1]] - 1))
    least = np.minimum.reduceat(rough[:, by_id], begin, axis=1) if len(begin) < len(x) else rough
    last = min(k, len(begin)) - 1
    bound = np.partition(least, last, axis=1)[:, last]
    far = np.where(np.isinf(bound), 0, np.abs(bound))
    moved = 4 * eps * max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) * np.sqrt(d)  # by taking the centre off
    slack = 8 * (d + 2) * eps * ((q_near * q_near).sum(1) + (x_near * x_near).sum(1).max()) + 4 * moved * np.sqrt(far) + moved**2
    a, b = np.nonzero((rough <= (bound + 2 * slack)[:, None]) & np.isfinite(rough))
    exact = np.sqrt(((q[a] - x[b]) ** 2).sum(1))
    order = np.lexsort((x_id[b], exact, a))
    a, b, exact = a[order], b[order], exact[order]
    if len(begin) < len(x):
        _, once = np.unique(np.stack([a, x_id[b]], 1), axis=0, return_index=True)
        once.sort()
        a, b, exact = a[once], b[once], exact[once]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], exact[keep]


def calibrate(tree: Tree, q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int = K, recall: float = RECALL) -> int:
    """The least number of leaf visits (widened by a tenth at a time) at which the probes ``q`` find ``recall`` of their
    neighbours among ``x``."""
    if tree.n_leaves < 2 or not len(q) or not len(x):
        return 1
    a, b, _ = nearest(q, q_id, x, x_id, k)
    leaf, needed = tree.assign(x), []
    asked = np.unique(a)
    for r, walk in zip(asked.tolist(), tree.walks(q[asked])):
        wanted = leaf[b[a == r]].tolist()
        due, found = set(wanted), {}
        for visits, node in enumerate(walk, 1):
            if node in due:
                found[node] = visits
                if len(found) == len(due):
                    break
        needed += [found[n] for n in wanted]
    needed, visits = np.sort(needed), 1
    while len(needed) and np.searchsorted(needed, visits, side="right") < recall * len(needed):
        visits = max(visits + 1, int(visits * 1.1))
    return min(visits, tree.n_leaves)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _assigner(shared) -> Callable:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value[0].assign(_vectors(batch.column("v")))
            yield pa.record_batch([pa.array(leaf), batch.column("vec_id"), batch.column("v")], ["leaf", "vec_id", "v"])

    return run


def _walker(shared) -> Callable:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, visits = shared.value
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                walks = list(tree.leaves(_vectors(part.column("v")), visits))
                rows = pa.array(np.repeat(np.arange(len(walks)), [len(w) for w in walks]))
                yield pa.record_batch([pa.array(np.concatenate(walks).astype(np.int64)), part.column("vec_id").take(rows), part.column("v").take(rows)], ["leaf", "query_id", "q"])

    return run


def search_block(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As ``nearest``, by a tree over the block, with how many candidates were compared in all."""
    order = np.lexsort((*x.T, x_id))  # whatever order the rows came in
    tree = Tree.grown(x[order], np.random.Generator(np.random.PCG64(43)), LEAF if len(x) > UNSPLIT else UNSPLIT)
    probes = np.argsort(q_id, kind="stable")[:BLOCK_PROBES]
    visits = calibrate(tree, q[probes], q_id[probes], x, x_id, k, recall)
    asks: dict[int, list[int]] = {}
    for row, leaves in enumerate(tree.leaves(q, visits)):
        for leaf in leaves:
            asks.setdefault(leaf, []).append(row)
    own = tree.assign(x)
    by_leaf = np.argsort(own, kind="stable")
    present, first = np.unique(own[by_leaf], return_index=True)
    parts, compared = [], 0
    for leaf, members in zip(present.tolist(), np.split(by_leaf, first[1:])):
        if leaf in asks:
            rows = np.array(asks[leaf])
            a, b, far = nearest(q[rows], q_id[rows], x[members], x_id[members], k)
            parts.append((rows[a], members[b], far))
            compared += len(rows) * len(members)
    a, b, far = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.lexsort((x_id[b], far, a))
    a, b, far = a[order], b[order], far[order]
    _, once = np.unique(np.stack([a, x_id[b]], 1), axis=0, return_index=True)
    once.sort()
    a, b, far = a[once], b[once], far[once]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], far[keep], compared


def _searcher(k: int, recall: float) -> Callable:
    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not queries.num_rows or not members.num_rows:
            return schema.empty_table()
        column = lambda t, c: t.column(c).combine_chunks()
        ids = lambda t, c: column(t, c).to_numpy(zero_copy_only=False)
        q_id, x_id = ids(queries, "query_id"), ids(members, "vec_id")
        a, b, score, _ = search_block(_vectors(column(queries, "q")), q_id, _vectors(column(members, "v")), x_id, k, recall)
        return pa.table([pa.array(q_id[a]), pa.array(x_id[b]), pa.array(score)], schema=schema)

    return run


def valid_vectors(table: DataFrame) -> DataFrame:
    """``(vec_id long, v array<double>)`` of the vectors that take part."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and size(v) > 0")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.filter(F.coalesce(finite, F.lit(False))).filter(F.exists("v", lambda c: c != 0))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (size["d"] if size else 0))


def search(table: DataFrame, k: int = K, every: int = EVERY, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """``table(vec_id, embedding)`` to ``(query_id, rank, vec_id, score)`` for the rows whose id is divisible by ``every``."""
    spark = table.sparkSession
    ship(spark)
    rows = valid_vectors(table).distinct()
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    rows_kept = cut(rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1).drop("nth"))
    picked = smallest(rows_kept, sample, ["vec_id", "v"], 29).collect()
    points = np.array([r["v"] for r in picked], float) if picked else np.zeros((0, 1))
    ids, n = np.array([r["vec_id"] for r in picked], np.int64), rows_kept.count()
    grown = max(1, len(points) * 3 // 4)
    tree = Tree.grown(points[:grown], np.random.Generator(np.random.PCG64(41)), max(TOP, -(-grown * MEMBERS // max(n, 1))))
    apart, probes = points[grown:], slice(grown, grown + PROBES)
    shared = spark.sparkContext.broadcast((tree, calibrate(tree, points[probes], ids[probes], apart, ids[grown:], k, recall)))  # at most as large as the sample

    members = cut(rows_kept.mapInArrow(_assigner(shared), "leaf long, vec_id long, v array<double>"))
    asked = rows.filter(F.col("vec_id") % every == 0)
    visits = cut(asked.mapInArrow(_walker(shared), "leaf long, query_id long, q array<double>"))
    counts = lambda t, name, size: t.groupBy("leaf").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    parts = cut(counts(members, "m_parts", MEMBERS).join(counts(visits, "q_parts", QUERIES), "leaf"))
    deal = lambda n, own: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(own)
    left = visits.join(parts, "leaf").withColumn("q_part", F.pmod(F.xxhash64("query_id", "q"), F.col("q_parts")).cast("int")).select("leaf", "q_part", deal("m_parts", "m_part"), "query_id", "q")
    right = members.join(parts, "leaf").withColumn("m_part", F.pmod(F.xxhash64("vec_id", "v"), F.col("m_parts")).cast("int")).select("leaf", deal("q_parts", "q_part"), "m_part", "vec_id", "v")
    key = ["leaf", "q_part", "m_part"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_searcher(k, recall), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # an id with several vectors counts once
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

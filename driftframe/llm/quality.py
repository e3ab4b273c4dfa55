"""Quality classifier: a sparse rule ensemble.

Statistics of each whole text (``STATISTICS``) are computed on the executors over the text's bytes. On a bounded sample of
labelled rows small boosted trees are grown; every path from a root to a node is a conjunctive rule; a logistic model
with a lasso penalty, chosen on a part of the sample held apart, keeps few of them. The kept rules become one Spark
column expression over the statistics, so scoring is a projection.

The sample holds at most ``SAMPLE`` labelled rows, those with the smallest hash, of documents and of labels; rows of the held-out third are never in
it. Labels, lang, source and doc_id are no inputs of a score.

Defined results: a null, empty or wordless text has all statistics 0 and is scored like any other; without labelled rows
every score is 0.5, and with labels of one kind only the score is their smoothed share; repeated rows are scored each;
a null doc_id counts as the empty text in the split and joins no label; empty tables give empty results; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftframe.durable import ship
from driftframe.llm.blocks import Block, blocks
from driftframe.llm.langid import held_out
from driftframe.llm.sampling import smallest

SAMPLE, TREES, DEPTH, CUTS = 8000, 30, 3, 24
STATISTICS = (
    "log_words", "word_length", "distinct_words", "top_word", "short_words", "long_words", "upper", "digits", "symbols", "stops", "marks",
    "bars", "wide", "line_words", "repeated_lines",
)
_UPPER, _DIGIT, _SYMBOL, _STOP, _MARK, _BAR, _WIDE, _LINE = range(8)
_CLASS = np.zeros((256, 8), bool)
_CLASS[65:91, _UPPER] = _CLASS[48:58, _DIGIT] = _CLASS[128:, _WIDE] = True
_CLASS[[ord(c) for c in "#$%&*@^~<>{}[]\\=+_/"], _SYMBOL] = True
_CLASS[[ord(c) for c in ".,;:"], _STOP] = _CLASS[[ord(c) for c in "!?"], _MARK] = _CLASS[ord("|"), _BAR] = _CLASS[10, _LINE] = True


def _per(codes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the largest count of one code, per document."""
    order = np.lexsort((codes, doc))
    c, d = codes[order], doc[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(c)))
    most = np.zeros(n)
    np.maximum.at(most, d[at], runs)
    return np.bincount(d[at], minlength=n), most


def statistics(b: Block) -> np.ndarray:
    """A row of ``STATISTICS`` for each document of the block."""
    n = len(b.first) - 1
    words, size = b.n_words, b.end - b.start
    w = np.maximum(words, 1)
    doc_of_word = b.doc
    inside = np.repeat(doc_of_word, size)
    offset = np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(b.start, size)
    chars = np.bincount(inside, minlength=n)
    hit = _CLASS[b.data[offset]]
    share = np.stack([np.bincount(inside, hit[:, k], n) for k in range(_LINE)], 1) / np.maximum(chars, 1)[:, None]
    sums = lambda x: np.bincount(doc_of_word, x, n)
    hashes = b.word_hashes()
    distinct, most = _per(hashes, doc_of_word, n)
    gap = np.zeros(len(b.start), bool)  # words that begin a line
    if len(b.start):
        lines = np.concatenate([[0], np.cumsum(_CLASS[b.data, _LINE])])
        gap[1:] = lines[b.start[1:]] > lines[b.end[:-1]]
        gap[b.first[:-1][words > 0]] = True
    at = np.flatnonzero(gap)
    line = np.add.reduceat(hashes * (np.arange(len(hashes), dtype=np.uint64) - np.repeat(at, np.diff(np.append(at, len(hashes)))).astype(np.uint64) + np.uint64(1)), at) if len(at) else hashes
    line_doc = doc_of_word[at]
    n_lines = np.bincount(line_doc, minlength=n)
    different, _ = _per(line, line_doc, n)
    return np.column_stack([
        np.log1p(words), chars / w, distinct / w, most / w, sums(size <= 3) / w, sums(size >= 15) / w,
        share[:, _UPPER], share[:, _DIGIT], share[:, _SYMBOL], share[:, _STOP], share[:, _MARK], share[:, _BAR], share[:, _WIDE],
        np.log1p(words / np.maximum(n_lines, 1)), 1 - different / np.maximum(n_lines, 1) - (n_lines == 0),
    ]) * (words > 0)[:, None]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [c for c in batch.schema.names if c != "text"]
        for b in blocks(batch.column("text")):
            table = statistics(b)
            yield pa.record_batch([*(batch.column(c)[b.rows] for c in keep), *(pa.array(table[:, k]) for k in range(len(STATISTICS)))], [*keep, *STATISTICS])


def measured(rows: DataFrame) -> DataFrame:
    """``rows`` with its column ``text`` replaced by the statistics."""
    ship(rows.sparkSession)
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(_measure, ", ".join([*kept, *(f"{s} double" for s in STATISTICS)]))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, cut) all of which hold


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: np.ndarray
    base: float


def _grow(x: np.ndarray, g: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, path: Rule, out: list[Rule], step: np.ndarray) -> None:
    """One regression tree on the residual ``g``; appends each node's path, adds each leaf's mean to ``step``."""
    if path:
        out.append(path)
    best = (1e-9, -1, 0.0)
    if len(path) < DEPTH and len(rows) >= 40:
        total, n = g[rows].sum(), len(rows)
        for f, own in enumerate(cuts):
            if len(own):
                bin_ = np.searchsorted(own, x[rows, f], side="left")
                s = np.bincount(bin_, g[rows], len(own) + 1).cumsum()[:-1]
                c = np.bincount(bin_, minlength=len(own) + 1).cumsum()[:-1]
                gain = np.where((c >= 10) & (n - c >= 10), s**2 / np.maximum(c, 1) + (total - s) ** 2 / np.maximum(n - c, 1) - total**2 / n, 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, float(own[k]))
    _, f, cut = best
    if f < 0:
        step[rows] += g[rows].mean() * 2 if len(rows) else 0
        return
    low = x[rows, f] <= cut
    _grow(x, g, cuts, rows[low], (*path, (f, False, cut)), out, step)
    _grow(x, g, cuts, rows[~low], (*path, (f, True, cut)), out, step)


def _holds(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for f, above, cut in rule:
            out[:, k] *= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return out


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient steps."""
    rate = 4 * len(y) / max(np.linalg.norm(np.column_stack([z, np.ones(len(y))]), 2) ** 2, 1e-9)
    w = v = np.zeros(z.shape[1] + 1)
    a = np.column_stack([z, np.ones(len(y))])
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        new = v - rate * (a.T @ (p - y)) / len(y)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        v, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Ensemble([], np.zeros(0), base)
    cuts = [np.unique(np.round(np.quantile(x[:, f], np.linspace(0.01, 0.99, CUTS)), 6)) for f in range(x.shape[1])]
    rules: list[Rule] = []
    margin = np.full(len(y), base)
    for _ in range(TREES):
        g, step = y - 1 / (1 + np.exp(-margin)), np.zeros(len(y))
        _grow(x, g, cuts, np.arange(len(y)), (), rules, step)
        margin += step
    rules = sorted(set(rules))
    z = _holds(x, rules)
    some = (z.mean(0) > 0) & (z.mean(0) < 1)
    rules, z = [r for r, s in zip(rules, some) if s], z[:, some]
    if not rules:
        return Ensemble([], np.zeros(0), base)
    apart = np.arange(len(y)) % 4 == 3

    def loss(penalty: float) -> float:
        w, c = _lasso(z[~apart], y[~apart], penalty, 150)
        m = z[apart] @ w + c
        return float(np.logaddexp(0, np.where(y[apart] > 0, -m, m)).mean())

    penalty = min((0.0003, 0.001, 0.003, 0.01), key=loss) if apart.any() and (~apart).any() else 0.001
    w, c = _lasso(z, y, penalty)
    kept = np.abs(w) > 1e-6
    return Ensemble([r for r, k in zip(rules, kept) if k], w[kept], c)


def compiled(model: Ensemble) -> Column:
    """The model's score as one column expression over the statistics."""
    total = F.lit(model.base)
    for rule, weight in zip(model.rules, model.weights):
        holds = reduce(lambda a, b: a & b, [(F.col(STATISTICS[f]) > cut) if above else (F.col(STATISTICS[f]) <= cut) for f, above, cut in rule])
        total = total + F.when(holds, F.lit(float(weight))).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Ensemble:
    """An ensemble from at most ``sample`` labelled rows that are not held out."""
    named = labels.select("doc_id", F.col(label).cast("double").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    named = smallest(named, sample, ["doc_id", "y"], 23)
    chosen = smallest(docs.select("doc_id", "text").join(named, "doc_id"), sample, ["doc_id", "y", "text"], 23)  # an id may stand in many rows
    rows = measured(chosen).toPandas().sort_values(["doc_id", "y", *STATISTICS])
    return fit(rows[list(STATISTICS)].to_numpy(float), (rows["y"].to_numpy(float) > 0).astype(float))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` and the statistics, one row a document."""
    model = learn(docs, labels, label)
    rows = measured(docs.select("doc_id", "text"))
    return rows.select("doc_id", held_out().alias("held_out"), compiled(model).alias("score"), *STATISTICS).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))

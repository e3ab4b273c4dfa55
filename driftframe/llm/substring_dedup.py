"""Removal of long passages that stand in the corpus more than once.

A window is ``size`` consecutive words of one document; each word covered by a window whose word sequence also
starts anywhere else is removed. Comparing all windows of all documents would shuffle a row a word, so windows
are found in two steps:

1. Anchors. ``ANCHOR`` words are hashed only at positions whose remainder modulo ``PERIOD`` is in the difference
   cover ``COVER``: every difference of two positions modulo the period is a difference of two of its members.
   Two equal windows contain ``PERIOD`` pairs of aligned anchors, and for one of these both positions are in the
   cover. So two equal windows always share an anchor, while 5 of 21 positions are hashed.
2. Extension. Around each anchor that occurs twice, the windows that contain it are hashed in full (96 bits) and
   counted. Only a window met twice removes its words, so a shared anchor alone removes nothing.

A hash met more than once inside a task is known to repeat: its first place, or its first two if they lie in different
blocks, stand for it in the count, the other places go on without it, each with a key of its own. So a passage that stands
in a third of all documents reaches the count once or twice a task, not once a document, and its places are dealt evenly.

Documents are told apart by a 64-bit hash of (doc_id, text); rows equal in both are copies of each other and lose
all words in windows. Places are judged on the input. Defined results: a null or wordless text, or one of fewer
words than a window, loses nothing; the hash of no kept words is that of the empty string; empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftframe.durable import cut, release, ship
from driftframe.llm.blocks import Block, blocks, mix

SIZE, ANCHOR, PERIOD = 35, 15, 21
COVER = (0, 1, 4, 14, 16)
#: ``tail`` holds the other half of the hash (32 bits), whether the hash is known to repeat (1 bit), and the place (31 bits).
_PLACES = "code long, key long, tail long"
_MANY = 1 << 31
SEEN = 1 << 19  # hashes that a task remembers
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


class _Carried:
    """Which hashes a task has sent to the count already, in a table of fixed size. A slot holds the last hash that fell on it;
    a hash that was displaced is merely sent once more, so the table saves rows and decides nothing."""

    def __init__(self) -> None:
        self.code, self.more, self.times = np.zeros(SEEN, np.uint64), np.zeros(SEEN, np.uint64), np.zeros(SEEN, np.uint8)
        self.owner = np.zeros(SEEN, np.int64)

    def again(self, code: np.ndarray, more: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct hashes: which were met before in this task, and which of these need not be sent again, because their
        repeating is known where they were sent. ``many``: they repeat in this block."""
        slot = (code % np.uint64(SEEN)).astype(np.int64)
        met = (self.times[slot] > 0) & (self.code[slot] == code) & (self.more[slot] == more)
        known = met & (self.times[slot] > 1)
        number = np.arange(len(slot))
        self.owner[slot] = number  # a slot on which several hashes of the block fall takes one of them, in all three columns
        one = np.flatnonzero(self.owner[slot] == number)
        at = slot[one]
        self.code[at], self.more[at], self.times[at] = code[one], more[one], 1 + (met | many)[one]
        return met, known


def _once(code: np.ndarray, key: np.ndarray, tail: np.ndarray, carried: _Carried, more: np.ndarray | None = None) -> pa.RecordBatch:
    """Places for the count, marked where the hash is known to repeat. Repeats inside the task keep their row, under
    a code of their own, and the first place, or the first two, carry the hash."""
    order = np.argsort(code, kind="stable") if more is None else np.lexsort((more, code))
    same = code[order][1:] == code[order][:-1]
    if more is None:
        more = np.zeros(len(code), np.uint64)
    else:
        same &= more[order][1:] == more[order][:-1]
    many, later = np.zeros(len(code), bool), np.zeros(len(code), bool)
    later[order[1:][same]] = True
    many[order[1:][same]] = many[order[:-1][same]] = True
    first = np.flatnonzero(~later)
    met, known = carried.again(code[first], more[first], many[first])
    many[first[met]] = True
    later[first[known]] = True
    out = code.copy()
    out[later] = mix(key[later] * np.uint64(3) + tail[later])
    tail = tail | (many.astype(np.uint64) << np.uint64(31))
    return pa.record_batch([out.view(np.int64), key.view(np.int64), tail.view(np.int64)], ["code", "key", "tail"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    carried = _Carried()
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for b in blocks(batch.column("text")):
            at = b.inside(ANCHOR)
            place = at - b.first[b.doc[at]]
            chosen = _IN_COVER[place % PERIOD] & (b.n_words[b.doc[at]] >= SIZE)
            at, place = at[chosen], place[chosen]
            code = b.windows(b.word_hashes(), ANCHOR)[at]
            yield _once(code, keys[b.rows][b.doc[at]], place.astype(np.uint64), carried)


def _spread(b: Block, places: pa.Array, before: int, after: int, span: int) -> np.ndarray:
    """Which words of the block lie in ``[p - before, p + after)`` of a place ``p`` of their document, among the words
    that a window of ``span`` can start at."""
    part = places.slice(b.rows.start, b.rows.stop - b.rows.start)
    counts = part.value_lengths().fill_null(0).to_numpy()
    doc = np.repeat(np.arange(len(counts)), counts)
    at = b.first[doc] + part.flatten().to_numpy().astype(np.int64)
    low, high = b.first[doc], np.maximum(b.first[doc + 1] - span + 1, b.first[doc])
    edge = np.bincount(np.clip(at - before, low, high), minlength=len(b.start) + 1) - np.bincount(np.clip(at + after, low, high), minlength=len(b.start) + 1)
    return np.cumsum(edge[:-1]) > 0


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    carried = _Carried()
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for b in blocks(batch.column("text")):
            at = np.flatnonzero(_spread(b, batch.column("places"), SIZE - ANCHOR, 1, SIZE))
            words = b.word_hashes()
            code, more = b.windows(words, SIZE)[at], b.windows(words, SIZE, 1)[at] >> np.uint64(32)
            place = (at - b.first[b.doc[at]]).astype(np.uint64)
            yield _once(code, keys[b.rows][b.doc[at]], (more << np.uint64(32)) | place, carried, more)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: words, words removed, and the kept words' text."""
    for batch in batches:
        ids = batch.column("doc_id")
        for b in blocks(batch.column("text")):
            gone = _spread(b, batch.column("places"), 0, SIZE, 1)
            removed = np.add.reduceat(np.append(gone, False), b.first[:-1]) * (b.n_words > 0) if len(b.first) > 1 else b.first[:0]
            raw, texts = b.data.tobytes(), []
            for d in range(len(b.first) - 1):
                lo, hi = b.first[d], b.first[d + 1]
                if lo == hi:
                    texts.append(b"")
                elif not removed[d]:
                    texts.append(b" ".join(raw[b.start[lo] : b.end[hi - 1]].split()))
                else:
                    keep = np.flatnonzero(~gone[lo:hi]) + lo
                    texts.append(b" ".join([raw[s:e] for s, e in zip(b.start[keep].tolist(), b.end[keep].tolist())]))
            yield pa.record_batch([ids[b.rows], pa.array(b.n_words.astype(np.int64)), pa.array(np.asarray(removed, np.int64)), pa.array([t.decode() for t in texts])], ["doc_id", "n_words", "n_removed", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for out in _kept(batches):
        sums = [hashlib.sha256(t.as_buffer()).hexdigest() for t in out.column("kept")]
        yield pa.record_batch([out.column(0), out.column(1), out.column(2), pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _repeated(places: DataFrame) -> DataFrame:
    """Places whose hash occurs twice, as one list a document. Rows are dealt by half of the hash and counted by all of it."""
    same = Window.partitionBy("code", F.shiftrightunsigned("tail", 32))
    counted = places.repartition("code").withColumn("n", F.count("*").over(same))
    counted = counted.filter((F.col("n") > 1) | (F.col("tail").bitwiseAND(_MANY) != 0))
    return counted.groupBy("key").agg(F.collect_list(F.col("tail").bitwiseAND(_MANY - 1).cast("int")).alias("places"))


def deduplicate(docs: DataFrame, digest: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_words, n_removed, kept)``, or with ``kept_sha256`` in place of the text."""
    ship(docs.sparkSession)
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    near = cut(_repeated(keyed.select("key", "text").mapInArrow(_anchors, _PLACES)))
    release(docs.sparkSession)  # the anchors are the larger part of what is shuffled, and done with
    # doc_id rides along so that both joins read one and the same exchange of the texts
    windows = keyed.join(near, "key").select("key", "doc_id", "text", "places").mapInArrow(_windows, _PLACES)
    found = _repeated(windows)
    joined = keyed.join(found, "key", "left").select("doc_id", "text", "places")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_digest if digest else _kept, f"doc_id {kind}, n_words long, n_removed long, {'kept_sha256' if digest else 'kept'} string")

"""Fuzzy search for short licence notices.

A text is reduced to its words (A-Z lower-cased, joined by one space). A notice of n characters may differ by
``k = n // 10`` edits; cut into k + 1 pieces, one piece of every such occurrence is untouched (pigeonhole). All pieces
are sought at once as exact seeds with an Aho-Corasick automaton; around each seed the regex library's bounded-error
matching verifies the whole notice, counts its edits and gives its span. Exact phrases are counted apart.

Each text is scanned whole, one at a time, on the executors; nothing is shuffled. Where seeds crowd, the text is searched in
overlapping pieces of bounded length, and places become word numbers by one look-up table, so the work grows with the text.

Defined results: a null, empty or wordless text has no label and score 0; overlapping phrases are counted each;
repeated rows are scanned each; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.durable import ship
from driftframe.llm.blocks import strings

#: Phrases whose words must stand consecutively, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Short notices, as words, with their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution", "cc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)
PIECE = 6  # lengths of a notice
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def errors(notice: str) -> int:
    return len(notice) // 10


@lru_cache
def _compiled(notices: tuple[tuple[str, str], ...]) -> tuple[ahocorasick.Automaton, list[regex.Pattern]]:
    seeds: dict[str, list[tuple[int, int]]] = {}
    for i, (notice, _) in enumerate(notices):
        edges = np.linspace(0, len(notice), errors(notice) + 2).astype(int)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            seeds.setdefault(notice[a:b], []).append((i, a))
    automaton = ahocorasick.Automaton()
    for seed, of in seeds.items():
        automaton.add_word(seed, (len(seed), of))
    automaton.make_automaton()
    return automaton, [regex.compile(f"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={errors(n)}}}") for n, _ in notices]


def _occurrences(pattern: regex.Pattern, least: int, plain: str, a: int, b: int) -> Iterator[regex.Match]:
    """The best match between ``a`` and ``b``, then those before and after it. None is shorter than ``least``."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if b - a >= least and (m := pattern.search(plain, a, b)):
            yield m
            todo += [(a, m.start()), (m.end(), b)]


def _in_pieces(pattern: regex.Pattern, size: int, slack: int, plain: str, a: int, b: int) -> Iterator[regex.Match]:
    """``_occurrences`` from left to right in pieces that overlap by as much as an occurrence can measure."""
    while a < b:
        end = min(b, a + PIECE * size)
        found = sorted(_occurrences(pattern, size - slack, plain, a, end), key=lambda m: m.start())
        yield from found
        if end == b:
            return
        a = max(end - size - slack + 1, *(m.end() for m in found[-1:]), a + 1)


def find_notices(plain: str, notices: tuple[tuple[str, str], ...] = NOTICES) -> list[tuple[int, int, int, int]]:
    """``(notice, start, end, edits)`` in characters of the reduced text, non-overlapping for each notice."""
    automaton, patterns = _compiled(notices)
    windows: dict[int, list[list[int]]] = {}
    for end, (size, of) in automaton.iter(plain):
        for i, offset in of:
            slack, start = errors(notices[i][0]), end + 1 - size - offset
            window = [max(0, start - slack), start + len(notices[i][0]) + slack]
            last = windows.setdefault(i, [])
            if last and window[0] <= last[-1][1]:
                last[-1][1] = max(last[-1][1], window[1])
            else:
                last.append(window)
    out = []
    for i, of in windows.items():
        for a, b in of:
            size = len(notices[i][0])
            out += [(i, m.start(), m.end(), sum(m.fuzzy_counts)) for m in _in_pieces(patterns[i], size, errors(notices[i][0]), plain, a, min(b, len(plain)))]
    return sorted(out, key=lambda f: (f[1], f[0]))


def scan_text(raw: bytes) -> dict:
    words = raw.translate(_TABLE).split()
    plain = b" ".join(words)
    places, labels, score, spans = [], set(), 0.0, []
    if b"license" in plain:
        framed = b" " + plain + b" "
        gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
        for phrase, label in PHRASES:
            sought, at = f" {phrase} ".encode(), -1
            while (at := framed.find(sought, at + 1)) >= 0:
                places.append(int(np.searchsorted(gaps, at)))
                labels.add(label)
                score = 1.0
    stated = sorted(labels)
    text = plain.decode()
    notices = find_notices(text)
    gaps = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32) if notices else None
    for i, start, end, edits in notices:
        notice, label = NOTICES[i]
        labels.add(label)
        score = max(score, 1 - edits / len(notice))
        spans.append({"label": label, "first_word": int(np.searchsorted(gaps, start)), "end_word": int(np.searchsorted(gaps, end)) + 1, "edits": edits})
    return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(stated), "labels": ",".join(sorted(labels)), "score": score, "spans": spans}


_FIELDS = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64())])))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan_text(x.as_buffer().to_pybytes()) for x in strings(batch.column("text"))]
        found = pa.RecordBatch.from_pylist(rows, _FIELDS)
        yield pa.record_batch([batch.column("doc_id"), *found.columns], ["doc_id", *_FIELDS.names])


def scan(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)``."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, {fields}, spans array<struct<label:string,first_word:long,end_word:long,edits:long>>")


def report(docs: DataFrame) -> DataFrame:
    """``scan`` with its spans as one string, ``label:first_word:end_word:edits`` comma-joined."""
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["first_word"].cast("string"), s["end_word"].cast("string"), s["edits"].cast("string"))), ",")
    return scan(docs).withColumn("spans", said)

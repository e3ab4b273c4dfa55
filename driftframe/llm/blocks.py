"""Words of whole texts as numpy arrays, a bounded block of rows at a time.

Arrow hands over the UTF-8 bytes of a text column as one buffer. Words are found and hashed on that buffer
without making a Python object for each word, in blocks of about ``BLOCK_BYTES`` so that memory does not
follow the number of rows in a batch. A text longer than a block is a block of its own: no text is split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_KEYS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_STEP_KEYS = _rng.integers(1, 2**63, (2, 64), dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, BLOCK_BYTES + 1)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(m - 1, b, U64)])) for b in (_BASE, _BASE_INVERSE)]
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Block:
    """Some whole texts. Word ``i`` of the block has ``bytes[start[i]:end[i]]`` and belongs to text ``doc[i]``;
    text ``d`` has the words ``first[d]:first[d + 1]``."""

    rows: slice
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def word_hashes(self) -> np.ndarray:
        up, down = _powers_to(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_BYTE_KEYS[self.data] * up[:-1], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))

    def windows(self, words: np.ndarray, size: int, family: int = 0) -> np.ndarray:
        """A hash of each ``size`` words from each position of the block (across texts too; see ``inside``)."""
        n = max(0, len(words) - size + 1)
        out = np.zeros(n, U64)
        for k in range(size):
            out += (words[k : k + n] ^ (words[k : k + n] >> U64(29))) * _STEP_KEYS[family, k]
        return mix(out)

    def inside(self, size: int) -> np.ndarray:
        """The positions from which ``size`` words stand in one text."""
        n = max(0, len(self.start) - size + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[size - 1 : size - 1 + n])


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def runs_of(column: pa.Array, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """Cut a text column into runs ``(first, rows)`` of at most ``rows`` rows and about ``size`` bytes; a longer text is a run of
    its own. What is worked out for a run together is so bounded by bytes, not by rows alone."""
    ends = np.cumsum(pc.binary_length(strings(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(column):
        before = ends[a - 1] if a else 0
        b = min(a + rows, max(a + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield a, b - a
        a = b


def blocks(column: pa.Array, lower: bool = False, white: np.ndarray = WHITE, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut ``column`` into blocks of whole texts. ``lower``: A-Z become a-z first."""
    column = strings(column)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + block_bytes, side="right")) - 1)
        part = data[offsets[a] : offsets[b]]
        yield _block(slice(a, b), LOWER[part] if lower else part, offsets[a : b + 1] - offsets[a], white)
        a = b


def _block(rows: slice, data: np.ndarray, offsets: np.ndarray, white: np.ndarray) -> Block:
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~white[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Block(rows, data, start, end, doc, first)

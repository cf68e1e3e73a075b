"""Words and hashes of whole Arrow batches of text, without a Python step per word.

A word is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``.  Texts are
handled in chunks of whole documents, so memory is bounded by ``CHUNK_BYTES`` or by
the longest single document.  Hashes have 64 bits and are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MASK = (1 << 64) - 1
_LEFT = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 steps)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of byte ranges.

    A range is read as lanes of eight bytes from its start on.  Each lane is mixed, then mixed
    again with its number, so no combination of lanes cancels out, and the sum is mixed with
    the length.
    """
    length = ends - starts
    lanes = (length + 7) >> 3
    edge = np.cumsum(lanes) - lanes
    of = np.repeat(np.arange(len(starts)), lanes)
    number = np.arange(len(of)) - edge[of]
    at = starts[of] + (number << 3)
    windows = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    empty = np.maximum(8 - (ends[of] - at), 0).astype(np.uint64) << np.uint64(3)
    lane = windows[at] << empty  # at most 56 bits, as a lane has a byte
    lane = mix(mix(lane) + number.astype(np.uint64) * _LEFT, salt)
    total = np.zeros(len(starts), np.uint64)
    some = lanes > 0
    if len(lane):
        total[some] = np.add.reduceat(lane, edge[some])
    return mix(total + length.astype(np.uint64) * _LEFT, salt)


class Chunk:
    """Some whole documents: their bytes, word bounds and the document of each word."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n_docs = len(offsets) - 1
        self.word = word = ~SPACE[data]
        full = offsets[:-1] < offsets[1:]
        begin, last = offsets[:-1][full], offsets[1:][full] - 1
        at = word.copy()
        at[1:] &= ~word[:-1]
        at[begin] = word[begin]
        self.starts = np.flatnonzero(at)
        at = word.copy()
        at[:-1] &= ~word[1:]
        at[last] = word[last]
        self.ends = np.flatnonzero(at) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        #: Index of each document's first word, and after the last one the number of words.
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self, lower: bool = False) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        return _ranges(data, self.starts, self.ends, 7)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of arbitrary byte ranges."""
        return _ranges(self.data, starts, ends, 3)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum over each document's bytes."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def grams(h: np.ndarray, doc: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each run of k words of one document.

    Hashes of two halves are joined and mixed, runs of a power of two first and then those that
    add up to k.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    part, width, done, out = mix(h, 11 + salt), 1, 0, None
    while True:
        if k & width:
            out = part[:n] if out is None else mix(out * _LEFT + part[done : done + n], salt)
            done += width
        if done == k:
            break
        part = mix(part[:-width] * _LEFT + part[width:], salt)
        width *= 2
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return at, mix(out[at], salt)


def texts(column: pa.Array) -> Iterator[Chunk]:
    """The column's texts in chunks; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1
        j = min(max(j, i + 1), n)
        yield Chunk(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j

"""Monotone sequences in Elias-Fano form, in files that are mapped into memory.

A file holds a JSON index in its first bytes and arrays behind it.  A sequence consists of
segments, each with its own least key, its own words of high bits and its own bytes of low
bits, so that many processes can each lay down a segment of one file, and a second attempt
writes the same bytes again.  All methods take and return whole arrays of positions or keys.
"""

from __future__ import annotations

import json
import os

import numpy as np

HEAD = 4096
BYTES, TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Place of the r-th one of byte b at 8 * b + r.
IN_BYTE = np.argsort(~np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool), axis=1, kind="stable").ravel()


def create(path: str, arrays: dict[str, tuple[str, int]], filled: dict[str, np.ndarray] | None = None, **facts) -> None:
    """Makes a file of zeroed arrays, given by type and length, but for those that are filled at once."""
    at, index, filled = HEAD, {}, filled or {}
    for name, (kind, n) in (arrays | {k: (v.dtype.str, len(v)) for k, v in filled.items()}).items():
        index[name] = (kind, at, n)
        at += -(-np.dtype(kind).itemsize * n // 64) * 64
    head = json.dumps({"arrays": index, "facts": facts}).encode()
    with open(f"{path}.new", "wb") as f:
        f.write(head.ljust(HEAD))
        for name, values in filled.items():
            f.seek(index[name][1])
            f.write(values.tobytes())
        f.truncate(at + 64)
    os.replace(f"{path}.new", path)


def load(path: str, write: bool = False) -> tuple[dict[str, np.ndarray], dict]:
    with open(path, "rb") as f:
        head = json.loads(f.read(HEAD))
    mode = "r+" if write else "r"
    return {k: np.memmap(path, kind, mode, at, (n,)) if n else np.zeros(0, kind) for k, (kind, at, n) in head["arrays"].items()}, head["facts"]


def plan(n: np.ndarray, base: np.ndarray, span: np.ndarray, prefix: str = "") -> tuple[int, dict[str, tuple[str, int]], dict[str, np.ndarray]]:
    """Low bits, arrays to write and arrays known, of segments of n keys each from base up to base + span."""
    total = int(n.sum())
    low = max(0, min(56, int(span.sum() // max(total, 1)).bit_length() - 1))
    words = (n + (span >> low) + 1) // 64 + 2
    room = (n * low // 8 + 16) // 8 * 8
    edges = lambda x: np.concatenate(([0], np.cumsum(x))).astype(np.int64)
    arrays = {"low": ("u1", int(room.sum()) + 8), "high": ("u8", int(words.sum())), "ones": ("i8", int(words.sum())), "zeros": ("i8", int(words.sum()))}
    known = {"off": edges(n), "word": edges(words), "byte": edges(room), "base": np.asarray(base, np.int64), "span": np.asarray(span, np.int64)}
    return low, {prefix + k: v for k, v in arrays.items()}, {prefix + k: v for k, v in known.items()}


def write(arrays: dict[str, np.ndarray], low: int, segment: int, keys: np.ndarray, prefix: str = "") -> None:
    """Lays down one segment's keys, which ascend."""
    a = {k: arrays[prefix + k] for k in ("low", "high", "ones", "zeros", "off", "word", "byte", "base")}
    n = len(keys)
    first, last = int(a["word"][segment]), int(a["word"][segment + 1])
    keys = keys - a["base"][segment]
    high = np.zeros(last - first, np.uint64)
    step = 1 << 16
    for i in range(0, n, step):  # a multiple of 8 keys, so each part begins at a byte
        k = keys[i : i + step]
        if low:
            bits = (k[:, None] >> np.arange(low)) & 1
            packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
            at = int(a["byte"][segment]) + i * low // 8
            a["low"][at : at + len(packed)] = packed
        where = (k >> low) + np.arange(i, i + len(k))
        np.bitwise_or.at(high, where >> 6, np.uint64(1) << (where & 63).astype(np.uint64))
    a["high"][first:last] = high
    ones = int(a["off"][segment]) + np.concatenate(([0], np.cumsum(np.bitwise_count(high).astype(np.int64))[:-1]))
    a["ones"][first:last] = ones
    a["zeros"][first:last] = np.arange(first, last) * 64 - ones


class Sequence:
    def __init__(self, arrays: dict[str, np.ndarray], low: int, prefix: str = ""):
        self.low = low
        lows = arrays[prefix + "low"]
        #: Eight bytes from each byte on, as overlapping numbers over the mapped file.
        self.windows = np.ndarray((max(len(lows) - 7, 0),), "<u8", lows, strides=(1,))
        self.high, self.ones, self.zeros = (np.asarray(arrays[prefix + k]) for k in ("high", "ones", "zeros"))
        self.off, self.word, byte, self.base, self.span = (np.array(arrays[prefix + k]) for k in ("off", "word", "byte", "base", "span"))
        self.n = int(self.off[-1])
        #: First bit of a segment's low bits, less what its first position would add.
        self.bit = byte[:-1] * 8 - self.off[:-1] * low

    @staticmethod
    def _in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the rank-th one of each word: counts of ones up to each byte, side by side in one number, then a table for the byte."""
        x = word - ((word >> np.uint64(1)) & np.uint64(0x5555555555555555))
        x = (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))
        upto = ((x + (x >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * BYTES
        rank = rank.astype(np.uint64)
        # a byte's top bit stays where its count is at most the rank
        place = np.bitwise_count((rank * BYTES | TOPS) - upto & TOPS).astype(np.uint64) << np.uint64(3)
        rank -= (upto << np.uint64(8)) >> place & np.uint64(255)
        return place.astype(np.int64) + IN_BYTE[(word >> place & np.uint64(255)) << np.uint64(3) | rank]

    def _zero(self, i: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.zeros, i, "right") - 1
        return w * 64 + self._in_word(~self.high[w], i - self.zeros[w])

    def _one(self, i: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.ones, i, "right") - 1
        return w * 64 + self._in_word(self.high[w], i - self.ones[w])

    def _low(self, bit: np.ndarray) -> np.ndarray:
        # low is 56 bits at most, so eight bytes from the first bit's byte on hold it
        return ((self.windows[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The keys at positions i; 0 where there are none at all."""
        if not self.n or not len(i):
            return np.zeros(len(i), np.int64)
        s = np.searchsorted(self.off, i, "right") - 1
        high = self._one(i) - self.word[s] * 64 - (i - self.off[s])
        return self.base[s] + ((high << self.low) | self._low(self.bit[s] + i * self.low))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Successor search: position of each key, or -1 where it is not in the sequence."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n or not len(keys):
            return out
        s = np.searchsorted(self.base, keys, "right") - 1
        ok = np.flatnonzero(s >= 0)
        ok = ok[keys[ok] - self.base[s[ok]] <= self.span[s[ok]]]
        s = s[ok]
        k = keys[ok] - self.base[s]
        h, low = k >> self.low, k & ((1 << self.low) - 1)
        begin = self.word[s] * 64
        none = self.zeros[self.word[s]]
        start = np.where(h > 0, self._zero(none + np.maximum(h - 1, 0)) + 1, begin)
        # the list ends at the next zero, most often in the same word
        left = ~self.high[start >> 6] >> (start & 63).astype(np.uint64)
        stop = start + np.bitwise_count((left & (~left + np.uint64(1))) - np.uint64(1))
        far = np.flatnonzero(left == 0)
        stop[far] = self._zero(none[far] + h[far])
        before = self.off[s] - begin - h
        lo, hi, bit = start + before, np.minimum(stop + before, self.off[s + 1]), self.bit[s]
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            ok, lo, hi, low, bit = ok.take(open_), lo.take(open_), hi.take(open_), low.take(open_), bit.take(open_)
            mid = (lo + hi) >> 1
            value = self._low(bit + mid * self.low) if self.low else np.zeros(len(mid), np.int64)
            less, same = value < low, np.flatnonzero(value == low)
            out[ok.take(same)] = mid.take(same)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            hi[same] = lo[same]
            open_ = np.flatnonzero(lo < hi)
        return out

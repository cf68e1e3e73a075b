"""Operator 6, substring dedup: seed and extend.

A window is ``length`` consecutive words of one document.  Of the k-word grams in each
window the one with the least hash (the leftmost, if tied) is its anchor; equal windows have
equal anchors at the same place (winnowing), so a window that repeats can only hang on an
anchor hash that repeats.

1. Seed: anchors (hash, document, position), about one for every (length - k + 2) / 2 words,
   are joined on their hash; those met once are dropped.  Hashes that hold more than a 1024th of
   all anchors are so few that they are sent to all tasks, so no task gets all places of one.
2. Extend: around each repeated anchor the match is extended to both sides by whole windows,
   compared through 128-bit hashes.  The least document of each window hash has its first
   occurrence, and within that document the least start.  A minimum is combined before the
   shuffle, so a passage found in a third of all documents costs a row a task, and no pairs
   of occurrences are formed.
3. Windows that are not a first occurrence are repeats; overlapping ones form the maximal
   repeated spans, and their words go.

Defined results: a null or empty text has no words; a document shorter than a window loses
nothing; ties are decided by id and start; rows that repeat an id count as one document's
occurrences and each gets its own result row; null ids come last, together with the largest id
there can be; very long texts are whole texts like others, in memory one at a time; an empty
table gives an empty result; other columns stay out of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.scratch import discard, join_one, materialise
from lexforge.llm.words import Chunk, grams, mix, texts

#: Words of an anchor.
SEED = 5
LAST = (1 << 63) - 1


def _windows(c: Chunk, h: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, and position and hash of each one's anchor."""
    starts, _ = np.zeros(0, np.int64), None
    n = len(h) - length + 1
    if n <= 0:
        return starts, starts, np.zeros(0, np.uint64)
    starts = np.flatnonzero(c.doc[:n] == c.doc[length - 1 :])
    at, g = grams(h, c.doc, k)
    of = np.zeros(len(h), np.uint64)
    of[at] = g
    least, where = of[starts], starts.copy()
    for j in range(1, length - k + 1):
        other = of[starts + j]
        less = other < least
        least[less] = other[less]
        where[less] = starts[less] + j
    return starts, where, least


def _marks(c: Chunk, lists: pa.Array, size: int) -> np.ndarray:
    """One flag for each word: is its position in its document's list?"""
    out = np.zeros(size, bool)
    part = lists.slice(c.first, c.n_docs)
    counts = np.nan_to_num(np.asarray(pa.compute.list_value_length(part).fill_null(0)))
    values = np.asarray(part.flatten())
    if len(values):
        counts = counts.astype(np.int64)
        within = values < np.repeat(np.diff(c.bounds), counts)  # a row that repeats an id may be shorter
        out[(np.repeat(c.bounds[:-1], counts) + values)[within]] = True
    return out


def _anchors(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for c in texts(batch.column(1)):
                _, where, least = _windows(c, c.hashes(), length, k)
                where, first = np.unique(where, return_index=True)
                doc = c.doc[where]
                yield pa.RecordBatch.from_arrays([pa.array(least[first].view(np.int64)), pa.array(ids[c.first + doc]), pa.array((where - c.bounds[doc]).astype(np.int32))], names=["hash", "id", "pos"])

    return run


def _extended(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for c in texts(batch.column(1)):
                h = c.hashes()
                starts, where, _ = _windows(c, h, length, k)
                starts = starts[_marks(c, batch.column(2), len(h))[where]] if len(starts) else starts
                doc = c.doc[starts]
                pair = [pa.array(_hash_at(h, starts, c.doc, length, salt).view(np.int64)) for salt in (1, 2)]
                yield pa.RecordBatch.from_arrays([*pair, pa.array(ids[c.first + doc])], names=["h1", "h2", "id"])

    return run


def _hash_at(h: np.ndarray, starts: np.ndarray, doc: np.ndarray, length: int, salt: int) -> np.ndarray:
    at, g = grams(h, doc, length, salt)
    return g[np.searchsorted(at, starts)]


def _first_here(c: Chunk, starts: np.ndarray, h1: np.ndarray, firsts: pa.Array) -> np.ndarray:
    """Is a window in its document's list of windows first seen there, and the first of these in it?"""
    own = lambda x, doc: mix(x ^ mix(doc.astype(np.uint64), 5))
    part = firsts.slice(c.first, c.n_docs)
    counts = np.asarray(pa.compute.list_value_length(part).fill_null(0)).astype(np.int64)
    listed = np.sort(own(np.asarray(part.flatten()).astype(np.int64).view(np.uint64), np.repeat(np.arange(c.n_docs), counts)))
    keys = own(h1, c.doc[starts])
    out = np.zeros(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = True
    if not len(listed):
        return np.zeros(len(keys), bool)
    return out & (listed[np.minimum(np.searchsorted(listed, keys), len(listed) - 1)] == keys)


def _cleaned(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in texts(batch.column(1)):
                h = c.hashes()
                starts, where, _ = _windows(c, h, length, k)
                gone = np.zeros(len(h) + 1, np.int64)
                if len(starts):
                    starts = starts[_marks(c, batch.column(2), len(h))[where]]
                    starts = starts[~_first_here(c, starts, _hash_at(h, starts, c.doc, length, 1), batch.column(3))]
                    gone[starts] += 1
                    np.subtract.at(gone, starts + length, 1)
                gone = np.cumsum(gone)[:-1] > 0
                removed = np.bincount(c.doc[gone], minlength=c.n_docs)
                raw = c.data.tobytes()
                texts_out, spans = [], []
                for d in range(c.n_docs):
                    a, b = c.bounds[d], c.bounds[d + 1]
                    words = raw[c.offsets[d] : c.offsets[d + 1]].split()
                    if removed[d]:
                        flags = gone[a:b]
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
                        spans.append(edge.astype(np.int32))
                        keep, last = [], 0
                        for x, y in edge.reshape(-1, 2):
                            keep += words[last:x]
                            last = y
                        words = keep + words[last:]
                    else:
                        spans.append(np.zeros(0, np.int32))
                    texts_out.append(b" ".join(words))
                at = batch.column(4).slice(c.first, c.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [at, pa.array(np.diff(c.bounds)), pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts_out], pa.string()), pa.array(spans, pa.list_(pa.int32())), pa.array(texts_out, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text", k: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans, kept) of every row.

    ``spans`` holds start and end of each maximal repeat in words, one after the other, and
    ``kept`` the words that stay, joined by one space.
    """
    own = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(F.coalesce(own, F.lit(LAST)).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), own.alias("own"))
    anchors = materialise(rows.select("id", "text").mapInArrow(_anchors(length, k), "hash long, id long, pos int"), "anchors")
    repeated = materialise(anchors.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1"), "repeated")
    seeds = materialise(join_one(anchors, repeated, "hash").groupBy("id").agg(F.collect_set("pos").alias("seeds")), "seeds")
    discard(anchors)
    discard(repeated)
    found = rows.join(seeds, "id").select("id", "text", "seeds").mapInArrow(_extended(length, k), "h1 long, h2 long, id long")
    first = found.groupBy("h1", "h2").agg(F.min("id").alias("id"))
    firsts = materialise(first.groupBy("id").agg(F.collect_list("h1").alias("firsts")), "firsts")
    out = rows.join(seeds.join(firsts, "id", "left"), "id", "left").select("id", "text", "seeds", "firsts", "own")
    return out.mapInArrow(_cleaned(length, k), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<int>, kept string")

"""Operator 10, language-model scoring with an Elias-Fano n-gram trie of three levels.

Level 1 has all training tokens, as sorted 63-bit hashes; a token's id is its place there.
Level 2 has all pairs: successors of a token, all lists laid end to end as one monotone
sequence of context * size + successor, with a monotone sequence of pointers to where each
list starts.  Level 3 has triples (u, v, w) as place of (u, v) and place of w *among the
successors of v*, so its numbers stay small; a search there is relative to the context.
Beside the keys stand quantised log10 probabilities (16 bits over 0 to -16); the mass that a
context leaves to shorter ones follows from its pointers or stands beside it in the same way.

Smoothing is interpolated absolute discounting over all counts, those of one included, down to
(c + 0.1) / (N + 0.1 * (V + 1)) for single tokens, so the model is a proper distribution up
to the quantisation.

A level is built in one shuffle.  Its keys are dealt by range into segments of about ``SEGMENT``
tokens, whose bounds follow from the counts of the level above, a context of many tokens being
cut among its successors.  Tasks that read texts send each segment sorted keys with sums, as
compressed differences; a task merges a segment; then each segment's task writes its own part
of the level's file in the shared folder, which all executors map.  The driver holds a few
numbers a segment.  A task that runs twice writes the same bytes.  The shared folder
(``spark.checkpoint.dir``) must be a mounted one, else train() refuses.

Defined results: a null or empty text is the end token alone; very long texts are whole texts
like others, in memory one at a time; documents train unless crc32(id) mod 10 is 0, a null id
is held out; repeated rows train as often as they stand there; without training rows each token
has probability 1 of 0.1 / 0.1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import eliasfano
from lexforge.llm.scratch import discard, materialise, mounted
from lexforge.llm.words import Chunk, mix, texts

#: Tokens that a task counts at once, and about those of a segment.
HELD, SEGMENT = 1 << 22, 1 << 20
ADD, DISCOUNT = 0.1, 0.75
FLOOR, STEPS = -16.0, 65535
END = int(mix(np.array([0x454E44], np.uint64), 99)[0] >> np.uint64(1))


def quantise(logs: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(logs / FLOOR, 0, 1) * STEPS).astype(np.uint16)


def value(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * (FLOOR / STEPS)


_LOADED: dict[str, tuple[dict, dict]] = {}


def _file(path: str) -> tuple[dict, dict]:
    if path not in _LOADED:
        if len(_LOADED) > 30:  # of models that this process read before
            _LOADED.clear()
        _LOADED[path] = eliasfano.load(path)
    return _LOADED[path]


class Trie:
    """The levels whose files are given, for lookups of whole arrays."""

    def __init__(self, files: list[str]):
        levels = [_file(f) for f in files]
        self.one, facts = levels[0]
        self.n, self.total, self.trained = facts["n"], facts["total"], facts["trained"]
        self.words = eliasfano.Sequence(self.one, facts["low"])
        if len(levels) > 1:
            self.two, facts = levels[1]
            self.pairs = eliasfano.Sequence(self.two, facts["low"])
            self.starts = eliasfano.Sequence(self.two, facts["p_low"], "p_")
            self.widest = facts["widest"]
        if len(levels) > 2:
            self.three, facts = levels[2]
            self.triples = eliasfano.Sequence(self.three, facts["low"])

    def sequence(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the chunk's distinct words (-1: unknown) and, last, of the start; start, words and end of
        all documents, one after the other, as places among those; document; is it a start?"""
        h = (c.hashes(lower=True) >> np.uint64(1)).astype(np.int64)
        distinct, inverse = np.unique(np.append(h, END), return_inverse=True)
        size = np.diff(c.bounds) + 2
        edge = np.concatenate(([0], np.cumsum(size)))
        seq = np.empty(edge[-1], np.int64)
        seq[np.arange(len(h)) + 2 * c.doc + 1] = inverse[:-1]
        seq[edge[:-1]] = len(distinct)
        seq[edge[1:] - 1] = inverse[-1]
        first = np.zeros(len(seq), bool)
        first[edge[:-1]] = True
        return np.append(self.words.find(distinct), self.n), seq, np.repeat(np.arange(c.n_docs), size), first

    def pair_keys(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each place, the key of the pair that ends there, or -1."""
        out = np.full(len(ids), -1, np.int64)
        out[1:] = np.where((ids[:-1] >= 0) & (ids[1:] >= 0) & ~first[1:], ids[:-1] * (self.n + 1) + ids[1:], -1)
        return out

    @staticmethod
    def _each(find, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """find() of the distinct keys and, last, -1; for each key its place among those, the last for -1."""
        some = np.flatnonzero(keys >= 0)
        distinct, inverse = np.unique(keys[some], return_inverse=True)
        at = np.full(len(keys), len(distinct), np.int64)
        at[some] = inverse
        return np.append(find(distinct), -1), at

    @staticmethod
    def _logs(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Values of the codes at these places, 0 where the place is -1."""
        out, some = np.zeros(len(at)), np.flatnonzero(at >= 0)
        out[some] = value(codes[at[some]])
        return out

    def triple_keys(self, words: np.ndarray, seq: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """For each place, the key of the triple that ends there, or -1."""
        out = np.full(len(seq), -1, np.int64)
        both = np.flatnonzero((pairs[1:] >= 0) & (pairs[:-1] >= 0)) + 1
        if len(both):
            starts = self.starts.get(np.maximum(words, 0))
            out[both] = pairs[both - 1] * self.widest + pairs[both] - starts[seq[both - 1]]
        return out

    def count(self, ids: np.ndarray) -> np.ndarray:
        """How often the tokens stand in training texts, -1 never, and the start as often as there are texts."""
        out, some = np.zeros(len(ids)), np.flatnonzero((ids >= 0) & (ids < self.n))
        out[some] = self.one["count"][ids[some]]
        out[ids == self.n] = self.trained
        return out

    def base(self, ids: np.ndarray) -> np.ndarray:
        return np.log10((np.where(ids < self.n, self.count(ids), 0) + ADD) / (self.total + ADD * (self.n + 1)))

    def width(self, ids: np.ndarray) -> np.ndarray:
        """Number of different successors."""
        ids = np.maximum(ids, 0)
        return self.starts.get(ids + 1) - self.starts.get(ids)

    def left(self, ids: np.ndarray) -> np.ndarray:
        """log10 of what each context leaves to single tokens; 0 for one without successors."""
        out, some = np.zeros(len(ids)), np.flatnonzero(ids >= 0)
        width = self.width(ids[some])
        some, width = some[width > 0], width[width > 0]
        out[some] = np.log10(DISCOUNT * width / self.count(ids[some]))
        return out

    def score(self, c: Chunk) -> list[np.ndarray]:
        """The big arrays are read once for each distinct word, pair and triple, in ascending order."""
        words, seq, doc, first = self.sequence(c)
        single = self.base(words)[seq]
        pair, at2 = self._each(self.pairs.find, self.pair_keys(words[seq], first))
        pairs = pair[at2]
        triple, at3 = self._each(self.triples.find, self.triple_keys(words, seq, pairs))
        # what a document's start gets here from the one before is left out below
        out = single.copy()
        out[1:] += self.left(words)[seq[:-1]]
        out = np.where(pairs >= 0, self._logs(self.two["logp"], pair)[at2], out)
        out[1:] += self._logs(self.three["rest"], pair)[at2[:-1]]
        out = np.where((triple >= 0)[at3], self._logs(self.three["logp"], triple)[at3], out)
        use = np.flatnonzero(~first)
        doc = doc[use]
        add = lambda x: np.bincount(doc, x[use], c.n_docs)
        return [np.diff(c.bounds) + 1, add((words >= 0)[seq]).astype(np.int64), add(single), add(out)]


#: Ascending keys with sums, and of the first and last context there how many keys and their sum.
PACKED = "segment long, n long, least long, most long, total long, first long, first_n long, first_sum long, last long, last_n long, last_sum long, widest long, part binary"


def _wrap(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Byte planes of the keys' differences and of the counts, compressed."""
    planes = [np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in (np.diff(keys, prepend=0), counts)]
    return len(keys).to_bytes(8, "little") + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unwrap(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(part[:8], "little")
    raw = np.frombuffer(pa.decompress(part[8:], 16 * n, codec="zstd", asbytes=True), np.uint8)
    gaps, counts = (np.ascontiguousarray(x.reshape(8, n).T).view("<i8").ravel() for x in (raw[: 8 * n], raw[8 * n :]))
    return np.cumsum(gaps), counts


def _sums(key: Callable[[Chunk], np.ndarray], emit: Callable[[np.ndarray, np.ndarray], pa.RecordBatch]):
    """Sums of the keys of some millions of tokens at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return emit(keys, n)

        for batch in batches:
            for c in texts(batch.column(0)):
                held.append(key(c))
                if sum(map(len, held)) >= HELD:
                    yield flush()
        if held:
            yield flush()

    return run


def _as_rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])


def _as_parts(bounds: str):
    """One row for each segment that has keys."""

    def emit(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        edge = np.append(np.searchsorted(keys, np.load(bounds, mmap_mode="r")), len(keys))
        some = np.flatnonzero(np.diff(edge))
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array([_wrap(keys[a:b], n[a:b]) for a, b in zip(edge[some], edge[some + 1], strict=True)], pa.binary())], names=["segment", "part"])

    return emit


def _word_keys(c: Chunk) -> np.ndarray:
    h = (c.hashes(lower=True) >> np.uint64(1)).astype(np.int64)
    return np.concatenate([h, np.full(c.n_docs, END)])


def _of_contexts(keys: np.ndarray, counts: np.ndarray, divisor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, their numbers of keys and sums, and for each key the place of its context among those."""
    ctx = keys // divisor
    new = np.flatnonzero(np.diff(ctx, prepend=-1))
    n = np.diff(np.append(new, len(keys)))
    return ctx[new], n, np.add.reduceat(counts, new), np.repeat(np.arange(len(new)), n)


def _merged(divisor: int):
    """Adds up the parts of one segment."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if "part" in pdf:
            keys, counts = (np.concatenate(x) for x in zip(*map(_unwrap, pdf["part"]), strict=True))
        else:
            keys, counts = pdf["key"].to_numpy(), pdf["n"].to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, counts = keys[new], np.add.reduceat(counts, new)
        ctx, n, sums, _ = _of_contexts(keys, counts, divisor)
        row = (pdf["segment"].iloc[0], len(keys), keys[0], keys[-1], counts.sum(), ctx[0], n[0], sums[0], ctx[-1], n[-1], sums[-1], n.max(), _wrap(keys, counts))
        return pd.DataFrame([row], columns=[c.split()[0] for c in PACKED.split(", ")])

    return run


def _cuts(weights: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Where running sums pass a multiple of segment: the place, and the share of its weight."""
    total = np.cumsum(weights)
    at = np.arange(segment, (total[-1] if len(total) else 0) + 1, segment)
    i = np.searchsorted(total, at)
    return i, 1 - (total[i] - at) / weights[i]


class _Level:
    """A level's segments while it is built: a few numbers of each here, the keys in a table."""

    def __init__(self, table: DataFrame):
        self.table = materialise(table, "segments")
        f = self.facts = self.table.drop("part").orderBy("segment").toPandas()  # one row for a million tokens
        self.segments = f["segment"].to_numpy()
        self.n = f["n"].to_numpy(np.int64)
        self.low, self.arrays, self.known = eliasfano.plan(self.n, f["least"].to_numpy(np.int64), (f["most"] - f["least"]).to_numpy(np.int64))
        other = f[f["last"] != f["first"]]
        self.edge, inverse = np.unique(np.concatenate([f["first"], other["last"]]).astype(np.int64), return_inverse=True)
        add = lambda c: np.bincount(inverse, np.concatenate([f["first_" + c], other["last_" + c]]).astype(float), len(self.edge))
        #: Contexts that may go on in the next segment, with what all segments have of them.
        self.edge_n, self.edge_sum = add("n").astype(np.int64), add("sum").astype(np.int64)
        self.widest = int(max([1, *f["widest"], *self.edge_n]))

    def write(self, path: str, lay: Callable[[dict, int, np.ndarray, np.ndarray], tuple[np.ndarray, ...]]) -> list[np.ndarray]:
        """lay(arrays, segment, keys, counts) on executors, for each segment; what it returns, together."""
        segments = self.segments

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrays, _ = eliasfano.load(path, write=True)
            for batch in batches:
                for row in batch.to_pylist():
                    found = lay(arrays, int(np.searchsorted(segments, row["segment"])), *_unwrap(row["part"]))
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in found], names=["a", "b", "c"])
            for x in arrays.values():
                if isinstance(x, np.memmap):
                    x.flush()

        rows = self.table.select("segment", "part").mapInArrow(run, "a binary, b binary, c binary").collect()  # a number or so a segment
        discard(self.table)
        return [np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[c], kind) for r in rows)]) for c, kind in (("a", np.int64), ("b", np.float64), ("c", np.int64))]


def _with_edges(own: tuple, edge: np.ndarray, edge_n: np.ndarray, edge_sum: np.ndarray) -> tuple:
    """_of_contexts() with the first and the last context taken over all segments."""
    ctx, n, sums, of = own
    for i in {0, len(ctx) - 1}:
        at = np.searchsorted(edge, ctx[i])
        n[i], sums[i] = edge_n[at], edge_sum[at]
    return ctx, n, sums, of


def train(docs: DataFrame, segment: int = SEGMENT) -> list[str]:
    """Paths of the level files for Trie(), which all executors can map.  docs: one column, the text."""
    here = mounted(docs.sparkSession, "trie")
    if here is None:
        raise ValueError("spark.checkpoint.dir must be a folder that all executors have mounted")
    one, two, three = (f"{here}/level-{i}.ef" for i in (1, 2, 3))

    def segments(key, bounds: np.ndarray, divisor: int, name: str) -> DataFrame:
        np.save(path := f"{here}/{name}.npy", np.unique(np.append(bounds, 0)))
        parts = docs.mapInArrow(_sums(key, _as_parts(path)), "segment long, part binary")
        return parts.repartition(min(len(bounds) + 1, 10_000), "segment").groupBy("segment").applyInPandas(_merged(divisor), PACKED)

    # level 1: hashes, so ranges of equal length hold equally many
    counts = docs.mapInArrow(_sums(_word_keys, _as_rows), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "counts")
    size, total, trained = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("key") == END, F.col("n"))), F.lit(0))).first()
    base, bits = size + 1, max(0, (size // segment).bit_length())
    if base * base >= 1 << 63:
        raise ValueError("more different tokens than pairs can be numbered for")
    dealt = counts.withColumn("segment", F.shiftright("key", 63 - bits) if bits else F.lit(0).cast("long")).repartition(1 << bits, "segment")
    level = _Level(dealt.groupBy("segment").applyInPandas(_merged(1 << 62), PACKED))
    discard(counts)
    eliasfano.create(one, level.arrays | {"count": ("i8", size)}, level.known, n=size, low=level.low, total=int(total), trained=int(trained))
    off, low = level.known["off"], level.low

    def lay_words(a, s, keys, counts):
        eliasfano.write(a, low, s, keys)
        a["count"][off[s] : off[s + 1]] = counts
        place, share = _cuts(np.minimum(counts, base), segment)
        return off[s] + place, share, place

    place, share, _ = level.write(one, lay_words)
    start, part = _cuts(np.array([min(trained, base)]), segment)
    place, share = np.append(place, start + size), np.append(share, part)

    # level 2
    def pair_keys(c: Chunk) -> np.ndarray:
        trie = Trie([one])
        words, seq, _, first = trie.sequence(c)
        keys = trie.pair_keys(words[seq], first)
        return keys[keys >= 0]

    bounds = np.unique(np.append(place * base + (share * base).astype(np.int64), 0))
    level = _Level(segments(pair_keys, bounds, base, "pairs"))
    # a segment has the pointers of the contexts that begin in its range
    least = bounds[level.segments]
    least[:1] = 0
    owned = np.append(-(-least // base), base + 1) if len(least) else np.zeros(1, np.int64)
    off2, low2, widest = level.known["off"], level.low, level.widest
    p_low, p_arrays, p_known = eliasfano.plan(np.diff(owned), off2[:-1], level.n, "p_")
    if int(off2[-1]) * widest >= 1 << 63:
        raise ValueError("more different pairs than triples can be numbered for")
    eliasfano.create(two, level.arrays | p_arrays | {"logp": ("u2", int(off2[-1]))}, level.known | p_known, low=low2, p_low=p_low, widest=widest)
    edges2 = level.edge, level.edge_n, level.edge_sum

    def lay_pairs(a, s, keys, counts):
        trie = Trie([one])
        eliasfano.write(a, low2, s, keys)
        eliasfano.write(a, p_low, s, off2[s] + np.searchsorted(keys, np.arange(owned[s], owned[s + 1]) * base), "p_")
        ctx, n, _, of = _with_edges(_of_contexts(keys, counts, base), *edges2)
        totals, p1 = trie.count(ctx), (trie.count(keys % base) + ADD) / (total + ADD * base)
        a["logp"][off2[s] : off2[s + 1]] = quantise(np.log10((counts - DISCOUNT) / totals[of] + (DISCOUNT * n / totals)[of] * p1))
        place, share = _cuts(counts, segment)
        return off2[s] + place, share, keys[place] % base

    place, share, last = level.write(two, lay_pairs)

    # level 3
    def triple_keys(c: Chunk) -> np.ndarray:
        trie = Trie([one, two])
        words, seq, _, first = trie.sequence(c)
        pair, at = trie._each(trie.pairs.find, trie.pair_keys(words[seq], first))
        keys = trie.triple_keys(words, seq, pair[at])
        return keys[keys >= 0]

    bounds = np.unique(np.append(place * widest + (share * Trie([one, two]).width(last)).astype(np.int64), 0))
    level = _Level(segments(triple_keys, bounds, widest, "triples"))
    off3, low3 = level.known["off"], level.low
    eliasfano.create(three, level.arrays | {"logp": ("u2", int(off3[-1])), "rest": ("u2", int(off2[-1]))}, level.known, low=low3)
    edges3 = level.edge, level.edge_n, level.edge_sum

    def lay_triples(a, s, keys, counts):
        trie = Trie([one, two])
        eliasfano.write(a, low3, s, keys)
        ctx, n, sums, of = _with_edges(_of_contexts(keys, counts, widest), *edges3)
        left = DISCOUNT * n / sums
        a["rest"][ctx] = quantise(np.log10(left))
        lower = trie.starts.get(trie.pairs.get(ctx) % base)[of] + keys % widest
        a["logp"][off3[s] : off3[s + 1]] = quantise(np.log10((counts - DISCOUNT) / sums[of] + left[of] * 10 ** value(trie.two["logp"][lower])))
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    level.write(three, lay_triples)
    return [one, two, three]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Trains on the rows that are not held out and scores all."""
    fold = F.pmod(F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)), F.lit(10))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    files = train(rows.where(~F.col("held_out")).select("text"), segment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(files)
        for batch in batches:
            for c in texts(batch.column(2)):
                n, known, base, model = trie.score(c)
                own = [batch.column(i).slice(c.first, c.n_docs) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(known), pa.array(np.full(c.n_docs, trie.total)), pa.array(base), pa.array(model)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

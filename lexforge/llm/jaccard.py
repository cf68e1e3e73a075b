"""Operator 4, n-gram Jaccard join by prefix trees.

A document's set holds the hashes (64 bits) of its distinct k-word shingles.  Documents with
equal sets form a class and only one row of it goes on, under that row's number.  Candidates then come in three exact
steps, none of which forms pairs:

* With e(a) = the most shingles that a set of size a may lack in a partner, the e + e/2 + 1
  shingles of least hash of two linked sets share at least L = e/2 + 1 (the smaller e of the
  two).  Sets with fewer than L shingles met elsewhere among those have no partner.
* Of the shared ones, in a global order of frequency, the rarest but L - 1 are keys: two
  linked sets have a key in common.  Sets are tied to the least id of each of their keys, and
  the connected components of these ties are blocks; no link leaves its block.
* A block's sets go to one task, where they are stored in a prefix tree, most frequent
  shingle first, so that shared parts are stored and compared once.  A probe walks down with
  its overlap so far, to the sets of other components that share enough of its rarest
  shingles among theirs, and leaves a subtree when even the rest of both cannot reach the
  threshold; where most of the tree would be walked, all of it is read in one pass.

Texts that share a passage tie unlike sets, so some blocks grow with the table.  Those over
``block_shingles`` are cut into bands by size: a band has the sizes of two neighbouring intervals, and
linked sets lie in one interval or in neighbours, so they have a band in common.  Bands still
over ``block_shingles`` are dealt into chunks, and each pair of chunks is a task of its own; the
links found then go through components() again.  Memory of a task is bounded by two chunks.

Defined results: a null, empty or blank text has an empty set and no links, its component is
its own id; rows that repeat an id, or have none, are told apart by their texts, so each is
compared, and a component has the least id of its rows, null only if none has one; very long
texts are whole sets, in memory one at a time; an empty table gives an empty result; other
columns are ignored, or kept by one_of_each() whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.graph import components
from lexforge.llm.scratch import discard, materialise, unused
from lexforge.llm.words import Chunk, grams, mix, texts

LAST = (1 << 63) - 1
#: A tree of fewer shingles for each candidate is read as a whole, not walked.
SCAN = 5000


def shingle_sets(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each distinct shingle, in order of document and hash."""
    h = c.hashes(lower=True)
    at, g = grams(h, c.doc, k)
    docs, parts = [c.doc[at]], [g]
    n = np.diff(c.bounds)
    for short in range(1, k):
        which = np.flatnonzero(n == short)
        at, g = grams(h, c.doc, short, 100 + short)
        docs.append(which)
        parts.append(g[np.searchsorted(at, c.bounds[which])])
    doc, g = np.concatenate(docs), np.concatenate(parts)
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], g[new]


def spare(n, percent: int):
    """The most shingles of a set of n that a linked set may lack."""
    return (100 - percent) * n // 100


def _sketch(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in texts(batch.column(3)):
                doc, g = shingle_sets(c, k)
                n = np.bincount(doc, minlength=c.n_docs)
                edge = np.concatenate(([0], np.cumsum(n)))
                signs = []
                for salt in (21, 22):
                    total = np.zeros(len(g) + 1, np.uint64)
                    np.cumsum(mix(g, salt), out=total[1:])
                    signs.append(pa.array((total[edge[1:]] - total[edge[:-1]]).view(np.int64)))
                e = spare(n, percent)
                first = np.minimum(e + e // 2 + 1, n)
                kept = np.arange(len(g)) - edge[doc] < first[doc]
                offsets = np.concatenate(([0], np.cumsum(first))).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(g[kept].view(np.int64)))
                own = [batch.column(i).slice(c.first, c.n_docs) for i in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), *signs, prefix], names=["own", "id", "v", "n", "s1", "s2", "prefix"])

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in texts(batch.column(1)):
                doc, g = shingle_sets(c, k)
                edge = np.searchsorted(doc, np.arange(c.n_docs + 1))
                raw = [g[edge[i] : edge[i + 1]].tobytes() for i in range(c.n_docs)]
                rest = [batch.column(i).slice(c.first, c.n_docs) for i in (0, 2, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(raw, pa.binary())], names=["id", "block", "band", "part", "parts", "grams"])

    return run


def ends(most: int, percent: int) -> list[int]:
    """Last sizes of intervals up to most; linked sets lie in one interval or in neighbours."""
    out = [0]
    while out[-1] < most:
        out.append(100 * (out[-1] + 1) // percent)
    return out[1:]


def _bands(percent: int):
    """Both bands of sets by their sizes, from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            at = np.searchsorted(np.array(ends(int(n.max(initial=0)), percent), np.int64), n)
            for band in (at, at + 1):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(band.astype(np.int32))], names=[*batch.schema.names, "band"])

    return run


class PrefixTree:
    """Path-compressed trie of sorted sets, each a leaf; nodes are arrays indexed by number."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        """sets: ascending ranks of the shared shingles; sizes: of the whole sets."""
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.sets = [sets[i] for i in self.order]
        self.sizes = sizes[self.order]
        #: (first leaf, end leaf, depth at which its segment starts, depth at its end, children)
        self.nodes: list[tuple[int, int, int, int, list[int]]] = []
        common = [self._common(a, b) for a, b in zip(self.sets, self.sets[1:], strict=False)]
        self.root = self._build(0, len(sets), 0, np.array(common, np.int64)) if sets else -1

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _build(self, lo: int, hi: int, depth: int, common: np.ndarray) -> int:
        """Node of the leaves lo to hi, which share their first depth ranks; iterative, as tries are deep."""
        todo, root = [(lo, hi, depth, -1)], len(self.nodes)
        while todo:
            lo, hi, depth, parent = todo.pop()
            at = len(self.nodes)
            end = len(self.sets[lo]) if hi - lo == 1 else int(common[lo : hi - 1].min())
            self.nodes.append((lo, hi, depth, end, []))
            if parent >= 0:
                self.nodes[parent][4].append(at)
            if hi - lo > 1:
                cuts = [lo, *(lo + 1 + np.flatnonzero(common[lo : hi - 1] == end)).tolist(), hi]
                todo += [(a, b, end, at) for a, b in zip(cuts, cuts[1:], strict=False)]
        return root

    def limits(self) -> None:
        n = len(self.nodes)
        lo, hi, end = (np.array([x[i] for x in self.nodes]) for i in (0, 1, 3))
        lengths = np.array([len(s) for s in self.sets])
        self.starts = [np.zeros(0, np.int64)] * n
        self.longest = np.zeros(n, np.int64)
        self.smallest = np.zeros(n, np.int64)
        for i in range(n):
            self.longest[i] = lengths[lo[i] : hi[i]].max() - end[i]
            self.smallest[i] = self.sizes[lo[i] : hi[i]].min()
            if self.nodes[i][4]:
                self.nodes[i][4].sort(key=lo.__getitem__)
                self.starts[i] = lo[self.nodes[i][4]]
        # all segments in a row, parents before children, and the number behind each node's last descendant
        self.flat = np.concatenate([*(self.sets[x[0]][x[2] : x[3]] for x in self.nodes), np.zeros(0, np.int64)])
        self.edge = np.concatenate(([0], np.cumsum([x[3] - x[2] for x in self.nodes], dtype=np.int64)))
        self.behind = np.arange(1, n + 1)
        self.node_of = np.zeros(len(self.sets), np.int64)
        for i in range(n - 1, -1, -1):
            if self.nodes[i][4]:
                self.behind[i] = self.behind[self.nodes[i][4]].max()
            else:
                self.node_of[lo[i]] = i

    def index(self, percent: int) -> None:
        """Leaves by each of their rarest shingles; of those, linked sets share the lesser ``fewest`` at least.

        Linked sets share percent of either's shingles at least.  So with f more shingles than it may lack,
        each of them has f of the shared ones among its rarest; those that meet nobody are the rarest of all.
        """
        lacks = spare(self.sizes, percent)
        self.fewest = np.minimum(lacks // 2 + 1, self.sizes - lacks)
        kept = lacks + self.fewest - (self.sizes - np.array([len(s) for s in self.sets], np.int64))
        self.rarest = [s[max(0, len(s) - k) :] if k > 0 else s[:0] for s, k in zip(self.sets, kept.tolist(), strict=True)]
        every = np.concatenate([*self.rarest, np.zeros(0, np.int64)])
        leaf = np.repeat(np.arange(len(self.sets)), [len(r) for r in self.rarest])
        order = np.argsort(every, kind="stable")
        ranks, first = np.unique(every[order], return_index=True)
        self.having = dict(zip(ranks.tolist(), np.split(leaf[order], first[1:]), strict=False))

    def candidates(self, leaf: int, percent: int, label: np.ndarray) -> np.ndarray:
        """Leaves after this one, of other components and sizes that may link, with enough of the rarest shingles in common."""
        own = self.rarest[leaf]
        if not len(own):
            return np.zeros(0, np.int64)
        met = np.bincount(np.concatenate([self.having[r] for r in own.tolist()]))[leaf + 1 :]
        found = np.flatnonzero(met)
        met, found = met[found], found + leaf + 1
        size, sizes = self.sizes[leaf], self.sizes[found]
        fit = (met >= np.minimum(self.fewest[leaf], self.fewest[found])) & (label[found] != label[leaf])
        return found[fit & (100 * sizes >= percent * size) & (100 * size >= percent * sizes)]

    def overlaps(self, mask: np.ndarray) -> np.ndarray:
        """Shingles of the mask on the way to each leaf; each segment is compared once."""
        met = np.concatenate(([0], np.cumsum(mask[self.flat], dtype=np.int32)))
        own = met[self.edge[1:]] - met[self.edge[:-1]]
        left = np.bincount(self.behind, own, len(own) + 1)[:-1].astype(np.int64)
        return np.cumsum(own - left)[self.node_of]

    def partners(self, leaf: int, percent: int, width: int, label: np.ndarray) -> list[int]:
        """Leaves after this one, of other components, whose sets reach the threshold."""
        among = self.candidates(leaf, percent, label)
        if not len(among):
            return []
        own, size = self.sets[leaf], int(self.sizes[leaf])
        mask = np.zeros(width, bool)
        mask[own] = True
        if len(self.flat) < SCAN * len(among):
            met, sizes = self.overlaps(mask)[among], self.sizes[among]
            return among[100 * met >= percent * (size + sizes - met)].tolist()
        out, todo = [], [(self.root, 0, among)]
        while todo:
            node, overlap, among = todo.pop()
            lo, _, start, end, children = self.nodes[node]
            path = self.sets[lo]
            if end > start:
                overlap += int(mask[path[start:end]].sum())
            rest = min(int(self.longest[node]), len(own) - int(np.searchsorted(own, path[end - 1], "right")) if end else len(own))
            most = overlap + rest
            if 100 * most < percent * (size + int(self.smallest[node]) - most):
                continue
            if children:
                child = np.searchsorted(self.starts[node], among, "right") - 1
                cuts = [0, *(1 + np.flatnonzero(child[1:] != child[:-1])).tolist(), len(child)]
                todo += [(children[child[a]], overlap, among[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            elif 100 * overlap >= percent * (size + int(self.sizes[lo]) - overlap):
                out.append(lo)
        return out


def join_block(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Least id of each set's component among sets linked at percent or more."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    _, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    width = int((counts > 1).sum())  # the others meet nobody, and count in sizes only
    ranked = rank[inverse]
    edge = np.concatenate(([0], np.cumsum(sizes)))
    local = [np.sort(r[r < width]) for r in (ranked[edge[i] : edge[i + 1]] for i in range(len(sets)))]
    tree = PrefixTree(local, sizes)
    tree.limits()
    tree.index(percent)
    label = ids[tree.order].copy()
    for leaf in range(len(sets)):
        for other in tree.partners(leaf, percent, width, label):
            a, b = label[leaf], label[other]
            if a != b:
                label[label == max(a, b)] = min(a, b)
    out = np.empty(len(sets), np.int64)
    out[tree.order] = label
    return out


def _joined(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["block", "band", "id"])  # equal rows only: an id here is the number of a set
        found = []
        for _, block in pdf.groupby(["block", "band"], sort=False):
            ids = block["id"].to_numpy()
            found.append(pd.DataFrame({"a": ids, "b": join_block(ids, [np.frombuffer(x, np.uint64) for x in block["grams"]], percent)}))
        out = pd.concat(found) if found else pd.DataFrame({"a": [], "b": []}, dtype="int64")
        return out[out.a != out.b]

    return run


def _least_shared(n: Column, percent: int) -> Column:
    """L of a set of n: what its prefix shares at least with that of any linked set."""
    smallest = F.floor((F.lit(percent) * n + 99) / 100)
    e = F.floor(F.lit(100 - percent) * smallest / 100)
    return (F.floor(e / 2) + 1).cast("int")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """What tells rows apart: the id, the last for none, and a hash of the text and of having an id."""
    own = F.col(f"`{id_col}`").cast("long")
    return F.coalesce(own, F.lit(LAST)), F.xxhash64(F.col(f"`{text_col}`").cast("string"), own.isNull())


def _grouped(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, block_shingles: int = 1_000_000) -> DataFrame:
    """(own, id, v, n, root, least) of every row: number of its component, null for an empty set, and the least id there."""
    own, version = _rows(docs, id_col, text_col)
    rows = docs.select(own.alias("id"), version.alias("v"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sets = docs.select(F.col(f"`{id_col}`").cast("long").alias("own"), own.alias("id"), version.alias("v"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sets = sets.mapInArrow(_sketch(k, percent), "own long, id long, v long, n long, s1 long, s2 long, prefix array<long>")
    sets = materialise(sets.withColumn("row", F.monotonically_increasing_id()), "sets")
    key = ["n", "s1", "s2"]
    classes = materialise(sets.where("n > 0").groupBy(*key).agg(F.min("own").alias("rep"), F.min("row").alias("node")), "classes")
    alone = sets.join(classes, [*key], "inner").where("row = node").select(F.col("node").alias("id"), F.col("id").alias("doc"), "v", "n", "prefix")
    alone = materialise(alone, "representatives")
    postings = alone.select("id", "n", F.explode("prefix").alias("gram"))
    shared = postings.groupBy("gram").count().where("count > 1")
    met = postings.join(shared, "gram").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct(F.col("count").alias("df"), "gram"))).alias("met"))
    least = _least_shared(F.col("n"), percent)
    keys = met.where(F.size("met") >= least).select("id", "n", F.slice("met", F.lit(1), F.size("met") - least + 1)["gram"].alias("keys"))
    keys = materialise(keys, "keys")
    ties = keys.select("id", F.explode("keys").alias("gram"))
    hubs = ties.groupBy("gram").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1")
    coarse = components(ties.join(hubs, "gram").select(F.col("id").alias("a"), F.col("hub").alias("b")))
    members = coarse.unionByName(coarse.select(F.col("root").alias("id"), "root").distinct()).withColumnRenamed("root", "block")
    members = members.join(alone.select("id", "doc", "v", "n"), "id")
    members = materialise(members, "members")
    discard(alone)
    discard(keys)
    sizes = materialise(members.groupBy("block").agg(F.sum("n").alias("t")).where(F.col("t") > block_shingles).select("block"), "large")
    large = F.broadcast(sizes)
    banded = members.join(large, "block").select("id", "doc", "v", "n", "block").mapInArrow(_bands(percent), "id long, doc long, v long, n long, block long, band int")
    members = members.join(large, "block", "left_anti").select("id", "doc", "v", "n", "block", F.lit(-1).alias("band")).unionByName(banded)
    parts = banded.groupBy("block", "band").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("several"))
    members = members.join(F.broadcast(parts), ["block", "band"], "left").withColumn("parts", F.coalesce("several", F.lit(1)))
    members = materialise(members.select("id", "doc", "v", "block", "band", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "parts"), "members")
    total = members.count()
    full = rows.withColumnRenamed("id", "doc").join(members.hint("merge"), ["doc", "v"]).select("id", "text", "block", "band", "part", "parts")
    full = full.mapInArrow(_full_sets(k), "id long, block long, band int, part int, parts int, grams binary")
    # blocks that are not cut share tasks; a band of several parts has a task for each pair of parts
    other = F.explode(F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(-1))))
    full = full.withColumn("other", other)
    bins = max(24, total // 2000)
    task = F.when(F.col("band") < 0, F.struct(F.lit(-1).cast("long").alias("block"), F.lit(-1).alias("band"), F.pmod(F.xxhash64("block"), F.lit(bins)).cast("int").alias("i"), F.lit(0).alias("j")))
    task = task.otherwise(F.struct(F.col("block"), F.col("band"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")))
    links = materialise(full.groupBy(task.alias("task")).applyInPandas(_joined(percent), "a long, b long"), "pairs")
    roots = components(links) if not sizes.isEmpty() else links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    # the least id of each component with links
    linked = roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct()).withColumnRenamed("id", "node")
    least = linked.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "root")
    found = sets.select("own", "id", "v", *key).join(classes, key, "left").join(linked, "node", "left")
    return found.select("own", "id", "v", "n", F.coalesce("root", "node").alias("root"), F.coalesce("least", "rep", "own").alias("least"))


def similar(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return _grouped(docs, k, percent, id_col, text_col, block_shingles).select(F.col("own").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of least id, with all its columns; rows without a word all stay."""
    id_, v, place = (unused(docs, c) for c in ("__id", "__v", "__place"))
    per = _grouped(docs, k, percent, id_col, text_col).where("root is not null").groupBy("root", "id", "v").agg(F.count("*").alias("c"))
    per = materialise(per, "grouped")
    first = per.groupBy("root").agg(F.min(F.struct("id", "v")).alias("first"), F.sum("c").alias("rows")).where("rows > 1")
    odd = per.join(first, "root").select(F.col("id").alias(id_), F.col("v").alias(v), (F.struct("id", "v") == F.col("first")).alias("first"), "c")
    odd = materialise(odd.where("not first or c > 1").drop("c"), "odd")
    own, version = _rows(docs, id_col, text_col)
    marked = docs.withColumns({id_: own, v: version})
    columns = [f"`{c}`" for c in docs.columns]
    out = marked.join(odd.select(id_, v), [id_, v], "left_anti").select(*columns)
    twice = odd.where("first").select(id_, v)
    if twice.isEmpty():
        return out
    # of rows that repeat both id and text, one
    nth = F.row_number().over(Window.partitionBy(id_, v).orderBy(F.xxhash64(*[F.col(c) for c in columns])))
    kept = marked.join(twice, [id_, v], "left_semi").withColumn(place, nth).where(F.col(place) == 1)
    return out.unionByName(kept.select(*columns))

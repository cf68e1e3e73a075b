"""Operator 2, approximate nearest neighbours: one HNSW graph a shard, results merged.

Equal vectors are one node, which carries the least ids that may be asked for; so thousands of
copies of one vector neither fill its neighbour lists nor one task.  Nodes are dealt to shards
by a hash of the vector.  Each shard's graph is built in one task and stored as flat arrays:
the vectors, the nodes of each level, and fixed-width rows of neighbour numbers.  Queries go
in blocks to every shard; each block and shard is a task, so memory is bounded by one of
each.  The nearest found by all shards are merged and scored in double precision.

Search and insertion are done for many vectors in lockstep: each step takes the nearest
unexpanded candidate of every row and scores its neighbours in one array operation.

All distances are in double precision, so finite float components of any size keep their order.

Defined results: vectors that are null or zero, or hold null or non-finite components, and
rows without an id take no part; vectors of different lengths never meet; rows that repeat an
id are one candidate, at the least distance of their vectors, and one query, with the least of
their vectors in order of components; ties go to the smaller id; with fewer than k candidates
all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexforge.llm.scratch import materialise

#: Neighbours at upper levels (twice as many at the lowest) and breadth of building and searching.
LINKS, BUILD, SEARCH, BATCH = 16, 80, 160, 256


class Graph:
    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.vectors = np.ascontiguousarray(vectors, np.float64)
        self.squares = (self.vectors * self.vectors).sum(1)
        n = len(vectors)
        #: Distances computed so far.
        self.computed = 0
        u = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)).astype(np.int64), 8)
        top = int(self.level.max()) if n else -1
        #: Per level, a row of neighbours for each node; -1 fills up.
        self.near = [np.full((n, LINKS * (2 if l == 0 else 1)), -1, np.int32) for l in range(top + 1)]
        self.entry, self.top = -1, -1

    def build(self) -> "Graph":
        n, done = len(self.vectors), 0
        while done < n:
            size = min(BATCH, max(1, done // 4), n - done)
            self._insert(np.arange(done, done + size))
            done += size
        return self

    def _distance(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        self.computed += ids.size
        return np.maximum(self.squares[ids] + (q * q).sum(1)[:, None] - 2 * np.matmul(self.vectors[ids], q[:, :, None])[:, :, 0], 0)

    def layer(self, q: np.ndarray, entry: np.ndarray, level: int, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest found from entry (B, e) on one level: ids and squared distances, nearest first."""
        rows, near = len(q), self.near[level]
        ids = np.full((rows, breadth), -1, np.int64)
        dist = np.full((rows, breadth), np.inf)
        spent = np.ones((rows, breadth), bool)
        seen = np.zeros((rows, len(self.vectors)), bool)
        e = entry.shape[1]
        ids[:, :e], dist[:, :e], spent[:, :e] = entry, self._distance(q, entry), False
        seen[np.arange(rows)[:, None], entry] = True
        active = np.arange(rows)
        while len(active):
            open_ = np.where(spent[active], np.inf, dist[active])
            at = open_.argmin(1)
            more = np.isfinite(open_[np.arange(len(active)), at])
            active, at = active[more], at[more]
            if not len(active):
                break
            spent[active, at] = True
            around = near[ids[active, at]].astype(np.int64)
            fresh = (around >= 0) & ~seen[active[:, None], np.maximum(around, 0)]
            seen[active[:, None], np.maximum(around, 0)] |= fresh
            d = np.where(fresh, self._distance(q[active], np.maximum(around, 0)), np.inf)
            all_d = np.concatenate([dist[active], d], 1)
            best = np.argsort(all_d, 1, kind="stable")[:, :breadth]
            all_ids = np.concatenate([ids[active], around], 1)
            all_spent = np.concatenate([spent[active], np.zeros(d.shape, bool)], 1)
            row = np.arange(len(active))[:, None]
            ids[active], dist[active], spent[active] = all_ids[row, best], all_d[row, best], all_spent[row, best]
        return ids, dist

    def _choose(self, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Neighbours in different directions: each kept one is nearer to the node than to any kept before."""
        ids, first = np.unique(ids, return_index=True)
        order = np.argsort(dist[first], kind="stable")[: 4 * most]
        ids, dist = ids[order], dist[first][order]
        if len(ids) <= most // 2:
            return ids
        v = self.vectors[ids]
        sq = (v * v).sum(1)
        between = sq[:, None] + sq[None, :] - 2 * (v @ v.T)
        closest = np.full(len(ids), np.inf)
        kept = []
        for i in range(len(ids)):
            if dist[i] < closest[i]:
                kept.append(i)
                if len(kept) == most:
                    break
                np.minimum(closest, between[i], out=closest)
        if len(kept) < most:  # fill up with the nearest of the rest
            kept += [i for i in range(len(ids)) if i not in set(kept)][: most - len(kept)]
        return ids[kept]

    def _insert(self, new: np.ndarray) -> None:
        q, old_top = self.vectors[new], self.top
        entry = np.full((len(new), 1), max(self.entry, 0), np.int64)
        for level in range(max(old_top, int(self.level[new].max())), -1, -1):
            here = np.flatnonzero(self.level[new] >= level)
            found = np.zeros((len(new), 0), np.int64), np.zeros((len(new), 0))
            if level <= old_top:
                found = self.layer(q, entry, level, BUILD if level == 0 else 16)
                entry = found[0][:, : 1 if level else 4]
                entry = np.where(entry < 0, entry[:, :1], entry)
            if len(here):
                self._connect(new[here], found[0][here], found[1][here], level)
        if self.level[new].max() > old_top:
            self.entry = int(new[self.level[new].argmax()])
            self.top = int(self.level[new].max())

    def _connect(self, nodes: np.ndarray, ids: np.ndarray, dist: np.ndarray, level: int) -> None:
        near, v = self.near[level], self.vectors[nodes]
        most = near.shape[1]
        sq = (v * v).sum(1)
        own = np.maximum(sq[:, None] + sq[None, :] - 2 * (v @ v.T), 0)
        back: dict[int, list[int]] = {}
        for i, node in enumerate(nodes.tolist()):
            ok = ids[i] >= 0
            others = np.arange(len(nodes)) != i
            c = np.concatenate([ids[i][ok], nodes[others]])
            d = np.concatenate([dist[i][ok], own[i][others]])
            chosen = self._choose(c, d, LINKS)
            near[node, : len(chosen)] = chosen
            for x in chosen.tolist():
                back.setdefault(x, []).append(node)
        for node, more in back.items():
            row = near[node]
            c = np.union1d(row[row >= 0], more)
            if len(c) > most:
                c = self._choose(c, self._distance(self.vectors[[node]], c[None, :])[0], most)
            near[node] = -1
            near[node, : len(c)] = c

    def search(self, q: np.ndarray, k: int) -> np.ndarray:
        """(B, k) numbers of the nearest nodes found, -1 where there are none."""
        q = np.ascontiguousarray(q, np.float64)
        entry = np.full((len(q), 1), self.entry, np.int64)
        for level in range(self.top, 0, -1):
            entry = self.layer(q, entry, level, 8)[0][:, :1]
        return self.layer(q, entry, 0, max(SEARCH, k))[0][:, :k]

    def flat(self) -> dict[str, object]:
        nodes = [np.flatnonzero(self.level >= l).astype(np.int32) for l in range(self.top + 1)]
        return {"entry": self.entry, "level_sizes": [len(x) for x in nodes], "level_nodes": np.concatenate(nodes).tobytes(), "neighbours": b"".join(self.near[l][x].tobytes() for l, x in enumerate(nodes))}

    @classmethod
    def load(cls, vectors: np.ndarray, entry: int, level_sizes, level_nodes: bytes, neighbours: bytes) -> "Graph":
        out = cls.__new__(cls)
        out.vectors, out.entry, out.top, out.computed = np.ascontiguousarray(vectors, np.float64), entry, len(level_sizes) - 1, 0
        out.squares = (out.vectors * out.vectors).sum(1)
        nodes, flat, out.near, at, cell = np.frombuffer(level_nodes, np.int32), np.frombuffer(neighbours, np.int32), [], 0, 0
        for l, size in enumerate(level_sizes):
            width = LINKS * (2 if l == 0 else 1)
            near = np.full((len(vectors), width), -1, np.int32)
            near[nodes[at : at + size]] = flat[cell : cell + size * width].reshape(size, width)
            out.near.append(near)
            at, cell = at + size, cell + size * width
        return out


INDEX = "dim int, shard int, entry int, level_sizes array<int>, level_nodes binary, neighbours binary, vectors binary, ids array<array<long>>"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("first")
    vectors = np.array(pdf["vec"].tolist(), np.float64)
    row = Graph(vectors).build().flat() | {"dim": pdf["dim"].iloc[0], "shard": pdf["shard"].iloc[0], "vectors": vectors.tobytes(), "ids": [list(x) for x in pdf["ids"]]}
    return pd.DataFrame([row])[["dim", "shard", "entry", "level_sizes", "level_nodes", "neighbours", "vectors", "ids"]]


def _find(k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if index.empty or queries.empty:
            return none
        row, out = index.iloc[0], []
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, int(row["dim"]))
        graph = Graph.load(vectors, int(row["entry"]), row["level_sizes"], row["level_nodes"], row["neighbours"])
        for start in range(0, len(queries), BATCH):
            part = queries.iloc[start : start + BATCH]
            q = np.array(part["vec"].tolist(), np.float64)
            near = graph.search(q, 2 * k)
            for i, own in enumerate(part["query_id"].tolist()):
                nodes = near[i][near[i] >= 0]
                diff = (vectors[nodes] - q[i]) ** 2
                score = np.sqrt(np.add.accumulate(diff, 1)[:, -1])  # one component after the other
                best: dict[int, float] = {}
                for s, node in sorted(zip(score.tolist(), nodes.tolist(), strict=True)):
                    for x in row["ids"][node]:
                        if x != own:
                            best.setdefault(x, s)
                out += [(own, x, s) for s, x in sorted((s, x) for x, s in best.items())[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else none

    return run


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def index(rows: DataFrame, k: int, shard_rows: int = 16384, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """The flat graphs of all shards, as a table in the shared folder, and the number of shards."""
    v = F.col(vec_col).cast("array<double>")
    rows = rows.where(F.col(id_col).isNotNull() & usable(v)).select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).distinct()
    # the k + 1 least ids of each vector: salted first, then of what is left
    salted = W.partitionBy("vec", "salt").orderBy("id")
    every = W.partitionBy("vec").orderBy("id")
    least = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    least = least.withColumn("n", F.row_number().over(every)).where(F.col("n") <= k + 1)
    nodes = least.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = materialise(nodes.select("vec", "ids", F.get("ids", F.lit(0)).alias("first"), F.size("vec").alias("dim")), "vectors")
    shards = max(1, -(-nodes.count() // shard_rows))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"))
    return materialise(nodes.groupBy("dim", "shard").applyInPandas(_build, INDEX), "graphs"), shards


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 16384, query_block: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each query but itself."""
    graphs, shards = index(rows, k, shard_rows, id_col, vec_col)
    v = F.col(vec_col).cast("array<double>")
    q = queries.where(F.col(id_col).isNotNull() & usable(v)).groupBy(F.col(id_col).cast("long").alias("query_id")).agg(F.min(v).alias("vec"))
    q = materialise(q, "queries")
    blocks = max(1, -(-q.count() // query_block))
    q = q.select("query_id", "vec", F.size("vec").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    g = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["dim", "shard", "block"]
    hits = g.groupBy(*key).cogroup(q.groupBy(*key)).applyInPandas(_find(k), "query_id long, vec_id long, score double")
    hits = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

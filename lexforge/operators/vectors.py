"""Cosine neighbours, mutual links, clusters and medoids over unit vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from lexforge.operators.graph import components, cut


def _tiles(n: int, first: int = 256, most: int = 2048) -> list[slice]:
    """Slices of a growing length, so that the least of the best is known after few rows."""
    out, at = [], 0
    while at < n:
        out.append(slice(at, min(n, at + first)))
        at, first = at + first, min(first * 2, most)
    return out


class _Best:
    """The k best found so far of each row: rounded and full similarity, and the other's id; ties by the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.key, self.sim, self.j = np.full((n, k), -np.inf), np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, r: np.ndarray, j: np.ndarray, sim: np.ndarray) -> None:
        if not len(r):
            return
        rows = np.unique(r)
        r = np.concatenate([np.repeat(rows, self.k), r])
        j, sim = np.concatenate([self.j[rows].ravel(), j]), np.concatenate([self.sim[rows].ravel(), sim])
        key = np.round(sim, 9)
        order = np.lexsort((j, -key, r))
        first = np.searchsorted(r[order], rows)  # each row has k or more here
        take = order[first[:, None] + np.arange(self.k)]
        self.key[rows], self.sim[rows], self.j[rows] = key[take], sim[take], j[take]

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = np.isfinite(self.sim)
        return np.repeat(ids, self.k)[some.ravel()], self.j[some], self.sim[some]


def _hits(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of what is true in a table that is nearly all false."""
    flat = close.ravel()
    if flat.size % 8:
        return np.nonzero(close)
    words = np.flatnonzero(flat.view(np.uint64))
    at, bit = np.nonzero(flat.reshape(-1, 8)[words])
    return np.divmod(words[at] * 8 + bit, close.shape[1])


def _meet(a: np.ndarray, ai: np.ndarray, c: np.ndarray, ci: np.ndarray, k: int, both: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best in c of each row of a and, if both, the other way round; rows are sorted by id.

    Products in single precision only rule out: what comes within their error of the k-th best so far is
    computed in double precision, and a tile with too much of that as a whole.
    """
    lengths = [np.sqrt((x.astype(np.float64) ** 2).sum(1)) for x in (a, c)]
    most = [x.max(initial=0.0) for x in lengths]
    rough = max(most) < 1e15
    a32, c32 = (x.astype(np.float32, copy=False) for x in (a, c))
    unit = (a.shape[1] + 8) * 2.0**-23
    slack = [lengths[0] * most[1] * unit + 1e-8, lengths[1] * most[0] * unit + 1e-8]
    best, other = _Best(len(a), k), _Best(len(c) if both else 0, k)
    for s in _tiles(len(a)):
        for t in _tiles(len(c)):
            sims = a32[s] @ c32[t].T if rough else None
            exact = None
            for side, top, u in ((0, best, s), (1, other, t))[: 1 + both]:
                if rough:
                    least = (top.key[u, -1] - slack[side][u]).astype(np.float32)
                    close = sims >= (least if side else least[:, None])
                if rough and np.count_nonzero(close) * 16 < close.size:
                    x, y = _hits(close)
                    other_id = ai[s][x] != ci[t][y]
                    x, y = x[other_id], y[other_id]
                    sim = np.concatenate([np.einsum("ij,ij->i", a[s][x[p : p + 65536]].astype(np.float64), c[t][y[p : p + 65536]].astype(np.float64)) for p in range(0, max(1, len(x)), 65536)])
                else:
                    if exact is None:
                        exact = a[s].astype(np.float64) @ c[t].astype(np.float64).T
                        exact[ai[s][:, None] == ci[t][None, :]] = -np.inf
                    table = exact.T if side else exact
                    at = np.argsort(-np.round(table, 9), 1, kind="stable")[:, :k]
                    x, y = np.repeat(np.arange(len(table)), at.shape[1]), at.ravel()
                    sim = table[x, y]
                    x, y = (y, x) if side else (x, y)
                r, j = (t.start + y, ai[s][x]) if side else (s.start + x, ci[t][y])
                top.add(r, j, sim)
    return [best.found(ai), other.found(ci)][: 1 + both]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    if lists.null_count or len(set(lists.value_lengths().unique().to_pylist())) > 1:
        raise ValueError("vectors of different lengths")
    values = lists.flatten()
    return values.to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def nearest(vectors: DataFrame, k: int = 10, blocks: int = 12, least: int = 2048, most: int = 65536, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(i, j, sim, rank): the k most similar others of each vector; ties by the smaller id.

    Vectors are dealt into blocks and each two blocks are a task, which looks both ways.  Up to blocks * most
    vectors there are no more blocks than that, so what is shuffled, some k rows per vector and block, grows with
    the table; beyond, blocks no longer grow, so a task's memory does not.  Products grow with the table's square.
    """
    kind = vectors.schema[vec_col].dataType.elementType
    number = "float" if isinstance(kind, FloatType) else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{number}>").alias("v"))
    n = rows.count()
    parts = max(1, -(-n // most), min(blocks, -(-n // least)))
    tasks = parts * (parts + 1) // 2
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    p, q = F.least("b", "o"), F.greatest("b", "o")
    dealt = dealt.select("id", "v", "b", p.alias("p"), q.alias("q"), (q * (q + 1) / 2 + p).cast("int").alias("task"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [x for x in batches if x.num_rows]
        if not every:
            return
        given = pa.Table.from_batches(every)
        vec = _matrix(given["v"])
        ids, b, p, q = (given[c].to_numpy() for c in ("id", "b", "p", "q"))
        usable = np.isfinite(vec).all(1)
        for key in np.unique(given["task"].to_numpy()):
            mine = usable & (given["task"].to_numpy() == key)
            if not mine.any():
                continue
            sides = [np.flatnonzero(mine & (b == one[mine][0])) for one in (p, q)]
            sides = [at[np.argsort(ids[at], kind="stable")] for at in sides]
            both = bool(p[mine][0] != q[mine][0])
            for i, j, sim in _meet(vec[sides[0]], ids[sides[0]], vec[sides[1]], ids[sides[1]], k, both):
                yield from pa.table({"i": i, "j": j, "sim": sim}).to_batches(max_chunksize=100_000)

    found = dealt.repartitionById(tasks, "task").mapInArrow(pairs, "i long, j long, sim double")
    order = W.partitionBy("i").orderBy(F.round("sim", 9).desc(), "j")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mutual(neighbours: DataFrame) -> DataFrame:
    """(i, j, sim), i < j, where each is among the other's neighbours."""
    neighbours = cut(neighbours.select("i", "j", "sim"))  # else both sides would find them
    back = neighbours.select(F.col("i").alias("j"), F.col("j").alias("i"))
    return neighbours.join(back, ["i", "j"]).where("i < j").select("i", "j", "sim")


def clusters(ids: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """(id, cluster): connected components over links of at least threshold; the least id names a cluster."""
    roots = components(links.where(F.col("sim") >= threshold).select(F.col("i").alias("a"), F.col("j").alias("b")))
    return ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))


def ranked_sizes(members: DataFrame) -> DataFrame:
    """(cluster, size, index): largest first, then the least member."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    return sizes.withColumn("index", F.row_number().over(W.orderBy(F.col("size").desc(), "cluster")) - 1)


def medoids(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(cluster, medoid): the member nearest to the sum of its cluster, first id on a tie.

    Sums are made per component with partial sums before the shuffle.
    """
    rows = members.join(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")), "id")
    parts = rows.select("cluster", "id", F.posexplode("v").alias("d", "x"))
    sums = parts.groupBy("cluster", "d").agg(F.sum("x").alias("s"))
    dots = parts.join(sums, ["cluster", "d"]).groupBy("cluster", "id").agg(F.round(F.sum(F.col("x") * F.col("s")), 9).alias("dot"))
    best = F.min(F.struct((-F.col("dot")).alias("d"), "id"))["id"]
    return dots.groupBy("cluster").agg(best.alias("medoid"))

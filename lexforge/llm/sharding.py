"""Operator 9, sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**16 segments.  A document's segment comes from a hash of its id and text
checksum, so rows that repeat one id spread out, and each shard's virtual nodes sit at
segments hashed from their names.  A document belongs to the next virtual node clockwise;
where that node's shard is full, it continues clockwise to the next node whose shard has
room.  With ``slack`` 0 the bounds are the even counts themselves, floor and ceiling of rows /
shards, so shards differ by one row at most (law ``rows``); the price is that a full shard's
overflow moves between old shards when one is added.

All documents of a segment meet the same nodes, so who goes where depends on the counts of
the segments alone: 65,536 numbers whatever the table's size.  The driver walks that table
once round the ring and gets, for each segment, which ranks go to which shard and from which
slot on.  Rows equal in id, size and checksum are counted first, before the shuffle, and take
a range of ranks together, so a row repeated any number of times is one row of each task.

Defined results: a null text has no bytes, size 8 and crc32 0; a null id hashes as none; a
very long text counts whole; rows of a segment are ranked by id, size and checksum, and equal
rows are interchangeable; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexforge.llm.scratch import materialise

SEGMENTS = 1 << 16


def segment(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(SEGMENTS)).cast("int")


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(segment, shard) of all virtual nodes, clockwise."""
    return sorted((zlib.crc32(f"shard {s} node {v}".encode()) % SEGMENTS, s) for s in range(shards) for v in range(nodes))


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack > 0:
        return [-(-int(rows * (1 + slack)) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def assign(counts: dict[int, int], shards: int, nodes: int = 64, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Walks the ring: (segment, first rank, end rank, shard, slot of the first rank).

    Each segment's rows go to the next node clockwise with room; a node whose shard is full
    is taken off the ring, so the walk costs one step for each cut and each full node.
    """
    room = capacities(sum(counts.values()), shards, slack)
    used = [0] * shards
    open_nodes = [x for x in ring(shards, nodes) if room[x[1]] > 0]
    out = []
    for seg in sorted(counts):
        rank, left = 0, counts[seg]
        while left:
            at = bisect.bisect_left(open_nodes, (seg, -1)) % len(open_nodes)
            shard = open_nodes[at][1]
            take = min(left, room[shard])
            if take:
                out.append((seg, rank, rank + take, shard, used[shard]))
                used[shard] += take
                room[shard] -= take
                rank += take
                left -= take
            if not room[shard]:
                open_nodes = [x for x in open_nodes if x[1] != shard]
    return out


def shard(docs: DataFrame, shards: int = 24, nodes: int = 64, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of docs.

    One narrow table (no texts) of different rows is written and then ranked and looked up.
    The cuts are at most one for each segment and one for each node, so broadcasting them has a
    fixed bound.
    """
    text = F.col(f"`{text_col}`").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("__rows"))
    rows = materialise(rows.withColumn("segment", segment(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string")))), "shards")
    counts = {r["segment"]: r["n"] for r in rows.groupBy("segment").agg(F.sum("__rows").alias("n")).collect()}  # SEGMENTS at most
    cuts = assign(counts, shards, nodes, slack)
    plan = docs.sparkSession.createDataFrame(pd.DataFrame(cuts, columns=["segment", "__from", "__to", "shard", "__slot"]).astype("int64"), "segment int, __from long, __to long, shard int, __slot long")
    upto = F.sum("__rows").over(W.partitionBy("segment").orderBy("doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, 0))
    ranked = rows.withColumn("__end", upto).withColumn("__rank", F.col("__end") - F.col("__rows"))
    here = (ranked.segment == plan.segment) & (ranked["__end"] > plan["__from"]) & (ranked["__rank"] < plan["__to"])
    # ranks of one row of counts, some at a time, as there may be any number
    first, last, step = F.greatest("__rank", "__from"), F.least("__end", "__to") - 1, 1 << 16
    dealt = ranked.join(F.broadcast(plan), here).select("doc_id", "size", "text_crc32", "shard", (F.col("__slot") - F.col("__from")).alias("__add"), last.alias("__last"), F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("__some"))
    dealt = dealt.withColumn("__one", F.explode(F.sequence("__some", F.least(F.col("__some") + step - 1, "__last"))))
    return dealt.select("doc_id", "size", "text_crc32", "shard", (F.col("__one") + F.col("__add")).cast("long").alias("slot"))

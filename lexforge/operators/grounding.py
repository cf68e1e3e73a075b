"""Claims and quotes, and the sources nearest to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexforge.functions.text import tokens


def best_source(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """(claim_id, chunk_index, overlap): per claim the chunk with most of its distinct tokens, the earliest on a tie.

    Both sides are within one reply (reply_id), so the join is on the reply and a token.
    """
    left = claims.select("reply_id", "claim_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("t"))
    right = chunks.select("reply_id", "chunk_index", F.explode(F.array_distinct(tokens(F.col("text")))).alias("t"))
    size = left.groupBy("claim_id").agg(F.count("*").alias("n"))
    hits = left.join(right, ["reply_id", "t"]).groupBy("claim_id", "chunk_index").count().join(size, "claim_id")
    hits = hits.withColumn("overlap", F.round(F.col("count") / F.col("n"), 6))
    order = W.partitionBy("claim_id").orderBy(F.col("overlap").desc(), "chunk_index")
    return hits.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("claim_id", "chunk_index", "overlap")


def nearest_quote(markers: DataFrame, quotes: DataFrame, within: int = 400) -> DataFrame:
    """(marker_id, quote_id, gap): the quote (start, end) nearest to a marker's place, the first on a tie."""
    gap = F.when(F.col("pos") < F.col("start"), F.col("start") - F.col("pos")).when(F.col("pos") > F.col("end"), F.col("pos") - F.col("end")).otherwise(F.lit(0))
    both = markers.join(quotes, "reply_id").withColumn("gap", gap).where(F.col("gap") <= within)
    order = W.partitionBy("marker_id").orderBy("gap", "quote_id")
    return both.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("marker_id", "quote_id", "gap")

"""Percentiles, quotas and the final document score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexforge.operators.graph import cut


def percentile(score: Column, *keys: str) -> Column:
    """Tie-averaged percentile in [0, 1], per group of keys; equal up to 12 decimals is a tie; a single row has 1."""
    s = F.round(score, 12)
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    order = group.orderBy(s)
    ties = W.partitionBy(*keys, s) if keys else W.partitionBy(s)
    n = F.count(F.lit(1)).over(group)
    mean = F.rank().over(order) - 1 + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
    return F.when(n == 1, F.lit(1.0)).otherwise(mean / F.greatest(n - 1, F.lit(1)).cast("double"))


def quotas(sizes: DataFrame, k: int) -> DataFrame:
    """(cluster, size) to (cluster, size, quota): largest remainders, then larger clusters, then smaller numbers."""
    every = W.partitionBy(F.lit(0))
    exact = F.lit(k) * F.col("size") / F.sum("size").over(every)
    rows = sizes.withColumn("whole", F.floor(F.lit(k) * F.col("size") / F.sum("size").over(every))).withColumn("rest", F.round(exact - F.floor(exact), 12))
    rows = rows.withColumn("left", F.lit(k) - F.sum("whole").over(every))
    order = every.orderBy(F.col("rest").desc(), F.col("size").desc(), "cluster")
    return rows.select("cluster", "size", (F.col("whole") + (F.row_number().over(order) <= F.col("left")).cast("long")).alias("quota"))


def within_quota(scored: DataFrame, quota: DataFrame) -> DataFrame:
    """The best rows of each cluster (doc_id, cluster, score) as far as its quota goes."""
    order = W.partitionBy("cluster").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rn", F.row_number().over(order)).join(quota.select("cluster", "quota"), "cluster").where("rn <= quota").drop("quota")


def final_score(repr_: Column, novelty: Column, pagerank: Column, alpha: float = 0.25, weight: float = 0.2) -> Column:
    return alpha * ((1 - weight) * repr_ + weight * novelty) + (1 - alpha) * pagerank


def with_percentile(scored: DataFrame, score: str, into: str = "percentile") -> DataFrame:
    """percentile() over the whole table, without a task that sees all of it.

    Scores are counted, dealt by range and summed within ranges; the sums of the ranges before
    are a table with a row for each range.
    """
    rows = cut(scored).withColumn("__s", F.round(F.col(score), 12))  # read twice, computed once
    ties = cut(rows.groupBy("__s").agg(F.count("*").alias("__n")).repartitionByRange("__s").withColumn("__range", F.spark_partition_id()))
    ranges = ties.groupBy("__range").agg(F.sum("__n").alias("__in"), F.min("__s").alias("__least"))
    before = W.partitionBy(F.lit(0)).orderBy(F.col("__least").asc_nulls_first())
    ranges = ranges.withColumn("__before", F.sum("__in").over(before) - F.col("__in")).withColumn("__all", F.sum("__in").over(W.partitionBy(F.lit(0))))
    own = W.partitionBy("__range").orderBy("__s")
    ties = ties.withColumn("__upto", F.sum("__n").over(own) - F.col("__n")).join(ranges, "__range")
    mean = F.col("__before") + F.col("__upto") + (F.col("__n") - 1) / F.lit(2.0)
    value = F.when(F.col("__all") == 1, F.lit(1.0)).otherwise(mean / F.greatest(F.col("__all") - 1, F.lit(1)).cast("double"))
    ties = ties.select(F.col("__s").alias("__tie"), value.alias(into))
    return rows.join(ties, F.col("__s").eqNullSafe(F.col("__tie"))).drop("__s", "__tie")

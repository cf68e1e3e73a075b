"""Operator 8, mixing sources to target weights by repetition rates.

Tokens are summed by source; each source's target follows from its weight, and its rate is
target / tokens.  A document is emitted floor(rate) times, plus once more if a number in
[0, 1) hashed from seed and id lies under the fraction.  The same seed gives the same mix.

Targets: the total to take, shared by weight; where a share would pass ``most`` times the
source's size it stops there and the excess is shared again.  That is a water level: the
source's target is min(most * size, level * weight).  Sources sorted by size / weight reach
their limit in this order, so the level follows from running sums over the table of
sources, without a loop.

Defined results: a null source is a source of its own, last in order; a null or empty text
has size 0 and its rate is its source's; a very long text counts whole; a source without tokens
has target 0 and its documents rate 0; repeated rows are emitted alike; extra columns stay, and
where one is named like an added column, that gets underscores behind its name; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexforge.llm.scratch import unused

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def unit(seed: str, key: Column) -> Column:
    """A number in [0, 1) with 32 bits, hashed from seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target, rate).

    Sources take the weights in turn, by code point order with null last.  The windows run
    over one row for each source, after all sums.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    everyone = W.partitionBy(F.lit(0))
    by_limit = everyone.orderBy(F.col("source_size") / F.col("weight"), "place")
    level = (F.lit(share) * F.sum("source_size").over(everyone) - F.lit(most) * F.coalesce(F.sum("source_size").over(by_limit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))) / (F.sum("weight").over(by_limit.rowsBetween(0, W.unboundedFollowing)))
    # the first source, in order of limits, that the level of the rest does not fill
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.lit(most) * F.col("source_size"), F.struct("pos", "level"))).over(everyone)
    return (
        sizes.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("pos", F.row_number().over(by_limit))
        .withColumn("level", level)
        .withColumn("free", free)
        .withColumn("target", F.when(F.col("free").isNull() | (F.col("pos") < F.col("free.pos")), F.lit(most) * F.col("source_size")).otherwise(F.col("free.level") * F.col("weight")).cast("double"))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .select("source", "source_size", "target", "rate")
    )


def column(docs: DataFrame) -> str:
    """Name of the struct column that mix() adds: ``mix``, with underscores if docs has that."""
    return unused(docs, "mix")


def mix(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None) -> DataFrame:
    """Adds a struct column (size, source_size, target, rate, copies), named by column(), to docs.

    Sizes are summed over all documents with partial sums before the shuffle, so a source
    that holds most rows costs no more than others; ``size_col`` names them where they are
    known.  The plan of the sources goes to every task; beyond Spark's own broadcast limit the
    join is an ordinary one.
    """
    size, source, plan_source, planned = (unused(docs, c) for c in ("__size", "__source", "__plan_source", "__plan"))
    sized = docs.withColumns({size: n_words(F.col(f"`{text_col}`")) if size_col is None else F.col(f"`{size_col}`"), source: F.col(f"`{source_col}`").cast("string")})
    plan = targets(sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size")), list(weights), share, most)
    plan = plan.select(F.col("source").alias(plan_source), F.struct("source_size", "target", "rate").alias(planned))
    both = sized.join(plan, F.col(source).eqNullSafe(F.col(plan_source)), "left")
    rate = F.col(planned)["rate"]
    extra = (unit(seed, F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) < rate - F.floor(rate)).cast("long")
    return both.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(F.col(size).alias("size"), F.col(planned)["source_size"].alias("source_size"), F.col(planned)["target"].alias("target"), rate.alias("rate"), (F.floor(rate).cast("long") + extra).alias("copies")).alias(column(docs)),
    )


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mixed rows themselves: each document as often as its copies say, with the columns of docs."""
    mixed = mix(docs, **how)
    copies = F.explode(F.array_repeat(F.lit(True), F.col(column(docs))["copies"].cast("int")))
    return mixed.withColumn(unused(mixed, "__copy"), copies).select(*[F.col(f"`{c}`") for c in docs.columns])

"""What a reader of a cited page needs: page order, marked spans, quotes and source chips."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: shorter quotes are not told apart from chance.
LEAST_QUOTE = 12


@F.pandas_udf(StringType())
def joined_letters(text: pd.Series) -> pd.Series:
    """Lower-case letters a-z and digits of a text, marks taken off; Spark has no function that decomposes them."""

    def one(t):
        plain = unicodedata.normalize("NFKD", t or "").lower()
        return "".join(c for c in plain if c.isascii() and c.isalnum())

    return text.map(one)


def page_order(first: Column, last: Column, pages: Column) -> Column:
    """All page numbers from 1: the recorded range widened by one on either side, then the rest; null without pages."""
    lo, hi = F.greatest(F.lit(1), first - 1), F.least(pages, last + 1)
    recorded = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    return F.when(pages >= 1, F.array_union(recorded, F.sequence(F.lit(1), pages)))


def overlapping(spans: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of spans (start, end) that share a place with [start, end)."""
    return spans.where((F.col("end") > start) & (F.col("start") < end))


def relevant_quotes(quotes: DataFrame) -> DataFrame:
    """(sentence, quote, ...) rows whose quote stands in the citing sentence; all of them where there is none."""
    mine, own = joined_letters("sentence"), joined_letters("quote")
    rows = quotes.withColumns({"__in": mine, "__quote": own})
    kept = (F.col("__in") == "") | ((F.length("__quote") >= LEAST_QUOTE) & F.col("__in").contains(F.col("__quote")))
    return rows.where(kept).drop("__in", "__quote")


def chips(sources: DataFrame) -> DataFrame:
    """(reply_id, place, doc_id, cited, verified) to a row a document of a reply: its first cited place, and is any verified?"""
    rows = sources.where("cited")
    return rows.groupBy("reply_id", "doc_id").agg(F.min("place").alias("place"), F.bool_or(F.coalesce("verified", F.lit(False))).alias("verified"))


def highlights(hits: DataFrame) -> DataFrame:
    """(target, page, item) to a row a page: its distinct items in order, and is it the target's first page?"""
    pages = hits.groupBy("target", "page").agg(F.sort_array(F.collect_set("item")).alias("items"))
    first = hits.groupBy("target").agg(F.min("page").alias("first"))
    return pages.join(first, "target").select("target", "page", "items", (F.col("page") == F.col("first")).alias("scroll_here"))

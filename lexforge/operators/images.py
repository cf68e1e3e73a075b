"""Statistics of page images given as one row a pixel; nothing larger than a histogram is grouped.

Null levels count nowhere; a page without any is not in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVELS = 256


def histogram(pixels: DataFrame) -> DataFrame:
    """(page, level) to (page, level, n) of the levels that occur."""
    return pixels.where("level IS NOT NULL").groupBy("page", "level").agg(F.count("*").alias("n"))


def full_histogram(pixels: DataFrame) -> DataFrame:
    """All 256 levels of each page, absent ones with 0."""
    found = histogram(pixels)
    every = found.select("page").distinct().select("page", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    return every.join(found, ["page", "level"], "left").select("page", "level", F.coalesce("n", F.lit(0)).alias("n"))


def otsu(pixels: DataFrame) -> DataFrame:
    """(page, threshold): the level that parts dark from light with the largest variance between both.

    The lowest of equal ones; 0 where all pixels have one level.
    """
    page = W.partitionBy("page")
    upto = page.orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    weighted = F.col("level") * F.col("n")
    rows = histogram(pixels).select(
        "page", "level", F.sum("n").over(upto).alias("dark"), F.sum(weighted).over(upto).alias("dark_sum"), F.sum("n").over(page).alias("all"), F.sum(weighted).over(page).alias("all_sum")
    )
    light = F.col("all") - F.col("dark")
    apart = F.col("dark_sum") / F.col("dark") - (F.col("all_sum") - F.col("dark_sum")) / light
    between = F.when(light > 0, F.col("dark") * light * apart * apart).otherwise(0.0)
    best = F.max(F.struct(between.alias("v"), (-F.col("level")).alias("l")))
    return rows.groupBy("page").agg(best.alias("b")).select("page", F.when(F.col("b.v") > 0, -F.col("b.l")).otherwise(0).cast("int").alias("threshold"))


def row_variance(pixels: DataFrame, ink_below: int = 128) -> DataFrame:
    """(page, row, level) to (page, variance): of the ink counts of its rows, largest where lines are level."""
    rows = pixels.groupBy("page", "row").agg(F.count(F.when(F.col("level") < ink_below, 1)).alias("ink"))
    return rows.groupBy("page").agg(F.var_pop("ink").alias("variance"))


def blank(pixels: DataFrame, above: int = 250, share: float = 0.99) -> DataFrame:
    """(page, blank): are more than that share of its pixels lighter?"""
    light = F.count(F.when(F.col("level") > above, 1)) / F.count("level")
    return pixels.where("level IS NOT NULL").groupBy("page").agg((light > share).alias("blank"))


def routed(docs: DataFrame, pages: DataFrame, most: float = 0.3) -> DataFrame:
    """(doc) and pages (doc, kind) to (doc, converter, scanned): few pages other than digital, or OCR; also without pages."""
    share = F.avg((F.col("kind") != "digital").cast("double"))
    per = pages.groupBy("doc").agg(share.alias("share"), F.count(F.when(F.col("kind") == "scanned", 1)).alias("scanned"))
    out = docs.join(per, "doc", "left")
    return out.select("doc", F.when(F.col("share") < most, "digital").otherwise("ocr").alias("converter"), F.coalesce("scanned", F.lit(0).cast("long")).alias("scanned"))


def page_reports(pages: DataFrame) -> DataFrame:
    """(doc, page, kind, density, blank) to a row a document: number of pages and its pages in order."""
    page = F.struct("page", "kind", "density", "blank")
    return pages.groupBy("doc").agg(F.count("*").alias("n_pages"), F.array_sort(F.collect_list(page)).alias("pages"))

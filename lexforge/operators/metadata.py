"""Bibliographic records of a registry: their normal form and their overlay over a document's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as T

RECORD = """author array<struct<given:string,family:string>>, abstract string, issued struct<`date-parts`:array<array<int>>>, `is-referenced-by-count` bigint,
    reference array<struct<`article-title`:string,`volume-title`:string,author:string,DOI:string,unstructured:string>>"""


def _or_null(c):
    return F.nullif(F.trim(c), F.lit(""))


def normalise(works: DataFrame, year: int, month: int) -> DataFrame:
    """(doi, work as JSON) to one row a DOI: title, authors, abstract, created, refs, cited_by.

    A null work is a known miss: its row stays, with ``hit`` false.  Dates after the given
    month are left out, a broken JSON gives a hit without values.
    """
    w = F.from_json("work", RECORD)
    raw = F.get_json_object("work", "$.title")
    title = _or_null(F.when(raw.startswith("["), F.get_json_object("work", "$.title[0]")).otherwise(raw))
    authors = F.filter(F.transform(w["author"], lambda a: F.trim(F.concat_ws(" ", _or_null(a["given"]), _or_null(a["family"])))), lambda a: a != "")
    issued = F.get(w["issued"]["date-parts"], F.lit(0))
    y, m = F.get(issued, F.lit(0)), F.get(issued, F.lit(1))
    created = F.when(y.isNotNull() & T.plausible_date(y, m, year, month), F.struct(y.alias("year"), m.alias("month")))
    refs = F.transform(
        w["reference"],
        lambda r: F.struct(
            F.coalesce(_or_null(r["article-title"]), _or_null(r["volume-title"]), F.lit("")).alias("title"),
            F.filter(F.array(_or_null(r["author"])), lambda a: a.isNotNull()).alias("authors"),
            F.nullif(r["DOI"], F.lit("")).alias("doi"), F.trim(F.coalesce(r["unstructured"], F.lit(""))).alias("raw"),
        ),
    )
    none = F.array().cast("array<string>")
    return works.select(
        "doi", F.col("work").isNotNull().alias("hit"), title.alias("title"), F.coalesce(authors, none).alias("authors"), T.strip_markup(w["abstract"]).alias("abstract"),
        created.alias("created"), refs.alias("refs"), w["is-referenced-by-count"].alias("cited_by"),
    )


def overlay(docs: DataFrame, records: DataFrame) -> DataFrame:
    """docs (doc_id, doi, title, authors, ...) with each value replaced where the record has one.

    ``lookup`` tells apart a match, a known miss, a DOI nobody asked for, and no DOI.
    """
    r = records.select(F.col("doi").alias("__doi"), "hit", F.col("title").alias("__title"), F.col("authors").alias("__authors"))
    out = docs.join(r.dropDuplicates(["__doi"]), F.col("doi") == F.col("__doi"), "left")
    lookup = F.when(F.col("doi").isNull(), "none").when(F.col("hit").isNull(), "absent").when(F.col("hit"), "match").otherwise("miss")
    new = {"title": F.coalesce("__title", "title"), "authors": F.when(F.size("__authors") > 0, F.col("__authors")).otherwise(F.col("authors")), "lookup": lookup}
    return out.withColumns(new).drop("__doi", "__title", "__authors", "hit")

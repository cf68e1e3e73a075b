"""Citation graph: exact DOI links, and title links found by shared tokens and then verified."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import index_tokens, norm_doi, norm_title, surname
from lexforge.operators.relational import keep_first, keep_last


def _surnames(authors):
    return F.array_distinct(F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), surname), lambda s: s != ""))


def doi_links(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """(src, dst): a reference's DOI is a document's; of documents with one DOI the last counts."""
    known = keep_last(docs.select(F.col("doc_id").alias("dst"), norm_doi(F.col("doi")).alias("key")).where("key <> ''"), ["key"], "dst")
    return refs.select(F.col("doc_id").alias("src"), norm_doi(F.col("doi")).alias("key")).where("key <> ''").join(known, "key").where("src <> dst").select("src", "dst").distinct()


def title_links(docs: DataFrame, refs: DataFrame, min_key: int = 4, min_contained: int = 15) -> DataFrame:
    """(src, dst) by titles.

    Candidates share two informative tokens with the reference (one, if either has only one)
    or its exact title; they are found by an equi-join on tokens, never by a cross join.
    A candidate counts if one title contains the other (of min_contained characters at
    least, or equal), its year is at most one later, and authors, where both have them, share
    a surname.
    """
    titles = docs.select(F.col("doc_id").alias("dst"), norm_title(F.col("title")).alias("title"), F.col("year").alias("dst_year"), _surnames(F.col("authors")).alias("dst_names")).where(F.length("title") >= min_key)
    wanted = refs.select("ref_id", F.col("doc_id").alias("src"), norm_title(F.col("title")).alias("wanted"), _surnames(F.col("authors")).alias("names"))
    wanted = wanted.where(F.length("wanted") >= min_key).join(docs.select(F.col("doc_id").alias("src"), F.col("year").alias("src_year")), "src", "left")
    have = titles.select("dst", F.size(index_tokens(F.col("title"))).alias("have"), F.explode(index_tokens(F.col("title"))).alias("t"))
    need = wanted.select("ref_id", F.size(index_tokens(F.col("wanted"))).alias("need"), F.explode(index_tokens(F.col("wanted"))).alias("t"))
    shared = need.join(have, "t").groupBy("ref_id", "dst", "need", "have").count()
    shared = shared.where((F.col("count") >= F.when(F.col("need") == 1, 1).otherwise(2)) | (F.col("have") == 1)).select("ref_id", "dst")
    first = keep_first(titles.select("dst", F.col("title").alias("wanted")), ["wanted"], "dst")
    exact = wanted.join(first, "wanted").select("ref_id", "dst")
    both = shared.unionByName(exact).distinct().join(wanted, "ref_id").join(titles, "dst").where("src <> dst")
    a, b = F.col("title"), F.col("wanted")
    match = (a == b) | (b.contains(a) & (F.length(a) >= min_contained)) | (a.contains(b) & (F.length(b) >= min_contained))
    years = F.col("src_year").isNull() | F.col("dst_year").isNull() | (F.col("dst_year") <= F.col("src_year") + 1)
    people = (F.size("names") == 0) | (F.size("dst_names") == 0) | F.arrays_overlap("names", "dst_names")
    return both.where(match & years & people).select("src", "dst").distinct()


def graph(docs: DataFrame, refs: DataFrame) -> DataFrame:
    return doi_links(docs, refs).unionByName(title_links(docs, refs)).distinct()

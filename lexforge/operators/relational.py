"""Joins, windows and set operations of the document application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mark_duplicates(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Adds ``duplicate``: not the first of its keys by arrival."""
    return rows.withColumn("duplicate", F.row_number().over(W.partitionBy(*keys).orderBy(arrival)) > 1)


def keep_first(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    return mark_duplicates(rows, keys, arrival).where(~F.col("duplicate")).drop("duplicate")


def keep_last(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(arrival).desc()))).where("__n = 1").drop("__n")


def questions_of_replies(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question): the last user turn before each reply."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    return turns.withColumn("question", asked).where("role = 'assistant'").select("conv_id", "turn", "question")


def delete_first_pair(turns: DataFrame) -> DataFrame:
    """Drops each conversation's first reply and the user turn right before it."""
    order = W.partitionBy("conv_id").orderBy("turn")
    first = F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(W.partitionBy("conv_id"))
    rows = turns.withColumn("__first", first).withColumn("__next", F.lead("turn").over(order))
    gone = (F.col("turn") == F.col("__first")) | ((F.col("role") == "user") & (F.col("__next") == F.col("__first")))
    return rows.where(~F.coalesce(gone, F.lit(False))).select("conv_id", "turn", "role", "text")


def assemble(turns: DataFrame) -> DataFrame:
    """(conv_id, context): numbered parts joined by blank lines, in order."""
    part = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), F.col("role"), F.lit("\n"), F.col("text"))
    held = F.sort_array(F.collect_list(F.struct("turn", part.alias("p"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(held, lambda x: x["p"]), "\n\n").alias("context"))


def latest(rows: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """Per key the kept columns of the last row; one partial aggregate, no sort."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in keep])


def search(rows: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows whose joined columns contain the needle, whatever the case; an empty needle keeps all."""
    return rows if not needle else rows.where(F.lower(F.concat_ws(" ", *columns)).contains(needle.lower()))


def merge_incremental(old: DataFrame, reprocessed: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows but those of reprocessed keys, and the new rows; a reprocessed key without new rows is gone."""
    return old.join(reprocessed, key, "left_anti").unionByName(new)


def is_fresh(newest: Column, extracted: Column) -> Column:
    return F.coalesce(newest >= extracted, F.lit(False))


def palette(rows: DataFrame, order: str, colours: int = 8) -> DataFrame:
    return rows.withColumn("colour", (F.row_number().over(W.orderBy(order)) - 1) % colours)


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the keys in gone."""
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.join(rows, key, "left_anti").unionByName(rows)


def ingest_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of known documents only, with the document's internal id; a full replacement."""
    return chunks.join(documents.select("doc_id", "document_id"), "doc_id")


def overlay(base: DataFrame, extra: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of base, overwritten where extra has a value."""
    other = extra.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    kept = [F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns]
    return base.join(other, key, "left").select(*kept)


def probe_cache(keys: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``state``: hit, miss (known to have no value) or absent."""
    there = cache.select(key, value, F.lit(True).alias("__there"))
    state = F.when(F.col("__there").isNull(), "absent").when(F.col(value).isNull(), "miss").otherwise("hit")
    return keys.join(there, key, "left").withColumn("state", state).drop("__there")


def category_label(keywords: Column, index: Column) -> Column:
    """The first three keywords, or "cluster" and the category's number where it has none."""
    return F.when(F.size(F.coalesce(keywords, F.array())) > 0, F.array_join(F.slice(keywords, 1, 3), ", ")).otherwise(F.concat(F.lit("cluster "), index.cast("string")))


def labelled_members(members: DataFrame, labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks (doc_id, ...) with the label of their document's category, null for documents of none."""
    return chunks.join(members.join(labels, "cluster").select("doc_id", "label"), "doc_id", "left")


def known_members(members: DataFrame, docs: DataFrame, keywords: DataFrame, every: Column) -> DataFrame:
    """(cluster, doc_ids, keywords): members (cluster, doc_id) that are documents; clusters without any go, and one
    without keywords of its own has those given for all."""
    kept = members.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("cluster").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))
    own = F.col("keywords")
    return kept.join(keywords, "cluster", "left").select("cluster", "doc_ids", F.when(F.size(F.coalesce(own, F.array())) > 0, own).otherwise(every).alias("keywords"))


def ordered_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks in order of document and place; a collection without any is an error."""
    if chunks.isEmpty():
        raise LookupError("there are no chunks: run the pipeline first")
    return chunks.orderBy("doc_id", "chunk_index")


def with_status(docs: DataFrame, status: str | None = None) -> DataFrame:
    return docs if status is None else docs.where(F.col("status") == status)


def first_of(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("__nth", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__nth = 1").drop("__nth")


def top_with_chunks(ranked: DataFrame, chunks: DataFrame, n: int = 2) -> DataFrame:
    """The best n documents (doc_id, score) that have chunks."""
    return ranked.join(chunks.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.col("score").desc(), "doc_id").limit(n)

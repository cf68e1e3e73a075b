"""Input pieces and results of triple extraction; the extractor itself is a service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as T

#: The greatest length of one piece, and the edges' white space.
PIECE_CHARS = 8000
_EDGES = r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), _EDGES, "")


def pieces(chunks: DataFrame, most: int = PIECE_CHARS) -> DataFrame:
    """(doc_id, chunk_id, heading, text) to (doc_id, chunk_id, piece, text).

    Bibliographies and blank chunks go; a text over ``most`` characters is cut between words
    into pieces of equally many words, as few as its length asks for.
    """
    text = _trimmed(F.col("text"))
    rows = chunks.withColumn("text", text).where("text <> ''").where(~T.is_reference_heading(F.coalesce("heading", F.lit(""))))
    return rows.select("doc_id", "chunk_id", F.posexplode(T.split_oversized(F.col("text"), most)).alias("piece", "text"))


def clean_triples(triples: DataFrame) -> DataFrame:
    """Distinct (subject, predicate, object) without blank or null parts."""
    parts = ["subject", "predicate", "object"]
    rows = triples.select(*parts)
    for p in parts:
        rows = rows.where(_trimmed(F.col(p)) != "")
    return rows.distinct()


def clean_entities(entities: DataFrame) -> DataFrame:
    """Distinct non-blank entities."""
    return entities.select("entity").where(_trimmed(F.col("entity")) != "").distinct()


def counts(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """One row: numbers of entities, relations and kinds of relation of the union of all graphs."""
    relations = clean_triples(triples).agg(F.count("*").alias("relations"), F.countDistinct("predicate").alias("relation_types"))
    return clean_entities(entities).agg(F.count("*").alias("entities")).crossJoin(F.broadcast(relations))  # one row each

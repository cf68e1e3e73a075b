"""A training corpus in five stages, each an operator of lexforge.llm.

Quality rules drop documents, line dedup cuts repeated runs of lines, the n-gram join leaves
one document of each group of near copies (five-word shingles, 80 %), mixing repeats or
drops documents towards the sources' target weights, and byte-level BPE encodes what is left.
Rules are fitted by EM, so SQL cannot express the whole; a test compares its rows with a
brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import bpe, jaccard, lines, mixing, quality
from lexforge.llm.scratch import discard, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated runs of three lines, and of one or two with 50 words; a document all of whose lines stand elsewhere before goes."""
    return lines.delete_repeats(docs, drop_emptied=True, least_words=50).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With smaller caches than alone, let go at each task's end: the stages before leave a grown JVM heap beside the workers."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False, keep=False, share=0.3)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each reads the table that the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)  # documents itself was not written here and stays
    return STAGES[-1][1](spark, docs, sf_dir)

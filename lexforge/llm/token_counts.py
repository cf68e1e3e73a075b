"""Operator 3, token counts: rollups kept up to date by signed deltas.

Totals by source, language and tokenizer version are sums, so a batch of changes needs only
its own rows: an insert adds the new count, a delete takes the old one away, a revised count
does both.  Each batch is summed and written to a folder of the writer's own below one named by
the batch's id, and counts once Spark's success mark is there.  Of two writers of a batch the
one that ends first counts and the other takes its folder back; a batch that is committed again
adds nothing, and one that broke off has no mark.  compact() adds up the batches seen and
carries their ids on, so they stay known.

A tokenizer version is a pattern of one token, or a rank file of a byte-level BPE.

Defined results: null sources and languages are groups of their own; a null text or count has
no tokens; a very long text counts whole; repeated rows in a batch count as often as they stand
there; an ``op`` other than insert, delete and revise ends the commit with an error and nothing
is added; keys whose documents and tokens both came back to zero are no longer listed; an empty
batch is a commit without rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.scratch import root

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """Sums a batch of changes: (op, source, lang, tokenizer, n_tokens, old_n_tokens).

    ``op`` is insert, delete or revise; delete and revise carry the count that was added
    before.  Partial sums go before the shuffle, so a hot source is one row for each task.
    """
    new, old, op = F.coalesce(F.col("n_tokens"), F.lit(0)), F.coalesce(F.col("old_n_tokens"), F.lit(0)), F.col("op")
    unknown = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(op.cast("string"), F.lit("null")))).cast("long")
    sign = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(unknown)
    tokens = F.when(op == "insert", new).when(op == "delete", -old).when(op == "revise", new - old)
    return changes.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


class Rollup:
    """Totals at a path that any Spark file system reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _folder(self, batch: str) -> str:
        if not batch or any(c in batch for c in "/\\:*?[]{}"):
            raise ValueError(f"not a batch id: {batch!r}")
        return f"{self.path}/batch={batch}"

    def _done(self, pattern: str) -> list[str]:
        """Folders with a success mark, the first to end first."""
        found = self._fs.globStatus(self._at(f"{pattern}/_SUCCESS")) or []
        marks = sorted((m.getModificationTime(), m.getPath().getParent().toString()) for m in found)
        return [path for _, path in marks]

    def _counting(self) -> dict[str, str]:
        """For each batch, the folder that counts."""
        out: dict[str, str] = {}
        for path in self._done(f"{self.path}/batch=*/*"):
            out.setdefault(path.split("/")[-2].removeprefix("batch="), path)
        return out

    def committed(self, batch: str) -> bool:
        return bool(self._done(f"{self._folder(batch)}/*"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds the batch unless it is there; says whether it was added."""
        if self.committed(batch):
            return False
        own = f"{self._folder(batch)}/{uuid.uuid4().hex}"
        deltas(changes).write.parquet(own)
        if self._done(f"{self._folder(batch)}/*")[0].endswith(own.rsplit("/", 1)[-1]):
            return True
        self._fs.delete(self._at(own), True)  # another writer was first
        return False

    def batches(self) -> list[str]:
        return sorted(self._counting())

    def _totals(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(DELTA).parquet(*folders) if folders else self.spark.createDataFrame([], DELTA)
        out = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def totals(self) -> DataFrame:
        return self._totals(self._done(f"{self.path}/compacted/*")[:1] + sorted(self._counting().values()))

    def compact(self, into: str) -> "Rollup":
        """The same totals in one folder at another path, with all batch ids, so that none can be added twice."""
        new, known = Rollup(self.spark, into), self._counting()
        for batch in known:  # a batch that counts and has no rows of its own
            self._fs.create(self._at(f"{new._folder(batch)}/compacted/_SUCCESS"), True).close()
        self._totals(self._done(f"{self.path}/compacted/*")[:1] + sorted(known.values())).write.parquet(f"{new.path}/compacted/{uuid.uuid4().hex}")
        return new


#: Tokenizer versions that the built-in counter knows, as patterns of one token.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]"}


def count(text: Column, tokenizer: str) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def bpe_counts(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> Column:
    """Number of tokens of a byte-level BPE given by its rank file, which executors must have at that place."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(F.col(f"`{text_col}`").cast("string"))


def bpe_inserts(docs: DataFrame, tokenizer: str, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """inserts() for a tokenizer given by its rank file."""
    return docs.select(F.lit("insert").alias("op"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), bpe_counts(docs, path, pattern, text_col).alias("n_tokens"), F.lit(0).cast("long").alias("old_n_tokens"))


def inserts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    n = count(F.col(text_col), tokenizer)
    return docs.select(F.lit("insert").alias("op"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), n.alias("n_tokens"), F.lit(0).cast("long").alias("old_n_tokens"))


def history(docs: DataFrame) -> DataFrame:
    """A rollup of docs under both tokenizers, kept by three batches, the second sent twice.

    All documents are inserted under words-1 and then under words-2; then the documents
    without any letter a to z are deleted under words-1, and those of more than 1,000
    words are revised under words-2 to the count of words-1.
    """
    spark = docs.sparkSession
    rollup = Rollup(spark, f"{root(spark)}/token-counts-{uuid.uuid4().hex}")
    rollup.commit("1", inserts(docs, "words-1"))
    for _ in range(2):
        rollup.commit("2", inserts(docs, "words-2"))
    one, two = count(F.col("text"), "words-1"), count(F.col("text"), "words-2")
    gone = docs.where(~F.coalesce(F.col("text"), F.lit("")).rlike("[a-z]")).select(F.lit("delete").alias("op"), "source", "lang", F.lit("words-1").alias("tokenizer"), F.lit(None).cast("long").alias("n_tokens"), one.alias("old_n_tokens"))
    new = docs.where(one > 1000).select(F.lit("revise").alias("op"), "source", "lang", F.lit("words-2").alias("tokenizer"), one.alias("n_tokens"), two.alias("old_n_tokens"))
    rollup.commit("3", gone.unionByName(new))
    return rollup.totals()

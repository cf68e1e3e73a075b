"""Operator 1, quality rules: weak supervision instead of all-must-pass filtering.

Rules look at counts of one text and vote good (1), bad (-1) or abstain (0).
Expectation-maximisation over the table of vote patterns estimates the share of good
documents and how often each rule votes either way for good and for bad ones; the
posterior probability of "good" is then the verdict.  The E and M steps need only the
number of documents of each vote pattern, at most 3**9 = 19683 rows whatever the corpus
size, so they run on the driver over that bounded table.

Defined results: a null or empty text has zero words and fails the base rule; repeated
rows count as often as they stand there and each gets its own result row; an empty
table gives an empty result; input columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.scratch import materialise
from lexforge.llm.words import grams, mix, texts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_letters", "n_digits")

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
#: ASCII letters and the first bytes of longer UTF-8 sequences.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[0xC0:] = True
LEAD = (np.arange(256) & 0xC0) != 0x80
END = np.zeros(256, bool)
END[list(b".!?\"')")] = True


def _count(c) -> list[np.ndarray]:
    h = c.hashes()
    data, word = c.data, c.word
    # lines: between line feeds, within a document
    cut = np.flatnonzero(data == 10)
    begin = np.union1d(c.offsets[:-1], cut + 1)
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data)) if len(begin) else begin
    stop = stop - (data[stop - 1] == 10) if len(begin) else stop
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(word, out=seen[1:])
    has = seen[stop] > seen[begin]
    begin, stop = begin[has], stop[has]
    line_doc = np.searchsorted(c.offsets, begin, "right") - 1
    lines = np.bincount(line_doc, minlength=c.n_docs)
    keys = mix(c.spans(begin, stop) ^ mix(line_doc.astype(np.uint64), 5))
    _, where = np.unique(keys, return_index=True)
    distinct = np.bincount(line_doc[where], minlength=c.n_docs)
    # the last word of each line ends it
    last = c.ends[np.searchsorted(c.starts, stop) - 1] - 1 if len(stop) else stop
    ended = np.bincount(line_doc[END[data[last]]], minlength=c.n_docs)
    # words in 3-word windows that occur twice or more
    at, g = grams(h, c.doc, 3)
    g = mix(g ^ mix(c.doc[at].astype(np.uint64), 5))
    order = np.argsort(g)
    g = g[order]
    same = np.zeros(len(g), bool)
    same[1:] = g[1:] == g[:-1]
    same[:-1] |= same[1:].copy()
    hit = np.zeros(len(h) + 2, bool)
    hit[at[order[same]]] = True
    hit[1:] |= hit[:-1] | np.append(False, hit[:-2])
    repeat = np.bincount(c.doc[hit[: len(h)]], minlength=c.n_docs)
    return [
        np.diff(c.bounds), c.per_doc(word & LEAD[data]), c.per_doc(SYMBOL[data]), lines - distinct, repeat,
        lines, ended, c.per_doc(LETTER[data]), c.per_doc(DIGIT[data]),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in texts(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n_docs), *(pa.array(x.astype(np.int64)) for x in _count(c))], names=["doc_id", *COUNTS])


def _features_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in texts(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n_docs), *(pa.array(x.astype(np.int64)) for x in _count(c))], names=["row", *COUNTS])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the counts that the rules look at."""
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(_features, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(F.col("n_words") == 0, -1).when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes on the columns of features(); thresholds are shares of words, lines or characters."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    share = lambda c, of: F.col(c) / of
    return {
        "length": _vote(F.col("n_words") < 30, F.col("n_words") >= 100),
        "symbols": _vote(share("n_symbols", words) > 0.20, share("n_symbols", words) < 0.05),
        "symbol_chars": _vote(share("n_symbols", chars) > 0.05, share("n_symbols", chars) < 0.01),
        "same_lines": _vote(share("n_dup_lines", lines) > 0.30, F.col("n_dup_lines") == 0),
        "same_words": _vote(share("n_repeat_words", words) > 0.30, share("n_repeat_words", words) < 0.10),
        "word_length": _vote(~(share("word_chars", words).between(3, 12)), share("word_chars", words).between(3.5, 10)),
        "sentence_ends": _vote(share("n_ended_lines", lines) < 0.20, share("n_ended_lines", lines) > 0.60),
        "letters": _vote(share("n_letters", chars) < 0.80, share("n_letters", chars) > 0.90),
        "digits": _vote(share("n_digits", chars) > 0.15, share("n_digits", chars) < 0.05),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, np.ndarray]:
    """EM over vote patterns and their numbers of documents.

    Returns the share of good documents and p[class, rule, vote + 1], the probability of
    each vote.  It starts from rules that are right four times out of five and smooths
    each estimate with that belief, which keeps "good" the class that good votes point to.
    """
    if not patterns:
        return 0.5, np.full((2, 0, 3), 1 / 3)
    votes = np.array([v for v, _ in patterns]) + 1
    n = np.array([k for _, k in patterns], float)
    start = np.array([[0.4, 0.2, 0.4], [0.05, 0.15, 0.8]])  # for bad and for good documents
    p = np.repeat(start[:, None, :], votes.shape[1], 1)
    prior, believed = 0.5, 0.01 * n.sum() + 1
    which = [(votes == k).astype(float) for k in range(3)]
    for _ in range(rounds):
        good = posterior(votes, prior, p)
        prior = float((n @ good + 1) / (n.sum() + 2))
        for c, r in enumerate((1 - good, good)):
            sums = np.stack([(n * r) @ w for w in which], 1) + believed * start[c]
            p[c] = sums / sums.sum(1, keepdims=True)
    return prior, p


def posterior(votes: np.ndarray, prior: float, p: np.ndarray) -> np.ndarray:
    at = np.arange(votes.shape[1])
    odds = np.log(prior) - np.log(1 - prior) + (np.log(p[1])[at, votes] - np.log(p[0])[at, votes]).sum(1)
    return 1 / (1 + np.exp(-odds))


def _weights(patterns: list[tuple[tuple[int, ...], int]], names: list[str]) -> Column:
    """The posterior as an expression over vote columns."""
    prior, p = fit(sorted(patterns))
    odds = F.lit(float(np.log(prior) - np.log(1 - prior)))
    for i, c in enumerate(names if patterns else []):
        bad, none, good = (float(np.log(p[1, i, k]) - np.log(p[0, i, k])) for k in range(3))
        odds = odds + F.when(F.col(c) < 0, bad).when(F.col(c) > 0, good).otherwise(none)
    return 1 / (1 + F.exp(-odds))


def _patterns(votes: DataFrame, names: list[str]) -> list[tuple[tuple[int, ...], int]]:
    return [(tuple(r[c] for c in names), r["count"]) for r in votes.groupBy(*names).count().collect()]  # 3**9 rows at most


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Counts, votes, posterior probability and verdict of each document.

    The votes of all documents are counted; the texts are read once, since the counts go
    to a table in the shared folder first.
    """
    names = [f"vote_{k}" for k in rules()]
    table = materialise(features(docs, id_col, text_col).withColumns({f"vote_{k}": v.cast("byte") for k, v in rules().items()}), "quality")
    return (
        table.withColumn("posterior", _weights(_patterns(table, names), names))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns and no shuffle.

    The texts are read twice: for the votes, then, weights known, for the verdicts.
    """
    names = [f"vote_{k}" for k in rules()]
    votes = features(docs, id_col, text_col).select(*[v.cast("byte").alias(f"vote_{k}") for k, v in rules().items()])
    verdict = _weights(_patterns(votes, names), names)
    counted = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = counted.schema["row"].dataType.simpleString()
    if not all(c.isidentifier() for c in docs.columns):
        kind = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in docs.schema.fields) + ">"
    out = counted.mapInArrow(_features_of_rows, f"row {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    out = out.withColumns({f"vote_{k}": v.cast("byte") for k, v in rules().items()})
    return out.where(~base_failed() & (verdict >= threshold)).select("row.*")

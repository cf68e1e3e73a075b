"""Work that a service does: registry lookups, models, converters.  The client is given by the caller.

A client is made once for each task by a factory, so that connections and models need not be
sent to executors; what it raises becomes an error in its row, and a missing record is no error.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How an extraction is tried again, and of what size a vector is.
LADDER, DIMS, BATCH = (0.0, 0.4, 0.7), 64, 32


class Missing(Exception):
    """The service has no such record."""


def called(rows: DataFrame, factory: Callable[[], Callable[[str], str]], key: str, pause: float = 0.0) -> DataFrame:
    """Adds answer, status (hit, miss, error, or none without a key) and error to rows; calls are ``pause`` seconds apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for batch in batches:
            found = []
            for k in batch[key]:
                if k is None or k != k:
                    found.append((None, "none", None))
                    continue
                try:
                    found.append((client(k), "hit", None))
                except Missing:
                    found.append((None, "miss", None))
                except Exception as e:
                    found.append((None, "error", str(e)))
                time.sleep(pause)
            yield batch.assign(**{c: [x[i] for x in found] for i, c in enumerate(("answer", "status", "error"))})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, kinds + ", answer string, status string, error string")


TRIPLES = "doc_id string, chunk_id string, attempts int, failed boolean, triples array<struct<subject:string,predicate:string,object:string>>"


def extracted(pieces: DataFrame, factory: Callable[[], Callable[[str, float], list[tuple[str, str, str]]]]) -> DataFrame:
    """Triples of each piece (doc_id, chunk_id, text), tried at rising temperatures; a piece that fails at all has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for batch in batches:
            out = []
            for row in batch.itertuples():
                found, tries = None, 0
                for heat in LADDER:
                    tries += 1
                    try:
                        found = [dict(zip(("subject", "predicate", "object"), t, strict=True)) for t in client(row.text, heat)]
                        break
                    except Exception:  # the next temperature may do
                        continue
                out.append((str(row.doc_id), str(row.chunk_id), tries, found is None, found or []))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_id", "attempts", "failed", "triples"])

    return pieces.select("doc_id", "chunk_id", "text").mapInPandas(run, TRIPLES)


def hashed_words(texts: list[str]) -> np.ndarray:
    """Vectors of length 1 from signed word hashes: a stand-in where no embedding model is at hand."""
    out = np.zeros((len(texts), DIMS))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            out[i, h % DIMS] += 1 if h >> 32 & 1 else -1
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm == 0, 1, norm)


def embedded(text: Column, factory: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: hashed_words) -> Column:
    """Vectors of texts, in batches of 32; a null text counts as empty."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            given = texts.fillna("").tolist()
            parts = [model(given[i : i + BATCH]) for i in range(0, len(given), BATCH)]
            yield pd.Series([list(map(float, v)) for p in parts for v in p], dtype=object)

    return vectors(text)


def model_name(name: Column) -> Column:
    """A name without a provider is one of the local server's."""
    return F.when(F.contains(name, F.lit("/")), name).otherwise(F.concat(F.lit("ollama_chat/"), name))

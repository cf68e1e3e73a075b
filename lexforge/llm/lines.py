"""Operator 7, line dedup by winnowing over line hashes, in DataFrame functions only.

Lines are split at line feeds; lines without a word stay and do not count.  Of each run of
``run`` lines the least line hash (the leftmost, if tied) is a guaranteed fingerprint: a run
that repeats does so with the same fingerprint.

1. Only fingerprints (hash, document, place) leave the documents.  They are joined on their
   hash and those met once are dropped; a hash of a great part of all places goes to every
   task, so a license line in a third of all documents fills none.
2. From the places that remain the match is extended to both sides: the runs that hang on
   them get 128-bit hashes, whose least (document, line) is the first occurrence.  Minima are
   combined before the shuffle, and no pairs of occurrences are formed.
3. Lines of any other occurrence are deleted, so what goes are the maximal later repeats of
   ``run`` or more lines.

With ``least_words``, one or two lines that together hold so many words are compared in the
same way, each such piece by its own hash, so long lines between lines of their own go too.

Defined results: a null text stays null and an empty one empty; documents with fewer lines
than a run lose nothing, unless ``least_words`` is given; ties are decided by id and line
number; rows that repeat an id are told apart by a hash of the text, and equal rows are
treated alike; null ids come last; a document that loses its last line with a word becomes
empty (drop_emptied leaves it out); a very long text is one row of line hashes; extra columns
stay as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.scratch import discard, join_one, materialise, unused

HAS_WORD = r"[^\x20\x09-\x0D]"
WORD = HAS_WORD + "+"
LAST = (1 << 63) - 1


def _runs(h: Column, run: int) -> Column:
    """Starts of the runs in an array of line hashes."""
    return F.when(F.size(h) >= run, F.sequence(F.lit(0), F.size(h) - run)).otherwise(F.array().cast("array<int>"))


def _print_at(h: Column, start: Column, run: int) -> Column:
    """Place of the fingerprint of the run at start."""
    part = F.slice(h, start + 1, run)
    return (start + F.array_position(part, F.array_min(part)) - 1).cast("int")


def _hashes(h: Column, start: Column, run: int) -> list[Column]:
    """128 bits of the run at start."""
    part = F.slice(h, start + 1, run)
    return [F.xxhash64(part).alias("h1"), F.xxhash64(F.lit(run), F.reverse(part)).alias("h2")]


def _short(rows: DataFrame, run: int, least_words: int) -> DataFrame:
    """The pieces of fewer lines than a run that hold the words, with 128-bit hashes."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def of(size: int) -> DataFrame:
        enough = F.filter(_runs(F.col("h"), size), lambda i: total(F.slice("n", i + 1, size)) >= least_words)
        return rows.select("id", "v", F.inline(F.transform(enough, lambda i: F.struct(i.alias("pos"), F.lit(size).alias("len"), *_hashes(F.col("h"), i, size)))))

    return reduce(DataFrame.unionByName, map(of, range(1, run)))


def _around(h: Column, places: Column, run: int) -> Column:
    """Starts of the runs whose fingerprints are at these places."""
    first, last = (lambda p: F.greatest(p - run + 1, F.lit(0))), (lambda p: F.least(p, F.size(h) - run))
    near = lambda p: F.when(first(p) <= last(p), F.sequence(first(p), last(p))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(places, lambda p: F.filter(near(p), lambda s: _print_at(h, s, run) == p)))


def column(docs: DataFrame) -> str:
    """Name of the struct column that delete_repeats() adds: ``lines``, with underscores if docs has that."""
    return unused(docs, "lines")


def delete_repeats(docs: DataFrame, run: int = 3, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False, least_words: int | None = None) -> DataFrame:
    """docs with the repeated lines cut from the text, and a struct column (n_lines, n_deleted) named by column()."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST))
    split = F.split(F.col(f"`{text_col}`").cast("string"), "\n")
    version = F.xxhash64(F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").isNull())  # tells rows apart that repeat an id
    marked = F.transform(split, lambda x, i: F.struct(i.cast("int").alias("i"), F.when(x.rlike(HAS_WORD), F.xxhash64(x)).alias("h"), (F.lit(0) if least_words is None else F.regexp_count(x, F.lit(WORD))).alias("n")))
    rows = docs.select(key.alias("id"), version.alias("v"), F.filter(F.coalesce(marked, F.array().cast("array<struct<i:int,h:bigint,n:int>>")), lambda x: x["h"].isNotNull()).alias("lines"))
    counts = [] if least_words is None else [F.col("lines.n").alias("n")]
    rows = rows.where(F.size("lines") >= (run if least_words is None else 1)).select("id", "v", F.col("lines.h").alias("h"), F.col("lines.i").alias("i"), *counts)
    rows = materialise(rows, "line-hashes")  # a few bytes a line, so later passes need no text
    h = F.col("h")
    places = F.array_distinct(F.transform(_runs(h, run), lambda i: _print_at(h, i, run)))
    prints = materialise(rows.select("id", "v", F.inline(F.transform(places, lambda p: F.struct(p.alias("at"), F.get(h, p).alias("hash"))))), "line-prints")
    where = F.struct("id", "v", "at")
    repeated = prints.groupBy("hash").agg(F.min(where).alias("a"), F.max(where).alias("b"), F.count("*").alias("c")).where("a <> b").select("hash", "c")
    repeated = materialise(repeated, "line-repeated")
    seeds = join_one(prints, repeated, "hash").groupBy("id", "v").agg(F.collect_set("at").alias("places"))
    runs = F.transform(_around(h, F.col("places"), run), lambda i: F.struct(i.cast("int").alias("pos"), F.lit(run).alias("len"), *_hashes(h, i, run)))
    seeded = rows.join(seeds, ["id", "v"]).select("id", "v", F.inline(runs))
    if least_words is not None:
        seeded = seeded.unionByName(_short(rows, run, least_words))
    seeded = materialise(seeded, "line-seeds")
    discard(prints)
    discard(repeated)
    first = seeded.groupBy("h1", "h2").agg(F.min(F.struct("id", "v", "pos", "len")).alias("at")).select("at.*")
    again = seeded.join(first, ["id", "v", "pos", "len"], "left_anti").groupBy("id", "v").agg(F.collect_set(F.struct("pos", "len")).alias("starts"))
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.slice("i", p["pos"] + 1, p["len"]))))
    id_, v, cut, n = (unused(docs, c) for c in ("__id", "__v", "__gone", "__n"))
    cuts = materialise(again.join(rows, ["id", "v"]).dropDuplicates(["id", "v"]).select(F.col("id").alias(id_), F.col("v").alias(v), gone.alias(cut)), "line-cuts")
    discard(seeded)
    discard(rows)
    # the text travels as its lines, so that no lambda splits it again
    n_lines = F.coalesce(F.size(F.filter(split, lambda x: x.rlike(HAS_WORD))), F.lit(0)).cast("long")
    whole = docs.select(*[split.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], key.alias(id_), version.alias(v), n_lines.alias(n))
    held = F.col(f"`{text_col}`")
    kept = F.array_except(F.sequence(F.lit(0), F.size(held) - 1), F.col(cut))
    text = F.when(F.col(cut).isNull(), F.array_join(held, "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(held, i)), "\n"))
    n_deleted = F.greatest(F.coalesce(F.size(cut), F.lit(0)), F.lit(0)).cast("long")
    # the same plan at every size; few cuts or many, the texts are dealt once
    both, into = whole.join(cuts.hint("merge"), [id_, v], "left"), column(docs)
    out = both.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.struct(F.col(n).alias("n_lines"), n_deleted.alias("n_deleted")).alias(into))
    return out.where(~((F.col(into)["n_deleted"] > 0) & (F.col(into)["n_deleted"] == F.col(into)["n_lines"]))) if drop_emptied else out

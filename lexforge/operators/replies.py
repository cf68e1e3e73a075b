"""Answers and their citations: markers, quoted spans, claims, and pointing each marker at the chunk that holds it.

All text work is done by column expressions; chunks are joined to markers within one reply, so
no reply's rows meet another's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexforge.functions.text import spaceless, tokens

# What counts as a marker, a loosely written marker, a linked one and a quote, and the limits of grounding.
MARKER = r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]"
LOOSE = r"\[\s*(?:n|N|#|source|excerpt|ref)\s*[.:]?\s*(\d+(?:\s*,\s*\d+)*)\s*\]"
LINKED = r"\[(\d+(?:\s*,\s*\d+)*)\]\([^)]*\)"
PLAIN = r"\[\d+(?:\s*,\s*\d+)*\]"
SHOWN = r"\[\d+(?:\s*,\s*\d+)*!?\]|\[!\]"
QUOTE = "[\"“”']([^\"“”']{25,})[\"“”']"
RUN, NEAR, OVERLAP, SIMILAR = 8, 400, 0.5, 0.6


def rewrite(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Text with each match of the pattern changed on its own."""
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(between, hits, lambda a, b: F.concat(a, F.when(b.isNull(), "").otherwise(change(b)))), "")


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """(text, start, end) of each match, from 0; text is the given group."""
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    upto = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    start = lambda i: upto(between, i + 1) + upto(hits, i)
    return F.transform(hits, lambda x, i: F.struct(F.get(kept, i).alias("text"), start(i).alias("start"), (start(i) + F.length(x)).alias("end")))


def _numbers(marker: Column) -> Column:
    return F.transform(F.regexp_extract_all(marker, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("int"))


def _within(marker: Column, sources: Column) -> Column:
    return F.filter(_numbers(marker), lambda n: (n >= 1) & (n <= sources))


def normalised(reply: Column, sources: Column) -> Column:
    """Loose and linked markers become [n]; of each marker only numbers of given sources stay, unless it has none."""
    plain = F.regexp_replace(F.regexp_replace(reply, LOOSE, "[$1]"), LINKED, "[$1]")
    listed = lambda m: F.concat(F.lit("["), F.array_join(_within(m, sources), ", "), F.lit("]"))
    return rewrite(plain, PLAIN, lambda m: F.when(F.size(_within(m, sources)) > 0, listed(m)).otherwise(m))


def quoted_spans(reply: Column) -> Column:
    """Quotes of 25 characters or more, then lines that begin with ">", each with its place."""
    lines = F.split(reply, "\n", -1)
    begin = lambda i: F.aggregate(F.slice(lines, 1, i), F.lit(0), lambda a, x: a + F.length(x) + 1)
    cited = F.transform(lines, lambda x, i: F.struct(F.regexp_replace(x, r"^\s*>\s?", "").alias("text"), begin(i).alias("start"), (begin(i) + F.length(x)).alias("end"), x.rlike(r"^\s*>\s?\S").alias("q")))
    cited = F.transform(F.filter(cited, lambda s: s["q"]), lambda s: F.struct(s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end")))
    return F.concat(located(reply, QUOTE, 1), cited)


def _sentences(part: Column) -> Column:
    return F.filter(F.transform(F.split(part, r"(?<=[.!?])\s+|\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def claim(reply: Column, start: Column, end: Column) -> Column:
    """The sentence before a marker, with what goes on behind it on the same line if the sentence is not at its end."""
    first = F.greatest(start - NEAR, F.lit(0))
    before = F.coalesce(F.get(F.reverse(_sentences(F.substring(reply, first + 1, start - first))), F.lit(0)), F.lit(""))
    line = F.get(F.split(F.substring(reply, end + 1, F.lit(NEAR)), "\n"), F.lit(0))
    after = F.coalesce(F.get(_sentences(line), F.lit(0)), F.lit(""))
    return F.when(before.rlike(r"[.!?]$"), before).otherwise(F.trim(F.concat(before, F.lit(" "), after)))


def markers(replies: DataFrame) -> DataFrame:
    """(reply_id, reply) to one row a marker: place, the nearest quote within reach (the first, if tied) or the claim, and numbers."""
    quotes = F.transform(quoted_spans(F.col("reply")), lambda q, i: F.struct(F.greatest(F.col("start") - q["end"], q["start"] - F.col("end"), F.lit(0)).alias("gap"), i.alias("i"), q["text"].alias("text")))
    rows = replies.select("reply_id", "reply", F.posexplode(located(F.col("reply"), MARKER)).alias("place", "m")).select("reply_id", "reply", "place", "m.start", "m.end", F.col("m.text").alias("marker"))
    rows = rows.withColumn("quote", F.array_min(F.filter(quotes, lambda q: q["gap"] <= NEAR))["text"])
    return rows.withColumn("claim", F.when(F.col("quote").isNull(), claim(F.col("reply"), F.col("start"), F.col("end"))))


def best_chunks(claims: DataFrame, chunks: DataFrame, key: str = "place") -> DataFrame:
    """Adds best (chunk_index, score, verbatim) to claims (reply_id, key, said), null without any match.

    A chunk scores the share of the claim's words that it has, and one more if it has a run of
    eight of them (or all, if fewer).  Claims under four words match nothing.
    """
    said = claims.select("reply_id", key, tokens(F.col("said")).alias("w")).where(F.size("w") >= 4)
    n = F.least(F.lit(RUN), F.size("w"))
    said = said.withColumn("runs", F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, n), "")))
    held = chunks.select("reply_id", "chunk_index", spaceless(F.col("text")).alias("joined"), F.array_distinct(tokens(F.col("text"))).alias("has"))
    both = said.join(held, "reply_id")
    verbatim = F.exists("runs", lambda r: F.contains(F.col("joined"), r))
    share = F.size(F.filter("w", lambda t: F.array_contains(F.col("has"), t))) / F.size("w")
    both = both.select("reply_id", key, "chunk_index", verbatim.alias("verbatim"), (verbatim.cast("int") + share).alias("score")).where("score > 0")
    best = both.groupBy("reply_id", key).agg(F.max_by(F.struct("chunk_index", "score", "verbatim"), F.struct("score", -F.col("chunk_index"))).alias("best"))
    return claims.join(best, ["reply_id", key], "left")


def repaired(replies: DataFrame, chunks: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """(reply_id, reply, quotes): each marker points at the chunk (numbered from 1) that its quote or claim comes from.

    A quote needs a run of its words in the chunk; a claim half of its words, or, where
    ``similar`` (reply_id, place, chunk_index, sim) is given, a similarity of 0.6.  A marker of
    neither keeps its valid numbers as [n!], or becomes [!].  ``quotes`` lists (chunk_index,
    text) of quotes found.  A reply without chunks stays as it is.
    """
    sizes = chunks.groupBy("reply_id").agg(F.count("*").cast("int").alias("sources"))
    found = best_chunks(markers(replies).withColumn("said", F.coalesce("quote", "claim")), chunks).join(sizes, "reply_id")
    lexical = F.when(F.when(F.col("quote").isNotNull(), F.col("best.verbatim")).otherwise(F.col("best.score") >= OVERLAP), F.col("best.chunk_index"))
    if similar is not None:
        near = similar.where(F.col("sim") > 0).groupBy("reply_id", "place").agg(F.max_by(F.struct("chunk_index", "sim"), F.struct("sim", -F.col("chunk_index"))).alias("near"))
        found = found.join(near, ["reply_id", "place"], "left")
        lexical = F.coalesce(lexical, F.when(F.col("quote").isNull() & (F.length("claim") >= 8) & (F.col("near.sim") >= SIMILAR), F.col("near.chunk_index")))
    valid = _within(F.col("marker"), F.col("sources"))
    flagged = F.when(F.size(valid) > 0, F.concat(F.lit("["), F.array_join(valid, ", "), F.lit("!]"))).otherwise("[!]")
    found = found.withColumn("target", lexical).withColumn("new", F.when(F.col("target").isNotNull(), F.concat(F.lit("["), (F.col("target") + 1).cast("string"), F.lit("]"))).otherwise(flagged))
    quote = F.when(F.col("quote").isNotNull() & F.col("target").isNotNull(), F.struct(F.col("target").alias("chunk_index"), F.col("quote").alias("text")))
    per = found.groupBy("reply_id").agg(F.array_sort(F.collect_list(F.struct("place", "new"))).alias("new"), F.sort_array(F.collect_set(quote)).alias("quotes"))
    out = replies.select("reply_id", "reply").join(per, "reply_id", "left")
    joined = F.array_join(F.zip_with(F.split("reply", MARKER, -1), F.col("new")["new"], lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    tidy = F.regexp_replace(F.regexp_replace(joined, " {2,}", " "), r" ([.,;:)])", "$1")
    return out.select("reply_id", F.when(F.col("new").isNull(), F.col("reply")).otherwise(tidy).alias("reply"), F.coalesce("quotes", F.array().cast("array<struct<chunk_index:int,text:string>>")).alias("quotes"))


def citing_sentences(block: Column) -> Column:
    """For each marker of a block, the sentence that it stands in, or the one before if that is markers alone."""
    plain = F.regexp_replace(F.regexp_replace(block, "`[^`]+`", " "), r"\*\*|\*", "")
    bare = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, SHOWN, " "), r"\s+", " "))
    parts = F.transform(F.split(plain, r"(?<=[.!?])\s+"), lambda s: F.struct(bare(s).alias("said"), F.regexp_count(s, F.lit(SHOWN)).alias("n")))
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        last = F.when(s["said"] != "", s["said"]).otherwise(a["last"])
        return F.struct(last.alias("last"), F.concat(a["out"], F.array_repeat(last, s["n"])).alias("out"))

    return F.aggregate(parts, start, step)["out"]


def cited(reply: Column, flagged: bool) -> Column:
    """Numbers of markers [n], or of flagged ones [n!], in order of first mention."""
    marks = F.regexp_extract_all(reply, F.lit(SHOWN), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(F.filter(marks, lambda m: m.contains("!") == F.lit(flagged)), _numbers)))


def merged_upward(lines: Column) -> Column:
    """Lines that hold nothing but markers go to the end of the line above."""
    only = rf"^\s*(?:(?:{SHOWN})\s*)+$"
    return F.aggregate(lines, F.array().cast("array<string>"), lambda a, x: F.when((F.size(a) > 0) & x.rlike(only), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), F.lit(" "), F.trim(x))))).otherwise(F.concat(a, F.array(x))))


def extended(turns: Column, question: Column, reply: Column) -> Column:
    """A conversation with one more question and its reply."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.concat(turns, F.array(turn("user", question), turn("assistant", reply)))


def well_formed(turns: Column) -> Column:
    """Has every turn a role and a content?"""
    return F.coalesce(turns.isNotNull() & F.forall(turns, lambda t: t["role"].isNotNull() & t["content"].isNotNull()), F.lit(False))


def with_quotes(sources: Column, quotes: Column) -> Column:
    """Sources without text and embedding, each with the quotes at its place."""
    return F.transform(sources, lambda s, i: s.dropFields("text", "embedding").withField("quotes", F.coalesce(F.get(quotes, i), F.array().cast("array<string>"))))

"""Titles, dates, sections and reference lists of extracted documents, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexforge.functions.text import first_words, is_reference_heading, plausible_date

# What is no title, what is a caption, the marks before an entry, and years.
NOT_TITLE = r"(?i)^(provided proper attribution|permission to reproduce|all rights reserved|published by|journal of|proceedings of|transactions on|vol\.|volume\s+\d|issue\s+\d|doi:|arxiv:)"
CAPTION = r"(?i)^(?:Figure|Table|Scheme|Chart|Fig\.?|Eq\.?)\s*\d+\s*[:.]"
CAPTION_LINE = r"(?im)^[ \t]*(?:Figure|Table|Scheme|Chart|Fig\.?|Eq\.?)\s*\d+\s*[:.][^\n]*$"
GLUED = r"^\d{1,3}\.(?=\S)"
ENTRY_MARK = r"^(?:[-–—•*]\s+)?(?:\[\d+\]|\(\d+\)|\d+[a-zA-Z]?\.)\s+"
LINE_MARK = r"(?m)^[ \t]*(?:[-–—•*]\s+)?(?:\[\d+\]|\(\d+\)|\d+[a-zA-Z]?\.)\s+"
INLINE_NUMBER = r"(?<![a-zA-Z:])\d{1,3}\.\s+(?=[A-Z\(\"\[])"
INLINE_BRACKET = r"\[\d+\]\s+"
AUTHOR_LINE = r"(?m)(?=^[A-Z][a-z\-]{1,25},\s+[A-Z])"
YEAR = r"(?:1[6-9]|20)\d{2}"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_TRIM = r"^\s+|\s+$"


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, _TRIM, "")


def clean_title(title: Column) -> Column:
    """Without leading sentences of publishers; null where nothing is left."""
    parts = F.split(_bare(title), r"(?<=[.!?])\s+")
    good = F.filter(F.transform(parts, lambda s, i: F.when(~s.rlike(NOT_TITLE), i)), lambda i: i.isNotNull())
    return F.when(F.size(good) > 0, F.nullif(_bare(F.array_join(F.slice(parts, F.get(good, F.lit(0)) + 1, F.size(parts)), " ")), F.lit("")))


def finalised(entries: Column) -> Column:
    """Entries without glued numbers, captions and blanks."""
    bare = F.transform(entries, lambda e: _bare(F.regexp_replace(_bare(e), GLUED, "")))
    return F.filter(bare, lambda e: (e != "") & ~e.rlike(CAPTION))


def structured_entry(text: Column) -> Column:
    """One entry on one line, without its mark."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), _bare), lambda x: x != "")
    return _bare(F.regexp_replace(F.array_join(lines, " "), ENTRY_MARK, ""))


def _after_marks(text: Column, mark: str) -> Column:
    """What follows each mark, its captions cut out, lines joined; null under two marks."""
    bodies = F.filter(F.transform(F.split(text, mark, -1), lambda b, i: F.when(i > 0, b)), lambda b: b.isNotNull())
    parts = F.flatten(F.transform(bodies, lambda b: F.split(F.regexp_replace(b, CAPTION_LINE, "\u0001"), "\u0001")))
    lines = F.transform(parts, lambda p: _bare(F.array_join(F.transform(F.split(_bare(p), "\n"), _bare), " ")))
    some = F.filter(lines, lambda x: x != "")
    return F.when((F.size(bodies) >= 2) & (F.size(some) > 0), some)


def _longer(parts: Column, than: int) -> Column:
    return F.filter(F.transform(parts, _bare), lambda p: F.length(p) > than)


def split_references(text: Column) -> Column:
    """Entries of a reference section: by marks at line starts, numbers or brackets in line, blank lines, authors or lines."""
    t = _bare(F.coalesce(text, F.lit("")))
    several = lambda c: F.when(F.size(c) >= 2, c)
    authors = F.split(t, AUTHOR_LINE, -1)
    authors = F.filter(authors, lambda p: p.rlike(r"^[A-Z][a-z\-]{1,25},\s+[A-Z]"))
    by_author = F.when(F.size(authors) >= 2, F.when(F.size(_longer(authors, 15)) > 0, _longer(authors, 15)))
    ways = [_after_marks(t, m) for m in (LINE_MARK, INLINE_NUMBER, INLINE_BRACKET)]
    ways += [several(_longer(F.split(t, r"\n[ \t]*\n"), 15)), by_author, several(_longer(F.split(t, r"\r?\n"), 20))]
    found = F.coalesce(*map(finalised, ways))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.coalesce(found, F.array(t)))


def tiered(*tiers: Column) -> Column:
    """The first list of two entries or more, else the first that is not empty."""
    none = F.array().cast("array<string>")
    enough = [F.when(F.size(t) >= 2, t) for t in tiers]
    any_ = [F.when(F.size(t) > 0, t) for t in tiers]
    return F.coalesce(*enough, *any_, none)


def created(text: Column, now_year: int, now_month: int, head: int = 3000) -> Column:
    """The latest date (year, month or null) in a text's head that is not in the future; null without one."""
    t = F.substring(F.coalesce(text, F.lit("")), 1, head)
    named = rf"\b([A-Za-z]{{3,9}})\.?\s+(?:\d{{1,2}}(?:st|nd|rd|th)?,?\s+)?({YEAR})\b"
    month = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(i))])
    date = lambda y, m: F.struct(y.cast("int").alias("year"), m.cast("int").alias("month"))
    words, years = (F.regexp_extract_all(t, F.lit(named), F.lit(g)) for g in (1, 2))
    spoken = F.zip_with(words, years, lambda w, y: date(y, F.try_element_at(month, F.lower(F.substring(w, 1, 3)))))
    iso = rf"\b({YEAR})-(\d{{2}})\b"
    dashed = F.zip_with(*(F.regexp_extract_all(t, F.lit(iso), F.lit(g)) for g in (1, 2)), date)
    bare = F.transform(F.regexp_extract_all(t, F.lit(rf"\b({YEAR})\b"), F.lit(1)), lambda y: date(y, F.lit(None)))
    known = F.filter(F.concat(spoken, dashed), lambda d: d["month"].between(1, 12))
    good = F.filter(F.concat(known, bare), lambda d: plausible_date(d["year"], d["month"], now_year, now_month))
    return F.array_max(good)  # an unknown month is the least


def sections(items: DataFrame) -> DataFrame:
    """(doc_id, ordinal, label, text, page) to (doc_id, section, heading, text, pages): a header opens a section."""
    rows = items.withColumn("text", _bare(F.coalesce("text", F.lit("")))).where("text <> ''").withColumn("head", F.col("label").isin("section_header", "title"))
    order = W.partitionBy("doc_id").orderBy("ordinal")
    rows = rows.withColumn("section", F.sum(F.col("head").cast("int")).over(order))
    body = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("ordinal", "text"))))["text"]
    out = rows.groupBy("doc_id", "section").agg(F.coalesce(F.max(F.when(F.col("head"), F.col("text"))), F.lit("")).alias("heading"), F.array_join(body, " ").alias("text"), F.when(F.count("page") > 0, F.array(F.min("page"), F.max("page"))).alias("pages"))
    return out


def body_text(sections: Column, text: Column) -> Column:
    """Texts of sections that are neither blank nor references, or the whole text where there are none."""
    kept = F.filter(sections, lambda s: (_bare(F.coalesce(s["text"], F.lit(""))) != "") & ~is_reference_heading(s["heading"]))
    return F.when(F.size(F.coalesce(kept, F.array())) > 0, F.array_join(F.transform(kept, lambda s: s["text"]), "\n")).otherwise(text)


def fallback(ways: list[Column], text: Column) -> Column:
    """title, authors and abstract, each from the first of the structs that has it; an abstract at last from the text."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    authors = F.coalesce(*[F.when(F.size(w["authors"]) > 0, w["authors"]) for w in ways], F.array().cast("array<string>"))
    return F.struct(F.coalesce(*[given(w["title"]) for w in ways]).alias("title"), authors.alias("authors"), F.coalesce(*[given(w["abstract"]) for w in ways], given(first_words(text))).alias("abstract"))


def extractable(status: Column, done: Column, force: bool = False) -> Column:
    """Is a document to be processed: forced or not yet done, and completed, pending or of no status."""
    ready = status.isNull() | status.isin("completed", "pending")
    return ready & (F.lit(force) | ~F.coalesce(done, F.lit(False)))


def extraction_report(outcomes: DataFrame) -> DataFrame:
    """(doc_id, filename, status, done, error) to one row: ids extracted, number skipped, errors in order of id."""
    todo = extractable(F.col("status"), F.col("done"))
    return outcomes.agg(
        F.sort_array(F.collect_list(F.when(todo & F.col("error").isNull(), F.col("doc_id")))).alias("extracted"),
        F.count(F.when(~todo, 1)).alias("skipped"),
        F.sort_array(F.collect_list(F.when(todo & F.col("error").isNotNull(), F.struct("doc_id", "filename", "error")))).alias("errors"),
    )


def coverage(docs: DataFrame, **tests: Column) -> DataFrame:
    """One row: number of documents, and of those for which each test holds."""
    return docs.agg(F.count("*").alias("n"), *[F.count(F.when(t, 1)).alias(k) for k, t in tests.items()])


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A prompt with {key} replaced for the keys given, and for those only."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), template)


def prompt(catalogue: DataFrame, name: str) -> str:
    """A prompt's text by its name; an unknown name is an error."""
    row = catalogue.where(F.col("name") == name).select("text").first()
    if row is None:
        raise KeyError(name)
    return row[0]

"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words and reference headings that results depend on.
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with",
    "by", "from", "as", "is", "was", "are", "were", "be", "been", "being", "have",
    "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "this", "that", "these", "those", "it", "its", "i", "we", "you", "he",
    "she", "they", "their", "our", "us", "not", "no", "so", "if", "than", "then",
]
REFERENCE_HEADINGS = ["references", "bibliography", "works cited", "literature cited", "citations"]


def tokens(text: Column) -> Column:
    """Lower-case runs of a to z longer than two letters, without stop words; null gives none."""
    return F.filter(long_runs(text), lambda t: ~t.isin(STOPWORDS))


def long_runs(text: Column) -> Column:
    """tokens() with the stop words still there; they cost less to drop from rows than from an array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def spaceless(text: Column) -> Column:
    return F.array_join(tokens(text), "")


def norm_heading(text: Column) -> Column:
    bare = F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"^[\divxlc]+[.)]?\s+", "")
    return F.regexp_replace(bare, r"[\s.:]+$", "")


def is_reference_heading(text: Column) -> Column:
    return norm_heading(text).isin(REFERENCE_HEADINGS)


def norm_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def norm_doi(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return F.regexp_replace(F.trim(bare), r"\.+$", "")


def find_doi(text: Column, head: int = 5000) -> Column:
    """The first DOI in the head of a text, or null."""
    hit = F.regexp_extract(F.substring(F.coalesce(text, F.lit("")), 1, head), r"\b(10\.[0-9]{4,9}/[-._;()/:a-zA-Z0-9]+)", 1)
    return F.nullif(F.regexp_replace(hit, r"[.,;)\]]+$", ""), F.lit(""))


def strip_markup(text: Column) -> Column:
    """Tags become blanks, white space collapses, a leading "abstract" goes."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "), r"\s+", " "))
    return F.trim(F.regexp_replace(plain, r"^(?i)abstract[\s:.]*", ""))


def surname(name: Column) -> Column:
    """Of "Last, First" the part before the comma, else of the whole name, the last run of letters."""
    part = F.split_part(F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lit(","), F.lit(1))
    return F.coalesce(F.try_element_at(F.regexp_extract_all(part, F.lit(r"[a-zà-öø-ÿ'\-]{2,}"), F.lit(0)), F.lit(-1)), F.lit(""))


def index_tokens(title: Column) -> Column:
    """Informative tokens of a normalised title, or all of them where none is."""
    every = F.array_distinct(F.filter(F.split(title, " "), lambda t: t != ""))
    good = F.filter(every, lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS))
    return F.when(F.size(good) > 0, good).otherwise(every)


def first_words(text: Column, n: int = 200) -> Column:
    return F.array_join(F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), 1, n), " ")


def meta_text(title: Column, abstract: Column, text: Column) -> Column:
    """Title and abstract on two lines, or the first 200 words where both are missing."""
    meta = F.concat_ws("\n", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(abstract), F.lit("")))
    return F.when(meta != "", meta).otherwise(first_words(text))


def content_id(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def plausible_date(year: Column, month: Column, now_year: int, now_month: int) -> Column:
    """Not later than the given month; an unknown month is fine in the same year."""
    return (year < now_year) | ((year == now_year) & (month.isNull() | (month <= now_month)))


def page_type(has_image: Column, chars: Column, area: Column, threshold: float = 0.0008) -> Column:
    density = F.round(F.try_divide(chars.cast("double"), area), 6)
    return F.when(has_image & (density < threshold), "scanned").when(has_image, "mixed").when(density >= threshold, "digital").otherwise("scanned")


def split_oversized(text: Column, most: int = 8000) -> Column:
    """At most ceil(length / most) pieces of equally many words, cut at single blanks and else unchanged."""
    words = F.split(text, " ", -1)
    step = F.ceil(F.size(words) / F.greatest(F.ceil(F.length(text) / most), F.lit(1))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.size(words) - 1, step), lambda i: F.array_join(F.slice(words, i + 1, step), " "))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(cut)


def reference_section(text: Column) -> Column:
    """What follows the last line that is a heading of references, trimmed; null without one."""
    heading = "|".join(sorted(REFERENCE_HEADINGS, key=len, reverse=True))
    pattern = rf"(?is)^(?:.*\n)?(?:{heading})[ \t\r]*\n(.*)$"
    return F.when(text.rlike(pattern), F.regexp_replace(F.regexp_extract(text, pattern, 1), r"^\s+|\s+$", ""))


def fenced_json(text: Column) -> Column:
    """The inside of the first code fence, or the text itself, trimmed."""
    inside = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.trim(F.when(text.contains("```"), inside).otherwise(text))


def query_class(reply: Column) -> Column:
    """type ("reason" or "retrieval") and confidence (0 to 1, else 0.5) of a classifier's reply, JSON or not."""
    body = fenced_json(F.coalesce(reply, F.lit("")))
    parsed = F.from_json(body, "type string, confidence double")
    is_json = F.try_parse_json(body).isNotNull()
    named = F.lower(F.regexp_extract(body, "(?i)(retrieval|reason)", 1))
    kind = F.when(F.when(is_json, parsed["type"]).otherwise(named) == "reason", "reason").otherwise("retrieval")
    sure = F.when(is_json & parsed["confidence"].isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), parsed["confidence"]))).otherwise(0.5)
    return F.struct(kind.alias("type"), sure.alias("confidence"))


def normal_email(text: Column) -> Column:
    """Trimmed and lower-case, or null where it is no address."""
    bare = F.trim(text)
    return F.when(bare.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lower(bare))

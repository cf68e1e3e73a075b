"""Queries over small inline tables, for what the given tables do not hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import citations, grounding, images, knowledge, metadata, rank, reading, replies, shapes
from lexforge.operators.chunking import chunk
from lexforge.plans.corpus import QUERIES, query, table

_DOIS = "(VALUES (1, 'see 10.1000/abc.def).'), (2, 'https://doi.org/10.5555/XY-1'), (3, 'none'), (4, 'a 10.12/short b 10.99999/ok;x')) AS t(id, text)"


@query(f"SELECT id, nullif(regexp_replace(regexp_extract(text, '\\b(10\\.[0-9]{{4,9}}/[-._;()/:a-zA-Z0-9]+)', 1), '[.,;)\\]]+$', ''), '') AS doi, regexp_replace(regexp_replace(lower(trim(text)), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', ''), '\\.+$', '') AS norm FROM {_DOIS}")
def find_doi(spark, sf_dir):
    rows = spark.sql(f"SELECT * FROM {_DOIS}")
    return rows.select("id", T.find_doi(F.col("text")).alias("doi"), T.norm_doi(F.col("text")).alias("norm"))


_PAGES = "(VALUES (1, true, 10, 480000), (1, true, 900, 480000), (1, false, 900, 480000), (2, false, 0, 480000), (3, false, 4000, 480000), (3, false, 4000, 480000)) AS t(doc, image, chars, area)"


@query(f"""WITH p AS (SELECT doc, CASE WHEN image AND round(chars / area, 6) < 0.0008 THEN 'scanned' WHEN image THEN 'mixed' WHEN round(chars / area, 6) >= 0.0008 THEN 'digital' ELSE 'scanned' END AS kind FROM {_PAGES})
    SELECT d.doc, CASE WHEN avg(CASE WHEN kind <> 'digital' THEN 1.0 WHEN kind = 'digital' THEN 0.0 END) < 0.3 THEN 'digital' ELSE 'ocr' END AS converter, count(*) FILTER (kind = 'scanned') AS scanned FROM (VALUES (1), (2), (3), (4)) AS d(doc) LEFT JOIN p ON p.doc = d.doc GROUP BY d.doc""")
def converter_routing(spark, sf_dir):
    kind = T.page_type(F.col("image"), F.col("chars"), F.col("area"))
    docs = spark.sql("SELECT * FROM (VALUES (1), (2), (3), (4)) AS d(doc)")
    return images.routed(docs, spark.sql(f"SELECT * FROM {_PAGES}").withColumn("kind", kind))


_DATES = "(VALUES (1, 2017, 6), (2, 2024, 6), (3, 2024, 5), (4, 2025, NULL), (5, 2024, NULL)) AS t(id, year, month)"


@query(f"SELECT id, year < 2024 OR (year = 2024 AND (month IS NULL OR month <= 5)) AS plausible FROM {_DATES}")
def plausible_dates(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {_DATES}").select("id", T.plausible_date(F.col("year"), F.col("month"), 2024, 5).alias("plausible"))


_CLUSTERS = "(VALUES (0, 5), (1, 3), (2, 1), (3, 1)) AS t(cluster, size)"


@query(f"""WITH w AS (SELECT *, 3 * size // sum(size) OVER () AS whole, round(3.0 * size / sum(size) OVER () - floor(3.0 * size / sum(size) OVER ()), 12) AS rest FROM {_CLUSTERS})
    SELECT cluster, size, CAST(whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, size DESC, cluster) <= 3 - sum(whole) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM w""")
def quota_fixture(spark, sf_dir):
    return rank.quotas(spark.sql(f"SELECT * FROM {_CLUSTERS}"), 3)


def _papers(spark):
    docs = [
        (1, "Attention based models for translation", ["Gomez, Aidan", "Noam Shazeer"], 2017, "10.1000/one"),
        (2, "A survey of graph clustering methods", ["Maria Lopez"], 2018, "10.1000/two"),
        (3, "Entropy", ["Ann Key"], 2015, None),
        (4, "Deep learning for molecules and much more", ["Kim Lee"], 2021, "10.1000/two"),
        (5, "A survey of graph clustering methods", ["Other Person"], 2019, None),
        (6, "Citing paper", ["Zed Yu"], 2018, None),
    ]
    refs = [
        (1, 6, "x", [], "https://doi.org/10.1000/ONE"), (2, 6, "A Survey of Graph Clustering Methods.", ["Lopez, M."], None), (3, 6, "Entropy", [], None),
        (4, 6, "Deep learning for molecules and much more", ["Kim Lee"], None), (5, 6, "graph clustering", ["Maria Lopez"], None), (6, 1, "y", [], "doi:10.1000/two."),
        (7, 6, "Attention based models for translation", ["Wrong Name"], None), (8, 6, "Citing paper", [], None),
    ]
    return (
        spark.createDataFrame(docs, "doc_id int, title string, authors array<string>, year int, doi string"),
        spark.createDataFrame(refs, "ref_id int, doc_id int, title string, authors array<string>, doi string"),
    )


@query("SELECT * FROM (VALUES (6, 1), (6, 2), (6, 3), (1, 4)) AS t(src, dst)")
def citation_graph(spark, sf_dir):
    return citations.graph(*_papers(spark))


_REPLIES = "(VALUES (1, 'a [n1] b [#2] c [source 3]', 3), (2, 'see [1](http://x.y) and [9]', 2), (3, 'only [7]', 2), (4, '[N1] [ excerpt. 2 , 9] [1, 2](u) [ref 3]x[1,5]', 2), (5, 'none [x] [ 1 ]', 1), (6, '', 1)) AS t(id, reply, sources)"
_LOOSE, _LINKED, _PLAIN = (p.replace("'", "''") for p in (replies.LOOSE, replies.LINKED, replies.PLAIN))


@query(f"""WITH p AS (SELECT id, sources, regexp_replace(regexp_replace(reply, '{_LOOSE}', '[\\1]', 'g'), '{_LINKED}', '[\\1]', 'g') AS r FROM {_REPLIES}),
    m AS (SELECT id, sources, string_split_regex(r, '{_PLAIN}') AS a, regexp_extract_all(r, '{_PLAIN}') AS b FROM p),
    x AS (SELECT id, a, b, list_transform(b, lambda y: list_filter(list_transform(regexp_extract_all(y, '[0-9]+'), lambda z: CAST(z AS INT)), lambda z: z BETWEEN 1 AND sources)) AS n FROM m)
    SELECT id, array_to_string(list_transform(range(1, len(a) + 1), lambda i: a[i] || CASE WHEN i > len(b) THEN '' WHEN len(n[i]) = 0 THEN b[i] ELSE '[' || array_to_string(n[i], ', ') || ']' END), '') AS reply FROM x""")
def normalised_citations(spark, sf_dir):
    rows = spark.sql(f"SELECT * FROM {_REPLIES}")
    return rows.select("id", replies.normalised(F.col("reply"), F.col("sources")).alias("reply"))


@query("SELECT * FROM (VALUES (1, 1, 10), (2, 2, 0)) AS t(marker_id, quote_id, gap)")
def nearest_quotes(spark, sf_dir):
    markers = spark.sql("SELECT * FROM (VALUES (1, 1, 60), (2, 1, 120), (3, 1, 900)) AS t(marker_id, reply_id, pos)")
    quotes = spark.sql("SELECT * FROM (VALUES (1, 1, 10, 50), (2, 1, 70, 130)) AS t(quote_id, reply_id, start, `end`)")
    return grounding.nearest_quote(markers, quotes)


_LEVELS = "SELECT l_returnflag || l_linestatus AS page, l_linenumber AS row, CAST(l_quantity * 5 AS INT) AS level FROM lineitem"


def _pixels(spark, sf_dir):
    """Quantities as grey levels of pages of seven rows."""
    level = (F.col("l_quantity") * 5).cast("int").alias("level")
    return table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("page"), F.col("l_linenumber").alias("row"), level)


@query(f"""WITH p AS ({_LEVELS}), h AS (SELECT page, level, count(*) AS n FROM p GROUP BY ALL), e AS (SELECT DISTINCT page FROM p)
    SELECT e.page, CAST(r.i AS INT) AS level, coalesce(h.n, 0) AS n FROM e CROSS JOIN range(256) AS r(i) LEFT JOIN h ON h.page = e.page AND h.level = r.i""")
def page_histogram(spark, sf_dir):
    return images.full_histogram(_pixels(spark, sf_dir))


@query(f"""WITH h AS (SELECT page, level, count(*) AS n FROM ({_LEVELS}) GROUP BY ALL),
    c AS (SELECT page, level, CAST(sum(n) OVER w AS DOUBLE) AS b, CAST(sum(level * n) OVER w AS DOUBLE) AS bs, CAST(sum(n) OVER (PARTITION BY page) AS DOUBLE) AS a, CAST(sum(level * n) OVER (PARTITION BY page) AS DOUBLE) AS s
          FROM h WINDOW w AS (PARTITION BY page ORDER BY level)),
    v AS (SELECT page, level, CASE WHEN a > b THEN b * (a - b) * pow(bs / b - (s - bs) / (a - b), 2) ELSE 0 END AS v FROM c),
    r AS (SELECT page, level, v, row_number() OVER (PARTITION BY page ORDER BY v DESC, level) AS k FROM v)
    SELECT page, CASE WHEN v > 0 THEN level ELSE 0 END AS threshold FROM r WHERE k = 1""")
def otsu_threshold(spark, sf_dir):
    return images.otsu(_pixels(spark, sf_dir))


@query(f"SELECT page, round(var_pop(ink), 6) AS variance FROM (SELECT page, row, count(*) FILTER (level < 128) AS ink FROM ({_LEVELS}) GROUP BY ALL) GROUP BY page")
def ink_row_variance(spark, sf_dir):
    return images.row_variance(_pixels(spark, sf_dir)).select("page", F.round("variance", 6).alias("variance"))


@query(f"SELECT page, count(*) FILTER (level > 10) / count(*) > 0.95 AS blank FROM ({_LEVELS}) GROUP BY page")
def blank_pages(spark, sf_dir):
    return images.blank(_pixels(spark, sf_dir), above=10, share=0.95)


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g') AS text FROM documents),
    w AS (SELECT doc_id, text, string_split(text, ' ') AS w, CASE WHEN length(text) > 8000 THEN CAST(ceil(length(text) / 8000.0) AS BIGINT) ELSE 1 END AS k FROM t WHERE text <> ''),
    s AS (SELECT doc_id, w, CAST(ceil(len(w) / CAST(k AS DOUBLE)) AS BIGINT) AS size FROM w),
    p AS (SELECT doc_id, w, size, unnest(range(0, CAST(ceil(len(w) / CAST(size AS DOUBLE)) AS BIGINT))) AS piece FROM s)
    SELECT doc_id, CAST(piece AS INT) AS piece, array_to_string(w[piece * size + 1:(piece + 1) * size], ' ') AS text FROM p""")
def extraction_pieces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("chunk_id"), F.lit(None).cast("string").alias("heading"), "text")
    return knowledge.pieces(docs).select("doc_id", "piece", "text")


_TRIPLES = "(VALUES ('a', 'is', 'b'), ('a', 'is', 'b'), ('b', 'has', ' '), (NULL, 'is', 'c'), ('b', 'has', 'c'), ('c', '', 'a')) AS t(subject, predicate, object)"
_ENTITIES = "(VALUES ('a'), ('b'), (''), ('  '), (NULL), ('a'), ('c')) AS t(entity)"


@query(f"SELECT DISTINCT subject, predicate, object FROM {_TRIPLES} WHERE trim(subject) <> '' AND trim(predicate) <> '' AND trim(object) <> ''")
def clean_triples(spark, sf_dir):
    return knowledge.clean_triples(spark.sql(f"SELECT * FROM {_TRIPLES}"))


@query(f"SELECT (SELECT count(DISTINCT entity) FROM {_ENTITIES} WHERE trim(entity) <> '') AS entities, (SELECT count(*) FROM (SELECT DISTINCT subject, predicate, object FROM {_TRIPLES} WHERE trim(subject) <> '' AND trim(predicate) <> '' AND trim(object) <> '')) AS relations, (SELECT count(DISTINCT predicate) FROM {_TRIPLES} WHERE trim(subject) <> '' AND trim(predicate) <> '' AND trim(object) <> '') AS relation_types")
def graph_counts(spark, sf_dir):
    return knowledge.counts(spark.sql(f"SELECT * FROM {_ENTITIES}"), spark.sql(f"SELECT * FROM {_TRIPLES}"))


_WORKS = [
    ("10.1000/a", '{"title": [" On trees "], "author": [{"given": "Ann", "family": "Key"}, {"family": "Lee"}, {}], "issued": {"date-parts": [[2019, 4, 2]]}, "is-referenced-by-count": 7, "reference": [{"volume-title": "Vol", "DOI": "10.1/x"}, {"article-title": "Art", "author": "Bo"}]}'),
    ("10.1000/b", None), ("10.1000/c", '{"title": "Plain", "issued": {"date-parts": [[2024, 6]]}}'), ("10.1000/d", '{"title": [], "issued": {"date-parts": [[2024]]}}'),
]


@query("""SELECT * FROM (VALUES ('10.1000/a', true, 'On trees', 'Ann Key|Lee', 2019, 4, 'Vol|Art', 7), ('10.1000/b', false, NULL, '', NULL, NULL, NULL, NULL),
    ('10.1000/c', true, 'Plain', '', NULL, NULL, NULL, NULL), ('10.1000/d', true, NULL, '', 2024, NULL, NULL, NULL)) AS t(doi, hit, title, authors, year, month, refs, cited_by)""".replace("SELECT *", "SELECT doi, hit, title, authors, year, month, refs, CAST(cited_by AS BIGINT) AS cited_by"))
def registry_records(spark, sf_dir):
    out = metadata.normalise(spark.createDataFrame(_WORKS, "doi string, work string"), 2024, 5)
    return out.select("doi", "hit", "title", F.array_join("authors", "|").alias("authors"), "created.year", "created.month", F.array_join(F.col("refs.title"), "|").alias("refs"), "cited_by")


@query("SELECT * FROM (VALUES (1, 'On trees', 'match'), (2, 'Own 2', 'miss'), (3, 'Own 3', 'absent'), (4, 'Own 4', 'none'), (5, 'Own 5', 'match')) AS t(doc_id, title, lookup)")
def registry_overlay(spark, sf_dir):
    docs = [(1, "10.1000/a", "Own 1", []), (2, "10.1000/b", "Own 2", ["Me"]), (3, "10.1000/zz", "Own 3", []), (4, None, "Own 4", []), (5, "10.1000/d", "Own 5", ["Me"])]
    records = metadata.normalise(spark.createDataFrame(_WORKS, "doi string, work string"), 2024, 5)
    return metadata.overlay(spark.createDataFrame(docs, "doc_id int, doi string, title string, authors array<string>"), records).select("doc_id", "title", "lookup")


@query()
def cluster_hulls(spark, sf_dir):
    """Hulls of each label's vectors over their first two components; the tests compare them with brute force."""
    e = table(spark, sf_dir, "embeddings")
    return shapes.hulls(e.select(F.col("label").alias("cluster"), F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y")))


@query("SELECT * FROM (VALUES (1, '2,3,4,5,1,6'), (2, '1,2,3'), (3, '3,1,2'), (4, NULL)) AS t(id, pages)")
def page_orders(spark, sf_dir):
    rows = spark.sql("SELECT * FROM (VALUES (1, 3, 4, 6), (2, 1, 1, 3), (3, 4, 9, 3), (4, 1, 1, 0)) AS t(id, a, b, n)")
    return rows.select("id", F.array_join(reading.page_order(F.col("a"), F.col("b"), F.col("n")), ",").alias("pages"))


@query("SELECT user_id, event_id AS item FROM events WHERE event_id + 10 > 100 AND event_id < 200")
def overlapping_spans(spark, sf_dir):
    spans = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("item"), F.col("event_id").alias("start"), (F.col("event_id") + 10).alias("end"))
    return reading.overlapping(spans, 100, 200).select("user_id", "item")


@query("SELECT * FROM (VALUES (1), (4), (5)) AS t(id)")
def quotes_of_sentence(spark, sf_dir):
    rows = [(1, "As Müller says, “graphs are every-where”.", "Graphs are everywhere"), (2, "As said here", "As said"), (3, "One claim of many words", "another claim of words"), (4, None, "x"), (5, "…", None)]
    return reading.relevant_quotes(spark.createDataFrame(rows, "id int, sentence string, quote string")).select("id")


@query("SELECT l_orderkey AS reply_id, l_suppkey AS doc_id, min(l_linenumber) AS place, bool_or(l_linestatus = 'F') AS verified FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL")
def source_chips(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return reading.chips(li.select(F.col("l_orderkey").alias("reply_id"), F.col("l_linenumber").alias("place"), F.col("l_suppkey").alias("doc_id"), (F.col("l_returnflag") != "N").alias("cited"), (F.col("l_linestatus") == "F").alias("verified")))


@query("""WITH p AS (SELECT l_orderkey AS target, l_linenumber AS page, list_sort(list(DISTINCT l_suppkey)) AS i FROM lineitem GROUP BY ALL)
    SELECT target, page, array_to_string(i, ',') AS items, page = min(page) OVER (PARTITION BY target) AS scroll_here FROM p""")
def page_highlights(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_linenumber").alias("page"), F.col("l_suppkey").alias("item"))
    return reading.highlights(hits).select("target", "page", F.array_join("items", ",").alias("items"), "scroll_here")


@query("SELECT * FROM (VALUES (1, '[1] A.' || chr(10) || '[2] B.'), (2, 'last'), (3, NULL), (4, '')) AS t(id, refs)")
def reference_sections(spark, sf_dir):
    rows = [(1, "Body\nReferences\n\n[1] A.\n[2] B.\n"), (2, "BIBLIOGRAPHY\nfirst\nWorks cited \nlast"), (3, "References in text only"), (4, "x\nReferences\n")]
    return spark.createDataFrame(rows, "id int, text string").select("id", T.reference_section(F.col("text")).alias("refs"))


@query("SELECT id, type, CAST(confidence AS DOUBLE) AS confidence FROM (VALUES (1, 'reason', 0.8), (2, 'reason', 1), (3, 'reason', 0.5), (4, 'retrieval', 0.5), (5, 'retrieval', 0), (6, 'retrieval', 0.5)) AS t(id, type, confidence)")
def classified_queries(spark, sf_dir):
    rows = [(1, '{"type": "reason", "confidence": 0.8}'), (2, '```json\n{"type": "reason", "confidence": 7}\n```'), (3, 'I would REASON here'), (4, "no idea"), (5, '{"type": "other", "confidence": -1}'), (6, None)]
    return spark.createDataFrame(rows, "id int, reply string").select("id", T.query_class(F.col("reply")).alias("c")).select("id", "c.type", "c.confidence")


_EMAILS = "(VALUES (1, ' Ann@X.org '), (2, 'a b@x.org'), (3, 'a@x'), (4, NULL)) AS t(id, email)"


@query(f"SELECT id, CASE WHEN regexp_matches(trim(email), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN lower(trim(email)) END AS email FROM {_EMAILS}")
def normal_emails(spark, sf_dir):
    rows = spark.sql(f"SELECT * FROM {_EMAILS}")
    return rows.select("id", T.normal_email(F.col("email")).alias("email"))


@query()
def document_chunks(spark, sf_dir):
    """Chunks of 180 words with overlap; the tests compare them with their invariants."""
    docs = table(spark, sf_dir, "documents")
    return chunk(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")).select("doc_id", "chunk_id", "chunk_index", "text", "prefix_len")


assert "document_chunks" in QUERIES

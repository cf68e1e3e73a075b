"""Queries of replies, references, viewer, ranking and services, over the given tables and small inline ones."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import images, lexical, rank, references, relational, replies, services, shapes, viewer
from lexforge.operators.graph import cut, if_small
from lexforge.plans import corpus
from lexforge.plans.corpus import query, table

_HYBRID = f"""WITH {corpus._BM25}, kc AS (SELECT source AS cluster, term, round(sum(tf) * max(idf), 6) AS s FROM tf JOIN documents USING (doc_id) JOIN df USING (term) GROUP BY ALL),
    kr AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, term) AS rn FROM kc), kq AS (SELECT DISTINCT item_id, unnest({corpus._TOKENS}) AS term FROM benchmark),
    kb AS (SELECT item_id, cluster, round(pow(1.05, count(*)), 6) AS boost FROM kq JOIN kr USING (term) WHERE rn <= 20 GROUP BY ALL),
    v AS (SELECT b.item_id, d.doc_id, d.source, list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS sim FROM benchmark b JOIN embeddings x ON x.vec_id = b.item_id, documents d JOIN embeddings y ON y.vec_id = d.doc_id),
    h AS (SELECT v.item_id, v.doc_id, round(sim, 6) AS sim, round(round(sim, 6) * coalesce(boost, 1) + coalesce(r.score, 0), 6) AS score FROM v LEFT JOIN kb ON kb.item_id = v.item_id AND kb.cluster = v.source LEFT JOIN r ON r.item_id = v.item_id AND r.doc_id = v.doc_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, max(score) OVER (PARTITION BY item_id) AS best FROM h)"""


@query(f"{_HYBRID} SELECT item_id, doc_id, sim, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 8 AND (rank = 1 OR score >= greatest(0.5 * best, 0))")
def hybrid_top8(spark, sf_dir):
    """Vectors with the numbers of questions and documents stand in for theirs."""
    docs, asked, vecs = (table(spark, sf_dir, t) for t in ("documents", "benchmark", "embeddings"))
    v, tf, cluster = F.col("embedding").alias("v"), lexical.postings(docs), F.col("source").alias("cluster")
    chunks = cut(docs.join(vecs, docs.doc_id == vecs.vec_id).select("doc_id", cluster, v))
    sims = lexical.similarities(asked.join(vecs, asked.item_id == vecs.vec_id).select("item_id", v), chunks).withColumn("sim", F.round("sim", 6))
    boosts = if_small(cut(corpus._boosts(lexical.cluster_keywords(tf, corpus._n(docs), docs.select("doc_id", cluster)), asked)))
    found = cut(lexical.retriever_scores(tf, corpus._n(docs), asked).withColumn("bm25", F.round("bm25", 6)))
    lex = lexical.against_best(found).join(chunks.select("doc_id").distinct(), "doc_id", "left_semi")
    scored = lexical.hybrid(sims, boosts, lex).withColumn("score", F.round("score", 6))
    return lexical.top_with_floor(scored).select("item_id", "doc_id", "sim", "score", "rank")


_FINAL = f"""{corpus._NOVEL}, p AS (SELECT doc_id, source, {corpus._pct('PARTITION BY source')} AS nov, (rank() OVER (PARTITION BY source ORDER BY n_chars) - 1 + (count(*) OVER (PARTITION BY source, n_chars) - 1) / 2.0) / greatest(count(*) OVER (PARTITION BY source) - 1, 1) AS rep,
        count(*) OVER (PARTITION BY source) AS size FROM (SELECT nv.*, n_chars FROM nv JOIN documents USING (doc_id))),
    f AS (SELECT doc_id, source, round(0.25 * (0.8 * (CASE WHEN size = 1 THEN 1 ELSE rep END) + 0.2 * nov) + 0.75 * (1.0 / (1 + doc_id % 7)), 9) AS score FROM p)"""


def _final(spark, sf_dir):
    """Lengths stand in for representativeness and numbers for link scores."""
    docs = corpus._novelty(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    rep, nov = rank.percentile(F.col("n_chars"), "source"), rank.percentile(F.col("novelty"), "source")
    return docs.select("doc_id", "source", F.round(rank.final_score(rep, nov, 1.0 / (1 + F.col("doc_id") % 7)), 9).alias("score"))


@query(f"{_FINAL} SELECT * FROM f")
def final_document_scores(spark, sf_dir):
    return _final(spark, sf_dir)


@query(f"{_FINAL} SELECT doc_id, score FROM f WHERE doc_id IN (SELECT vec_id FROM embeddings) ORDER BY score DESC, doc_id LIMIT 2")
def top_documents_with_chunks(spark, sf_dir):
    return relational.top_with_chunks(_final(spark, sf_dir), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))).select("doc_id", "score")


@query("SELECT conv_id AS doc_id, turn AS chunk_index, content AS text, row_number() OVER (ORDER BY conv_id, turn) AS place FROM (SELECT conv_id, turn, text AS content FROM conversations)")
def chunk_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "text")
    place = F.row_number().over(W.orderBy("doc_id", "chunk_index"))  # only to show the order
    return relational.ordered_chunks(rows).withColumn("place", place.cast("long"))


@query("SELECT o_orderkey AS doc_id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F'")
def documents_of_status(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"))
    return relational.with_status(relational.with_status(docs), "F")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def latest_of_each(spark, sf_dir):
    return relational.first_of(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderdate").desc(), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("""SELECT count(*) AS n, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (source IS NOT NULL AND source <> '') AS sourced, count(*) FILTER (n_chars > 2000) AS long,
    count(*) FILTER (regexp_matches(text, '\\b10\\.[0-9]{4,9}/')) AS with_doi FROM documents""")
def metadata_coverage(spark, sf_dir):
    given = F.coalesce(F.col("source"), F.lit("")) != ""
    return references.coverage(table(spark, sf_dir, "documents"), english=F.col("lang") == "en", sourced=given, long=F.col("n_chars") > 2000, with_doi=T.find_doi(F.col("text")).isNotNull())


_TURNS = "FROM (SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)"


@query(f"SELECT conv_id, CAST(len(t) + 2 AS INT) AS n, list_concat(t, [struct_pack(role := 'user', content := 'and then?'), struct_pack(role := 'assistant', content := 'so')])[-3].content AS third_last, len(list_filter(t, lambda m: m.role IS NULL OR m.content IS NULL)) = 0 AS valid {_TURNS}")
def conversation_append(spark, sf_dir):
    turn = F.struct("turn", F.col("role").alias("role"), F.col("text").alias("content"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    rows = rows.withColumn("t", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    more = replies.extended(F.col("t"), F.lit("and then?"), F.lit("so"))
    return rows.select("conv_id", F.size(more).alias("n"), F.element_at(more, -3)["content"].alias("third_last"), replies.well_formed(F.col("t")).alias("valid"))


@query(r"""SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+([A-Z0-9("''\[])', '\1' || chr(1) || '\2', 'g'), '([.!?])\s+([A-Z0-9("''\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda s: len(s) >= 25) AS parts FROM documents""")
def viewer_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", viewer.sentences(F.col("text")).alias("parts"))


_SENTENCES = r"""(VALUES (1, 'Graphs of papers cite each other often. Trees do not have cycles in them at all. Papers cite papers.', 'do graphs have cycles'), (2, 'Only one sentence that is long enough here', 'x')) AS t(chunk_id, body, focus)"""


@query(rf"""WITH s AS (SELECT chunk_id, focus, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS ordinal FROM (SELECT chunk_id, focus, list_filter(string_split(regexp_replace(body, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: len(x) >= 25) AS p FROM {_SENTENCES})),
    w AS (SELECT *, len(list_intersect(list_transform(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: len(x) >= 3), lambda x: regexp_replace(x, 's$', '')), list_transform(list_filter(string_split(focus, ' '), lambda x: len(x) >= 3), lambda x: regexp_replace(x, 's$', '')))) AS shared FROM s),
    c AS (SELECT *, 0.5 + 0.01 * ordinal + 0.1 * shared AS score FROM w), b AS (SELECT *, max(score) OVER (PARTITION BY chunk_id) AS best FROM c)
    SELECT chunk_id, CAST(ordinal AS INT) AS ordinal, text, CAST(round(score, 6) AS DOUBLE) AS score FROM b WHERE score >= best - 0.05""")
def picked_sentences(spark, sf_dir):
    rows = spark.sql(f"SELECT * FROM {_SENTENCES}").select("chunk_id", "focus", F.posexplode(viewer.sentences(F.col("body"))).alias("ordinal", "text"))
    rows = rows.withColumns({"a": viewer.folded(F.col("text")), "b": viewer.folded(F.col("focus"))})
    scored = rows.select("chunk_id", "ordinal", "text", (0.5 + 0.01 * F.col("ordinal")).alias("sim"), viewer.shared_words(F.col("a"), F.col("b")).alias("shared"))
    return viewer.picked(scored, precise=True).withColumn("score", F.round("score", 6))


@query("WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[\\x00-\\x7F]*')) SELECT doc_id, CAST(0 AS INT) AS start, CAST(len(array_to_string(w, '')) AS INT) AS stop FROM w WHERE len(array_to_string(w, '')) >= 16")
def chunks_on_pages(spark, sf_dir):
    """Each document is a page of one item and a chunk of it, so all of it is found."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"^[\x00-\x7F]*$")).select("doc_id", "text")
    pages = viewer.page_index(docs.select(F.col("doc_id").alias("page_id"), F.lit(0).alias("ordinal"), "text"))
    found = viewer.located(docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("page_id"), "text"), pages)
    return found.select(F.col("chunk_id").alias("doc_id"), "place.start", F.col("place.end").alias("stop"))


_STATES = "(VALUES (1, 'a.pdf', 'completed', false, NULL), (2, 'b.pdf', NULL, NULL, NULL), (3, 'c.pdf', 'failed', false, NULL), (4, 'd.pdf', 'pending', true, NULL), (5, 'e.pdf', 'pending', false, 'no text')) AS t(doc_id, filename, status, done, error)"


@query(f"""WITH g AS (SELECT *, (status IS NULL OR status IN ('completed', 'pending')) AND NOT coalesce(done, false) AS todo FROM {_STATES})
    SELECT array_to_string(list_sort(list(doc_id) FILTER (todo AND error IS NULL)), ',') AS extracted, count(*) FILTER (NOT todo) AS skipped, string_agg(doc_id || ':' || error, ',' ORDER BY doc_id) FILTER (todo AND error IS NOT NULL) AS errors FROM g""")
def extraction_report(spark, sf_dir):
    out = references.extraction_report(spark.sql(f"SELECT * FROM {_STATES}"))
    return out.select(F.array_join("extracted", ",").alias("extracted"), "skipped", F.array_join(F.transform("errors", lambda e: F.concat(e["doc_id"].cast("string"), F.lit(":"), e["error"])), ",").alias("errors"))


_ITEMS = "(VALUES (1, 1, 'text', ' intro ', 1), (1, 2, 'title', 'One', 1), (1, 3, 'text', 'a', 2), (1, 4, 'text', ' ', 9), (1, 5, 'text', 'b', 3), (1, 6, 'section_header', 'References', NULL), (1, 7, 'text', 'r', NULL), (1, 8, 'section_header', 'Two', 4), (2, 1, 'text', 'only', NULL)) AS t(doc_id, ordinal, label, text, page)"


@query(f"""WITH i AS (SELECT doc_id, ordinal, label IN ('title', 'section_header') AS head, trim(text) AS text, page FROM {_ITEMS} WHERE trim(text) <> ''), s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY ordinal) AS section FROM i)
    SELECT doc_id, section, coalesce(max(text) FILTER (head), '') AS heading, coalesce(string_agg(text, ' ' ORDER BY ordinal) FILTER (NOT head), '') AS text, min(page) AS first_page, max(page) AS last_page FROM s GROUP BY doc_id, section""")
def item_sections(spark, sf_dir):
    out = references.sections(spark.sql(f"SELECT * FROM {_ITEMS}"))
    return out.select("doc_id", "section", "heading", "text", F.get("pages", F.lit(0)).alias("first_page"), F.get("pages", F.lit(1)).alias("last_page"))


@query("SELECT * FROM (VALUES (1, 'intro' || chr(10) || 'a b'), (2, 'only')) AS t(doc_id, body)")
def section_bodies(spark, sf_dir):
    per = references.sections(spark.sql(f"SELECT * FROM {_ITEMS}")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "heading", "text"))).alias("s"))
    return per.select("doc_id", references.body_text(F.col("s"), F.lit("whole")).alias("body"))


_TITLES = "(VALUES (1, 'Journal of Trees. Vol. 3 is out! On trees. And more'), (2, 'On trees'), (3, 'All rights reserved.'), (4, NULL), (5, 'doi:10.1/x. ')) AS t(id, title)"


@query(f"""WITH p AS (SELECT id, string_split(regexp_replace(trim(title), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM {_TITLES}), n AS (SELECT id, s, list_position(list_transform(s, lambda x: regexp_matches(x, '{references.NOT_TITLE}')), false) AS k FROM p)
    SELECT id, CASE WHEN k > 0 THEN array_to_string(s[k:], ' ') END AS title FROM n""")
def clean_titles(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {_TITLES}").select("id", references.clean_title(F.col("title")).alias("title"))


_TEXTS = "(VALUES (1, 'Submitted June 2017; see (Lee, 1997)'), (2, '2017-06-12 and 2017'), (3, 'in 2019'), (4, 'May 2030, Sept. 3rd, 2023'), (5, 'none 12345'), (6, NULL), (7, '2024 and 2024-09'), (8, 'March 2018 or 2018-11 or 2018-13')) AS t(id, text)"
_MONTH = "CASE lower(substr(w, 1, 3)) " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(references.MONTHS, 1)) + " END"


@query(f"""WITH d AS (SELECT id, unnest(regexp_extract_all(text, '\\b([A-Za-z]{{3,9}})\\.?\\s+(?:\\d{{1,2}}(?:st|nd|rd|th)?,?\\s+)?({references.YEAR})\\b', 1)) AS w, unnest(regexp_extract_all(text, '\\b([A-Za-z]{{3,9}})\\.?\\s+(?:\\d{{1,2}}(?:st|nd|rd|th)?,?\\s+)?({references.YEAR})\\b', 2)) AS y FROM {_TEXTS}),
    i AS (SELECT id, unnest(regexp_extract_all(text, '\\b({references.YEAR})-(\\d{{2}})\\b', 1)) AS y, unnest(regexp_extract_all(text, '\\b({references.YEAR})-(\\d{{2}})\\b', 2)) AS m FROM {_TEXTS}),
    c AS (SELECT id, y::INT AS year, {_MONTH} AS month FROM d WHERE {_MONTH} IS NOT NULL UNION ALL SELECT id, y::INT, m::INT FROM i WHERE m::INT BETWEEN 1 AND 12 UNION ALL SELECT id, unnest(regexp_extract_all(text, '\\b({references.YEAR})\\b', 1))::INT, NULL FROM {_TEXTS}),
    g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY year DESC, coalesce(month, 0) DESC) AS n FROM c WHERE year < 2024 OR (year = 2024 AND (month IS NULL OR month <= 5)))
    SELECT t.id, year, month FROM {_TEXTS} LEFT JOIN g ON g.id = t.id AND n = 1""")
def scanned_dates(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {_TEXTS}").select("id", references.created(F.col("text"), 2024, 5).alias("d")).select("id", "d.year", "d.month")


_REFS = [
    (1, "[1] Ann Key. On trees.\n[2] Bo Lee. On\n  graphs.\nFigure 3: a caption\n- [3] 18.Sierra. More"), (2, "1. Ann Key. On trees. 2. Bo Lee, J. 3 of 4. 3. Cy Moe."), (3, "text [1] Ann Key [2] Bo Lee"),
    (4, "Key, A. (2001) On trees.\n\nLee, B. (2002) On graphs."), (5, "Key, A. (2001) On trees and\nmore of them\nLee, B. (2002) On graphs."), (6, "an entry without any marks\nanother entry of that kind"), (7, "just one"), (8, ""), (9, None),
]


@query("""SELECT * FROM (VALUES (1, 'Ann Key. On trees.|Bo Lee. On graphs.|Sierra. More'), (2, 'Ann Key. On trees.|Bo Lee, J. 3 of 4.|Cy Moe.'), (3, 'Ann Key|Bo Lee'), (4, 'Key, A. (2001) On trees.|Lee, B. (2002) On graphs.'),
    (5, 'Key, A. (2001) On trees and' || chr(10) || 'more of them|Lee, B. (2002) On graphs.'), (6, 'an entry without any marks|another entry of that kind'), (7, 'just one'), (8, ''), (9, '')) AS t(id, entries)""")
def split_references(spark, sf_dir):
    return spark.createDataFrame(_REFS, "id int, text string").select("id", F.array_join(references.split_references(F.col("text")), "|").alias("entries"))


@query("SELECT * FROM (VALUES (1, 'Ann Key. On trees.|Bo. More'), (2, 'x|y'), (3, 'a'), (4, '')) AS t(id, entries)")
def tiered_references(spark, sf_dir):
    rows = [(1, ["[1] Ann Key.\n On trees.", "- 2. Bo. More"], ["w"], "x"), (2, ["a"], [], "x\ny"), (3, [], ["a"], ""), (4, [], [], "")]
    rows = spark.createDataFrame(rows, "id int, labelled array<string>, walked array<string>, dump string")
    dumped = F.filter(F.split("dump", "\n"), lambda x: x != "")
    found = references.tiered(F.transform("labelled", references.structured_entry), F.col("walked"), dumped)
    return rows.select("id", F.array_join(found, "|").alias("entries"))


_HEADERS = "(VALUES (1, 'A', 'x|y', NULL, 'B', 'z', 'short', 'w1 w2'), (2, ' ', '', '', NULL, 'z', NULL, 'w1 w2'), (3, NULL, '', NULL, NULL, '', NULL, NULL)) AS t(id, t1, a1, s1, t2, a2, s2, body)"


@query(f"SELECT id, coalesce(nullif(trim(t1), ''), nullif(trim(t2), '')) AS title, CASE WHEN a1 <> '' THEN a1 ELSE coalesce(a2, '') END AS authors, coalesce(nullif(trim(s1), ''), nullif(trim(s2), ''), nullif(body, '')) AS abstract FROM {_HEADERS}")
def metadata_fallback(spark, sf_dir):
    way = lambda i: F.struct(F.col(f"t{i}").alias("title"), F.filter(F.split(f"a{i}", r"\|"), lambda x: x != "").alias("authors"), F.col(f"s{i}").alias("abstract"))
    rows = spark.sql(f"SELECT * FROM {_HEADERS}").select("id", references.fallback([way(1), way(2)], F.col("body")).alias("m"))
    return rows.select("id", "m.title", F.array_join("m.authors", "|").alias("authors"), "m.abstract")


@query("SELECT r_regionkey AS id, replace(replace('In {name} ({key}): {name}, {other}', '{name}', r_name), '{key}', CAST(r_regionkey AS VARCHAR)) AS prompt FROM region")
def filled_prompts(spark, sf_dir):
    catalogue = spark.createDataFrame([("where", "In {name} ({key}): {name}, {other}")], "name string, text string")
    template = F.lit(references.prompt(catalogue, "where"))
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), references.filled(template, {"name": F.col("r_name"), "key": F.col("r_regionkey").cast("string")}).alias("prompt"))


@query("SELECT n_nationkey AS id, CASE WHEN contains(n, '/') THEN n ELSE 'ollama_chat/' || n END AS model FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'x/' ELSE '' END || n_name AS n FROM nation)")
def model_names(spark, sf_dir):
    name = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "x/").otherwise(""), "n_name")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), services.model_name(name).alias("model"))


@query("""WITH m AS (SELECT c_nationkey AS cluster, c_custkey AS doc_id FROM customer), k AS (SELECT m.cluster, list_sort(list(m.doc_id)) AS d FROM m WHERE doc_id IN (SELECT o_custkey FROM orders) GROUP BY cluster)
    SELECT cluster, array_to_string(d, ',') AS docs, CASE WHEN cluster % 3 = 0 THEN 'all' ELSE 'k' || cluster END AS keywords FROM k""")
def known_cluster_members(spark, sf_dir):
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("doc_id"))
    words = members.select("cluster").distinct().select("cluster", F.when(F.col("cluster") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("k"), F.col("cluster").cast("string")))).alias("keywords"))
    out = relational.known_members(members, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id")), words, F.array(F.lit("all")))
    return out.select("cluster", F.array_join("doc_ids", ",").alias("docs"), F.array_join("keywords", ",").alias("keywords"))


@query("""WITH l AS (SELECT c_nationkey AS cluster, 'cluster ' || c_nationkey AS label, c_custkey AS doc_id FROM customer WHERE c_nationkey < 10) SELECT o_orderkey AS chunk_id, o_custkey AS doc_id, label FROM orders LEFT JOIN l ON doc_id = o_custkey""")
def chunk_categories(spark, sf_dir):
    members = table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("doc_id"))
    labels = members.select("cluster").distinct().select("cluster", relational.category_label(F.array().cast("array<string>"), F.col("cluster")).alias("label"))
    return relational.labelled_members(members, labels, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"))).select("chunk_id", "doc_id", "label")


@query("SELECT l_orderkey AS doc, count(*) AS n_pages, string_agg(l_linenumber || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS pages FROM lineitem GROUP BY l_orderkey")
def page_reports(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_returnflag").alias("kind"), F.col("l_discount").alias("density"), F.lit(False).alias("blank"))
    return images.page_reports(rows).select("doc", "n_pages", F.array_join(F.transform("pages", lambda p: F.concat(p["page"].cast("string"), p["kind"])), ",").alias("pages"))


@query("SELECT label AS cluster, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS x, round(avg(CAST(embedding[2] AS DOUBLE)), 6) AS y FROM embeddings GROUP BY label")
def cluster_centroids(spark, sf_dir):
    return shapes.centroids(_places(spark, sf_dir)).select("cluster", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _places(spark, sf_dir):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("cluster"), F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


@query()
def cluster_shell_hulls(spark, sf_dir):
    """Outlines round each member; the tests check that they hold all members."""
    return shapes.hulls(shapes.shells(_places(spark, sf_dir)))


@query()
def cluster_trees(spark, sf_dir):
    """Shortest trees over each label's vectors in three dimensions; the tests compare their lengths with brute force."""
    return shapes.spanning_trees(_places(spark, sf_dir))


_CHUNKS = [(1, 0, "Graph methods group papers by the citations they share with other papers in a collection"), (1, 1, "Trees are graphs without cycles and every pair of nodes has one path between them"), (2, 0, "Anything at all"), (4, 0, "Birds fly over the sea and land"), (4, 1, "Trees are graphs without cycles and every pair of nodes has one path between them"), (5, 0, "Trees without cycles")]
_ANSWERS = [
    (1, "As said, “papers by the citations they share with other papers in a collection” [2]. All the rest is near that quote [1, 2]\n> none of these words were ever in there [2]"),
    (2, "No marker here"), (3, "no chunks [1]"), (4, "Every pair of nodes has one path [1]\nNothing supports dragons flying above castles. [7]\n[1]\nDragons breathe fire near castles [2, 9]"), (5, "Grounded by meaning alone it is, not by words [3]"),
]


@query("""SELECT * FROM (VALUES (1, 'As said, “papers by the citations they share with other papers in a collection” [1]. All the rest is near that quote [1, 2!]' || chr(10) || '> none of these words were ever in there [2!]', '0'),
    (2, 'No marker here', ''), (3, 'no chunks [1]', ''), (4, 'Every pair of nodes has one path [2]' || chr(10) || 'Nothing supports dragons flying above castles. [!]' || chr(10) || '[1!]' || chr(10) || 'Dragons breathe fire near castles [2!]', ''), (5, 'Grounded by meaning alone it is, not by words [1]', '')) AS t(reply_id, reply, quoted)""")
def repaired_replies(spark, sf_dir):
    chunks, given = spark.createDataFrame(_CHUNKS, "reply_id int, chunk_index int, text string"), spark.createDataFrame(_ANSWERS, "reply_id int, reply string")
    similar = spark.createDataFrame([(5, 0, 0, 0.7), (4, 1, 0, 0.59)], "reply_id int, place int, chunk_index int, sim double")
    return replies.repaired(given, chunks, similar).select("reply_id", "reply", F.array_join(F.transform("quotes", lambda q: q["chunk_index"].cast("string")), ",").alias("quoted"))


_MARKED = "(VALUES (1, 'First claim. [1] Second [2, 3] one [4!]. `[9]` *Third* [!] end [2]'), (2, 'plain'), (3, '')) AS t(id, reply)"


@query("SELECT * FROM (VALUES (1, 'First claim.|Second one .|Second one .|Third end|Third end', '1,2,3,9', '4'), (2, '', '', ''), (3, '', '', '')) AS t(id, said, verified, flagged)".replace("'First claim.|Second one .|Second one .", "'Second one .|Second one .|Second one ."))
def cited_markers(spark, sf_dir):
    rows, r = spark.sql(f"SELECT * FROM {_MARKED}"), F.col("reply")
    return rows.select("id", F.array_join(replies.citing_sentences(r), "|").alias("said"), F.array_join(replies.cited(r, False), ",").alias("verified"), F.array_join(replies.cited(r, True), ",").alias("flagged"))


@query("SELECT * FROM (VALUES (1, 'a|b [1] [2]|c'), (2, '[1]|x'), (3, '')) AS t(id, lines)")
def merged_marker_lines(spark, sf_dir):
    rows = spark.createDataFrame([(1, ["a", "b", " [1] [2]", "c"]), (2, ["[1]", "x"]), (3, [])], "id int, lines array<string>")
    return rows.select("id", F.array_join(replies.merged_upward(F.col("lines")), "|").alias("lines"))


@query("SELECT n_regionkey AS id, string_agg(n_name || '=' || CASE WHEN n % 2 = 0 THEN 'q' || n ELSE '' END, ',' ORDER BY n) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS n FROM nation) GROUP BY n_regionkey")
def sources_with_quotes(spark, sf_dir):
    source = F.struct("n_nationkey", F.col("n_name").alias("name"), F.lit("long").alias("text"), F.lit(None).cast("array<double>").alias("embedding"))
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.array_sort(F.collect_list(source)).alias("s"))
    quotes = F.transform("s", lambda s, i: F.when(i % 2 == 0, F.array(F.concat(F.lit("q"), i.cast("string")))))
    out = rows.withColumn("q", quotes).select("id", replies.with_quotes(F.col("s"), F.col("q")).alias("s"))
    return out.select("id", F.array_join(F.transform("s", lambda s: F.concat(s["name"], F.lit("="), F.array_join(s["quotes"], "+"))), ",").alias("sources"))


@query()
def stand_in_vectors(spark, sf_dir):
    """Hashed words in place of an embedding model, which needs files that are not here."""
    return table(spark, sf_dir, "benchmark").select("item_id", services.embedded(F.col("text")).alias("v"))

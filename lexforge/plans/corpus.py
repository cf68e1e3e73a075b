"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import lexical, rank, relational, vectors
from lexforge.operators.graph import cut, if_small, pagerank

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _n(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda t: len(t) > 2 AND t NOT IN ({_STOP}))"
_TF = f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL),
    nd AS (SELECT count(*) AS n FROM documents),
    df AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), nd)"""


@query(f"WITH {_TF} SELECT doc_id, term, tf FROM tf")
def tokenise_tf(spark, sf_dir):
    return lexical.term_counts(table(spark, sf_dir, "documents"))


@query(f"WITH {_TF} SELECT term, df, round(idf, 6) AS idf FROM df")
def doc_freq_idf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lexical.document_frequencies(lexical.term_counts(docs), _n(docs)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_TF} SELECT (SELECT sum(c) / max(n) FROM (SELECT count(*) AS c FROM tf GROUP BY doc_id), nd) AS avg_distinct, (SELECT sum(tf) / max(n) FROM tf, nd) AS avg_tokens")
def average_lengths(spark, sf_dir):
    """Both definitions: distinct terms (retriever) and tokens (ranker) per document."""
    t = F.col("t")
    docs = table(spark, sf_dir, "documents").select(T.tokens(F.col("text")).alias("t"))
    return docs.agg((F.sum(F.size(F.array_distinct(t))) / F.count("*")).alias("avg_distinct"), (F.sum(F.size(t)) / F.count("*")).alias("avg_tokens"))


_BM25 = f"""{_TF},
    dl AS (SELECT doc_id, count(*) AS dl FROM tf GROUP BY doc_id),
    av AS (SELECT sum(dl) / max(n) AS avgdl FROM dl, nd),
    q AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS t FROM benchmark),
    m AS (SELECT DISTINCT item_id, CASE WHEN t IN (SELECT term FROM df) THEN t ELSE substr(t, 1, len(t) - 1) END AS term FROM q WHERE t IN (SELECT term FROM df) OR t LIKE '%s'),
    s AS (SELECT item_id, doc_id, round(sum(idf * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25
          FROM m JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), av GROUP BY ALL),
    r AS (SELECT *, round(0.3 * bm25 / max(bm25) OVER (PARTITION BY item_id), 6) AS score FROM s)"""


@query(f"""WITH {_BM25}, k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, max(score) OVER (PARTITION BY item_id) AS best FROM r)
    SELECT item_id, doc_id, bm25, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 8 AND (rank = 1 OR score >= greatest(0.5 * best, 0))""")
def bm25_retriever_top8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = lexical.retriever_scores(lexical.postings(docs), _n(docs), table(spark, sf_dir, "benchmark"))
    return lexical.top_with_floor(lexical.against_best(cut(found.withColumn("bm25", F.round("bm25", 6)))))


_KEYS = "kw AS (SELECT term FROM df ORDER BY round(df * idf, 6) DESC, term LIMIT 20)"


@query(f"WITH {_TF}, {_KEYS} SELECT term, round(df * idf, 6) AS score, CAST(row_number() OVER (ORDER BY round(df * idf, 6) DESC, term) AS INTEGER) AS rank FROM df WHERE term IN (SELECT term FROM kw)")
def corpus_keywords(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lexical.corpus_keywords(lexical.term_counts(docs), _n(docs))


_RANKER = f"""WITH {_TF}, {_KEYS}, dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id), av AS (SELECT sum(dl) / max(n) AS avgdl FROM dl, nd),
    s AS (SELECT doc_id, round(sum(idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id), av WHERE term IN (SELECT term FROM kw) GROUP BY doc_id)"""


def _ranker(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tf = lexical.postings(docs)
    return lexical.ranker_scores(tf, _n(docs), lexical.corpus_keywords(tf, _n(docs))).select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_RANKER} SELECT * FROM s")
def bm25_ranker_scores(spark, sf_dir):
    return _ranker(spark, sf_dir)


@query(f"""WITH {_TF}, {_KEYS}, e AS (SELECT doc_id, unnest(t) AS term, (generate_subscripts(t, 1) - 1) // 180 AS win FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)),
    c AS (SELECT doc_id, win, term, count(*) AS f FROM e GROUP BY ALL), l AS (SELECT doc_id, win, sum(f) AS dl FROM c GROUP BY ALL),
    s AS (SELECT c.doc_id, c.win, sum(idf * (f * 2.5) / (f + 1.5 * (0.25 + 0.75 * dl / 180.0))) AS s FROM c JOIN df USING (term) JOIN l ON c.doc_id = l.doc_id AND c.win = l.win
          WHERE term IN (SELECT term FROM kw) AND (c.win = 0 OR dl >= 45) GROUP BY ALL),
    b AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, win) AS rn FROM s)
    SELECT d.doc_id, round(coalesce((SELECT sum(s) / 5 FROM b WHERE b.doc_id = d.doc_id AND rn <= 5), 0), 6) AS score FROM documents d""")
def topm_window_representativeness(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tf = lexical.postings(docs)
    out = lexical.window_scores(docs, _n(docs), tf, lexical.corpus_keywords(tf, _n(docs)))
    return out.select("doc_id", F.round("score", 6).alias("score"))


_NOVEL = f"WITH {_TF}, v AS (SELECT doc_id, round(avg(idf), 6) AS x FROM tf JOIN df USING (term) WHERE df >= 2 GROUP BY doc_id), nv AS (SELECT d.doc_id, d.source, coalesce(x, 0.0) AS novelty FROM documents d LEFT JOIN v USING (doc_id))"


def _novelty(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = lexical.novelty(docs, lexical.postings(docs), _n(docs))
    return out.select("doc_id", F.round("novelty", 6).alias("novelty"))


@query(f"{_NOVEL} SELECT doc_id, novelty FROM nv")
def novelty_score(spark, sf_dir):
    return _novelty(spark, sf_dir)


def _pct(part: str) -> str:
    return f"CASE WHEN count(*) OVER ({part}) = 1 THEN 1.0 ELSE (rank() OVER ({part} ORDER BY novelty) - 1 + (count(*) OVER ({part} {',' if part else 'PARTITION BY'} novelty) - 1) / 2.0) / greatest(count(*) OVER ({part}) - 1, 1) END"


@query(f"{_NOVEL} SELECT doc_id, round({_pct('')}, 9) AS percentile FROM nv")
def percentile_tie_avg(spark, sf_dir):
    return rank.with_percentile(_novelty(spark, sf_dir), "novelty").select("doc_id", F.round("percentile", 9).alias("percentile"))


@query(f"{_NOVEL} SELECT doc_id, source, round({_pct('PARTITION BY source')}, 9) AS percentile FROM nv")
def percentile_by_cluster(spark, sf_dir):
    scored = _novelty(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return scored.select("doc_id", "source", F.round(rank.percentile(F.col("novelty"), "source"), 9).alias("percentile"))


@query(f"""WITH {_TF}, c AS (SELECT source AS cluster, term, round(sum(tf) * max(idf), 6) AS score FROM tf JOIN documents USING (doc_id) JOIN df USING (term) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rn FROM c)
    SELECT cluster, list(term ORDER BY rn) AS keywords FROM r WHERE rn <= 20 GROUP BY cluster""")
def cluster_keywords(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lexical.cluster_keywords(lexical.postings(docs), _n(docs), docs.select("doc_id", F.col("source").alias("cluster")))


@query(f"""WITH {_TF}, c AS (SELECT source AS cluster, term, round(sum(tf) * max(idf), 6) AS score FROM tf JOIN documents USING (doc_id) JOIN df USING (term) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rn FROM c)
    , s AS (SELECT DISTINCT source FROM documents UNION ALL SELECT 'zz'), k AS (SELECT cluster, string_agg(term, ', ' ORDER BY rn) AS words FROM r WHERE rn <= 3 GROUP BY cluster)
    SELECT source AS cluster, coalesce(words, 'cluster ' || (row_number() OVER (ORDER BY source) - 1)) AS label FROM s LEFT JOIN k ON k.cluster IS NOT DISTINCT FROM source""")
def category_labels(spark, sf_dir):
    """Sources and one without a document stand in for categories."""
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("cluster")).distinct().union(spark.sql("SELECT 'zz'"))
    index = names.withColumn("index", F.row_number().over(W.orderBy(F.col("cluster").asc_nulls_last())) - 1)  # a row a category
    words = cluster_keywords(spark, sf_dir).withColumnRenamed("cluster", "of")
    found = index.join(words, F.col("cluster").eqNullSafe(F.col("of")), "left")
    return found.select("cluster", relational.category_label(F.col("keywords"), F.col("index")).alias("label"))


@query(f"""WITH {_TF}, c AS (SELECT source AS cluster, term, round(sum(tf) * max(idf), 6) AS score FROM tf JOIN documents USING (doc_id) JOIN df USING (term) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rn FROM c),
    q AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS term FROM benchmark)
    SELECT item_id, cluster, count(*) AS matches, round(pow(1.05, count(*)), 6) AS boost FROM q JOIN r USING (term) WHERE rn <= 20 GROUP BY ALL""")
def keyword_boost(spark, sf_dir):
    return _boosts(cluster_keywords(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def _boosts(keywords, questions):
    asked = questions.select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    words = keywords.select("cluster", F.explode("keywords").alias("term"))
    out = asked.join(words, "term").groupBy("item_id", "cluster").agg(F.count("*").alias("matches"))
    return out.withColumn("boost", F.round(F.pow(F.lit(1.05), F.col("matches")), 6))


_KNN = """sims AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
    nn AS (SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY round(sim, 9) DESC, j) AS rank FROM sims QUALIFY rank <= 10),
    mu AS (SELECT a.i, a.j, a.sim FROM nn a JOIN nn b ON a.i = b.j AND a.j = b.i WHERE a.i < a.j)"""
_CC = f"""WITH RECURSIVE {_KNN}, e AS (SELECT i AS a, j AS b FROM mu WHERE sim >= 0.4 UNION ALL SELECT j, i FROM mu WHERE sim >= 0.4),
    cc(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, cc.root FROM cc JOIN e ON e.a = cc.id), cl AS (SELECT id, min(root) AS cluster FROM cc GROUP BY id)"""


@query(f"WITH {_KNN} SELECT i, j, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM nn")
def knn_top10(spark, sf_dir):
    return vectors.nearest(table(spark, sf_dir, "embeddings")).withColumn("sim", F.round("sim", 6))


@query(f"WITH {_KNN} SELECT i, j, round(sim, 4) AS sim FROM mu")
def mutual_knn_edges(spark, sf_dir):
    return vectors.mutual(vectors.nearest(table(spark, sf_dir, "embeddings"))).withColumn("sim", F.round("sim", 4))


def _clusters(spark, sf_dir):
    vecs = table(spark, sf_dir, "embeddings")
    return vectors.clusters(vecs.select(F.col("vec_id").alias("id")), vectors.mutual(vectors.nearest(vecs)), 0.4)


@query(f"{_CC} SELECT id, cluster FROM cl")
def connected_components_t04(spark, sf_dir):
    return _clusters(spark, sf_dir)


@query(f"{_CC} SELECT cluster, count(*) AS size, CAST(row_number() OVER (ORDER BY count(*) DESC, cluster) - 1 AS INTEGER) AS index FROM cl GROUP BY cluster")
def cluster_sizes_ranked(spark, sf_dir):
    return vectors.ranked_sizes(_clusters(spark, sf_dir))


@query(f"""{_CC}, s AS (SELECT cluster, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, cluster) AS r FROM cl GROUP BY cluster)
    SELECT CASE WHEN r <= 8 THEN CAST(r - 1 AS VARCHAR) ELSE 'other' END AS bucket, count(*) AS clusters, CAST(sum(size) AS BIGINT) AS members FROM s GROUP BY 1""")
def cluster_legend(spark, sf_dir):
    sizes = vectors.ranked_sizes(_clusters(spark, sf_dir))
    bucket = F.when(F.col("index") < 8, F.col("index").cast("string")).otherwise("other")
    return sizes.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("clusters"), F.sum("size").alias("members"))


@query(f"""{_CC}, p AS (SELECT cluster, id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS d FROM cl JOIN embeddings ON vec_id = id),
    s AS (SELECT cluster, d, sum(x) AS s FROM p GROUP BY ALL), t AS (SELECT cluster, id, round(sum(x * s), 9) AS dot FROM p JOIN s USING (cluster, d) GROUP BY ALL)
    SELECT cluster, id AS medoid FROM t QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY dot DESC, id) = 1""")
def cluster_medoid(spark, sf_dir):
    return vectors.medoids(_clusters(spark, sf_dir), table(spark, sf_dir, "embeddings"))


_QUOTA = """s AS (SELECT source AS cluster, count(*) AS size FROM documents GROUP BY source),
    w AS (SELECT *, 50 * size // sum(size) OVER () AS whole, round(50.0 * size / sum(size) OVER () - floor(50.0 * size / sum(size) OVER ()), 12) AS rest FROM s),
    qt AS (SELECT cluster, size, CAST(whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, size DESC, cluster) <= 50 - sum(whole) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM w)"""


@query(f"WITH {_QUOTA} SELECT * FROM qt")
def largest_remainder_quota(spark, sf_dir):
    return rank.quotas(table(spark, sf_dir, "documents").groupBy(F.col("source").alias("cluster")).agg(F.count("*").alias("size")), 50)


@query(f"{_NOVEL}, {_QUOTA}, r AS (SELECT doc_id, source AS cluster, novelty AS score, row_number() OVER (PARTITION BY source ORDER BY novelty DESC, doc_id) AS rn FROM nv) SELECT r.cluster, doc_id, score, CAST(rn AS INTEGER) AS rn FROM r JOIN qt ON r.cluster = qt.cluster WHERE rn <= quota")
def quota_topk(spark, sf_dir):
    scored = _novelty(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("cluster")), "doc_id").withColumnRenamed("novelty", "score")
    return rank.within_quota(scored, largest_remainder_quota(spark, sf_dir))


def _unrolled_pagerank(rounds: int) -> str:
    step = ", ".join(
        f"""r{k} AS MATERIALIZED (SELECT n.id, 0.15 / m.m + 0.85 * coalesce(x.inc, 0) + 0.85 * (1 - y.kept) / m.m AS score FROM nodes n CROSS JOIN m
            LEFT JOIN (SELECT dst, sum(score / deg) AS inc FROM r{k - 1} JOIN o ON src = id GROUP BY dst) x ON x.dst = n.id
            CROSS JOIN (SELECT sum(score) AS kept FROM r{k - 1} WHERE id IN (SELECT src FROM o)) y)"""
        for k in range(1, rounds + 1)
    )
    every = " UNION ALL ".join(f"SELECT {k} AS k, a.id, a.score, abs(a.score - b.score) AS moved FROM r{k} a JOIN r{k - 1} b USING (id)" for k in range(1, rounds + 1))
    return f"""WITH {_KNN}, nodes AS (SELECT vec_id AS id FROM embeddings), m AS (SELECT count(*) AS m FROM nodes), o AS MATERIALIZED (SELECT i AS src, j AS dst, count(*) OVER (PARTITION BY i) AS deg FROM nn WHERE rank <= 3), r0 AS (SELECT id, 1.0 / m AS score FROM nodes, m), {step},
        z AS MATERIALIZED ({every}), last AS (SELECT min(k) AS k FROM (SELECT k, sum(moved) AS moved FROM z GROUP BY k), m WHERE moved < m * 1e-6)
        SELECT id, round(score, 9) AS score FROM z, last WHERE z.k = last.k"""


@query(_unrolled_pagerank(40))
def pagerank_knn_graph(spark, sf_dir):
    """Over each vector's three nearest others, until the change falls under the tolerance."""
    vecs = table(spark, sf_dir, "embeddings")
    edges = vectors.nearest(vecs).where("rank <= 3").select(F.col("i").alias("src"), F.col("j").alias("dst"))
    return pagerank(vecs.select(F.col("vec_id").alias("id")), edges).select("id", F.round("score", 9).alias("score"))


@query("""SELECT doc_id, substr(sha256(text), 1, 16) AS content_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS duplicate FROM documents""")
def content_hash_dedupe(spark, sf_dir):
    return relational.mark_duplicates(table(spark, sf_dir, "documents").select("doc_id", T.content_id(F.col("text")).alias("content_id")), ["content_id"], "doc_id")


@query(r"SELECT source, lang, count(*) AS docs, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS words, CAST(max(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS longest, count(*) FILTER (len(regexp_extract_all(text, '\S+')) > 220) AS oversize FROM documents GROUP BY ALL")
def word_stats(spark, sf_dir):
    n = T.word_count(F.col("text")).cast("long")
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("docs"), F.sum(n).alias("words"), F.max(n).alias("longest"), F.count(F.when(n > 220, 1)).alias("oversize"))


@query("SELECT doc_id, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g')) AS title FROM documents")
def norm_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.norm_title(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(trim(lower(split_part(text, chr(10), 1))), '^[\divxlc]+[.)]?\s+', ''), '[\s.:]+$', '') AS heading FROM documents")
def norm_heading(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.norm_heading(F.split_part("text", F.lit("\n"), F.lit(1))).alias("heading"))


@query(r"SELECT page_id, trim(regexp_replace(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '^(?i)abstract[\s:.]*', '')) AS plain FROM pages")
def strip_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_markup(F.col("html")).alias("plain"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question FROM conversations QUALIFY role = 'assistant'")
def chat_reply_question(spark, sf_dir):
    return relational.questions_of_replies(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations) c WHERE NOT (role = 'assistant' AND k = 1) AND NOT coalesce(role = 'user' AND nx = 'assistant' AND nt = (SELECT min(turn) FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = 'assistant'), false)")
def chat_delete_pair(spark, sf_dir):
    return relational.delete_first_pair(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, substr(trim(text), 1, 60) AS title FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def chat_titles(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", F.substring(F.trim("text"), 1, 60).alias("title"))


@query("SELECT conv_id, string_agg('[' || turn || '] ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def context_assembly(spark, sf_dir):
    return relational.assemble(table(spark, sf_dir, "conversations"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_event_per_user(spark, sf_dir):
    return relational.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "ts"])


@query("SELECT n.n_name, count(c.c_custkey) AS customers FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
def related_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return table(spark, sf_dir, "nation").join(counts, "n_nationkey", "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"))


@query("SELECT source, count(*) AS docs, count(DISTINCT text) AS texts, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def source_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.countDistinct(F.xxhash64("text")).alias("texts"), F.countDistinct("lang").alias("langs"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), 'the')")
def search_box(spark, sf_dir):
    return relational.search(table(spark, sf_dir, "documents"), ["source", "lang", "text"], "the").select("doc_id", "source")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def owner_scope(spark, sf_dir):
    """Ownership through a parent, as a semi join."""
    owned = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf_dir, "customer").join(owned, "c_nationkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def include_parent(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


@query("SELECT d.doc_id, d.source FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def uncategorised_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'pending' WHEN l.quality = 1 THEN 'completed' ELSE 'failed' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def extraction_update(spark, sf_dir):
    """A left join with defaults, as when extraction results are folded into documents."""
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.select("doc_id", F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"))


@query("""SELECT doc_id, source FROM documents WHERE source <> 'src0' UNION ALL SELECT doc_id, 'new' FROM documents WHERE source = 'src0' AND lang = 'en'""")
def incremental_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    again = docs.where("source = 'src0'").select("doc_id")
    fresh = docs.where("source = 'src0' AND lang = 'en'").select("doc_id", F.lit("new").alias("source"))
    return relational.merge_incremental(docs.select("doc_id", "source"), again, fresh, "doc_id")


@query("SELECT user_id, max(ts) AS newest, max(ts) >= TIMESTAMP '2024-01-01' AS fresh FROM events GROUP BY user_id")
def freshness(spark, sf_dir):
    newest = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("newest"))
    return newest.withColumn("fresh", relational.is_fresh(F.col("newest"), F.to_timestamp(F.lit("2024-01-01"))))


@query("SELECT n_nationkey, n_name, CAST((row_number() OVER (ORDER BY n_nationkey) - 1) % 8 AS INTEGER) AS colour FROM nation")
def palette(spark, sf_dir):
    return relational.palette(table(spark, sf_dir, "nation"), "n_nationkey").select("n_nationkey", "n_name", "colour")


@query("SELECT doc_id, array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), 1, 200), ' ') AS head FROM documents")
def meta_text_fallback(spark, sf_dir):
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", T.meta_text(none, none, F.col("text")).alias("head"))


@query("""SELECT d, min(x) AS lo, max(x) AS hi FROM (SELECT unnest(embedding::DOUBLE[]) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS d FROM embeddings) GROUP BY d""")
def axis_ranges(spark, sf_dir):
    parts = table(spark, sf_dir, "embeddings").select(F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x"))
    return parts.groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))

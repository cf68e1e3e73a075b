"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import bpe, hnsw, jaccard, lines, mixing, ngram_lm, quality, sharding, substring, token_counts
from lexforge.llm.scratch import materialise


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hnsw.nearest(rows, rows.where(F.pmod(F.col("vec_id"), F.lit(100)) == 0))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.history(_documents(spark, sf_dir))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(_documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out, made = lines.delete_repeats(docs), F.col(lines.column(docs))
    return out.select("doc_id", made["n_lines"].alias("n_lines"), made["n_deleted"].alias("n_deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    sizes = materialise(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("words")), "sizes")  # words are counted once
    return mixing.mix(sizes, size_col="words").select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_hnsw, op3_token_counts, op4_ngram_jaccard, op5_bpe, op6_substring_dedup, op7_line_dedup, op8_mixing, op9_sharding, op10_lm_scoring)}

_WORDS_1 = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
_WORDS_2 = r"len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]'))"

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM e JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
        r(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(root) FROM r WHERE r.id = d.doc_id) AS component_id
        FROM d LEFT JOIN n USING (doc_id)""",
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        x AS (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 20 THEN range(1, len(w) - 18) ELSE [] END) AS s FROM d),
        y AS (SELECT doc_id, s, row_number() OVER (PARTITION BY md5(array_to_string(w[s:s + 19], ' ')) ORDER BY doc_id, s) AS n FROM x),
        g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM y WHERE n > 1),
        e AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
        k AS (SELECT e.doc_id, string_agg(t, ' ' ORDER BY e.i) AS kept, count(*) AS n FROM e ANTI JOIN g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op7_line_dedup": r"""
        WITH e AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        b AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM e WHERE regexp_matches(t, '[^\x20\x09-\x0D]')),
        r AS (SELECT doc_id, p, t AS t1, lead(t, 1) OVER o AS t2, lead(t, 2) OVER o AS t3 FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
        n AS (SELECT doc_id, p, row_number() OVER (PARTITION BY t1, t2, t3 ORDER BY doc_id, p) AS n FROM r WHERE t3 IS NOT NULL),
        g AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM n WHERE n > 1),
        z AS (SELECT b.doc_id, b.i FROM b JOIN g ON b.doc_id = g.doc_id AND b.p = g.p),
        k AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY i) AS kept FROM e ANTI JOIN z USING (doc_id, i) GROUP BY doc_id),
        c AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id), x AS (SELECT doc_id, count(*) AS n FROM z GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(x.n, 0) AS BIGINT) AS n_deleted, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op3_token_counts": f"""
        WITH c AS (SELECT source, lang, coalesce(text, '') AS text, {_WORDS_1} AS one, {_WORDS_2} AS two FROM documents),
        d AS (
            SELECT source, lang, 'words-1' AS tokenizer, 1 AS docs, one AS tokens FROM c
            UNION ALL SELECT source, lang, 'words-2', 1, two FROM c
            UNION ALL SELECT source, lang, 'words-1', -1, -one FROM c WHERE NOT regexp_matches(text, '[a-z]')
            UNION ALL SELECT source, lang, 'words-2', 0, one - two FROM c WHERE one > 1000)
        SELECT source, lang, tokenizer, CAST(sum(docs) AS BIGINT) AS n_docs, CAST(sum(tokens) AS BIGINT) AS n_tokens
        FROM d GROUP BY ALL HAVING sum(docs) <> 0 OR sum(tokens) <> 0""",
    "op8_mixing": f"""
        WITH d AS (SELECT doc_id, source, CAST({_WORDS_1} AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
        x AS (SELECT *, [3.0, 1.0, 2.0][place % 3 + 1]::DOUBLE AS weight FROM w),
        y AS (SELECT *, row_number() OVER o AS pos,
                (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
              FROM x WINDOW o AS (ORDER BY source_size / weight, place)),
        f AS (SELECT min(pos) AS pos, arg_min(level, pos) AS level FROM y WHERE level * weight <= 2.0 * source_size),
        t AS (SELECT y.source, y.source_size, CAST(CASE WHEN f.pos IS NULL OR y.pos < f.pos THEN 2.0 * y.source_size ELSE f.level * y.weight END AS DOUBLE) AS target FROM y, f),
        r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
            size * (CAST(floor(rate) AS BIGINT) + CASE WHEN CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
        FROM r""",
}

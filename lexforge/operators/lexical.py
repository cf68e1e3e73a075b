"""Inverted index, two BM25 scores, keywords, novelty and window scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexforge.functions.text import STOPWORDS, long_runs, tokens
from lexforge.operators.graph import cut, if_small

K1, B = 1.5, 0.75


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf); texts are dealt by document, which is less than their terms and keeps a document's terms together."""
    dealt = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartition("doc_id")
    every = dealt.select("doc_id", F.explode(long_runs(F.col("text"))).alias("term"))
    return every.where(~F.col("term").isin(STOPWORDS)).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term_counts() as a written table: frequencies, lengths and hits read it, and the texts are split once."""
    return cut(term_counts(docs, id_col, text_col))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def document_frequencies(postings: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf); n_docs is one row with the number of documents, n."""
    return postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_docs)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def retriever_scores(postings: DataFrame, n_docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(item_id, doc_id, bm25): squared idf, length as the number of distinct terms.

    A question's terms (item_id, text) are joined to the postings, so only documents that
    share a term are scored; a plural that is no term falls back to its singular.
    """
    sizes = postings.groupBy("doc_id").agg(F.count("*").alias("dl"))
    average = sizes.agg(F.sum("dl").alias("total")).crossJoin(n_docs).select((F.col("total") / F.greatest("n", F.lit(1))).alias("avgdl"))
    asked = questions.select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("asked"))
    singular = F.when(F.col("asked").endswith("s"), F.expr("substring(asked, 1, length(asked) - 1)"))
    asked = cut(asked.withColumn("singular", singular))
    either = asked.select(F.explode(F.array("asked", "singular")).alias("term")).where("term is not null")
    freq = if_small(_wanted(postings, n_docs, either))  # of all postings, those of a term that may be asked for
    known = freq.select(F.col("term").alias("asked"))
    direct = asked.join(known, "asked", "left_semi").select("item_id", F.col("asked").alias("term"))
    plural = asked.join(known, "asked", "left_anti").where("singular is not null").select("item_id", F.col("singular").alias("term"))
    wanted = if_small(cut(direct.unionByName(plural).distinct().join(freq.select("term"), "term", "left_semi")))
    tf, length = F.col("tf"), F.col("dl") / F.col("avgdl")
    part = F.pow("idf", F.lit(2)) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length))
    # each posting is weighed once, dealt by document, before it meets the questions that ask for its term
    weighed = postings.join(freq, "term").join(sizes, "doc_id").crossJoin(F.broadcast(average)).select("doc_id", "term", part.alias("part"))
    return weighed.join(wanted, "term").groupBy("item_id", "doc_id").agg(F.sum("part").alias("bm25"))


def against_best(found: DataFrame, weight: float = 0.3) -> DataFrame:
    """(item_id, doc_id, bm25) with a score: the part of the item's best; found is a written table, as it is read twice.

    The best of an item are partial maxima, so no task gets all documents of an item.
    """
    best = if_small(cut(found.groupBy("item_id").agg(F.max("bm25").alias("best"))))
    return found.join(best, "item_id").select("item_id", "doc_id", "bm25", F.round(F.lit(weight) * F.col("bm25") / F.col("best"), 6).alias("score"))


def top_with_floor(scores: DataFrame, k: int = 8, floor: float = 0.5) -> DataFrame:
    """Per item the k best of (item_id, doc_id, score) that reach floor times the best; the best always stays."""
    order = W.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    best = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    cut = F.greatest(F.lit(floor) * F.max("score").over(W.partitionBy("item_id")), F.lit(0.0))
    return best.withColumn("cut", cut).where((F.col("rank") == 1) | (F.col("score") >= F.col("cut"))).drop("cut")


def _wanted(postings: DataFrame, n_docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df, idf) of the terms given, as a written table."""
    terms = if_small(cut(terms.select("term").distinct()))
    return cut(document_frequencies(postings.join(terms, "term", "left_semi"), n_docs))


def ranker_scores(postings: DataFrame, n_docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, score) against one list of terms: plain idf, length in tokens."""
    freq = if_small(_wanted(postings, n_docs, terms))
    sizes = postings.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    average = sizes.agg(F.sum("dl").alias("total")).crossJoin(n_docs).select((F.col("total") / F.col("n")).alias("avgdl"))
    tf, length = F.col("tf"), F.col("dl") / F.col("avgdl")
    part = F.col("idf") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length))
    return postings.join(freq, "term").join(sizes, "doc_id").crossJoin(F.broadcast(average)).groupBy("doc_id").agg(F.sum(part).alias("score"))


def window_scores(docs: DataFrame, n_docs: DataFrame, postings: DataFrame, terms: DataFrame, width: int = 180, most: int = 5) -> DataFrame:
    """(doc_id, score): mean of the best windows of ``width`` tokens, missing ones as zero.

    A last window under a quarter of the width goes unless it is the only one.
    """
    freq = if_small(_wanted(postings, n_docs, terms).select("term", "idf"))
    every = docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "term")).withColumn("win", F.floor(F.col("pos") / width))
    # all other terms of a window count as one, without an idf
    known = every.join(freq, "term", "left").withColumn("term", F.when(F.col("idf").isNotNull(), F.col("term")))
    counts = known.groupBy("doc_id", "win", "term", "idf").agg(F.count("*").alias("tf"))
    sizes = counts.groupBy("doc_id", "win").agg(F.sum("tf").alias("dl"))
    sizes = sizes.where((F.col("win") == 0) | (F.col("dl") >= width // 4))
    tf, length = F.col("tf"), F.col("dl") / F.lit(float(width))
    part = F.col("idf") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length))
    scored = counts.where("idf is not null").join(sizes, ["doc_id", "win"]).groupBy("doc_id", "win").agg(F.sum(part).alias("s"))
    best = scored.withColumn("rn", F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("s").desc(), "win"))).where(F.col("rn") <= most)
    sums = best.groupBy("doc_id").agg((F.sum("s") / most).alias("score"))
    return docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def novelty(docs: DataFrame, postings: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(doc_id, novelty): mean idf of a document's terms that another document has too."""
    shared = document_frequencies(postings, n_docs).where("df >= 2")
    means = postings.join(shared, "term").groupBy("doc_id").agg(F.avg("idf").alias("novelty"))
    return docs.select("doc_id").join(means, "doc_id", "left").select("doc_id", F.coalesce("novelty", F.lit(0.0)).alias("novelty"))


def corpus_keywords(postings: DataFrame, n_docs: DataFrame, n: int = 20) -> DataFrame:
    """(term, score, rank): terms of most summed idf."""
    freq = document_frequencies(postings, n_docs).select("term", F.round(F.col("df") * F.col("idf"), 6).alias("score"))
    top = freq.orderBy(F.col("score").desc(), "term").limit(n)  # n rows, then ranked
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "term")))


def cluster_keywords(postings: DataFrame, n_docs: DataFrame, clusters: DataFrame, n: int = 20) -> DataFrame:
    """(cluster, keywords): per cluster (doc_id, cluster) the terms of most summed tf * idf."""
    freq = document_frequencies(postings, n_docs)
    sums = postings.join(clusters, "doc_id").groupBy("cluster", "term").agg(F.sum("tf").alias("tf")).join(freq, "term")
    sums = sums.select("cluster", "term", F.round(F.col("tf") * F.col("idf"), 6).alias("score"))
    top = sums.withColumn("rn", F.row_number().over(W.partitionBy("cluster").orderBy(F.col("score").desc(), "term"))).where(F.col("rn") <= n)
    return top.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "term"))), lambda x: x["term"]).alias("keywords"))


def similarities(questions: DataFrame, chunks: DataFrame, block: int = 256) -> DataFrame:
    """(item_id, doc_id, sim) of every question (item_id, v) and chunk (doc_id, v); questions go in blocks, chunks once to each.

    Other columns of chunks stay.  Vectors of another length than the question's are an error.
    """
    blocks = max(1, -(-questions.count() // block))
    packed = questions.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("item_id", "v")).alias("qs"))
    packed = if_small(cut(packed), 1000)  # few blocks go to every task; dealt by block, all chunks would be in as few
    rows = chunks.repartition("doc_id").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(packed, "block")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    same = lambda q: F.when(F.size(q["v"]) == F.size("v"), dot(q["v"], F.col("v"))).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))
    return rows.select(*(c for c in chunks.columns if c != "v"), F.inline(F.transform("qs", lambda q: F.struct(q["item_id"].alias("item_id"), same(q).alias("sim")))))


def hybrid(sims: DataFrame, boosts: DataFrame, lexical: DataFrame) -> DataFrame:
    """(item_id, doc_id, sim, score) of sims (item_id, doc_id, cluster, sim): similarity times the boost (item_id, cluster), 1 without one, and the lexical part, 0 without one."""
    lexical = lexical.select("item_id", "doc_id", F.col("score").alias("lex"))
    rows = sims.join(boosts.select("item_id", "cluster", "boost"), ["item_id", "cluster"], "left").join(lexical, ["item_id", "doc_id"], "left")
    return rows.select("item_id", "doc_id", "sim", (F.col("sim") * F.coalesce("boost", F.lit(1.0)) + F.coalesce("lex", F.lit(0.0))).alias("score"))

"""What is computed once, and what is shuffled, as the plans of operators tell."""

from pyspark.sql import functions as F

from lexforge.operators import lexical, rank


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_percentiles_compute_their_scores_once(spark):
    scored = spark.range(20).groupBy((F.col("id") % 7).alias("id")).agg(F.sum(F.xxhash64("id") % 5).cast("double").alias("s"))
    out = rank.with_percentile(scored, "s")
    assert "xxhash64" not in _plan(out) and out.count() == 7


def test_terms_of_a_document_stay_together(spark):
    docs = spark.createDataFrame([(1, "one two two"), (1, "two three"), (2, None)], "doc_id int, text string")
    counts = lexical.term_counts(docs)
    assert _plan(counts).count("Exchange hashpartitioning(doc_id") == 1 and "term#" not in _plan(counts).split("Exchange hashpartitioning(")[1].split(")")[0]
    assert {tuple(r) for r in counts.collect()} == {(1, "one", 1), (1, "two", 3), (1, "three", 1)}


def test_one_block_of_questions_goes_to_all_chunks(spark):
    chunks = spark.createDataFrame([(i, "a", [1.0, float(i)]) for i in range(9)], "doc_id int, cluster string, v array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item_id int, v array<float>")
    sims = lexical.similarities(asked, chunks)
    assert "BroadcastHashJoin" in _plan(sims) and "hashpartitioning(block" not in _plan(sims)
    assert {(r["item_id"], r["doc_id"], r["cluster"], r["sim"]) for r in sims.collect()} == {(1, i, "a", 1.0) for i in range(9)} | {(2, i, "a", float(i)) for i in range(9)}


def test_scores_against_the_best_have_no_window(spark):
    from lexforge.operators.graph import cut

    found = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (2, 1, 3.0)], "item_id int, doc_id int, bm25 double")
    out = lexical.against_best(cut(found))
    assert "Window" not in _plan(out) and {tuple(r) for r in out.collect()} == {(1, 1, 4.0, 0.3), (1, 2, 2.0, 0.15), (2, 1, 3.0, 0.3)}


def test_plain_texts_stay_in_the_jvm(spark):
    from lexforge.operators import viewer

    df = spark.createDataFrame([("Plain TEXT 1",), ("Äpfel Ｈ",), (None,), ("end\n",), ("",)], "t string")
    got = [r["w"] for r in df.select(viewer.norm_words(F.col("t")).alias("w")).collect()]
    assert got == [["plain", "text", "1"], ["apfel", "h"], [], ["end"], []]
    assert "CASE WHEN" in df.select(viewer.norm_words(F.col("t")))._jdf.queryExecution().analyzed().toString()

import json

import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import rank, relational
from lexforge.operators.chunking import Sizes, chunks_of, sentences, windows
from lexforge.operators.graph import pagerank
from lexforge.sources import files


def test_sentences_go_on_after_abbreviations_and_initials():
    assert sentences("We follow Smith et al. They did. See Fig. 3 by J. Doe. End") == ["We follow Smith et al. They did.", "See Fig. 3 by J. Doe.", "End"]
    assert sentences("  ") == []


def test_windows_keep_to_their_size():
    text = " ".join(f"Word{i} goes here now." for i in range(300))
    out = windows(text, 60, 12)
    assert all(len(w.split()) <= 60 for w in out)
    assert set(text.split()) == {w for c in out for w in c.split()}
    assert len(windows("w " * 500, 100, 20)) == 7


def test_chunks_merge_small_sections_and_cut_tables():
    doc = {"title": "T", "text": "", "sections": [{"heading": "A", "text": "one two", "pages": [1, 2]}, {"heading": "B", "text": "three", "pages": [2, 4]}, {"heading": "C", "text": "", "pages": None}], "tables": [{"text": "x " * 400, "page": 3}]}
    out = chunks_of(doc, Sizes())
    assert out[0]["text"] == "T — A\none two B. three C. " .rstrip() or out[0]["text"].startswith("T — A\none two B. three")
    assert out[0]["pages"] == [1, 4] and out[0]["text"][out[0]["prefix_len"] :].startswith("one two")
    assert out[-1]["chunk_type"] == "table" and out[-1]["text"].endswith("…") and len(out[-1]["text"].split()) == 300 + 1 + 3


def test_chunk_query(spark):
    from lexforge.plans.fixtures import document_chunks

    rows = document_chunks(spark, "/root/testdata/sf0.001")
    assert rows.where(F.size(F.split(F.trim("text"), r"\s+")) > 180).count() == 0


def test_pagerank(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    edges = spark.createDataFrame([(0, 1), (0, 1), (1, 2), (2, 0), (3, 2)], "src long, dst long")
    scores = {r["id"]: r["score"] for r in pagerank(nodes, edges).collect()}
    assert abs(sum(scores.values()) - 1) < 1e-6 and max(scores, key=scores.get) == 2
    even = pagerank(nodes, edges.limit(0)).collect()
    assert {r["score"] for r in even} == {0.2}


def test_percentile_ties(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 1.0 + 1e-14), (3, 2.0), (4, 3.0)], "id int, s double")
    got = {r["id"]: r["p"] for r in rows.select("id", rank.percentile(F.col("s")).alias("p")).collect()}
    assert got == pytest.approx({1: 1 / 6, 2: 1 / 6, 3: 2 / 3, 4: 1.0})
    assert rows.limit(1).select(rank.percentile(F.col("s")).alias("p")).first()["p"] == 1.0


@pytest.mark.parametrize("k", [2, 3, 10, 40])
def test_quotas_sum_to_k(spark, k):
    sizes = spark.createDataFrame([(0, 5), (1, 3), (2, 1), (3, 1)], "cluster int, size long")
    assert rank.quotas(sizes, k).agg(F.sum("quota")).first()[0] == k


def test_text_functions(spark):
    row = spark.range(1).select(
        T.norm_heading(F.lit("7. References:")).alias("h"), T.surname(F.lit("Gomez, Aidan N.")).alias("a"), T.surname(F.lit("Aidan N. Gomez")).alias("b"), T.surname(F.lit("")).alias("c"),
        T.index_tokens(F.lit("the of")).alias("i"), T.tokens(F.lit(None).cast("string")).alias("n"), F.size(T.split_oversized(F.lit("ab " * 6000))).alias("p"),
    ).first()
    assert (row.h, row.a, row.b, row.c, row.i, row.n, row.p) == ("references", "gomez", "gomez", "", ["the", "of"], [], 3)


def test_cache_states_and_overlay(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "doi string")
    cache = spark.createDataFrame([("a", "T"), ("b", None)], "doi string, title string")
    got = {r["doi"]: r["state"] for r in relational.probe_cache(keys, cache, "doi", "title").collect()}
    assert got == {"a": "hit", "b": "miss", "c": "absent"}
    base = spark.createDataFrame([("a", "old"), ("b", "kept")], "doi string, title string")
    assert {tuple(r) for r in relational.overlay(base, cache, "doi", ["title"]).collect()} == {("a", "T"), ("b", "kept")}


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.PDF").write_bytes(b"%PDF-1.7")
    (tmp_path / "in/b.pdf").write_bytes(b"junk")
    (tmp_path / "in/c.txt").write_bytes(b"x")
    got = {r["path"].rsplit("/")[-1]: r["error"] for r in files.scan(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.PDF": None, "b.pdf": "not a PDF"}
    (tmp_path / "m.json").write_text(json.dumps({"d1": {"text": "x"}, "d2": {"text": None}}))
    assert {tuple(r) for r in files.keyed_json(spark, str(tmp_path / "m.json"), "struct<text:string>").collect()} == {("d1", "x"), ("d2", None)}
    for n in (3, 2):
        files.replace(spark.range(n), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_stream_drops_repeated_contents(spark, tmp_path):
    from lexforge.streaming.ingest import ingest

    rows = spark.createDataFrame([("x", "2024-01-01 00:00:00"), ("x", "2024-01-01 01:00:00"), ("y", "2024-01-01 02:00:00")], "text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "src"))
    ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2

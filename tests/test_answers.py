"""Operators without SQL, against brute force or by what they promise."""

import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexforge.operators import chunking, rank, references, replies, services, shapes, viewer
from lexforge.sources import files


def test_located_and_quotes(spark):
    text = "a “quoted text of more than twenty five” [1] b\n  > cited line\n[2, 3]"
    row = spark.createDataFrame([(text,)], "t string").select(replies.located(F.col("t"), replies.MARKER).alias("m"), replies.quoted_spans(F.col("t")).alias("q")).first()
    assert [(m["text"], text[m["start"] : m["end"]]) for m in row["m"]] == [("[1]", "[1]"), ("[2, 3]", "[2, 3]")]
    assert [(q["text"], text[q["start"] : q["end"]]) for q in row["q"]] == [("quoted text of more than twenty five", "“quoted text of more than twenty five”"), ("cited line", "  > cited line")]


def test_claims(spark):
    text = "One is so. [1] Two goes [2] on. Three\n[3]\nFour"
    df = spark.createDataFrame([(1, text)], "reply_id int, reply string")
    assert [r["claim"] for r in replies.markers(df).orderBy("place").collect()] == ["One is so.", "[1] Two goes on.", "Three"]


def test_spanning_trees_are_shortest(spark):
    rng = np.random.default_rng(2)
    at = np.round(rng.normal(size=(7, 3)), 1)
    df = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(at)] + [(2, 9, 0.0, 0.0, 0.0)], "cluster long, id long, x double, y double, z double")
    got = shapes.spanning_trees(df).collect()
    gap = lambda a, b: math.dist(at[a], at[b])
    pairs, best = list(itertools.combinations(range(7), 2)), math.inf
    for links in itertools.combinations(pairs, 6):
        root = list(range(7))
        for a, b in links:
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        best = min(best, sum(gap(*x) for x in links)) if len(set(root)) == 1 else best
    assert len(got) == 6 and sum(r["distance"] for r in got) == pytest.approx(best) and {r["cluster"] for r in got} == {1}


def test_shell_hulls_hold_their_members(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (2, 1.0, 0.0)], "cluster long, x double, y double")
    out = shapes.hulls(shapes.shells(df)).groupBy("cluster").agg(F.min("x"), F.max("x"), F.count("*")).orderBy("cluster").collect()
    assert [tuple(round(v, 6) for v in r) for r in out] == [(1, -0.16, 0.16, 12), (2, -0.16, 1.16, 14)]


def test_percentile_in_ranges(spark):
    rows = [(i, float(i * 37 % 11)) for i in range(300)] + [(999, 1e-14)]
    df = spark.createDataFrame(rows, "id long, s double").repartition(7)
    a = {r["id"]: r["p"] for r in df.select("id", rank.percentile(F.col("s")).alias("p")).collect()}
    assert {r["id"]: r["percentile"] for r in rank.with_percentile(df, "s").collect()} == pytest.approx(a)
    assert [r["percentile"] for r in rank.with_percentile(df.where("id = 5"), "s").collect()] == [1.0]


def test_calls(spark):
    def lookup():
        def client(key):
            if key == "gone":
                raise services.Missing(key)
            if key == "bad":
                raise OSError("down")
            return key.upper()

        return client

    df = spark.createDataFrame([(1, "a"), (2, "gone"), (3, "bad"), (4, None)], "id int, doi string")
    assert [tuple(r)[2:] for r in services.called(df, lookup, "doi").orderBy("id").collect()] == [("A", "hit", None), (None, "miss", None), (None, "error", "down"), (None, "none", None)]


def test_extraction_tries_again(spark):
    def extractor():
        def client(text, heat):
            if text == "never" or (text == "late" and heat < 0.7):
                raise ValueError(text)
            return [(text, "at", str(heat))]

        return client

    df = spark.createDataFrame([("d", "1", "now"), ("d", "2", "late"), ("d", "3", "never")], "doc_id string, chunk_id string, text string")
    got = {r["chunk_id"]: (r["attempts"], r["failed"], [tuple(t) for t in r["triples"]]) for r in services.extracted(df, extractor).collect()}
    assert got == {"1": (1, False, [("now", "at", "0.0")]), "2": (3, False, [("late", "at", "0.7")]), "3": (3, True, [])}


def test_stand_in_vectors(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None)], "id int, t string")
    got = {r["id"]: r["v"] for r in df.select("id", services.embedded(F.col("t")).alias("v")).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1) and got[2] == got[3] == [0.0] * services.DIMS


def test_match_on_a_page(spark):
    head, body, tail = ([f"{c}{i}word" for i in range(n)] for c, n in (("h", 25), ("b", 40), ("t", 10)))
    page = " ".join([*head, "extra", *body[:30], "gap", *tail])
    chunk = " ".join([*head[:3], "other", *head[4:], *body, *tail])
    pages = viewer.page_index(spark.createDataFrame([(1, 0, page[:60]), (1, 1, page[60:]), (1, 2, "behind")], "page_id int, ordinal int, text string"))
    found = viewer.located(spark.createDataFrame([(1, 1, chunk), (2, 1, "not there at all, none of it"), (3, 1, "Behind")], "chunk_id int, page_id int, text string"), pages).collect()
    joined = pages.first()["joined"]
    assert [r["chunk_id"] for r in found] == [1] and found[0]["items"] == [0, 1]
    piece = joined[found[0]["place"]["start"] : found[0]["place"]["end"]]
    assert piece.startswith("h8word") and piece.endswith("t9word")


def test_page_words(spark):
    row = spark.createDataFrame([("Äpfel, naïve cafés 2x",)], "t string").select(viewer.norm_words(F.col("t")).alias("w"), viewer.keyword_tokens(viewer.folded(F.col("t"))).alias("k")).first()
    assert row["w"] == ["apfel", "naive", "cafes", "2x"] and row["k"] == ["apfel", "naive", "cafe"]


def test_structured_chunks(spark):
    long = " ".join(f"This is sentence number {i} of the text." for i in range(80))
    doc = {"doc_id": "d", "title": "T", "text": "", "sections": [{"heading": "A", "text": "tiny part", "pages": [1]}, {"heading": "B", "text": "also tiny", "pages": [2]}, {"heading": "C", "text": long, "pages": [3, 4]}, {"heading": " ", "text": None, "pages": None}], "tables": [{"text": "w " * 400, "page": 5}, {"text": " ", "page": 6}]}
    ddl = "doc_id string, title string, text string, sections array<struct<heading:string,text:string,pages:array<int>>>, tables array<struct<text:string,page:int>>"
    rows = chunking.chunk(spark.createDataFrame([doc], ddl)).orderBy("chunk_index").collect()
    assert rows[0]["text"] == "T — A\ntiny part B. also tiny" and rows[0]["pages"] == [1, 2] and rows[0]["prefix_len"] == 6
    body = [r for r in rows if r["heading"] == "C"]
    assert len(body) > 2 and all(r["text"].startswith("T — C\nThis is") and len(r["text"].split()) <= 180 + 3 for r in body)
    for a, b in zip(body, body[1:], strict=False):  # each begins with sentences that end the one before, of 30 words or more
        shared = next(n for n in range(len(b["text"]), 0, -1) if a["text"].endswith(b["text"][6:n]))
        assert 30 <= len(b["text"][6:shared].split()) < 60
    assert rows[-1]["chunk_type"] == "table" and rows[-1]["text"].endswith(" …") and rows[-1]["pages"] == [5, 5] and len(rows[-1]["text"].split()) == 304


def test_sentences_go_on_after_abbreviations():
    assert chunking.sentences(" See Fig. 3 by J. Doe et al. Then? (Yes.) “No” e.g. This! ") == ["See Fig. 3 by J. Doe et al. Then?", "(Yes.) “No” e.g. This!"]


def test_unknown_prompt(spark):
    with pytest.raises(KeyError):
        references.prompt(spark.createDataFrame([("a", "b")], "name string, text string"), "c")


def test_replace_and_restore(spark, tmp_path):
    path, read = str(tmp_path / "t"), lambda: sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "t")).collect())
    for n in (1, 2, 3):
        files.replace(spark.range(n), path)
        assert read() == list(range(n))
    (tmp_path / "t").rename(tmp_path / "t.old2")  # as if it broke off between the two renames
    assert files.restore(spark, path) and read() == [0, 1] and not files.restore(spark, path)


def test_settings_lines(spark):
    lines = spark.createDataFrame([(0, "A=1"), (1, "# B=2"), (2, "C=3")], "ordinal int, line string")
    assert [r["line"] for r in files.set_lines(lines, {"C": "x=y", "D": "4", "A": ""}).orderBy("ordinal").collect()] == ["A=", "# B=2", "C=x=y", "D=4"]


def test_graph_tables(spark, tmp_path):
    triples = spark.createDataFrame([("a", "is", "b"), ("a", "is", "b"), ("b", "is", "c")], "subject string, predicate string, object string")
    files.write_graph(spark.createDataFrame([("a",), ("a",), ("b",)], "entity string"), triples, str(tmp_path))
    assert [spark.read.parquet(str(tmp_path / t)).count() for t in ("entities", "edges", "relations")] == [2, 1, 2]


def test_large_tree_is_quick_and_the_same():
    rng = np.random.default_rng(5)
    rows = pd.DataFrame(np.round(rng.normal(size=(6000, 3)), 2), columns=["x", "y", "z"]).assign(cluster=1, id=range(6000))
    began = time.process_time()
    got = shapes._tree(rows)
    took = time.process_time() - began
    at = rows[["x", "y", "z"]].to_numpy()
    assert set(got["b"]) == set(range(1, 6000)) and np.allclose(got["distance"], np.linalg.norm(at[got["a"]] - at[got["b"]], axis=1))
    small = shapes._tree(rows.iloc[:1500])
    began = time.process_time()
    gap = np.linalg.norm(at[:1500] - at[0], axis=1)
    inside, total = np.zeros(1500, bool), 0.0
    inside[0] = True
    for _ in range(1499):
        i = int(np.where(inside, np.inf, gap).argmin())
        inside[i], total = True, total + gap[i]
        gap = np.minimum(gap, np.linalg.norm(at[:1500] - at[i], axis=1))
    assert small["distance"].sum() == pytest.approx(total)
    assert took < 40 * (time.process_time() - began)  # about 13 times as long; with a sort of all outsiders at each step it was 80

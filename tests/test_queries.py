"""Every registered corpus query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lexforge.plans import answers, corpus, fixtures  # noqa: F401

DATA = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return None if v != v else round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(corpus.ORACLE_SQL))
def test_query(spark, duck, name):
    got = corpus.QUERIES[name](spark, DATA)
    want = duck.sql(corpus.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    theirs = sorted((tuple(plain(v) for v in r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert mine == theirs

"""Neighbours against brute force, in few blocks and with many ties."""

import numpy as np
import pytest

from lexforge.operators import vectors


def _table(spark, at):
    return spark.createDataFrame([(i * 3, [float(x) for x in v]) for i, v in enumerate(at)], "vec_id long, embedding array<float>")


def _brute(at, k):
    at = at.astype(np.float32).astype(float)
    sims = at @ at.T
    np.fill_diagonal(sims, -np.inf)
    order = np.argsort(-np.round(sims, 9), 1, kind="stable")[:, :k]
    return {(i * 3, int(j) * 3, rank) for i, row in enumerate(order) for rank, j in enumerate(row, 1)}


@pytest.mark.parametrize("kind", ["plain", "copies", "one"])
def test_neighbours_across_blocks(spark, kind):
    at = np.random.default_rng(1).normal(size=(900, 16))
    at = {"plain": at, "copies": np.repeat(at[:30], 30, 0), "one": np.repeat(at[:1], 900, 0)}[kind]
    got = vectors.nearest(_table(spark, at), 5, blocks=3, least=100)
    assert {(r["i"], r["j"], r["rank"]) for r in got.collect()} == _brute(at, 5)


def test_a_vector_goes_to_few_tasks(spark):
    at = np.random.default_rng(2).normal(size=(500, 4))
    plan = vectors.nearest(_table(spark, np.tile(at, (60, 1))), 2)._jdf.queryExecution().toString()
    assert "sequence(0, 11" in plan and "sequence(0, 14" not in plan  # 15 blocks a side before, and more with every row


def test_mutual_links_find_neighbours_once(spark):
    at = np.random.default_rng(3).normal(size=(60, 4))
    links = vectors.mutual(vectors.nearest(_table(spark, at), 3))
    assert "InArrow" not in (plan := links._jdf.queryExecution().toString()) and "InPandas" not in plan
    near = {(i, j) for i, j, _ in _brute(at, 3)}
    assert {(r["i"], r["j"]) for r in links.collect()} == {(i, j) for i, j in near if i < j and (j, i) in near}

"""Hulls against brute force: a corner is a point outside every triangle of others."""

import numpy as np

from lexforge.operators import shapes
from lexforge.plans.corpus import QUERIES


def _inside_all(corners: np.ndarray, points: np.ndarray) -> bool:
    edges = np.roll(corners, -1, axis=0) - corners
    away = points[:, None, :] - corners[None]
    return bool((edges[None, :, 0] * away[:, :, 1] - edges[None, :, 1] * away[:, :, 0] >= -1e-12).all())


def test_square_with_ties():
    points = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [1, 0], [0, 0], [2, 1]], float)
    assert shapes.hull(points).tolist() == [[0, 0], [2, 0], [2, 2], [0, 2]]


def test_few_points():
    assert len(shapes.hull(np.zeros((0, 2)))) == 0
    assert shapes.hull(np.array([[1.0, 2], [1, 2]])).tolist() == [[1, 2]]


def test_clusters(spark):
    sf = "/root/testdata/sf0.001"
    found = QUERIES["cluster_hulls"](spark, sf).toPandas()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    assert set(found["cluster"]) == set(rows["label"])
    for cluster, group in rows.groupby("label"):
        points = np.array([v[:2] for v in group["embedding"]], float)
        corners = found[found["cluster"] == cluster].sort_values("corner")[["x", "y"]].to_numpy()
        assert _inside_all(corners, points)
        assert {tuple(c) for c in corners} <= {tuple(p) for p in points}


def test_defined_results(spark):
    schema = "cluster int, x double, y double, note string"
    assert shapes.hulls(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 0.0, 0.0, "a"), (1, None, 1.0, "b"), (1, float("nan"), 1.0, "c"), (None, 1.0, 1.0, "d"), (1, 0.0, 0.0, "e")]
    assert [tuple(r) for r in shapes.hulls(spark.createDataFrame(rows, schema)).collect()] == [(1, 0, 0.0, 0.0)]

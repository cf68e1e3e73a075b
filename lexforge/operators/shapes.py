"""Outlines of clusters in the plane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The distance and number of points that a shell puts round a member.
PAD, SEGMENTS = 0.16, 12


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of (n, 2) points, counter-clockwise from the leftmost; fewer than three points as they are."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(side: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in side:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def _corners(pdf: pd.DataFrame) -> pd.DataFrame:
    found = []
    for cluster, group in pdf.groupby("cluster", dropna=False, sort=False):
        h = hull(group[["x", "y"]].to_numpy(float))
        found.append(pd.DataFrame({"cluster": cluster, "corner": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]}))
    return pd.concat(found) if found else pd.DataFrame({"cluster": [], "corner": [], "x": [], "y": []})


def hulls(points: DataFrame) -> DataFrame:
    """(cluster, x, y) to (cluster, corner, x, y).

    Each batch first gives up the points inside its own hull, so the task of a cluster only
    gets corners of batches, however many points the cluster has.  Rows without a place go.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _corners(pdf)[["cluster", "x", "y"]]

    rows = points.selectExpr("cast(cluster AS bigint) AS cluster", "cast(x AS double) AS x", "cast(y AS double) AS y").where("abs(x) < double('infinity') AND abs(y) < double('infinity') AND cluster IS NOT NULL")
    return rows.mapInPandas(partial, "cluster long, x double, y double").groupBy("cluster").applyInPandas(_corners, "cluster long, corner int, x double, y double")


def shells(points: DataFrame, pad: float = PAD) -> DataFrame:
    """(cluster, x, y) to the points of a circle round each, so that a hull of them is an outline at any number of members."""
    turn = F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)))
    angle = F.col("k") / SEGMENTS * 2 * np.pi
    return points.withColumn("k", turn).select("cluster", (F.col("x") + F.cos(angle) * pad).alias("x"), (F.col("y") + F.sin(angle) * pad).alias("y"))


def centroids(points: DataFrame) -> DataFrame:
    return points.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def _tree(pdf: pd.DataFrame) -> pd.DataFrame:
    """Joins the nearest outsider to the tree until all are in; each outsider keeps its nearest member, the earliest if tied.

    Outsiders lie at the front of arrays that are made once; who joins gives its place to the last of them.
    """
    pdf = pdf.sort_values("id")
    ids, at = pdf["id"].to_numpy(), pdf[["x", "y", "z"]].to_numpy(float)
    rest, joined = np.arange(1, len(ids)), np.zeros(len(ids), int)
    near, axes = np.zeros(len(rest), int), [c.copy() for c in at[1:].T]
    gap, d, part = np.sqrt(((at[1:] - at[0]) ** 2).sum(1)), np.empty(len(rest)), np.empty(len(rest))
    links, parents = [], []
    for left in range(len(rest), 0, -1):
        least = np.fmin.reduce(gap[:left])  # nan only if there is nothing else
        ties = np.flatnonzero(gap[:left] == least) if least == least else np.arange(left)
        k = ties[0] if len(ties) == 1 else ties[np.lexsort((rest[ties], joined[near[ties]]))[0]]
        i, last = rest[k], left - 1
        links.append((i, gap[k]))
        parents.append(near[k])
        joined[i] = len(links)
        for column in (rest, near, gap, *axes):
            column[k] = column[last]
        np.square(np.subtract(axes[0][:last], at[i, 0], out=d[:last]), out=d[:last])
        for column, place in zip(axes[1:], at[i, 1:], strict=True):
            d[:last] += np.square(np.subtract(column[:last], place, out=part[:last]), out=part[:last])
        np.sqrt(d[:last], out=d[:last])
        less = np.flatnonzero(d[:last] < gap[:last])
        near[less], gap[less] = i, d[less]
    joins = [i for i, _ in links]
    return pd.DataFrame({"cluster": pdf["cluster"].iloc[0], "a": ids[parents] if links else ids[:0], "b": ids[joins] if links else ids[:0], "distance": np.array([g for _, g in links], float)})


def spanning_trees(points: DataFrame) -> DataFrame:
    """(cluster, id, x, y, z) to the links (cluster, a, b, distance) of a shortest tree over each cluster, which must fit a task."""
    return points.select("cluster", "id", "x", "y", "z").groupBy("cluster").applyInPandas(_tree, "cluster long, a long, b long, distance double")

"""Tiles balanced by counts, neighbours over them, clusters on cells: against all pairs, on even and on skewed clouds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitesmith.operators import joins, points, tiles


def skewed(n=4000, seed=1):
    """Nine tenths of the points in a hundredth of the space."""
    rng = np.random.default_rng(seed)
    dense = rng.random((n * 9 // 10, 3)) * [2.154] * 3
    return np.concatenate([dense, rng.random((n - len(dense), 3)) * 10])


def frame(spark, xyz, scan=1):
    f = pd.DataFrame(xyz, columns=["x", "y", "z"])
    f.insert(0, "idx", np.arange(len(f), dtype=np.int64))
    f.insert(0, "scan_id", np.int32(scan))
    return spark.createDataFrame(f)


def slow_dbscan(xyz, eps, min_points):
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    near = d2 <= eps * eps
    core = near.sum(1) >= min_points
    label = np.full(len(xyz), -1)
    n = 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], n
            while todo:
                j = todo.pop()
                for k in np.flatnonzero(near[j] & core & (label < 0)):
                    label[k] = n
                    todo.append(k)
            n += 1
    out = label.copy()
    for i in np.flatnonzero(~core):
        reach = label[near[i] & core]
        out[i] = reach.min() if len(reach) else -1
    return core, out


def test_no_tile_is_large(spark):
    df = frame(spark, skewed(20_000)).select("scan_id", "idx", *[F.least(F.floor(F.col(d) * 25.6), F.lit(255)).cast("long").alias(c) for d, c in zip("xyz", tiles.cell_names(3))])
    placed, t = tiles.tiled(df, ["scan_id"], 3, 8, 500)
    assert placed.count() == 20_000 and t.agg(F.max("__m")).first()[0] <= 500 and t.count() < 400


@pytest.mark.parametrize("k", [1, 7])
def test_neighbours_over_balanced_tiles(spark, k):
    xyz = np.concatenate([skewed(1500), np.repeat([[9.0, 9.0, 9.0]], 20, axis=0)])  # ties
    got = joins.knn_join(frame(spark, xyz), k, ["x", "y", "z"], "idx", by=["scan_id"], tile_points=100).toPandas()
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    want = [(i, j, r) for i in range(len(xyz)) for r, j in enumerate(np.lexsort((np.arange(len(xyz)), d2[i]))[:k], 1)]
    assert sorted(zip(got["key"], got["other"], got["rank"])) == sorted(want)


def test_neighbours_without_groups(spark):
    df = frame(spark, skewed(300)).select("idx", "x", "y")
    assert joins.knn_join(df, 3, ["x", "y"], "idx", tile_points=20).count() == 900
    assert joins.knn_join(df.limit(2), 3, ["x", "y"], "idx").count() == 4
    assert joins.knn_join(df.limit(0), 3, ["x", "y"], "idx").count() == 0


@pytest.mark.parametrize("eps, min_points, tile", [(0.4, 8, 10**6), (0.4, 8, 200), (0.25, 4, 150), (1.5, 30, 100), (0.4, 1, 300)])
def test_clusters_on_cells(spark, eps, min_points, tile):
    xyz = np.concatenate([skewed(1200, 3), np.repeat([[5.0, 5.0, 5.0]], 40, axis=0), [[5.0, 5.0, 5.0 + eps], [5.0, 5.0, 5.0 - eps]]])
    got = points.dbscan(frame(spark, xyz), eps, min_points, tile_points=tile).toPandas().sort_values("idx")
    core, label = slow_dbscan(xyz, eps, min_points)
    assert got["is_core"].tolist() == core.tolist()
    assert got["cluster_id"].fillna(-1).astype(int).tolist() == label.tolist()


def test_clusters_of_several_scans_and_none(spark):
    df = frame(spark, skewed(300, 5)).unionByName(frame(spark, skewed(700, 6), 2)).unionByName(frame(spark, np.array([[0.0, 0, 0]]), 3))
    a = sorted(map(tuple, points.dbscan(df, 0.4, 5).collect()), key=str)
    b = sorted(map(tuple, points.dbscan(df, 0.4, 5, tile_points=60).collect()), key=str)
    assert a == b and len(a) == 1001
    assert points.dbscan(df.limit(0), 0.4, 5).count() == 0


def test_links_are_few(spark):
    """A dense cloud has rows by cells and points, not by pairs."""
    xyz = np.random.default_rng(2).random((3000, 3))
    found = points.cells_linked(xyz, np.floor(xyz / 0.17).astype(np.int64), np.arange(3000), np.zeros(3000, np.int64), 0.3, 10)
    cells = len(np.unique(np.floor(xyz / 0.17).astype(int), axis=0))
    assert found["link"].sum() <= cells and len(found["idx"]) <= 3000 + cells

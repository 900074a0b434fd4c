"""Neighbour joins over grids of cells, so that distance joins are equi-joins and never compare all pairs."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesmith.operators.graph import shared_table, small
from sitesmith.operators.tiles import around, block_names, cell_names, tiled


def _cells(df: DataFrame, dims: list[str], size: float, prefix: str) -> DataFrame:
    for i, d in enumerate(dims):
        df = df.withColumn(f"{prefix}{i}", F.floor(F.col(d) / size).cast("long"))
    return df


def _around(df: DataFrame, dims: list[str], size: float, reach: int = 1) -> DataFrame:
    """Each row once for every cell within `reach` of its own."""
    offsets = F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(at)]) for at in product(range(-reach, reach + 1), repeat=len(dims))])
    out = _cells(df, dims, size, "__c").withColumn("__o", F.explode(offsets))
    for i in range(len(dims)):
        out = out.withColumn(f"__c{i}", F.col(f"__c{i}") + F.col(f"__o.o{i}"))
    return out.drop("__o")


def distance2(dims: list[str], a: str = "a", b: str = "b"):
    return reduce(lambda x, y: x + y, [(F.col(f"{a}.{d}") - F.col(f"{b}.{d}")) * (F.col(f"{a}.{d}") - F.col(f"{b}.{d}")) for d in dims])


def radius_join(left: DataFrame, right: DataFrame, radius: float, dims: list[str], by: list[str] | None = None) -> DataFrame:
    """Pairs (a, b structs, d2) with squared distance at most radius^2, within equal `by` columns.

    Cells have the radius as their side, so partners lie in the 3^n cells around; the left
    side is repeated for those and meets the right in a hash join on cell.
    """
    by = by or []
    a = _around(left.select(F.struct("*").alias("a"), *[F.col(c) for c in {*dims, *by}]), dims, radius).select("a", *by, *[f"__c{i}" for i in range(len(dims))])
    b = _cells(right.select(F.struct("*").alias("b"), *[F.col(c) for c in {*dims, *by}]), dims, radius, "__c").select("b", *by, *[f"__c{i}" for i in range(len(dims))])
    j = a.join(b, [*by, *[f"__c{i}" for i in range(len(dims))]])
    return j.withColumn("d2", distance2(dims)).where(F.col("d2") <= radius * radius).select("a", "b", "d2")


#: Distances that are computed at a time.
AT_ONCE = 1 << 22
#: Levels by which a tile can be finer than tiles of even density would be.
FINER = 6


def _tile_knn(own: np.ndarray, near: np.ndarray, k: int, reach: float, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each own row its k nearest of near, which is in order of key: (own row, near row, d2) and which own rows are certain.

    A row is certain if its k-th distance is below the reach of its tile's halo, or near holds the whole group.
    """
    rows, cols, d2s, sure = [], [], [], np.zeros(len(own), bool)
    enough, k = len(near) >= k, min(k, len(near))
    step = max(1, min(1024, AT_ONCE // max(1, len(near))))
    for at in range(0, len(own), step):
        part = own[at : at + step]
        d2 = sum((part[:, i, None] - near[None, :, i]) ** 2 for i in range(own.shape[1]))
        kth = np.partition(d2, k - 1, axis=1)[:, k - 1]
        sure[at : at + len(part)] = whole | (enough & (np.sqrt(kth) < reach))
        i, j = np.nonzero(d2 <= kth[:, None])
        v = d2[i, j]
        order = np.lexsort((j, v, i))
        i, j, v = i[order], j[order], v[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        ok = (rank < k) & sure[at + i]
        rows.append(i[ok] + at), cols.append(j[ok]), d2s.append(v[ok])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), sure
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(d2s), sure


def knn_join(points: DataFrame, k: int, dims: list[str], key: str, by: list[str] | None = None, tile_points: int = 512, fold: tuple[Callable, str] | None = None) -> DataFrame:
    """The k nearest of each point in its `by` group, itself included: the by columns, key, other, d2, rank (1..k), ties by the other's key.

    Keys are numbers or strings, different within a group. Space is cut into tiles of at most tile_points points
    (finer where points are dense); every tile meets a copy of the points in a halo around it and compares in blocks of bounded size. What lies beyond
    the halo cannot be nearer than the halo is wide, so points whose k-th neighbour is within
    that are done. The others go again with twice the halo, copied into the
    tiles that still have some. Groups of k points or fewer give all they have; where no group is larger than four tiles each is one.

    With fold, a function and the DDL of what it returns, neighbours are summed up where they are found: given the
    coordinates, the starts of each point's stretch of neighbours, their places and squared distances, it gives columns of a value
    a point, and the rows are the by columns, key and these.
    """
    by, n = by or [], len(dims)
    kinds = dict(points.dtypes)
    cols = points.select(F.col(key).alias("key"), *by, *[F.col(d).cast("double").alias(d) for d in dims])
    widest = F.greatest(*[F.max(d) - F.min(d) for d in dims]) if n > 1 else F.max(dims[0]) - F.min(dims[0])
    sizes = shared_table(cols.groupBy(*by).agg(F.count("*").alias("__n"), F.when(widest > 0, widest).otherwise(1.0).alias("__w"), *[F.min(d).alias(f"__m{i}") for i, d in enumerate(dims)]), "sizes")
    most = sizes.agg(F.max("__n")).first()[0] or 0
    cols = cols.join(small(sizes), by) if by else cols.withColumns({c: F.lit(v) for c, v in (sizes.first() or {}).asDict().items()})
    depth = max(0, math.ceil(math.log2(max(1.0, most / tile_points)) / n)) + FINER if most > 4 * tile_points else 0
    for i, d in enumerate(dims):
        cell = F.floor((F.col(d) - F.col(f"__m{i}")) / F.col("__w") * F.lit(1 << depth)).cast("long")
        cols = cols.withColumn(f"__c{i}", F.least(cell, F.lit((1 << depth) - 1).cast("long")))
    cells, blocks = cell_names(n), block_names(n)
    cols = cols.select("key", *by, *dims, *cells, "__n", "__w")
    made = fold[1] if fold else f"other {kinds[key]}, d2 double, rank int"
    values = [x.split()[0] for x in made.split(", ")]
    out_ddl = f"key {kinds[key]}, {''.join(f'{c} {kinds[c]}, ' for c in by)}{made}, left boolean"
    part = min(1.0, (4.0 * k / tile_points) ** (1.0 / n))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("key").reset_index(drop=True)
        own = g.index[g["__own"]].to_numpy()
        side = g["__w"].iloc[0] / (1 << depth)
        i, j, d2, sure = _tile_knn(g.loc[own, dims].to_numpy(float), g[dims].to_numpy(float), k, g["__reach"].iloc[0] * side, len(g) == g["__n"].iloc[0])
        keys = g["key"].to_numpy()
        lost = keys[own[~sure]]
        if fold:
            starts = np.flatnonzero(np.diff(i, prepend=-1))
            found = fold[0](g[dims].to_numpy(float), starts, j, d2) if len(starts) else {c: np.empty(0) for c in values}
            out, empty = pd.DataFrame({"key": keys[own[i[starts]]], **found, "left": False}), dict.fromkeys(values, 0)
        else:
            rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
            out, empty = pd.DataFrame({"key": keys[own[i]], "other": keys[j], "d2": d2, "rank": rank.astype(np.int32), "left": False}), {"other": lost, "d2": 0.0, "rank": np.int32(0)}
        both = pd.concat([out, pd.DataFrame({"key": lost, **empty, "left": True})]) if len(lost) else out
        for c in by:
            both[c] = g[c].iloc[0]
        return both[["key", *by, *values, "left"]]

    if not depth:  # every group is one tile
        pool = cols.withColumns({"__own": F.lit(True), "__reach": F.lit(0.0)})
        return (pool.groupBy(*by) if by else pool.groupBy(F.lit("all"))).applyInPandas(run, out_ddl).drop("left")

    cols, tiles = tiled(cols, by, n, depth, tile_points)
    cols = shared_table(cols, "tiled")
    rest, done = None, None
    while True:
        reach = F.ceil(F.lit(part) * F.pow(F.lit(2.0), F.col("__l")))
        pool = around(cols.drop("__l", *blocks), tiles, by, n, depth, reach).withColumn("__own", F.col("__gap") == 0)
        if rest is not None:
            mine = rest.select(*by, "key", F.lit(True).alias("__open"))
            pool = pool.join(mine, [*by, "key"], "left").withColumn("__own", F.col("__own") & F.coalesce("__open", F.lit(False))).drop("__open")
        pool = pool.withColumn("__reach", reach.cast("double"))
        got = shared_table(pool.groupBy(*by, "__l", *blocks).applyInPandas(run, out_ddl), "knn")
        settled = got.where("not left").drop("left")
        done = settled if done is None else done.unionByName(settled)
        rest = got.where("left").select(*by, "key")
        if rest.isEmpty():
            return done
        # halos double until they hold a whole group, so this ends; only tiles with open points go on
        tiles = shared_table(cols.join(rest, [*by, "key"], "left_semi").groupBy(*by, "__l", *blocks).agg(F.count("*").alias("__m")), "open-tiles")
        part *= 2


def band_join(df: DataFrame, bands: DataFrame, value: str, low: str = "low", high: str = "high", cell: float = 1.0) -> DataFrame:
    """Left join on low <= value < high, as an equi-join on cells of the bands; bands are cut into the cells that they touch."""
    cut = bands.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(low) / cell).cast("long"), F.ceil(F.col(high) / cell).cast("long") - 1)))
    keyed = df.withColumn("__cell", F.floor(F.col(value) / cell).cast("long"))
    same = (keyed["__cell"] == cut["__cell"]) & (keyed[value] >= cut[low]) & (keyed[value] < cut[high])
    return keyed.join(cut, same, "left").drop("__cell")

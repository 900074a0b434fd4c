"""Tiles of about equal numbers of points: an octree (or its like in other dimensions) cut by counts.

Space is a grid of cells; a tile is a cube of 2^level cells a side. Counts are taken of the cells and summed up
for all levels at once; a cell belongs to the largest cube around it that holds at most `limit` points, so tiles
are small where points are dense. A tile's halo is a number of cells around it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesmith.operators.graph import shared_table, small


def cell_names(n: int) -> list[str]:
    return [f"__c{i}" for i in range(n)]


def block_names(n: int) -> list[str]:
    return [f"__b{i}" for i in range(n)]


def tiled(points: DataFrame, by: list[str], n: int, depth: int, limit: int, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """Points with cells __c0.. (from 0 to below 2^depth) -> (with their tile: __l, __b0.., the tiles with their number of points __m).

    A tile holds at most `limit` points, unless it is a cube of the level `least`, which is not cut.
    """
    cells, blocks = cell_names(n), block_names(n)
    counts = points.groupBy(*by, *cells).agg(F.count("*").alias("__m"))
    at = counts.withColumn("__l", F.explode(F.sequence(F.lit(least), F.lit(depth))))
    at = at.select("*", *[F.expr(f"shiftright({c}, __l)").alias(b) for c, b in zip(cells, blocks)])
    sums = at.groupBy(*by, "__l", *blocks).agg(F.sum("__m").alias("__m")).where((F.col("__m") <= limit) | (F.col("__l") == least))
    level = at.drop("__m").join(sums, [*by, "__l", *blocks], "left_semi").groupBy(*by, *cells).agg(F.max("__l").alias("__l"))
    level = small(shared_table(level, "levels"))
    out = points.join(level, [*by, *cells]).select("*", *[F.expr(f"shiftright({c}, __l)").alias(b) for c, b in zip(cells, blocks)])
    tiles = shared_table(out.groupBy(*by, "__l", *blocks).agg(F.count("*").alias("__m")), "tiles")
    return out, tiles


def around(points: DataFrame, tiles: DataFrame, by: list[str], n: int, depth: int, reach: Column) -> DataFrame:
    """Points with cells, once for each tile that they stand in or within `reach` cells (an expression of __l) of: __l, __b0.., __gap, the cells between (0 inside)."""
    cells, blocks = cell_names(n), block_names(n)
    levels = sorted(r["__l"] for r in tiles.select("__l").distinct().collect())  # at most as many as the grid has
    if not levels:
        levels = [0]
    out = points.withColumn("__l", F.explode(F.array(*[F.lit(v) for v in levels]))).withColumn("__r", reach.cast("long"))
    for c, b in zip(cells, blocks):
        low, high = f"shiftright(greatest({c} - __r, 0L), __l)", f"shiftright(least({c} + __r, {(1 << depth) - 1}L), __l)"
        out = out.withColumn(b, F.explode(F.sequence(F.expr(low), F.expr(high))))
    gaps = [F.greatest(F.expr(f"shiftleft({b}, __l) - {c}"), F.expr(f"{c} - shiftleft({b} + 1, __l) + 1"), F.lit(0)) for c, b in zip(cells, blocks)]
    out = out.withColumn("__gap", reduce(lambda x, y: F.greatest(x, y), gaps)).where(F.col("__gap") <= F.col("__r"))
    return out.join(small(tiles.select(*by, "__l", *blocks)), [*by, "__l", *blocks]).drop("__r")

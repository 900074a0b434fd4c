"""Point clouds: (scan_id, idx, x, y, z in metres, r, g, b) -> downsampled, cleaned, split, clustered and summarised.

Computed in doubles. Every step is keyed by scan and, where it looks for neighbours, by grid
cell, so one scan spreads over tasks. z is up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesmith.functions import text
from sitesmith.functions.geo import FEET_PER_METRE
from sitesmith.operators.graph import components, shared_table, small
from sitesmith.operators.joins import knn_join, radius_join
from sitesmith.operators.tiles import around, block_names, cell_names, tiled

XYZ = ["x", "y", "z"]


@dataclass(frozen=True)
class ScanConfig:
    voxel: float = 0.02
    neighbours: int = 30
    sigma: float = 2.0
    iterations: int = 1000
    threshold: float = 0.02


def voxel_downsample(points: DataFrame, size: float) -> DataFrame:
    """One point per occupied cell: mean position, whole-number mean colour of its coloured points (null without any); none for size <= 0."""
    if size <= 0:
        return points.limit(0)
    inv = 1.0 / size
    cell = [F.floor(F.col(d) * inv).cast("long").alias(f"i{d}") for d in XYZ]
    has = F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull()
    n = F.sum(has.cast("long"))
    mean = lambda c: F.when(n > 0, F.floor(F.sum(F.when(has, F.col(c).cast("long"))) / n)).cast("int").alias(c)
    out = points.groupBy("scan_id", *cell).agg(*[F.avg(d).alias(d) for d in XYZ], *[mean(c) for c in "rgb"], F.count("*").alias("n"), F.min("idx").alias("idx"))
    return out.select("scan_id", "idx", *XYZ, "r", "g", "b", "n", "ix", "iy", "iz")


def bounding_box(points: DataFrame, by: list[str]) -> DataFrame:
    return points.groupBy(*by).agg(*[f(d).alias(f"{n}_{d}") for d in XYZ for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n"))


def knn_mean_distance(points: DataFrame, k: int) -> DataFrame:
    """(scan_id, idx) -> mean distance to the k nearest others (k + 1 looked up, the point itself not counted), summed up where the neighbours are found."""
    def mean(xyz, starts, j, d2):
        return {"mean_d": np.add.reduceat(np.sqrt(d2), starts) / k}  # a point's own distance is zero

    return knn_join(points, k + 1, XYZ, "idx", by=["scan_id"], fold=(mean, "mean_d double")).select("scan_id", F.col("key").alias("idx"), "mean_d")


def remove_outliers(points: DataFrame, k: int, sigma: float) -> DataFrame:
    """Points whose mean distance is at most the scan's mean + sigma population deviations; scans of k points or fewer stay whole."""
    d = shared_table(knn_mean_distance(points, k), "knn")
    cut = d.groupBy("scan_id").agg((F.avg("mean_d") + sigma * F.stddev_pop("mean_d")).alias("cut"), F.count("*").alias("n"))
    keep = d.join(small(shared_table(cut, "cuts")), "scan_id").where((F.col("n") <= k) | (F.round("mean_d", 9) <= F.round("cut", 9))).select("scan_id", "idx")
    return points.join(keep, ["scan_id", "idx"], "left_semi")


#: Hypotheses up to which all of them are sent to every task (40 bytes each); beyond it they meet their scans in groups.
SENT_PLANES = 1_000_000
#: Points of a scan in such a group, on average.
GROUP_POINTS = 65_536


def hypotheses(sizes: DataFrame, iterations: int, seed: int = 1) -> DataFrame:
    """(scan_id, n) -> scan_id, iteration, at: three different places below n by modular steps, the same on every engine."""
    h = sizes.where("n >= 3").withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    k = F.col("iteration").cast("long") + seed * 1000003
    h = h.withColumns({"i0": k * 7919 % F.col("n"), "o1": 1 + k * 104729 % (F.col("n") - 1), "o2": 1 + k * 15485863 % (F.col("n") - 2)})
    o2 = F.col("o2") + (F.col("o2") >= F.col("o1")).cast("long")
    return h.select("scan_id", "iteration", F.array(F.col("i0"), (F.col("i0") + F.col("o1")) % F.col("n"), (F.col("i0") + o2) % F.col("n")).alias("at"))


def _votes(xyz: np.ndarray, normals: np.ndarray, offsets: np.ndarray, threshold: float) -> np.ndarray:
    total = np.zeros(len(offsets), np.int64)
    for at in range(0, len(xyz), 4096):
        total += (np.abs(np.round(xyz[at : at + 4096] @ normals.T + offsets, 9)) <= threshold).sum(axis=0)
    return total


def _inliers(points: DataFrame, planes: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """(scan_id, iteration, n) of stored planes: sent to the tasks that read the points if they are few, else dealt with the points of their scan in groups of bounded size."""
    spark, kind = points.sparkSession, dict(points.dtypes)["scan_id"]
    ddl = f"scan_id {kind}, iteration int, n long"
    if planes.limit(SENT_PLANES + 1).count() <= SENT_PLANES:
        held = {s: (g["iteration"].to_numpy(), g[["nx", "ny", "nz"]].to_numpy(), g["d"].to_numpy()) for s, g in planes.toPandas().groupby("scan_id")}
        sent = spark.sparkContext.broadcast(held)

        def count(frames):
            total: dict = {}
            for f in frames:
                for s, g in f.groupby("scan_id"):
                    if s in sent.value:
                        total[s] = total.get(s, 0) + _votes(g[XYZ].to_numpy(), *sent.value[s][1:], threshold)
            for s, n in total.items():
                yield pd.DataFrame({"scan_id": s, "iteration": sent.value[s][0], "n": n})

        votes = points.select("scan_id", *XYZ).mapInPandas(count, ddl)
    else:
        parts = sizes.select("scan_id", F.ceil(F.col("n") / GROUP_POINTS).cast("int").alias("parts"))
        own = points.select("scan_id", "idx", *XYZ).join(parts, "scan_id").withColumn("part", F.pmod(F.xxhash64("idx"), F.col("parts")).cast("int")).drop("parts", "idx")
        theirs = planes.join(parts, "scan_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def meet(p: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"scan_id": h["scan_id"], "iteration": h["iteration"], "n": _votes(p[XYZ].to_numpy(float).reshape(-1, 3), h[["nx", "ny", "nz"]].to_numpy(), h["d"].to_numpy(), threshold)})

        votes = own.groupBy("scan_id", "part").cogroup(theirs.groupBy("scan_id", "part")).applyInPandas(meet, ddl)
    return votes.groupBy("scan_id", "iteration").agg(F.sum("n").alias("n"))


def ground_planes(points: DataFrame, iterations: int, threshold: float, seed: int = 1) -> DataFrame:
    """RANSAC per scan -> scan_id, nx, ny, nz, d, inliers, iteration; nz >= 0; scans of fewer than 3 points or without a plane are left out.

    The hypotheses of a scan (three points by place, `iterations` of them) are a table made from
    the scans' sizes; their corners come from a join by place. Every batch of points is counted
    against all hypotheses of its scan at once and only counts are summed over tasks. The first of equally good hypotheses wins.
    """
    # idx is the place of a point in its scan
    sizes = shared_table(points.groupBy("scan_id").agg(F.count("*").alias("n")), "sizes")
    want = hypotheses(sizes, iterations, seed).select("scan_id", "iteration", F.posexplode("at").alias("j", "idx"))
    corners = points.select("scan_id", F.col("idx").cast("long").alias("idx"), *XYZ).join(want, ["scan_id", "idx"])
    corners = corners.groupBy("scan_id", "iteration").agg(*[F.max(F.when(F.col("j") == j, F.struct(*XYZ))).alias(f"p{j}") for j in range(3)]).where("p0 is not null and p1 is not null and p2 is not null")
    d = lambda a, c: F.col(f"p{a}.{c}") - F.col(f"p0.{c}")
    planes = corners.select(
        "scan_id", "iteration", F.col("p0").alias("p"), (d(1, "y") * d(2, "z") - d(1, "z") * d(2, "y")).alias("cx"),
        (d(1, "z") * d(2, "x") - d(1, "x") * d(2, "z")).alias("cy"), (d(1, "x") * d(2, "y") - d(1, "y") * d(2, "x")).alias("cz"),
    ).withColumn("len", F.sqrt(F.expr("cx * cx + cy * cy + cz * cz"))).where("len >= 1e-10")
    flip = F.when(F.col("cz") < 0, -1.0).otherwise(1.0)
    planes = planes.select("scan_id", "iteration", *[(F.col(c) / F.col("len") * flip).alias(n) for c, n in (("cx", "nx"), ("cy", "ny"), ("cz", "nz"))], "p")
    planes = shared_table(planes.withColumn("d", -F.expr("nx * p.x + ny * p.y + nz * p.z")).drop("p"), "planes")
    votes = _inliers(points, planes, sizes, threshold)
    best = votes.groupBy("scan_id").agg(F.max(F.struct("n", (-F.col("iteration")).alias("i"))).alias("v")).select("scan_id", F.col("v.n").alias("inliers"), (-F.col("v.i")).alias("iteration"))
    return planes.join(best, ["scan_id", "iteration"]).where("inliers > 0").select("scan_id", "nx", "ny", "nz", "d", "inliers", "iteration")


def split_ground(points: DataFrame, planes: DataFrame, threshold: float) -> DataFrame:
    """points with is_ground: within the threshold of their scan's plane on either side. Planes are a row a scan."""
    p = points.join(small(planes.select("scan_id", "nx", "ny", "nz", "d")), "scan_id")
    off = F.round(F.expr("nx * x + ny * y + nz * z + d"), 9)
    return p.withColumn("is_ground", F.abs(off) <= threshold).withColumn("height", off).drop("nx", "ny", "nz", "d")


#: Points of a tile in which clusters are looked for.
CLUSTER_TILE = 16_384


def dbscan(points: DataFrame, eps: float = 0.3, min_points: int = 50, tile_points: int = CLUSTER_TILE) -> DataFrame:
    """(scan_id, idx, x, y, z) -> scan_id, idx, is_core, cluster_id: 0, 1, ... by smallest core idx in a scan; null for noise.

    Core points have min_points neighbours within eps, themselves included. Cores within eps of each
    other are one cluster; a border point joins the one with the lowest number that has a core in reach.

    Space is cut into cells whose points are all within eps of each other (side eps / sqrt(3)), so that a cell of
    min_points is all core and the cores of a cell are one node. Tiles of cells are balanced by counts; each finds its
    nodes and their links in numpy, joins linked nodes at once and gives a row for each node and each border
    point. What is linked across tiles meets by node. A scan of tile_points or fewer is one tile and is done there.
    """
    side = eps / math.sqrt(3) * (1 - 1e-9)
    kind = dict(points.dtypes)["scan_id"]
    sizes = shared_table(points.groupBy("scan_id").agg(F.count("*").alias("__n"), *[F.min(d).alias(f"__m{i}") for i, d in enumerate(XYZ)], *[F.max(d).alias(f"__x{i}") for i, d in enumerate(XYZ)]), "sizes")
    p = points.select("scan_id", "idx", *XYZ).join(small(sizes.select("scan_id", *[f"__m{i}" for i in range(3)])), "scan_id")
    cells, blocks = cell_names(3), block_names(3)
    for c, d, i in zip(cells, XYZ, range(3)):
        p = p.withColumn(c, F.floor((F.col(d) - F.col(f"__m{i}")) / side).cast("long"))
    p = p.select("scan_id", F.col("idx").cast("long").alias("idx"), *XYZ, *cells)
    most, widest = sizes.agg(F.max("__n"), F.max(F.greatest(*[F.col(f"__x{i}") - F.col(f"__m{i}") for i in range(3)]))).first()
    out_ddl = f"scan_id {kind}, idx long, node long, is_core boolean, link boolean"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        found = cells_linked(g[XYZ].to_numpy(float), g[cells].to_numpy(np.int64), g["idx"].to_numpy(), g["__gap"].to_numpy(), eps, min_points)
        return pd.DataFrame(found).assign(scan_id=g["scan_id"].iloc[0])[["scan_id", "idx", "node", "is_core", "link"]]

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        f = pd.DataFrame(cells_linked(g[XYZ].to_numpy(float), g[cells].to_numpy(np.int64), g["idx"].to_numpy(), np.zeros(len(g), np.int64), eps, min_points))
        f = f[~f["link"]]
        number = {n: i for i, n in enumerate(np.unique(f["node"][f["is_core"]]).tolist())}  # a node is named by its cluster's smallest core
        f = f.assign(cluster_id=f["node"].map(number)).groupby("idx").agg({"is_core": "max", "cluster_id": "min"})
        out = g[["scan_id", "idx"]].join(f, on="idx")
        return out.assign(is_core=out["is_core"].eq(True), cluster_id=out["cluster_id"].astype("Int32"))

    ddl = f"scan_id {kind}, idx long, is_core boolean, cluster_id int"
    if not most or most <= tile_points:
        return p.groupBy("scan_id").applyInPandas(whole, ddl)
    depth = max(3, math.ceil(math.log2(max(2.0, widest / side + 1))))
    placed, tiles = tiled(p, ["scan_id"], 3, depth, tile_points, least=2)
    placed = shared_table(placed.drop("__l", *blocks), "tiled")
    pool = around(placed, tiles, ["scan_id"], 3, depth, F.lit(4))  # two cells hold all that is within eps; two more their neighbours
    found = shared_table(pool.groupBy("scan_id", "__l", *blocks).applyInPandas(run, out_ddl), "nodes")
    node = lambda c: F.struct("scan_id", F.col(c).alias("idx"))
    links = found.where("link").select(node("idx").alias("a"), node("node").alias("b"))
    cores = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    label = components(links.where("a <> b").distinct(), cores)
    number = label.select("label").distinct().withColumn("cluster_id", F.row_number().over(Window.partitionBy("label.scan_id").orderBy("label.idx")) - 1)
    number = shared_table(label.join(number, "label").select(F.col("id.scan_id").alias("scan_id"), F.col("id.idx").alias("node"), "cluster_id"), "clusters")
    of = found.where("not link").join(number, ["scan_id", "node"]).groupBy("scan_id", "idx").agg(F.max("is_core").alias("is_core"), F.min("cluster_id").alias("cluster_id"))
    out = placed.select("scan_id", "idx").join(of, ["scan_id", "idx"], "left")
    return out.select("scan_id", "idx", F.coalesce("is_core", F.lit(False)).alias("is_core"), F.col("cluster_id").cast("int").alias("cluster_id"))


#: Pairs of points that are compared at a time.
PAIRS = 1 << 21
AROUND = np.array([(x, y, z) for x in range(-2, 3) for y in range(-2, 3) for z in range(-2, 3)])


def pairs_of(left: np.ndarray, starts: np.ndarray, counts: np.ndarray):
    """Each left row with the rows starts .. starts + counts of the right side, some PAIRS at a time: (left rows, right rows)."""
    at, ends = 0, np.cumsum(counts)
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = counts[at:to]
        yield np.repeat(left[at:to], n), np.repeat(starts[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = to


def cells_linked(xyz: np.ndarray, cells: np.ndarray, idx: np.ndarray, gap: np.ndarray, eps: float, min_points: int) -> dict[str, np.ndarray]:
    """Nodes of a tile and its halo. gap: cells between a point and the tile; what lies within two has all its neighbours here.

    Rows (idx, node, is_core, link): own core points with their node, own border points with each node in reach, and, as links,
    the nodes (named by their smallest core) with the smallest node that they are linked with here.
    """
    order = np.lexsort((idx, *cells.T[::-1]))
    xyz, cells, idx, gap = xyz[order], cells[order], idx[order], gap[order]
    new = np.append(True, (np.diff(cells, axis=0) != 0).any(axis=1)) if len(cells) else np.empty(0, bool)
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(cells)))
    cell_of = np.cumsum(new) - 1
    low = cells.min(0) - 2
    span = cells.max(0) - low + 3
    code = lambda c: ((c - low) @ np.array([span[1] * span[2], span[2], 1])).astype(np.int64)
    codes, near = code(cells[starts]), gap[starts]

    def beside(offset: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the cells `who` those with a cell at the offset, and that cell."""
        want = codes[who] + int(offset @ np.array([span[1] * span[2], span[2], 1]))
        at = np.minimum(np.searchsorted(codes, want), len(codes) - 1)
        ok = codes[at] == want
        return who[ok], at[ok]

    def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((xyz[a] - xyz[b]) ** 2).sum(1) <= eps * eps

    def row_pairs(rows: np.ndarray, of: np.ndarray, to_cells: np.ndarray, limit: int | None = None, skip: int = 0):
        """Rows (each of the cell of[i]) with the points of to_cells."""
        n = counts[to_cells] - skip if limit is None else np.clip(counts[to_cells] - skip, 0, limit)
        some = n > 0
        yield from pairs_of(rows[some], (starts[to_cells] + skip)[some], n[some])

    core = counts[cell_of] >= min_points
    open_rows = np.flatnonzero(~core & (gap <= 2))
    seen = np.zeros(len(xyz), np.int64)
    seen[open_rows] = counts[cell_of[open_rows]]
    for offset in AROUND:
        if not offset.any() or not len(open_rows):
            continue
        own_cells = np.unique(cell_of[open_rows])
        have, other = beside(offset, own_cells)
        target = np.full(len(starts), -1)
        target[have] = other
        skip = 0
        rows = open_rows[target[cell_of[open_rows]] >= 0]
        while len(rows):  # a dense cell some points at a time, until a point has enough
            to = target[cell_of[rows]]
            for a, b in row_pairs(rows, rows, to, 256, skip):
                seen += np.bincount(a[within(a, b)], minlength=len(xyz))
            skip += 256
            rows = rows[(seen[rows] < min_points) & (counts[to] > skip)]
        open_rows = open_rows[seen[open_rows] < min_points]
    core |= (seen >= min_points) & (gap <= 2)
    core &= gap <= 2

    # nodes: cells with a core, named by their smallest core
    core_rows = np.flatnonzero(core)
    core_cells, first = np.unique(cell_of[core_rows], return_index=True)
    c_starts, c_counts = first, np.diff(np.append(first, len(core_rows)))
    place = np.full(len(starts), -1)
    place[core_cells] = np.arange(len(core_cells))
    name = np.array([idx[core_rows[a : a + n]].min() for a, n in zip(c_starts, c_counts)], np.int64)
    up = np.arange(len(core_cells))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for offset in AROUND[len(AROUND) // 2 + 1 :]:
        have, other = beside(offset, core_cells)
        a, b = place[have], place[other]
        ok = (b >= 0) & ((near[have] == 0) | (near[other] == 0))
        a, b = a[ok], b[ok]
        small_ = c_counts[a] * c_counts[b] <= 4096
        linked = np.zeros(len(a), bool)
        pick = np.flatnonzero(small_)
        # each core of a with all cores of b, for pairs of small nodes at once
        mine = np.repeat(pick, c_counts[a[pick]])
        rows = np.repeat(c_starts[a[pick]] - (np.cumsum(c_counts[a[pick]]) - c_counts[a[pick]]), c_counts[a[pick]]) + np.arange(c_counts[a[pick]].sum())
        for at, y in pairs_of(np.arange(len(mine)), c_starts[b[mine]], c_counts[b[mine]]):
            linked[mine[at][within(core_rows[rows[at]], core_rows[y])]] = True
        for i in np.flatnonzero(~small_):
            linked[i] = root(a[i]) == root(b[i]) or any_within(xyz[core_rows[c_starts[a[i]] : c_starts[a[i]] + c_counts[a[i]]]], xyz[core_rows[c_starts[b[i]] : c_starts[b[i]] + c_counts[b[i]]]], eps)
        for i in np.flatnonzero(linked):
            x, y = root(a[i]), root(b[i])
            if x != y:
                up[max(x, y)] = min(x, y)
    roots = np.array([root(i) for i in range(len(up))], np.int64)
    least = np.full(len(up), np.iinfo(np.int64).max)
    np.minimum.at(least, roots, name)
    joined = least[roots]

    own_core = core_rows[gap[core_rows] == 0]
    rim = np.flatnonzero(~core & (gap == 0))
    got: list[tuple[np.ndarray, np.ndarray]] = []
    for offset in AROUND:
        have, other = beside(offset, np.unique(cell_of[rim])) if len(rim) else (np.empty(0, int), np.empty(0, int))
        target = np.full(len(starts), -1)
        target[have] = place[other]
        rows = rim[target[cell_of[rim]] >= 0]
        to = target[cell_of[rows]]
        for a, b in pairs_of(np.arange(len(rows)), c_starts[to], c_counts[to]):
            ok = within(rows[a], core_rows[b])
            hit = np.unique(a[ok])
            got.append((idx[rows[hit]], joined[to[hit]]))
    edge_i, edge_n = (np.concatenate(x) for x in zip(*got)) if got else (np.empty(0, np.int64),) * 2
    edge = np.unique(np.stack([edge_i, edge_n]), axis=1)
    return {
        "idx": np.concatenate([idx[own_core], edge[0], name]), "node": np.concatenate([joined[place[cell_of[own_core]]], edge[1], joined]),
        "is_core": np.repeat([True, False, False], [len(own_core), edge.shape[1], len(name)]), "link": np.repeat([False, False, True], [len(own_core), edge.shape[1], len(name)]),
    }


def any_within(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether two sets have a pair within eps; points farther than eps from the other's box are left out first."""
    for x, y in ((0, 1), (1, 0)):
        sets = [a, b]
        gap = np.maximum(np.maximum(sets[y].min(0) - sets[x], sets[x] - sets[y].max(0)), 0)
        sets[x] = sets[x][(gap**2).sum(1) <= eps * eps]
        a, b = sets
        if not len(a) or not len(b):
            return False
    step = max(1, PAIRS // len(b))
    return any((((a[i : i + step, None] - b[None]) ** 2).sum(2) <= eps * eps).any() for i in range(0, len(a), step))


def first_come(points: DataFrame, eps: float, clusters: DataFrame) -> DataFrame:
    """dbscan() rows with the border rule of a scan in order of idx: the compat rule.

    A border point belongs to a cluster if it lies within eps of the cluster's first core, or
    comes after that core and within eps of any other; of several it takes the lowest number. Others are noise.
    """
    c = points.select("scan_id", "idx", *XYZ).join(clusters, ["scan_id", "idx"])
    core = c.where("is_core").withColumn("seed", F.min("idx").over(Window.partitionBy("scan_id", "cluster_id")))
    rim = c.where("not is_core and cluster_id is not null").drop("cluster_id", "is_core")
    j = radius_join(rim, core, eps, XYZ, by=["scan_id"])
    ok = (F.col("b.idx") == F.col("b.seed")) | (F.col("a.idx") > F.col("b.seed"))
    won = j.where(ok).groupBy(F.col("a.scan_id").alias("scan_id"), F.col("a.idx").alias("idx")).agg(F.min("b.cluster_id").alias("won"))
    out = clusters.join(won, ["scan_id", "idx"], "left")
    return out.select("scan_id", "idx", "is_core", F.when(F.col("is_core"), F.col("cluster_id")).otherwise(F.col("won")).alias("cluster_id"))


def concatenated(split: DataFrame) -> DataFrame:
    """Ground points followed by obstacles as one cloud, place by place: the whole cloud again."""
    ground, rest = split.where("is_ground"), split.where("not is_ground")
    return ground.withColumn("part", F.lit(0)).unionByName(rest.withColumn("part", F.lit(1)))


def annotations(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates and classifications (label, category, confidence) of the same scan and cluster -> label text, colour and place on the plan."""
    from sitesmith.functions import text

    j = candidates.join(classes.select("scan_id", "cluster_id", "label", "category", "confidence"), ["scan_id", "cluster_id"])
    return j.withColumn("text", F.format_string("%s (%.2f)", "label", "confidence")).withColumn("colour", text.category_colour(F.col("category")))


def candidates(points: DataFrame, planes: DataFrame) -> DataFrame:
    """Clustered points (scan_id, cluster_id, x, y, z, r, g, b) and planes -> one summary per cluster.

    Height is the largest distance from the ground plane, spread the wider side of the box, both in
    feet; density counts points per cubic metre of a box no thinner than 1 cm.
    """
    key = ["scan_id", "cluster_id"]
    p = points.where("cluster_id is not null").join(small(planes.select("scan_id", "nx", "ny", "nz", "d")), "scan_id")
    has = F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull()
    n = F.sum(has.cast("long"))
    mean = lambda c: F.when(n > 0, F.floor(F.sum(F.when(has, F.col(c).cast("long"))) / n)).cast("int").alias(f"m{c}")
    one = p.groupBy(*key).agg(
        F.count("*").alias("point_count"), *[F.avg(d).alias(f"c{d}") for d in XYZ], *[f(d).alias(f"{m}_{d}") for d in XYZ for m, f in (("min", F.min), ("max", F.max))],
        (F.max(F.abs(F.expr("nx * x + ny * y + nz * z + d"))) * FEET_PER_METRE).alias("height_ft"), *[mean(c) for c in "rgb"],
    )
    mid = one.select(*key, ((F.col("min_z") + F.col("max_z")) / 2).alias("mid"))
    halves = p.join(mid, key)
    low = F.col("z") <= F.col("mid")
    side = lambda cond, d: F.max(F.when(cond, F.col(d))) - F.min(F.when(cond, F.col(d)))
    cone = halves.groupBy(*key).agg(
        F.sum(low.cast("long")).alias("nl"), F.sum((~low).cast("long")).alias("nu"), F.greatest(side(low, "x"), side(low, "y")).alias("sl"), F.greatest(side(~low, "x"), side(~low, "y")).alias("su")
    )
    conical = (F.col("nl") >= 2) & (F.col("nu") >= 2) & (F.col("sl") >= 0.01) & (F.round(F.col("su") / F.col("sl"), 9) < 0.7)
    size = lambda d: F.greatest(F.col(f"max_{d}") - F.col(f"min_{d}"), F.lit(0.01))
    out = one.join(cone.select(*key, F.coalesce(conical, F.lit(False)).alias("conical")), key)
    spread = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) * FEET_PER_METRE
    out = out.withColumn("spread_ft", spread).withColumn("density", F.col("point_count") / (size("x") * size("y") * size("z")))
    # thresholds are compared after rounding, so that the last bit does not decide
    profile = text.vertical_profile(F.round("height_ft", 9), F.round("spread_ft", 9), F.col("conical"))
    return out.withColumn("dominant_color", text.classify_rgb(F.col("mr"), F.col("mg"), F.col("mb"))).withColumn("vertical_profile", profile).select(
        *key, "cx", "cy", "cz", *[f"{m}_{d}" for d in XYZ for m in ("min", "max")], "height_ft", "spread_ft", "point_count", "dominant_color", "vertical_profile", "density"
    )


def classify(cands: DataFrame) -> DataFrame:
    """label, category, species and confidence of candidates by ordered rules."""
    h, s = F.round("height_ft", 9), F.round("spread_ft", 9)
    prof, colour = F.col("vertical_profile"), F.col("dominant_color")
    pole = (h > 8) & (prof == "columnar") & (s < 2) & (colour == "gray")
    tree = (h > 8) & prof.isin("columnar", "spreading") & colour.isin("brown", "green")
    hard = (h < 3) & (prof == "flat")
    plane, trunk = (h > 15) & (s > 5), h > 15
    label = (
        F.when(pole, "Utility Pole").when(tree & plane, "London Plane Tree").when(tree & trunk, "Street Tree Trunk").when(tree, "Young Street Tree")
        .when(hard & (colour == "gray"), "Concrete Curb").when(hard & (colour == "brown"), "Brick Pathway").when(hard, "Hardscape Element").otherwise("Urban Structure")
    )
    category = F.when(pole, "utility").when(tree, "tree").when(hard, "hardscape").otherwise("structure")
    species = F.when(~pole & tree & plane, "Platanus × acerifolia").when(~pole & tree & trunk, "Lophostemon confertus")
    confidence = F.when(pole, 0.75).when(tree & plane, 0.85).when(tree & trunk, 0.72).when(tree, 0.60).when(hard, 0.65).otherwise(0.45)
    return cands.withColumn("label", label).withColumn("category", category).withColumn("species", species).withColumn("confidence", confidence)


def gaps(cands: DataFrame, planes: DataFrame, max_distance_ft: float = 30.0) -> DataFrame:
    """Pairs of candidates of a scan (a before b) with clear space between them, nearest first in `rank`."""
    c = cands.select("scan_id", "cluster_id", "cx", "cy", "spread_ft")
    pairs = radius_join(c, c, max_distance_ft / FEET_PER_METRE * (1 + 1e-9), ["cx", "cy"], by=["scan_id"]).where("a.cluster_id < b.cluster_id")
    g = pairs.select(
        F.col("a.scan_id").alias("scan_id"), F.col("a.cluster_id").alias("feature_a"), F.col("b.cluster_id").alias("feature_b"), (F.sqrt("d2") * FEET_PER_METRE).alias("distance_ft"),
        F.col("a.spread_ft").alias("sa"), F.col("b.spread_ft").alias("sb"), ((F.col("a.cx") + F.col("b.cx")) / 2).alias("mx"), ((F.col("a.cy") + F.col("b.cy")) / 2).alias("my"),
    ).where(F.round("distance_ft", 9) <= max_distance_ft)
    g = g.withColumn("clear_width_ft", F.col("distance_ft") - (F.col("sa") / 2 + F.col("sb") / 2)).where(F.round("clear_width_ft", 9) > 0)
    g = g.withColumn("clear_length_ft", F.least("sa", "sb")).withColumn("area_sqft", F.col("clear_width_ft") * F.col("clear_length_ft"))
    g = g.join(small(planes.select("scan_id", "nx", "ny", "nz", "d")), "scan_id")
    ground = F.when(F.abs("nz") < 1e-6, 0.0).otherwise(-F.expr("(nx * mx + ny * my + d) / nz") * FEET_PER_METRE)
    return g.withColumn("ground_ft", ground).select("scan_id", "feature_a", "feature_b", "distance_ft", "clear_width_ft", "clear_length_ft", "area_sqft", "ground_ft", "mx", "my")


def best_gap(g: DataFrame) -> DataFrame:
    """The largest gap per scan; of equals the last by distance and pair."""
    cols = [c for c in g.columns if c != "scan_id"]
    order = F.struct(F.round("area_sqft", 9), "distance_ft", "feature_a", "feature_b")
    return g.groupBy("scan_id").agg(F.max_by(F.struct(*cols), order).alias("v")).select("scan_id", *[F.col(f"v.{c}") for c in cols])


def scan_report(raw: DataFrame, voxels: DataFrame, clean: DataFrame, split: DataFrame) -> DataFrame:
    """Per scan: counts of each step, share retained, outliers removed, ground area of the box and obstacle height range."""
    n = lambda df, name: df.groupBy("scan_id").agg(F.count("*").alias(name))
    g = F.col("is_ground")
    side = lambda d: F.coalesce(F.max(F.when(g, F.col(d))) - F.min(F.when(g, F.col(d))), F.lit(0.0))
    s = split.groupBy("scan_id").agg(
        F.sum(g.cast("long")).alias("ground"), F.sum((~g).cast("long")).alias("obstacles"), (side("x") * side("y")).alias("ground_area_m2"),
        F.min(F.when(~g, F.col("height"))).alias("obstacle_low"), F.max(F.when(~g, F.col("height"))).alias("obstacle_high"),
    )
    j = n(raw, "points").join(n(voxels, "voxels"), "scan_id", "left").join(n(clean, "clean"), "scan_id", "left").join(s, "scan_id", "left")
    return j.withColumn("retained", F.col("voxels") / F.col("points")).withColumn("outliers", F.greatest(F.col("voxels") - F.col("clean"), F.lit(0)))


def process_scan(points: DataFrame, config: ScanConfig = ScanConfig()) -> tuple[DataFrame, DataFrame]:
    """Downsample, drop outliers, fit the ground, split: (points with is_ground, planes)."""
    small = voxel_downsample(points, config.voxel).select("scan_id", "idx", *XYZ, "r", "g", "b")
    clean = shared_table(reindexed(remove_outliers(small, config.neighbours, config.sigma)), "clean")
    planes = shared_table(ground_planes(clean, config.iterations, config.threshold), "ground")
    return split_ground(clean, planes, config.threshold), planes


def reindexed(points: DataFrame) -> DataFrame:
    """idx as the place of a point in its scan, in order of the old one.

    Places are counted per range of old ids and added up over ranges, so no task holds a whole scan.
    """
    p = points.withColumn("__r", F.expr("idx div 65536"))
    w = Window.partitionBy("scan_id").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    base = p.groupBy("scan_id", "__r").agg(F.count("*").alias("__n")).withColumn("__b", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("scan_id", "__r").orderBy("idx")) - 1
    return p.withColumn("__i", inside).join(base, ["scan_id", "__r"]).withColumn("idx", F.col("__i") + F.col("__b")).select(*points.columns)


def covariance_features(points: DataFrame, k: int) -> DataFrame:
    """Eigenvalues l1 >= l2 >= l3 of the covariance (over n) of each point's k nearest, itself included, with shape descriptors and normal.

    Eigenvalues are closed-form columns; the normal is the eigenvector of the least one,
    turned to z >= 0. Fewer than 3 neighbours or l1 < 1e-10 give zeros and (0, 0, 1).
    """
    if k < 3:
        raise ValueError("k must be at least 3")
    pairs = ("xx", "yy", "zz", "xy", "xz", "yz")

    def moments(xyz, starts, j, d2):
        n = np.diff(np.append(starts, len(j)))
        own = xyz[j]
        own = own - np.repeat(np.add.reduceat(own, starts, axis=0) / n[:, None], n, axis=0)
        return {"n": n, **{p: np.add.reduceat(own[:, "xyz".index(p[0])] * own[:, "xyz".index(p[1])], starts) / n for p in pairs}}

    ddl = "n long, " + ", ".join(f"{p} double" for p in pairs)
    cov = knn_join(points, k, XYZ, "idx", by=["scan_id"], fold=(moments, ddl)).withColumnRenamed("key", "idx")
    return with_eigen(cov)


def with_eigen(cov: DataFrame) -> DataFrame:
    """Rows with xx yy zz xy xz yz (and n) -> with l1 l2 l3, descriptors and normal nx ny nz."""
    off = F.expr("xy * xy + xz * xz + yz * yz")
    c = cov.withColumn("q", F.expr("(xx + yy + zz) / 3"))
    c = c.withColumn("p", F.sqrt((F.expr("(xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q)") + 2 * off) / 6))
    det = F.expr("(xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)")
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * F.col("p") * F.col("p") * F.col("p"))))
    c = c.withColumn("phi", F.when(F.col("p") > 1e-300, F.acos(r) / 3))
    c = c.withColumn("l1", F.when(F.col("phi").isNull(), F.col("q")).otherwise(F.col("q") + 2 * F.col("p") * F.cos("phi")))
    c = c.withColumn("l3", F.when(F.col("phi").isNull(), F.col("q")).otherwise(F.col("q") + 2 * F.col("p") * F.cos(F.col("phi") + 2.0943951023931953)))
    c = c.withColumn("l2", F.expr("3 * q - l1 - l3"))
    for name in ("l1", "l2", "l3"):
        c = c.withColumn(name, F.greatest(F.col(name), F.lit(0.0)))
    flat = (F.col("n") < 3) | (F.col("l1") < 1e-10)
    when = lambda e: F.when(flat, 0.0).otherwise(F.expr(e))
    c = c.withColumn("planarity", when("(l2 - l3) / l1")).withColumn("linearity", when("(l1 - l2) / l1")).withColumn("sphericity", when("l3 / l1"))
    c = c.withColumn("omnivariance", when("cbrt(l1 * l2 * l3)")).withColumn("curvature", when("l3 / (l1 + l2 + l3)"))
    # two rows of (A - l3 I) span the plane of the other eigenvectors; the longest cross product of two is the safest
    rows = [("xx - l3", "xy", "xz"), ("xy", "yy - l3", "yz"), ("xz", "yz", "zz - l3")]
    crosses = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        (a, b, d), (e, f, g) = ([f"({v})" for v in rows[t]] for t in (i, j))
        v = F.array(F.expr(f"{b}*{g} - {d}*{f}"), F.expr(f"{d}*{e} - {a}*{g}"), F.expr(f"{a}*{f} - {b}*{e}"))
        crosses.append(F.struct(F.aggregate(v, F.lit(0.0), lambda s, t: s + t * t).alias("len2"), v.alias("v")))
    c = c.withColumn("best", F.greatest(*crosses))
    sign = F.when(F.col("best.v")[2] < 0, -1.0).otherwise(1.0)
    bad = flat | (F.col("best.len2") < 1e-300)
    for i, name in enumerate(("nx", "ny", "nz")):
        c = c.withColumn(name, F.when(bad, 1.0 if i == 2 else 0.0).otherwise(F.col("best.v")[i] * sign / F.sqrt("best.len2")))
    return c.drop("q", "p", "phi", "best")

"""Terrain and scene meshes: triangulation, decimation, normals, extrusion."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesmith.operators.graph import shared_table, small

NO_COLOUR = (0, 128, 0)


def delaunay(xy: np.ndarray) -> np.ndarray:
    """Triangles (i, j, k, counter-clockwise) of different places, by sweeping in x and closing circles left behind."""
    n = len(xy)
    if n < 3:
        raise ValueError("a triangulation needs three points")
    order = np.lexsort((xy[:, 1], xy[:, 0]))
    mid, span = (xy.min(axis=0) + xy.max(axis=0)) / 2, max(float(np.ptp(xy, axis=0).max()), 1e-9)
    p = np.vstack([xy, mid + [-30 * span, -10 * span], mid + [0, 30 * span], mid + [30 * span, -10 * span]]).tolist()

    def circle(i, j, k):
        (ax, ay), (bx, by), (cx, cy) = p[i], p[j], p[k]
        bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
        d = 2 * (bx * cy - by * cx)
        if abs(d) < 1e-18:
            return None
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return (i, j, k, ax + ux, ay + uy, ux * ux + uy * uy)

    live, closed, last = [circle(n, n + 1, n + 2)], [], None
    for i in order.tolist():
        x, y = p[i]
        if last is not None and p[last] == [x, y]:
            continue
        last, edges, keep = i, {}, []
        for t in live:
            dx = x - t[3]
            if dx > 0 and dx * dx > t[5]:
                closed.append(t)
            elif dx * dx + (y - t[4]) ** 2 - t[5] > 1e-12 * max(1.0, t[5]):
                keep.append(t)
            else:
                for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                    e = (min(e), max(e))
                    edges[e] = edges.get(e, 0) + 1
        live = keep + [c for (a, b), times in edges.items() if times == 1 and (c := circle(a, b, i))]
    tri = np.array([t[:3] for t in closed + live if max(t[:3]) < n], np.int64).reshape(-1, 3)
    a, b, c = (xy[tri[:, i]] for i in range(3))
    cross = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    tri[cross < 0] = tri[cross < 0][:, [0, 2, 1]]
    tri = tri[np.abs(cross) > 0]
    return np.vstack([tri, rim(xy, tri)])


def rim(xy: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Triangles that fill the dents of a triangulation's edge up to the convex hull: flat ones there have circles too large for the triangle swept from."""
    ends = {(a, b) for t in tri.tolist() for a, b in zip(t, t[1:] + t[:1])}
    after = {a: b for a, b in ends if (b, a) not in ends}
    if not after:
        return np.empty((0, 3), np.int64)
    turn = lambda a, b, c: (xy[b, 0] - xy[a, 0]) * (xy[c, 1] - xy[a, 1]) - (xy[b, 1] - xy[a, 1]) * (xy[c, 0] - xy[a, 0])
    first = min(after, key=lambda i: (xy[i, 0], xy[i, 1]))
    way, out, at = [first], [], after[first]
    # an extreme point starts and ends the walk, so the dents lie between
    while True:
        while len(way) > 1 and turn(way[-2], way[-1], at) < 0:
            out.append((way[-2], at, way[-1]))
            way.pop()
        if at == first:
            return np.array(out, np.int64).reshape(-1, 3)
        way.append(at)
        at = after[at]


def triangulate(points: DataFrame) -> DataFrame:
    """Terrain points -> scan_id, tri, i0, i1, i2 (idx of corners); scans without a triangle are left out. A scan is one task's work."""
    kind = dict(points.dtypes)["scan_id"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        idx = g["idx"].to_numpy()
        try:
            t = idx[delaunay(g[["x", "y"]].to_numpy(float))]
        except ValueError:
            t = np.empty((0, 3), np.int64)
        return pd.DataFrame({"scan_id": [g["scan_id"].iloc[0]] * len(t), "tri": range(len(t)), "i0": t[:, 0], "i1": t[:, 1], "i2": t[:, 2]})

    return points.groupBy("scan_id").applyInPandas(run, f"scan_id {kind}, tri long, i0 long, i1 long, i2 long")


#: Cell sizes of the pyramid: each this much larger than the one before.
GROWTH, LEVELS = 1.25, 40


def corners(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """triangles with the places p0, p1, p2 of their corners; those without one of them are left out."""
    t = triangles
    for i in range(3):
        t = t.join(vertices.select("scan_id", F.col("idx").alias(f"i{i}"), F.struct("x", "y", "z").alias(f"p{i}")), ["scan_id", f"i{i}"])
    return t


def levels(vertices: DataFrame, triangles: DataFrame, target: int) -> DataFrame:
    """Scans of more than `target` triangles -> scan_id, level, cell: the finest of LEVELS cell sizes that leaves `target` triangles or fewer.

    One pass over the triangles counts all sizes of the pyramid together, in numpy, and a task gives a row for each scan and size: a triangle
    survives those that put its corners in three cells. Where none does, level is LEVELS and cell null: all in one.
    """
    n = triangles.groupBy("scan_id").agg(F.count("*").alias("tris")).where(F.col("tris") > target)
    box = vertices.groupBy("scan_id").agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    base = small(shared_table(box.join(n, "scan_id").select("scan_id", F.sqrt(2 * F.greatest("area", F.lit(1e-12)) / target).alias("base")), "mesh-sizes"))
    kind, names = dict(triangles.dtypes)["scan_id"], [f"{d}{i}" for i in range(3) for d in "xyz"]

    def count(batches):
        seen: dict = {}
        for b in batches:
            kept = b.schema.field("scan_id").type
            scans, of = np.unique(b.column("scan_id").to_numpy(zero_copy_only=False), return_inverse=True)
            base, at = b.column("base").to_numpy(), np.array([b.column(n).to_numpy(zero_copy_only=False) for n in names])
            n = np.array([np.bincount(of[survive(at, base * GROWTH**k)], minlength=len(scans)) for k in range(LEVELS)]).T
            for scan, own in zip(scans.tolist(), n):
                seen[scan] = seen.get(scan, 0) + own
            if len(seen) > 10_000:
                yield counted(seen, kept)
                seen = {}
        if seen:
            yield counted(seen, kept)

    def counted(seen, kept):
        return pa.RecordBatch.from_arrays([pa.array([s for s in seen for _ in range(LEVELS)], kept), pa.array(list(range(LEVELS)) * len(seen), pa.int32()), pa.array(np.concatenate(list(seen.values())).astype(np.int64))], names=["scan_id", "level", "n"])

    places = [F.nanvl(F.col(f"p{i}")[d].cast("double"), F.lit(0.0)).alias(f"{d}{i}") for i in range(3) for d in "xyz"]
    left = corners(vertices, triangles).join(base, "scan_id").select("scan_id", "base", *places).mapInArrow(count, f"scan_id {kind}, level int, n long")
    many = left.groupBy("scan_id", "level").agg(F.sum("n").alias("n")).where(F.col("n") > target).groupBy("scan_id").agg(F.collect_set("level").alias("many"))
    every = F.sequence(F.lit(0), F.lit(LEVELS))
    found = base.join(many, "scan_id", "left").withColumn("level", F.array_min(F.array_except(every, F.coalesce("many", F.array().cast("array<int>")))))
    steps = F.array(*[F.lit(GROWTH**k) for k in range(LEVELS)])
    return found.select("scan_id", "level", (F.col("base") * F.get(steps, F.col("level"))).alias("cell"))


def survive(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which triangles, places of whose corners are the rows x0, y0, z0, x1, ... (missing ones NaN), have them in three cells of the sizes given."""
    with np.errstate(invalid="ignore"):
        c = np.floor(at / size).reshape(3, 3, -1)
        apart = lambda i, j: ((c[i] < c[j]) | (c[i] > c[j])).any(axis=0)
        return apart(0, 1) & apart(1, 2) & apart(0, 2)


def decimate(vertices: DataFrame, triangles: DataFrame, target: int = 50_000, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertex clustering to at most `target` triangles a scan: vertices of a cell become their mean, triangles that collapse go.

    Meshes at or below the target pass unchanged; others take the finest cells of `levels` (or those given in `found`). Of triangles that fall together the
    first stays. The number of jobs does not depend on the scans.
    """
    found = small(shared_table(levels(vertices, triangles, target), "cells") if found is None else found)
    v = vertices.join(found, "scan_id", "left")
    at = lambda d: F.when(F.col("level") < LEVELS, F.floor(F.col(d) / F.col("cell"))).otherwise(F.lit(0)).cast("long")
    whole = F.col("level").isNull()
    v = v.withColumn("k", F.struct(F.when(whole, F.col("idx")).otherwise(at("x")).alias("x"), F.when(whole, 0).otherwise(at("y")).alias("y"), F.when(whole, 0).otherwise(at("z")).alias("z")))
    new = v.groupBy("scan_id", "k").agg(F.min("idx").alias("new"), *[F.avg(d).alias(d) for d in "xyz"], *[F.floor(F.avg(c)).cast("int").alias(c) for c in "rgb"])
    to = shared_table(v.select("scan_id", "idx", "k").join(new.select("scan_id", "k", "new"), ["scan_id", "k"]).select("scan_id", "idx", "new"), "cell-of")
    t = triangles
    for c in ("i0", "i1", "i2"):
        t = t.join(to.select("scan_id", F.col("idx").alias(c), F.col("new").alias(c + "n")), ["scan_id", c]).drop(c).withColumnRenamed(c + "n", c)
    t = t.where("i0 <> i1 and i1 <> i2 and i0 <> i2").withColumn("s", F.array_sort(F.array("i0", "i1", "i2")))
    t = t.groupBy("scan_id", "s").agg(F.min(F.struct("tri", "i0", "i1", "i2")).alias("t")).select("scan_id", "t.*")
    return new.select("scan_id", F.col("new").alias("idx"), "x", "y", "z", "r", "g", "b"), t


def vertex_normals(vertices: DataFrame, triangles: DataFrame, up: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """Area-weighted normals: triangles' cross products added up per vertex and scaled to one; `up` where they cancel or there are none."""
    t = corners(vertices, triangles)
    e = lambda a, d: f"(p{a}.{d} - p0.{d})"
    cross = [F.expr(f"{e(1, a)} * {e(2, b)} - {e(1, b)} * {e(2, a)}").alias(n) for n, a, b in (("cx", "y", "z"), ("cy", "z", "x"), ("cz", "x", "y"))]
    per = t.select("scan_id", F.explode(F.array("i0", "i1", "i2")).alias("idx"), *cross).groupBy("scan_id", "idx").agg(*[F.sum(c).alias(c) for c in ("cx", "cy", "cz")])
    j = vertices.select("scan_id", "idx").join(per, ["scan_id", "idx"], "left").withColumn("len", F.sqrt(F.expr("cx * cx + cy * cy + cz * cz")))
    return j.select("scan_id", "idx", *[F.when(F.col("len") > 1e-12, F.col(c) / F.col("len")).otherwise(u).alias(n) for c, n, u in zip(("cx", "cy", "cz"), ("nx", "ny", "nz"), up)])


def ear_clip(ring: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Triangles of a simple ring (open), counter-clockwise."""
    n = len(ring)
    area = sum(ring[i][0] * ring[(i + 1) % n][1] - ring[(i + 1) % n][0] * ring[i][1] for i in range(n))
    left = list(range(n)) if area > 0 else list(range(n))[::-1]
    turn = lambda a, b, c: (ring[b][0] - ring[a][0]) * (ring[c][1] - ring[a][1]) - (ring[b][1] - ring[a][1]) * (ring[c][0] - ring[a][0])
    out = []
    while len(left) > 3:
        for i in range(len(left)):
            a, b, c = left[i - 1], left[i], left[(i + 1) % len(left)]
            if turn(a, b, c) <= 0:
                continue
            if any(turn(a, b, p) >= 0 and turn(b, c, p) >= 0 and turn(c, a, p) >= 0 for p in left if p not in (a, b, c)):
                continue
            out.append((a, b, c))
            del left[i]
            break
        else:
            return out  # not simple
    return [*out, tuple(left)] if len(left) == 3 and turn(*left) > 0 else out


#: Constant depth of fills, in inches.
FILL_INCHES = 4.0


def solid(ring: list[tuple[float, float]], kind: str, height_inches: float) -> tuple[list[tuple[float, float, float]], list[tuple[int, int, int]]]:
    """Positions (x, y, z up in feet) and triangles of an extruded zone: top, reversed bottom and two triangles a side.

    Fills reach from 4 inches below the ground to it, others from it to their height; holes are
    not cut. Rings of fewer than four closed points, or without a face, give an empty mesh.
    """
    closed = ring if ring and ring[0] == ring[-1] else [*ring, *ring[:1]]
    if len(closed) < 4:
        return [], []
    base = [(float(x), float(y)) for x, y in closed[:-1]]
    faces = ear_clip(base)
    if not faces:
        return [], []
    z0, z1 = (-FILL_INCHES / 12, 0.0) if kind == "fills" else (0.0, height_inches / 12)
    n = len(base)
    pos = [(x, y, z1) for x, y in base] + [(x, y, z0) for x, y in base]
    tris = [*faces, *[(c + n, b + n, a + n) for a, b, c in faces]]
    for i in range(n):
        j = (i + 1) % n
        tris += [(i + n, j + n, j), (i + n, j, i)]
    return pos, tris


def extrude(ring: list[tuple[float, float]], kind: str, height_inches: float) -> tuple[np.ndarray, np.ndarray]:
    """`solid` as arrays."""
    pos, tris = solid(ring, kind, height_inches)
    return np.array(pos, float).reshape(-1, 3), np.array(tris, np.int64).reshape(-1, 3)


def normals(pos: np.ndarray, tris: np.ndarray, up=(0.0, 1.0, 0.0)) -> np.ndarray:
    out = np.zeros_like(pos)
    if len(tris):
        c = np.cross(pos[tris[:, 1]] - pos[tris[:, 0]], pos[tris[:, 2]] - pos[tris[:, 0]])
        for i in range(3):
            np.add.at(out, tris[:, i], c)
    size = np.linalg.norm(out, axis=1)
    out[size > 1e-12] /= size[size > 1e-12, None]
    out[size <= 1e-12] = up
    return out


def _quad_triangles(faces: list[tuple[int, int, int]]) -> np.ndarray:
    return np.array([*faces, *[(c + 4, b + 4, a + 4) for a, b, c in faces], *[t for i in range(4) for j in [(i + 1) % 4] for t in ((i + 4, j + 4, j), (i + 4, j, i))]], np.int64)


#: Triangles of an extruded convex quadrangle, as `extrude` gives them: counter-clockwise rings and clockwise ones.
QUADS = _quad_triangles([(3, 0, 1), (1, 2, 3)]), _quad_triangles([(0, 3, 2), (2, 1, 0)])


def extruded_quads(rings: pa.ListArray, kinds: list, heights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a column of rings the convex quadrangles, all worked on together: (places in the column, positions, triangles) by direction; others are for `extrude`."""
    x, y = (f.to_numpy(zero_copy_only=False).astype(float) for f in rings.values.flatten())
    starts, n = rings.offsets.to_numpy()[:-1].astype(np.int64), np.diff(rings.offsets.to_numpy())
    n = np.where(rings.is_null().to_numpy(zero_copy_only=False), 0, n)
    at = np.flatnonzero((n == 4) | (n == 5))
    first, last = starts[at], starts[at] + n[at] - 1
    same = (x[first] == x[last]) & (y[first] == y[last])
    at = at[same == (n[at] == 5)]
    corner = starts[at][:, None] + np.arange(4)
    px, py = x[corner], y[corner]
    (bx, cx), (by, cy) = ((np.roll(p, -1, 1), np.roll(p, -2, 1)) for p in (px, py))
    turn = (bx - px) * (cy - py) - (by - py) * (cx - px)
    fill = np.array([k == "fills" for k in kinds], bool)
    z0, z1 = np.where(fill, -FILL_INCHES / 12, 0.0), np.where(fill, 0.0, heights / 12)
    out = []
    for hit, tris in zip(((turn > 0).all(1), (turn < 0).all(1)), QUADS):
        rows = at[hit]
        pos = np.empty((len(rows), 8, 3))
        pos[:, :, 0], pos[:, :, 1] = np.tile(px[hit], 2), np.tile(py[hit], 2)
        pos[:, :4, 2], pos[:, 4:, 2] = z1[rows, None], z0[rows, None]
        out.append((rows, pos, tris))
    return out


def normals_of_many(pos: np.ndarray, tris: np.ndarray, up=(0.0, 1.0, 0.0)) -> np.ndarray:
    """`normals` of many meshes of the same triangles: pos is meshes x vertices x 3."""
    out = np.zeros_like(pos)
    c = np.cross(pos[:, tris[:, 1]] - pos[:, tris[:, 0]], pos[:, tris[:, 2]] - pos[:, tris[:, 0]])
    for i in range(3):
        for t, v in enumerate(tris[:, i].tolist()):
            out[:, v] += c[:, t]
    size = np.linalg.norm(out, axis=2)
    out[size > 1e-12] /= size[size > 1e-12, None]
    out[size <= 1e-12] = up
    return out


def scene_metadata(zones: DataFrame) -> DataFrame:
    """(project_id, tier, ring) -> meshes, vertices and triangles of each tier's scene, in closed form for simple rings: 2(n - 2) + 2n triangles."""
    n = F.size("ring") - 1
    ok = n >= 3
    return zones.groupBy("project_id", "tier").agg(
        F.sum(ok.cast("long")).alias("zone_count"), F.coalesce(F.sum(F.when(ok, 2 * n)), F.lit(0)).cast("long").alias("vertices"), F.coalesce(F.sum(F.when(ok, 4 * n - 4)), F.lit(0)).cast("long").alias("triangles")
    )


def scene_zones(assignments: DataFrame, zones: DataFrame, materials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assignments joined with their zone and material -> (project_id, tier, zone_id, ring, category, depth_inches) and the misses.

    An assignment of an unknown zone is skipped; one of a known zone without its material is a
    missing_material row, and no scene is made of its tier.
    """
    j = assignments.join(zones.select("project_id", "zone_id", "ring"), ["project_id", "zone_id"]).join(materials.select("material_id", "category", "depth_inches", F.lit(True).alias("__m")), "material_id", "left")
    missing = j.where("__m is null").select("project_id", "tier", "zone_id", "material_id")
    # a null project or tier is no other's
    lost = F.bool_or(F.col("__m").isNull()).over(Window.partitionBy("project_id", "tier")) & F.col("project_id").isNotNull() & F.col("tier").isNotNull()
    made = j.withColumn("__lost", lost).where("__m and not __lost")
    return made.select("project_id", "tier", "zone_id", "ring", "category", "depth_inches"), missing


def simplify(points: list[tuple[float, float]], eps: float) -> list[tuple[float, float]]:
    """Ramer-Douglas-Peucker, without recursion; a closed ring keeps its end points."""
    if len(points) < 3:
        return list(points)
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = points[a], points[b]
        size, far, at = math.hypot(bx - ax, by - ay), eps, None
        for i in range(a + 1, b):
            x, y = points[i]
            if size:
                t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / (size * size)))
                d = math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))
            else:
                d = math.hypot(x - ax, y - ay)
            if d > far:
                far, at = d, i
        if at is not None:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]


INSIDE = {"union": lambda x, y: x or y, "difference": lambda x, y: x and not y, "intersection": lambda x, y: x and y}


def boolean(a: list[list[tuple[float, float]]], b: list[list[tuple[float, float]]], op: str) -> list[list[tuple[float, float]]]:
    """union, difference or intersection of two sets of rings (even-odd) as trapezoids that do not overlap."""
    return booleans(a, b, [op])[0]


def booleans(a: list[list[tuple[float, float]]], b: list[list[tuple[float, float]]], ops: list[str]) -> list[list[list[tuple[float, float]]]]:
    """Several of `boolean` by one sweep.

    The plane is cut at every vertex and crossing; between two cuts edges do not meet, so the
    results are read off from left to right.
    """
    edges = [(r[i], r[(i + 1) % len(r)], s) for s, rings in ((0, a), (1, b)) for r in rings for i in range(len(r))]
    edges = [(p, q, s) if p[1] < q[1] else (q, p, s) for p, q, s in edges if p[1] != q[1]]
    ys = {p[1] for e in edges for p in e[:2]}
    for i, (p, q, s) in enumerate(edges):
        for u, v, t in edges[:i]:
            d = (q[0] - p[0]) * (v[1] - u[1]) - (q[1] - p[1]) * (v[0] - u[0])
            if d:
                k = ((u[0] - p[0]) * (v[1] - u[1]) - (u[1] - p[1]) * (v[0] - u[0])) / d
                y = p[1] + k * (q[1] - p[1])
                if 0 <= k <= 1 and u[1] <= y <= v[1]:
                    ys.add(y)
    at = lambda e, y: e[0][0] + (e[1][0] - e[0][0]) * (y - e[0][1]) / (e[1][1] - e[0][1])
    cuts, out = sorted(ys), [[] for _ in ops]
    for y0, y1 in zip(cuts, cuts[1:]):
        here = sorted(((at(e, (y0 + y1) / 2), e) for e in edges if e[0][1] <= y0 and e[1][1] >= y1), key=lambda x: x[0])
        for want, rings in zip([INSIDE[op] for op in ops], out):
            inside, start = [False, False], None
            for _, e in here:
                before = want(*inside)
                inside[e[2]] = not inside[e[2]]
                now = want(*inside)
                if now and not before:
                    start = e
                elif before and not now and start is not None:
                    ring = [(at(start, y0), y0), (at(e, y0), y0), (at(e, y1), y1), (at(start, y1), y1)]
                    if abs(ring_area(ring)) > 0:
                        rings.append(ring)
    return out


def ring_area(ring: list[tuple[float, float]]) -> float:
    return abs(sum(ring[i - 1][0] * ring[i][1] - ring[i][0] * ring[i - 1][1] for i in range(len(ring)))) / 2

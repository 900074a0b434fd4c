"""Hierarchies, scan pipelines, store writes and hull completion against versions written out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitesmith.operators import hdbscan, mesh, points, reconcile, store


def slow_clusters(x: np.ndarray, least: int, samples: int) -> set[frozenset]:
    """HDBSCAN by its definition: split each cluster at its longest needed distance, weigh what stays together, take the most stable."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(samples, len(x) - 1)]
    m = np.maximum(np.maximum(d, core[:, None]), core[None])

    def parts(s, below):
        left, out = set(s), []
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                i = todo.pop()
                seen.add(i)
                near = {j for j in left if m[i, j] < below}
                left -= near
                todo += near
            out.append(seen)
        return out

    def height(s):
        s = sorted(s)
        inside, worst = {s[0]}, 0.0
        while len(inside) < len(s):
            v, j = min((m[i, j], j) for i in inside for j in s if j not in inside)
            worst = max(worst, v)
            inside.add(j)
        return worst

    def grow(s, birth):
        """(points, stability, chosen sets below) of the cluster that begins as s."""
        whole, weight = set(s), 0.0
        while True:
            h = height(s)
            rate = 1 / max(h, 1e-12)
            big = [p for p in parts(s, h) if len(p) >= least]
            if len(big) == 1:
                weight += (rate - birth) * (len(s) - len(big[0]))
                s = big[0]
                continue
            weight += (rate - birth) * len(s)
            below = [grow(p, rate) for p in big]
            inner = sum(w for _, w, _ in below)
            if below and inner > weight:
                return whole, inner, [c for *_, cs in below for c in cs]
            return whole, weight, [frozenset(whole)]

    if len(x) < max(2, least):
        return set()
    s, birth = set(range(len(x))), 0.0
    while True:  # the root itself is never a cluster
        h = height(s)
        big = [p for p in parts(s, h) if len(p) >= least]
        if len(big) != 1:
            return {c for p in big for c in grow(p, 1 / h)[2]}
        s = big[0]


@pytest.mark.parametrize("seed", range(6))
def test_hdbscan_by_definition(seed):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(c, s, (n, 3)) for c, s, n in (((0, 0, 0), 0.1, 15), ((1, 1, 0), 0.2, 18), ((1.5, 1, 0.2), 0.1, 9), ((0, 2, 0), 0.4, 12))])
    got = hdbscan.labels(x, 5, 3)
    assert {frozenset(np.flatnonzero(got == c).tolist()) for c in set(got.tolist()) - {-1}} == slow_clusters(x, 5, 3)


def scan(spark):
    i = np.arange(625)
    ground = np.column_stack([i % 25 * 0.4, i // 25 * 0.4, np.where(i % 2, 0.002, -0.002)])
    j = np.arange(60)
    box = np.column_stack([2 + j % 10 * 0.1, 2 + j // 10 * 0.1, np.full(60, 0.5)])
    far = np.array([[20 + k, 20 + k, 20 + k] for k in range(5)], float)
    rows = [(0, n, *map(float, p), 10, 200, 10) for n, p in enumerate(np.vstack([ground, box, far]))]
    return spark.createDataFrame(rows, "scan_id int, idx long, x double, y double, z double, r int, g int, b int")


def test_process_scan(spark):
    split, planes = points.process_scan(scan(spark), points.ScanConfig(voxel=0.02, neighbours=8, sigma=2.0, iterations=200, threshold=0.02))
    p = planes.first()
    assert abs(p["nz"]) >= 0.99 and split.where("z > 10").count() == 0
    assert split.where("is_ground").count() == 625 and split.where("not is_ground and z between 0.49 and 0.51").count() == 60


def test_run_pipeline(spark):
    split, planes = points.process_scan(scan(spark), points.ScanConfig(voxel=0.02, neighbours=8, sigma=2.0, iterations=200, threshold=0.02))
    rest = split.where("not is_ground").select("scan_id", "idx", "x", "y", "z", "r", "g", "b")
    got = reconcile.run_pipeline(rest, planes, reconcile.EigenExtractor(5), reconcile.DensityClusterer(0.3, 4)).collect()
    assert len(got) == 1 and got[0]["point_count" if "point_count" in got[0].asDict() else "n"] == 60
    with pytest.raises(RuntimeError):
        reconcile.run_pipeline(rest, planes, reconcile.EigenExtractor(5), reconcile.DensityClusterer(0.3, 4), reconcile.FailingClassifier())


def test_inliers_in_groups(spark, monkeypatch):
    """Hypotheses that are too many to be sent give the same planes from groups of bounded size."""
    c = scan(spark)
    want = points.ground_planes(c, 50, 0.02).collect()
    monkeypatch.setattr(points, "SENT_PLANES", 0)
    monkeypatch.setattr(points, "GROUP_POINTS", 100)
    assert points.ground_planes(c, 50, 0.02).collect() == want and want


def test_groups_are_replaced_at_once(spark, tmp_path):
    """A reader keeps what it has opened; a group can end up empty; rows of other groups do not slip in; who comes second fails."""
    t = store.Groups(spark, f"file://{tmp_path}/zones", ["project_id"])
    make = lambda rows: spark.createDataFrame(rows, "project_id long, zone string")
    rows = lambda df: sorted((r["project_id"], r["zone"]) for r in df.collect())
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.replace(make([(1, "a"), (1, "b"), (2, "c")])) == 0
    before = t.read()
    t.replace(make([(2, "d"), (3, "e")]))
    middle = t.read()
    t.replace(make([(2, "x"), (4, "stray")]), make([(1, ""), (2, "")]))
    assert rows(before) == [(1, "a"), (1, "b"), (2, "c")] and rows(middle) == [(1, "a"), (1, "b"), (2, "d"), (3, "e")]
    assert rows(t.read()) == [(2, "x"), (3, "e")]
    t.replace(make([]), make([(2, "")]))
    assert rows(t.read()) == [(3, "e")]
    late = store.Groups(spark, f"file://{tmp_path}/zones", ["project_id"])
    late.version = lambda: 0
    with pytest.raises(store.Conflict):
        late.replace(make([(9, "late")]))
    assert rows(t.read()) == [(3, "e")] and t.vacuum() == 4 and rows(t.read()) == [(3, "e")]


def test_knn_fold_is_the_sum_of_neighbours(spark):
    rng = np.random.default_rng(4)
    xyz = rng.random((700, 3))
    c = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(xyz)] + [(1, 0, 0.0, 0.0, 0.0)], "scan_id int, idx long, x double, y double, z double")
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    got = {r["idx"]: r["mean_d"] for r in points.knn_mean_distance(c, 6).where("scan_id = 0").collect()}
    assert [got[i] for i in range(700)] == pytest.approx(np.sort(d, axis=1)[:, 1:7].mean(axis=1).tolist())
    near = np.argsort(d, axis=1, kind="stable")[:, :9]
    e = {r["idx"]: r for r in points.covariance_features(c, 9).where("scan_id = 0").collect()}
    for i in range(0, 700, 35):
        v = np.linalg.eigvalsh(np.cov(xyz[near[i]].T, bias=True))
        assert [e[i]["l3"], e[i]["l2"], e[i]["l1"]] == pytest.approx(v.tolist(), abs=1e-9)


@pytest.mark.parametrize("seed", range(5))
def test_triangulation_covers_the_hull(seed):
    """Areas add up to the hull's, no triangle holds another point in its circle, also where edges of the hull are nearly flat."""
    rng = np.random.default_rng(seed)
    a = np.linspace(0, 3, 12)
    xy = np.vstack([rng.random((40, 2)) * [3, 1], np.column_stack([a, -1e-5 * np.sin(a) - 0.1]), [[0, 1.1], [3, 1.1]]])
    t = mesh.delaunay(xy)
    area = lambda q: 0.5 * abs(np.dot(q[:, 0], np.roll(q[:, 1], -1)) - np.dot(q[:, 1], np.roll(q[:, 0], -1)))
    pts = sorted(map(tuple, xy))

    def half(ps):
        out = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    assert sum(area(xy[list(x)]) for x in t) == pytest.approx(area(np.array(half(pts) + half(pts[::-1]))), rel=1e-9)


def test_first_come_is_the_scan_in_order(spark):
    """The border rule against the loop that visits points in order and only queues the unvisited."""
    rng = np.random.default_rng(7)
    xs = np.sort(rng.random(60))[rng.permutation(60)] * 3
    eps, least = 0.06, 4
    near = [set(np.flatnonzero(np.abs(xs - x) <= eps).tolist()) for x in xs]
    label, seen, number = [None] * 60, [False] * 60, 0
    for i in range(60):
        if seen[i]:
            continue
        seen[i] = True
        if len(near[i]) < least:
            continue
        queue = [j for j in near[i] if j != i]
        label[i] = number
        while queue:
            j = queue.pop(0)
            if not seen[j]:
                seen[j] = True
                if len(near[j]) >= least:
                    queue += [k for k in near[j] if not seen[k]]
            if label[j] is None:
                label[j] = number
        number += 1
    c = spark.createDataFrame([(0, i, float(x), 0.0, 0.0) for i, x in enumerate(xs)], "scan_id int, idx long, x double, y double, z double")
    got = {r["idx"]: r["cluster_id"] for r in points.first_come(c, eps, points.dbscan(c, eps, least)).collect()}
    assert [got[i] for i in range(60)] == label


def test_decimation_takes_the_finest_level(spark):
    """Each scan's own level against all levels tried one by one; a wall without area falls into one cell, a small mesh stays."""
    rng = np.random.default_rng(5)
    side, target = 20, 100
    i = np.arange(side * side)
    xyz = np.column_stack([i % side, i // side, np.zeros(side * side)]) + rng.random((side * side, 3)) * 0.4
    tri = [t for k in i if k % side < side - 1 and k // side < side - 1 for t in ((k, k + 1, k + side), (k + 1, k + side + 1, k + side))]
    scans = {0: xyz, 1: xyz * [3, 1, 5], 2: np.column_stack([xyz[:, 0] * 0, xyz[:, 1], xyz[:, 0]])}
    v = [(s, int(k), *map(float, p), 1, 2, 3) for s, ps in scans.items() for k, p in enumerate(ps)] + [(3, k, float(k % 2), float(k // 2), 0.0, 1, 2, 3) for k in range(4)]
    t = [(s, n, *map(int, c)) for s in scans for n, c in enumerate(tri)] + [(3, 0, 0, 1, 2), (3, 1, 1, 3, 2)]
    less, left = mesh.decimate(spark.createDataFrame(v, "scan_id int, idx long, x double, y double, z double, r int, g int, b int"), spark.createDataFrame(t, "scan_id int, tri long, i0 long, i1 long, i2 long"), target)
    got = {r["scan_id"]: r["n"] for r in left.groupBy("scan_id").agg(F.count("*").alias("n")).collect()}
    kept = {r["scan_id"]: r["n"] for r in less.groupBy("scan_id").agg(F.count("*").alias("n")).collect()}
    for s, p in scans.items():
        base = np.sqrt(2 * max(np.ptp(p[:, 0]) * np.ptp(p[:, 1]), 1e-12) / target)
        for k in range(mesh.LEVELS + 1):
            cells = [tuple(c) for c in np.floor(p / (base * mesh.GROWTH**k)).tolist()] if k < mesh.LEVELS else [()] * len(p)
            stay = [sorted(cells[c] for c in x) for x in tri if len({cells[c] for c in x}) == 3]
            if len(stay) <= target:
                break
        assert got.get(s, 0) == len(set(map(str, stay))) <= target and kept[s] == len(set(cells))
    assert got[3] == 2 and kept[3] == 4 and 2 not in got and kept[2] == 1


def test_versions_side_by_side_without_broadcasts(spark, tmp_path):
    """Two versions in one plan, joined by shuffles: the scan of the one is not taken for that of the other."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = store.Groups(spark, f"file://{tmp_path}/zones", ["g"])
        t.replace(spark.range(6).select((F.col("id") % 3).alias("g"), "id"))
        old = t.read()
        t.replace(spark.createDataFrame([(1, 99)], "g long, id long"), spark.createDataFrame([(1,), (2,)], "g long"))
        both = old.withColumn("seen", F.lit("old")).unionByName(t.read().withColumn("seen", F.lit("new"))).groupBy("seen", "g").count()
        assert sorted(map(tuple, both.collect())) == [("new", 0, 2), ("new", 1, 1), ("old", 0, 2), ("old", 1, 2), ("old", 2, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_mesh_levels_make_no_row_a_level(spark):
    """A triangle is counted for all cell sizes as one row, and a missing place tells no cells apart."""
    import numpy as np

    from sitesmith.operators import mesh

    v = spark.createDataFrame([(1, i, float(i % 9), float(i // 9), 0.0) for i in range(81)], "scan_id int, idx long, x double, y double, z double")
    t = spark.createDataFrame([(1, i, i, i + 1, i + 9) for i in range(70)], "scan_id int, tri long, i0 long, i1 long, i2 long")
    found = mesh.levels(v, t, 20)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r)[:2] for r in found.collect()] and dict(found.dtypes)["scan_id"] == "int"
    at = np.array([[0.0, 0, 0], [0, 0, 0], [0, 0, 0], [1, 1, np.nan], [0, 0, 0], [0, 0, 0], [0, 0, 0], [1, 0, 1], [0, 0, 0]])
    assert mesh.survive(at, np.ones(3)).tolist() == [True, False, False]

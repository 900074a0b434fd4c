"""Known values of quotes, geometry, planting, sun, climate and scans."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitesmith.functions import climate, geo, money, solar, text
from sitesmith.operators import hdbscan, joins, mesh, points, quote, store


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def ring(*pts):
    return F.array(*[geo.point(float(x), float(y)) for x, y in [*pts, pts[0]]]) if pts else F.array().cast(geo.RING)


def tiers(spark, paver, mulch, edge):
    zones = spark.createDataFrame([("patio", 180.0, 54.0), ("bed", 160.0, 56.0), ("edge", 100.0, 40.0)], "zone_id string, area double, perimeter double").withColumn("label", F.col("zone_id"))
    mats = spark.createDataFrame([("p", "Paver", "sq_ft", paver, None), ("m", "Mulch", "cu_yd", mulch, 4.0), ("e", "Edging", "linear_ft", edge, None)], "material_id string, name string, unit string, price string, depth_inches double").withColumn("price", F.col("price").cast("decimal(12,4)"))
    a = spark.createDataFrame([(1, "good", "patio", "p"), (1, "good", "bed", "m"), (1, "good", "edge", "e")], "project_id int, tier string, zone_id string, material_id string")
    return a.withColumn("price_override", F.lit(None).cast("decimal(12,4)")).withColumn("depth_override", F.lit(None).cast("double")), zones, mats


@pytest.mark.parametrize("prices, total", [(("4.00", "30.00", "1.50"), "839.26"), (("8.50", "45.00", "3.25"), "1748.89"), (("15.00", "65.00", "8.00"), "3148.40")])
def test_quote_totals(spark, prices, total):
    assert str(quote.totals(quote.line_items(*tiers(spark, *prices))).first()["total"]) == total


def test_quote_violations_and_strict(spark):
    a, z, m = tiers(spark, "1", "1", "1")
    m = m.where("material_id <> 'p'").withColumn("depth_inches", F.lit(None).cast("double"))
    assert {r["violation"] for r in quote.violations(a, z, m).collect()} == {"missing_material", "missing_depth"}
    assert quote.clean_tiers(quote.line_items(a, z, m), quote.violations(a, z, m)).count() == 0
    with pytest.raises(Exception, match="quote: missing"):
        quote.line_items(a, z, m, strict=True).collect()
    # a dangling zone is skipped, whatever its material
    dangling = a.withColumn("zone_id", F.lit("none")).withColumn("material_id", F.lit("none"))
    assert quote.priced(dangling, z, m).count() == 0


def test_areas_and_perimeters(spark):
    sq, tri, ell = ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((0, 0), (4, 0), (0, 6)), ring((0, 0), (10, 0), (10, 5), (5, 5), (5, 10), (0, 10))
    assert [one(spark, geo.ring_area(r)) for r in (sq, tri, ell, ring())] == [100.0, 12.0, 75.0, 0.0]
    assert one(spark, geo.ring_perimeter(sq)) == 40.0 and one(spark, geo.ring_perimeter(ring((0, 0), (4, 0), (0, 3)))) == 12.0
    assert one(spark, geo.ring_perimeter(ring())) == 0.0
    assert one(spark, geo.contains(ell, F.lit(2.0), F.lit(7.0))) and not one(spark, geo.contains(ell, F.lit(7.0), F.lit(7.0)))
    assert one(spark, geo.from_geojson(F.lit('{"type":"Point","coordinates":[1,2]}'))) is None
    assert one(spark, geo.from_geojson(F.lit("no json"))) is None


def test_polygon_booleans():
    a, b, hole = [(0, 0), (10, 0), (10, 10), (0, 10)], [(5, 0), (15, 0), (15, 10), (5, 10)], [(3, 3), (7, 3), (7, 7), (3, 7)]
    size = lambda rings: sum(map(mesh.ring_area, rings))
    assert size(mesh.boolean([a], [b], "union")) == pytest.approx(150)
    assert size(mesh.boolean([a], [[(20, 0), (30, 0), (30, 10), (20, 10)]], "union")) == pytest.approx(200)
    assert size(mesh.boolean([a], [hole], "difference")) == pytest.approx(84)
    assert size(mesh.boolean([[(0, 0), (4, 0), (0, 4)]], [[(0, 0), (4, 4), (0, 4)]], "intersection")) == pytest.approx(4)


def test_planting(spark):
    assert [one(spark, money.plant_count(F.lit(a), F.lit(s))) for a, s in ((16.0, 6.0), (100.0, 12.0), (18.4, 8.0), (5.0, 0.0))] == [64, 100, 41, 0]
    assert one(spark, money.soil_volume_cuyd(F.lit(16.0), F.lit(8.0))) == pytest.approx(0.395, abs=1e-3)
    assert one(spark, money.format_dollars(F.lit(-1234567.5).cast("decimal(18,2)"))) == "-$1,234,567.50"
    assert one(spark, money.spacing_in_name(F.lit('Sedum (8" spacing)'))) == 8


@pytest.mark.parametrize("lat, lng, day, low, high", [(45.5, -122.7, "2024-06-20", 15, 16.5), (45.5, -122.7, "2024-12-21", 8, 9.5), (45.5, -122.7, "2024-03-20", 11.5, 12.75), (69.6, 19.0, "2024-06-20", 24, 24), (69.6, 19.0, "2024-12-21", 0, 0)])
def test_sun_hours(spark, lat, lng, day, low, high):
    df = spark.createDataFrame([(1, lat, lng, datetime.date.fromisoformat(day))], "id int, lat double, lng double, day date")
    r = solar.daily_sun(df, ["id"]).first()
    assert low <= r["sun_hours"] <= high and r["midnight_sun"] == (low == 24) and r["polar_night"] == (high == 0)


@pytest.mark.parametrize("lat, lng, zone", [(37.76, -122.45, 17), (37.80, -122.27, 16), (37.34, -121.89, 15), (37.68, -121.77, 14), (45.5, -122.7, None), (40.7, -74.0, None)])
def test_sunset(spark, lat, lng, zone):
    assert one(spark, climate.sunset_zone(F.lit(lat), F.lit(lng))) == zone


def test_climate_edges(spark):
    s = spark.createDataFrame([(1, 10.0, None, False), (2, 75.0, 300.0, True), (3, -65.0, -5.0, True)], "site_id int, lat double, elev double, coastal boolean")
    rows = {r["site_id"]: r for r in climate.with_frost_dates(s).collect()}
    assert rows[1]["spring"]["median"] == 15 and rows[1]["confidence"] == "low"
    assert rows[2]["spring"]["median"] == 170 + 4 - 5 and rows[3]["spring"]["median"] == 315
    assert {r["zone"] for r in climate.with_hardiness(s).collect()} <= set(range(1, 14))


def scan(spark, rows):
    return spark.createDataFrame([(0, i, *map(float, p), None, None, None) for i, p in enumerate(rows)], "scan_id int, idx long, x double, y double, z double, r int, g int, b int")


def test_scan_steps(spark):
    side = 20
    ground = [((i % side) * 0.4, (i // side) * 0.4, 0.002 * (-1) ** i) for i in range(side * side)]
    box = [(2 + (i % 5) * 0.1, 2 + (i // 5) * 0.1, 0.5) for i in range(25)]
    c = scan(spark, ground + box + [(50.0, 50.0, 20.0)])
    assert points.remove_outliers(c, 5, 2.0).where("x > 40").count() == 0
    clean = points.reindexed(points.remove_outliers(c, 5, 2.0))
    p = points.ground_planes(clean, 100, 0.02)
    row = p.first()
    assert row["nz"] > 0.99 and row["inliers"] >= 395
    s = points.split_ground(clean, p, 0.02)
    d = points.dbscan(s.where("not is_ground"), 0.3, 4)
    assert d.select("cluster_id").distinct().count() == 1 and d.count() == 25
    cand = points.candidates(s.join(d, ["scan_id", "idx"]), p).first()
    assert cand["point_count"] == 25 and cand["height_ft"] == pytest.approx(0.5 * 3.28084, rel=0.05)
    assert points.voxel_downsample(c, 0).count() == 0 and points.voxel_downsample(c.where("z > 0"), 1000.0).count() == 1


def test_knn_is_exact(spark):
    rng = np.random.default_rng(1)
    xyz = np.vstack([rng.normal(size=(80, 3)), rng.normal(size=(20, 3)) * 0.01 + 5])
    c = scan(spark, xyz.tolist())
    got = {(r["key"], r["rank"]): r["d2"] for r in joins.knn_join(c, 6, points.XYZ, "idx", by=["scan_id"]).collect()}
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
    d.sort(axis=1)
    for i in range(len(xyz)):
        assert [got[i, k + 1] for k in range(6)] == pytest.approx(d[i, :6].tolist())


def test_eigen_matches_numpy(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(30):
        m = rng.normal(size=(8, 3)) * [3, 1, 0.1]
        a = np.cov(m.T, bias=True)
        rows.append((i, 8, *map(float, (a[0, 0], a[1, 1], a[2, 2], a[0, 1], a[0, 2], a[1, 2]))))
    df = points.with_eigen(spark.createDataFrame(rows, "i int, n int, xx double, yy double, zz double, xy double, xz double, yz double"))
    for r in df.collect():
        a = np.array([[r["xx"], r["xy"], r["xz"]], [r["xy"], r["yy"], r["yz"]], [r["xz"], r["yz"], r["zz"]]])
        w, v = np.linalg.eigh(a)
        assert [r["l3"], r["l2"], r["l1"]] == pytest.approx(w.tolist(), abs=1e-9)
        assert abs(np.dot(v[:, 0], [r["nx"], r["ny"], r["nz"]])) == pytest.approx(1, abs=1e-6) and r["nz"] >= 0


def test_gap(spark):
    c = spark.createDataFrame([(0, 0, 0.0, 0.0, 2.0), (0, 1, 3.048, 0.0, 2.0)], "scan_id int, cluster_id int, cx double, cy double, spread_ft double")
    p = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 0.0)], "scan_id int, nx double, ny double, nz double, d double")
    g = points.gaps(c, p).first()
    assert [g[k] for k in ("distance_ft", "clear_width_ft", "clear_length_ft", "area_sqft")] == pytest.approx([10, 8, 2, 16], abs=1e-3) and g["mx"] == pytest.approx(1.524)


@pytest.mark.parametrize("h, s, colour, prof, want", [(25.1, 2.8, "brown", "columnar", "tree"), (0.5, 6.5, "gray", "flat", "hardscape"), (32.8, 1.3, "gray", "columnar", "utility"), (5.0, 3.0, "mixed", "spreading", "structure")])
def test_classify(spark, h, s, colour, prof, want):
    c = spark.createDataFrame([(h, s, colour, prof)], "height_ft double, spread_ft double, dominant_color string, vertical_profile string")
    assert points.classify(c).first()["category"] == want


def test_hdbscan_groups():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(40, 6)) * 0.05, rng.normal(size=(40, 6)) * 0.05 + 3, rng.uniform(-10, 10, size=(5, 6))])
    got = hdbscan.labels(x, 10, 5)
    assert len(set(got[:40])) == 1 and len(set(got[40:80])) == 1 and got[0] != got[40] and got[0] >= 0
    assert (hdbscan.labels(x[:5], 10, 5) == -1).all()


def test_delaunay_is_empty_circle():
    rng = np.random.default_rng(4)
    p = rng.uniform(size=(60, 2))
    t = mesh.delaunay(p)
    area = sum(mesh.ring_area([tuple(p[i]) for i in x]) for x in t)
    assert len(t) == len({tuple(sorted(x)) for x in t.tolist()}) and area <= 1
    for i, j, k in t:
        a, b, c = p[i], p[j], p[k]
        m = np.array([2 * (b - a), 2 * (c - a)])
        o = np.linalg.solve(m, [b @ b - a @ a, c @ c - a @ a])
        assert (((p - o) ** 2).sum(axis=1) >= ((a - o) ** 2).sum() - 1e-9).all()
    with pytest.raises(ValueError):
        mesh.delaunay(p[:2])


def test_extrusion_and_simplify():
    pos, tri = mesh.extrude([(0, 0), (10, 0), (10, 5), (5, 5), (5, 10), (0, 10)], "builds_up", 12)
    assert len(tri) == 2 * (6 - 2) + 2 * 6 and pos[:, 2].max() == 1
    assert len(mesh.extrude([(0, 0), (1, 1)], "fills", 4)[1]) == 0
    assert mesh.simplify([(0, 0), (1, 0.001), (2, 0)], 0.01) == [(0, 0), (2, 0)]


def test_store(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    ch = spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string")
    assert sorted(map(tuple, store.updated(a, ch, "id").collect())) == [(1, "x"), (2, "z")]
    assert [r["id"] for r in store.not_found(a, ch, "id").collect()] == [3]


def test_text(spark):
    assert one(spark, text.normalize_address(F.lit("  A  b\tC "))) == "a b c"
    assert one(spark, text.sanitize_filename(F.lit("Ab c/d_e-1"))) == "ab-c-d_e-1"
    assert one(spark, text.positive_limit(F.lit("x"), 7)) == 7 and one(spark, text.positive_limit(F.lit("12"), 7)) == 12


def test_terrain_artefacts_of_every_scan(spark):
    from conftest import SF

    from sitesmith.plans import artefacts, bind

    got = {r["scan_id"]: r for r in artefacts.terrain_artefacts(spark, SF).collect()}
    scans = {r["scan_id"] for r in bind.cloud(spark, SF).groupBy("scan_id").count().where("count >= 3").collect()}
    assert len(scans) > 3 and set(got) == scans
    assert all(r["magic"] == "glTF" and r["png"] == "504E47" and 0 < r["triangles"] <= 60 for r in got.values())

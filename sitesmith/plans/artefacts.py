"""Mesh, artefact, hierarchy and document queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesmith.functions import geo
from sitesmith.operators import hdbscan as hdb
from sitesmith.operators import mesh, points, tables
from sitesmith.operators.graph import shared_path, shared_table
from sitesmith.plans import bind
from sitesmith.plans.scanning import _EIGEN
from sitesmith.sources import artefacts, ply

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _feature_vectors(spark, d):
    c = bind.cloud(spark, d)
    return hdb.vectors(c, shared_table(points.covariance_features(c, 8), "eigen"))


@query()
def hdbscan(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of each label's points; a hierarchy has no SQL, tests hold it against one written out."""
    return hdb.hdbscan(_feature_vectors(spark, d), 8, 4)


@query(f"""WITH {bind.CLOUD}, {_EIGEN}, b AS (SELECT scan_id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM c GROUP BY scan_id)
SELECT scan_id, idx, round((x - lx) / greatest(hx - lx, 1e-10), 6) AS vx, round((y - ly) / greatest(hy - ly, 1e-10), 6) AS vy, round((z - lz) / greatest(hz - lz, 1e-10), 6) AS vz,
 round((l2 - l3) / l1, 4) AS planarity, round((l1 - l2) / l1, 4) AS linearity, round(l3 / l1, 4) AS sphericity FROM c JOIN b USING (scan_id) JOIN e USING (scan_id, idx) WHERE n >= 3 AND l1 >= 1e-10""")
def hdbscan_vectors(spark: SparkSession, d: str) -> DataFrame:
    c = bind.cloud(spark, d)
    e = shared_table(points.covariance_features(c, 8).where("n >= 3 and l1 >= 1e-10"), "eigen")
    return hdb.vectors(c, e).select("scan_id", "idx", *[F.round(F.col("v")[i], 6 if i < 3 else 4).alias(n) for i, n in enumerate(("vx", "vy", "vz", "planarity", "linearity", "sphericity"))])


#: A point is on the hull if all others lie within half a turn of it: a triangulation of n points, h of them there, has 2n - 2 - h triangles.
_HULL = """an AS (SELECT p.scan_id, p.idx, atan2(q.y - p.y, q.x - p.x) AS a FROM c p JOIN c q ON p.scan_id = q.scan_id AND p.idx <> q.idx),
gp AS (SELECT scan_id, idx, a, lead(a) OVER (PARTITION BY scan_id, idx ORDER BY a) AS b, min(a) OVER (PARTITION BY scan_id, idx) AS f FROM an),
hu AS (SELECT scan_id, idx, max(coalesce(b, f + 2 * pi()) - a) >= pi() - 1e-12 AS edge FROM gp GROUP BY ALL)"""


@query(f"WITH {bind.CLOUD}, {_HULL} SELECT scan_id, 2 * count(*) - 2 - count(*) FILTER (WHERE edge) AS triangles FROM hu GROUP BY scan_id HAVING count(*) >= 3")
def terrain_mesh(spark: SparkSession, d: str) -> DataFrame:
    """Triangles of each scan's terrain, as many as Euler's formula asks for."""
    t = mesh.triangulate(bind.cloud(spark, d))
    return t.groupBy("scan_id").agg(F.count("*").alias("triangles"))


TARGET = 500
_APART = lambda p, q: "(" + " OR ".join(f"floor({p}_{d} / (base * step)) <> floor({q}_{d} / (base * step))" for d in "xyz") + ")"
_STEPS = ", ".join(f"({k}, {mesh.GROWTH**k!r}::DOUBLE)" for k in range(mesh.LEVELS))
_CELL = ", ".join(f"floor({d} / cell)" for d in "xyz")


@query(f"""WITH {bind.GRID}, st(level, step) AS (VALUES {_STEPS}), sz AS (SELECT scan_id, sqrt(2 * greatest((max(x) - min(x)) * (max(y) - min(y)), 1e-12) / {TARGET}) AS base FROM gv WHERE scan_id IN (SELECT scan_id FROM gt GROUP BY scan_id HAVING count(*) > {TARGET}) GROUP BY scan_id),
lv AS (SELECT scan_id, level, base * step AS cell, count(*) FILTER (WHERE {_APART("a", "b")} AND {_APART("b", "c")} AND {_APART("a", "c")}) AS n FROM gt JOIN sz USING (scan_id), st GROUP BY scan_id, level, base * step),
ch AS (SELECT scan_id, min(level) AS level, min_by(cell, level) AS cell FROM lv WHERE n <= {TARGET} GROUP BY scan_id),
ce AS (SELECT gv.scan_id, gv.k AS id, level, CASE WHEN level IS NULL THEN [idx] ELSE [{_CELL}] END AS k FROM gv LEFT JOIN ch USING (scan_id)),
vn AS (SELECT scan_id, any_value(level) AS level, count(DISTINCT k) AS vertices FROM ce GROUP BY scan_id),
tn AS (SELECT gt.scan_id, count(DISTINCT list_sort([p.k, q.k, r.k])) AS triangles FROM gt JOIN ce p ON p.id = gt.scan_id * {bind.SIDE**2} + i0 JOIN ce q ON q.id = gt.scan_id * {bind.SIDE**2} + i1 JOIN ce r ON r.id = gt.scan_id * {bind.SIDE**2} + i2 WHERE p.k <> q.k AND q.k <> r.k AND p.k <> r.k GROUP BY gt.scan_id)
SELECT scan_id, level::INT AS level, vertices, coalesce(triangles, 0)::BIGINT AS triangles FROM vn LEFT JOIN tn USING (scan_id)""")
def mesh_decimate(spark: SparkSession, d: str) -> DataFrame:
    """Height fields brought down to 500 triangles: the level of the pyramid that each took, and what it leaves."""
    v, t = bind.grid(spark, d)
    v, t = shared_table(v, "grid"), shared_table(t, "grid-triangles")
    found = shared_table(mesh.levels(v, t, TARGET), "cells")
    less, left = mesh.decimate(v, t, TARGET, found)
    n = less.groupBy("scan_id").agg(F.count("*").alias("vertices")).join(left.groupBy("scan_id").agg(F.count("*").alias("triangles")), "scan_id", "left")
    return n.join(found.select("scan_id", "level"), "scan_id", "left").select("scan_id", "level", "vertices", F.coalesce("triangles", F.lit(0)).alias("triangles"))


@query(f"""WITH {bind.GRID}, u AS (SELECT *, b_x - a_x AS ux, b_y - a_y AS uy, b_z - a_z AS uz, c_x - a_x AS vx, c_y - a_y AS vy, c_z - a_z AS vz FROM gt),
k AS (SELECT scan_id, unnest([i0, i1, i2]) AS idx, uy * vz - uz * vy AS cx, uz * vx - ux * vz AS cy, ux * vy - uy * vx AS cz FROM u),
s AS (SELECT scan_id, idx, sum(cx) AS cx, sum(cy) AS cy, sum(cz) AS cz FROM k GROUP BY ALL)
SELECT scan_id, idx, round(coalesce(cx / sqrt(cx * cx + cy * cy + cz * cz), 0), 5) AS nx, round(coalesce(cy / sqrt(cx * cx + cy * cy + cz * cz), 0), 5) AS ny, round(coalesce(cz / sqrt(cx * cx + cy * cy + cz * cz), 1), 5) AS nz FROM gv LEFT JOIN s USING (scan_id, idx)""")
def vertex_normals(spark: SparkSession, d: str) -> DataFrame:
    """Normals of height fields in which a vertex belongs to up to six triangles."""
    return mesh.vertex_normals(*bind.grid(spark, d)).select("scan_id", "idx", *[F.round(x, 5).alias(x) for x in ("nx", "ny", "nz")])


@query(f"WITH {bind.ZONES} SELECT project_id, tier, count(*) AS zone_count, count(*) * 8 AS vertices, count(*) * 12 AS triangles FROM z GROUP BY ALL")
def scene_metadata(spark: SparkSession, d: str) -> DataFrame:
    return mesh.scene_metadata(bind.zones(spark, d))


def _scene_zones(spark, d):
    k = F.col("material_id")
    cat = F.element_at(F.array(*[F.lit(c) for c in artefacts.BASE_COLOURS]), (k % 4 + 1).cast("int"))
    return bind.zones(spark, d).select(
        "project_id", "tier", "zone_id", "ring", F.when(k % 3 == 0, "fills").when(k % 3 == 1, "sits_on_top").otherwise("builds_up").alias("kind"), (k % 24 + 1).cast("double").alias("height_inches"), cat.alias("category"))


@query(f"""WITH {bind.ZONES}, e AS (SELECT project_id, w * h * CASE WHEN material_id % 3 = 0 THEN 4 ELSE material_id % 24 + 1 END / 12.0::DOUBLE AS volume, 2 * w * h + 2 * (w + h) * CASE WHEN material_id % 3 = 0 THEN 4 ELSE material_id % 24 + 1 END / 12.0::DOUBLE AS surface FROM z)
SELECT project_id, count(*) * 12 AS faces, round(sum(volume), 3) AS volume_cuft, round(sum(surface), 3) AS surface_sqft FROM e GROUP BY project_id""")
def extruded_sql(spark: SparkSession, d: str) -> DataFrame:
    """Volume and surface of each project's zones, added up over the faces that the table function makes: right only if every solid is closed and faces outwards."""
    tables.register(spark)
    zones = _scene_zones(spark, d).select(F.col("project_id").alias("zone_id"), "ring", "kind", "height_inches")  # faces are only added up, so a project's zones may share its id
    return spark.sql("""
        WITH f AS (SELECT zone_id AS project_id, bx - ax AS ux, by - ay AS uy, bz - az AS uz, cx - ax AS vx, cy - ay AS vy, cz - az AS vz, ax, ay, az FROM extrude_zone(TABLE({zones}))),
        n AS (SELECT project_id, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz, ax, ay, az FROM f)
        SELECT project_id, count(*) AS faces, round(sum((ax * nx + ay * ny + az * nz) / 6), 3) AS volume_cuft, round(sum(sqrt(nx * nx + ny * ny + nz * nz) / 2), 3) AS surface_sqft FROM n GROUP BY project_id""", zones=zones)


@query(f"WITH {bind.ZONES} SELECT project_id, tier, count(*) AS zone_count, count(*) * 12 AS triangles, 'glTF' AS magic, true AS whole FROM z GROUP BY ALL")
def glb_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes: magic bytes, and whether the length in the header is the file's."""
    g = artefacts.scene_artefacts(_scene_zones(spark, d))
    size = F.hex(F.substring("glb", 9, 4))  # little-endian
    length = F.conv(F.concat(*[F.substring(size, at, 2) for at in (7, 5, 3, 1)]), 16, 10)
    return g.select("project_id", "tier", "zone_count", "triangles", F.substring("glb", 1, 4).cast("string").alias("magic"), (length.cast("long") == F.octet_length("glb")).alias("whole"))


@query()
def terrain_artefacts(spark: SparkSession, d: str) -> DataFrame:
    c = bind.cloud(spark, d)
    a = artefacts.terrain_artefacts(c, c, 60)
    return a.select("scan_id", "vertices", "triangles", F.substring("glb", 1, 4).cast("string").alias("magic"), F.hex(F.substring("png", 2, 3)).alias("png"))


@query(f"""WITH {bind.CLOUD}, k(encoding) AS (VALUES ('little'), ('big'), ('ascii'))
SELECT encoding, scan_id, idx, round(x::FLOAT::DOUBLE, 6) AS x, round(y::FLOAT::DOUBLE, 6) AS y, round(z::FLOAT::DOUBLE, 6) AS z, r::SMALLINT AS r, g::SMALLINT AS g, b::SMALLINT AS b FROM c, k""")
def ply_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every scan written as PLY files of all three encodings, with and without colours, and read by ranges of few vertices."""
    c, out = bind.cloud(spark, d), None
    for encoding in ("little", "big", "ascii"):
        path = shared_path(spark, f"ply-{encoding}")
        ply.write_scans(c, path, encoding, vertices=1000)
        back = ply.read_scans(spark, path, vertices=300, range_bytes=8192).withColumn("encoding", F.lit(encoding))
        out = back if out is None else out.unionByName(back)
    return out.select("encoding", F.col("scan_id").cast("int").alias("scan_id"), "idx", *[F.round(n, 6).alias(n) for n in "xyz"], "r", "g", "b")


@query(f"WITH {bind.BIG_CLOUD} SELECT scan_id, min(x::FLOAT::DOUBLE) AS min_x, max(x::FLOAT::DOUBLE) AS max_x, min(z::FLOAT::DOUBLE) AS min_z, max(z::FLOAT::DOUBLE) AS max_z, count(*) AS n FROM c GROUP BY scan_id")
def ply_extent(spark: SparkSession, d: str) -> DataFrame:
    """Extents from written scans; y and the colours are never converted."""
    path = shared_path(spark, "ply-extent")
    ply.write_scans(bind.big_cloud(spark, d), path, vertices=50_000)
    back = ply.read_scans(spark, path, vertices=20_000, columns="scan_id string, x double, z double")
    return back.groupBy(F.col("scan_id").cast("int").alias("scan_id")).agg(*[f(c).alias(f"{n}_{c}") for c in "xz" for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n"))


def _documents(spark, d):
    """Projects as documents: walls have no label, a third of the projects a scan."""
    from sitesmith.plans.storing import _projects

    k = F.col("project_id")
    z = bind.zones(spark, d).withColumn("zone_type", F.col("label")).withColumn("label", F.when(F.col("label") != "wall", F.col("label")))
    p = _projects(spark, d).withColumn("updated_at", F.date_add("created_at", (k % 30).cast("int"))).withColumn("scan_ref", F.when(k % 3 == 0, F.concat(F.lit("scans/"), k.cast("string"), F.lit(".ply"))))
    return artefacts.project_geojson(p, z, z)


_PROJECTS = """pj AS (SELECT o_orderkey AS project_id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'quoted' ELSE 'draft' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'scans/' || o_orderkey || '.ply' END AS scan_ref,
 o_orderdate::DATE AS created, o_orderdate::DATE + (o_orderkey % 30)::INT AS updated FROM orders)"""


@query(f"WITH {bind.ZONES}, {_PROJECTS} SELECT project_id, status, scan_ref, created, updated, zone_id, label AS zone_type, CASE WHEN label <> 'wall' THEN label END AS label, w * h AS area FROM z JOIN pj USING (project_id)")
def project_geojson(spark: SparkSession, d: str) -> DataFrame:
    """Projects written as FeatureCollections and parsed again."""
    p = artefacts.parse_project_geojson(_documents(spark, d))
    return p.select("project_id", "status", "scan_ref", F.to_date("created_at").alias("created"), F.to_date("updated_at").alias("updated"), "zone_id", "zone_type", "label", geo.ring_area(F.col("ring")).alias("area"))


@query(f"WITH {bind.ZONES} SELECT project_id, tier, zone_id, material_id FROM z JOIN orders ON o_orderkey = project_id")
def project_tiers_geojson(spark: SparkSession, d: str) -> DataFrame:
    """The assignments of the tiers in those documents."""
    return artefacts.parse_project_tiers(_documents(spark, d))


#: What is done to documents, by project_id % 16, and the fault that follows; the faults of features need a zone.
_DAMAGE = [
    ('"type":"FeatureCollection"', '"type":"Feature"', "expected FeatureCollection"), ('"project_id":', '"id":', "missing project_id"), ('"status":', '"state":', "missing status"),
    ('"status":"[a-z]+"', '"status":"lost"', "invalid status"), ('"tiers":', '"levels":', "missing tiers"), ('"created_at":', '"made_at":', "missing created_at"), ('"updated_at":"[0-9]+', '"updated_at":"x', "invalid updated_at"),
    ('"updated_at":', '"at":', "missing updated_at"), ('"properties":', '"p":', "feature missing properties"), ('"id":', '"key":', "zone missing id"), ('"zone_type":', '"kind":', "zone missing zone_type"),
    ('"geometry":', '"g":', "feature missing geometry"), ('"type":"Polygon"', '"type":"Point"', "expected Polygon"), ('[}]$', '', "expected FeatureCollection"),
]


@query("SELECT o_orderkey AS project_id, CASE " + " ".join(f"WHEN o_orderkey % 16 = {i} {'AND has' if 8 <= i <= 12 else ''} THEN '{f}'" for i, (_, _, f) in enumerate(_DAMAGE))
       + " END AS fault FROM (SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS has FROM orders)")
def geojson_faults(spark: SparkSession, d: str) -> DataFrame:
    """Documents damaged in fourteen ways, each with the fault that a reader names; the others have none."""
    docs, text = _documents(spark, d), F.col("geojson")
    for i, (old, new, _) in enumerate(_DAMAGE):
        text = F.when(F.col("project_id") % 16 == i, F.regexp_replace("geojson", old, new)).otherwise(text)
    return artefacts.read_documents(docs.withColumn("geojson", text)).select("project_id", "fault")


@query(f"""WITH {bind.ZONES}, b AS (SELECT zone_id, w, h, (owner % 30)::DOUBLE AS ox, (material_id % 10)::DOUBLE AS oy FROM z), o AS (SELECT *, greatest(least(w, ox + 10) - greatest(0, ox), 0) * greatest(least(h, oy + 8) - greatest(0, oy), 0) AS ov FROM b)
SELECT zone_id, round(w * h + 80 - ov, 6) AS union_area, round(w * h - ov, 6) AS difference_area, round(ov, 6) AS common_area FROM o""")
def polygon_boolean(spark: SparkSession, d: str) -> DataFrame:
    """General polygon clipping, on rectangles so that SQL can follow."""
    z = bind.zones(spark, d).select("zone_id", "w", "h", (F.col("owner") % 30).cast("double").alias("ox"), (F.col("material_id") % 10).cast("double").alias("oy"))

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples():
                a = [[(0.0, 0.0), (r.w, 0.0), (r.w, r.h), (0.0, r.h)]]
                b = [[(r.ox, r.oy), (r.ox + 10, r.oy), (r.ox + 10, r.oy + 8), (r.ox, r.oy + 8)]]
                rows.append((r.zone_id, *[round(sum(map(mesh.ring_area, rings)), 6) for rings in mesh.booleans(a, b, ["union", "difference", "intersection"])]))
            yield pd.DataFrame(rows, columns=["zone_id", "union_area", "difference_area", "common_area"])

    return z.mapInPandas(run, "zone_id string, union_area double, difference_area double, common_area double")


@query("SELECT user_id, (2 * (count(*) % 6 + 1) + 1)::INT AS points FROM events GROUP BY user_id")
def line_simplify(spark: SparkSession, d: str) -> DataFrame:
    """As many peaks as a user's events say, each with many points on its two sides, simplified to their turns."""
    u = bind.t(spark, d, "events").groupBy("user_id").agg((F.count("*") % 6 + 1).alias("peaks"))

    def run(frames):
        for f in frames:
            # a line at a time is held
            lines = ([(i / 10, (i % 100) / 10 if i % 100 <= 50 else 10 - (i % 100) / 10) for i in range(100 * n + 1)] for n in f["peaks"])
            yield pd.DataFrame({"user_id": f["user_id"], "points": [len(mesh.simplify(x, 0.01)) for x in lines]}).astype({"points": "int32"})

    return u.mapInPandas(run, "user_id long, points int")

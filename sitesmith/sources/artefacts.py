"""Binary artefacts as BINARY columns: glTF scenes and terrain (GLB), plan views (PNG); project documents (GeoJSON)."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesmith.functions import geo
from sitesmith.operators import mesh

PIXELS_PER_METRE, MAX_PIXELS, BACKGROUND = 30, 4096, 220
# Base colours of material categories, 0..1.
BASE_COLOURS = {"hardscape": (0.706, 0.706, 0.706, 1.0), "softscape": (0.545, 0.353, 0.169, 1.0), "edging": (0.392, 0.392, 0.392, 1.0), "fill": (0.824, 0.706, 0.549, 1.0)}


def y_up(pos: np.ndarray) -> np.ndarray:
    return np.stack([pos[:, 0], pos[:, 2], -pos[:, 1]], axis=1) if len(pos) else pos


def buffers(part: dict) -> list[tuple]:
    """A part's arrays as bytes: (attribute, data, kind, component, target, count, least and greatest), in the order of the file."""
    pos, normal = (y_up(np.asarray(part[k], "<f4")) for k in ("positions", "normals"))
    out = [("POSITION", pos.tobytes(), "VEC3", 5126, 34962, len(pos), (pos.min(axis=0).tolist(), pos.max(axis=0).tolist())), ("NORMAL", normal.tobytes(), "VEC3", 5126, 34962, len(normal), None)]
    if "colours" in part:
        c = np.asarray(part["colours"], np.uint8)
        out.append(("COLOR_0", c.tobytes(), "VEC4", 5121, 34962, len(c), None))
    t = np.asarray(part["triangles"], "<u4").ravel()
    return [*out, ("indices", t.tobytes(), "SCALAR", 5125, 34963, len(t), None)]


def glb(parts: list[dict]) -> bytes:
    """A binary glTF 2.0 file; each part is a node: name, positions and normals (z up), triangles, colours (u8 RGBA) or colour; or name, colour and its `buffers`.

    Parts of the same colour (within 1e-6) share a material; no parts give a valid empty scene.
    """
    views, accessors, meshes, nodes, materials, blobs, size = [], [], [], [], [], [], 0
    for p in parts:
        prim = {"attributes": {}}
        for name, data, kind, component, target, count, bounds in p.get("buffers") or buffers(p):
            views.append({"buffer": 0, "byteOffset": size, "byteLength": len(data), "target": target})
            acc = {"bufferView": len(views) - 1, "componentType": component, "count": count, "type": kind}
            if bounds:
                acc["min"], acc["max"] = bounds
            if component == 5121:
                acc["normalized"] = True
            (prim if name == "indices" else prim["attributes"])[name] = len(accessors)
            accessors.append(acc)
            blobs += [data, b"\0" * (-len(data) % 4)]
            size += len(data) + -len(data) % 4
        if "colour" in p:
            same = [i for i, m in enumerate(materials) if all(abs(a - b) <= 1e-6 for a, b in zip(m["pbrMetallicRoughness"]["baseColorFactor"], p["colour"]))]
            if not same:
                materials.append({"pbrMetallicRoughness": {"baseColorFactor": list(p["colour"]), "metallicFactor": 0.0, "roughnessFactor": 0.9}})
            prim["material"] = same[0] if same else len(materials) - 1
        meshes.append({"primitives": [prim]})
        nodes.append({"mesh": len(meshes) - 1, "name": p.get("name", "")})
    doc = {"asset": {"version": "2.0", "generator": "sitesmith"}, "scene": 0, "scenes": [{"nodes": list(range(len(nodes)))} if nodes else {}]}
    if parts:
        doc |= {"nodes": nodes, "meshes": meshes, "accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": size}]}
    if materials:
        doc["materials"] = materials
    text = json.dumps(doc, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    body = [struct.pack("<II", len(text), 0x4E4F534A), text]
    if size:
        body += [struct.pack("<II", size, 0x004E4942), *blobs]
    return b"".join([struct.pack("<III", 0x46546C67, 2, 12 + sum(map(len, body))), *body])


def png(pixels: np.ndarray) -> bytes:
    """An RGB image (height, width, 3) as PNG."""
    h, w, _ = pixels.shape
    raw = np.hstack([np.zeros((h, 1), np.uint8), np.ascontiguousarray(pixels, np.uint8).reshape(h, -1)]).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def plan_view(points: pd.DataFrame, triangles: np.ndarray, obstacles: np.ndarray) -> np.ndarray:
    """Pixels of a plan: triangles in their mean colour, lighter with height (0.7 to 1), 3 x 3 pixels darker at obstacles; y points up."""
    xyz = points[["x", "y", "z"]].to_numpy(float)
    if not len(xyz):
        return np.full((1, 1, 3), BACKGROUND, np.uint8)
    lo, hi = xyz.min(axis=0), xyz.max(axis=0)
    scale = min(PIXELS_PER_METRE, (MAX_PIXELS - 1) / max(hi[0] - lo[0], hi[1] - lo[1], 1e-9))
    w, h = (int(np.clip(np.ceil((hi[i] - lo[i]) * scale), 1, MAX_PIXELS)) for i in (0, 1))
    img = np.full((h, w, 3), BACKGROUND, np.uint8)
    px = np.stack([(xyz[:, 0] - lo[0]) * scale, (hi[1] - xyz[:, 1]) * scale], axis=1)
    rgb = points[["r", "g", "b"]].fillna(pd.Series(dict(zip("rgb", mesh.NO_COLOUR)))).to_numpy(float)
    light = 0.7 + 0.3 * (xyz[:, 2] - lo[2]) / max(hi[2] - lo[2], 1e-9)
    for t in triangles:
        a, b, c = px[t]
        x0, y0 = np.floor(np.minimum(np.minimum(a, b), c)).astype(int).clip(0)
        x1, y1 = np.ceil(np.maximum(np.maximum(a, b), c)).astype(int) + 1
        gx, gy = np.meshgrid(np.arange(x0, min(x1, w)) + 0.5, np.arange(y0, min(y1, h)) + 0.5)
        e = lambda p, q: (q[0] - p[0]) * (gy - p[1]) - (q[1] - p[1]) * (gx - p[0])
        u, v, s = e(a, b), e(b, c), e(c, a)
        hit = ((u >= 0) & (v >= 0) & (s >= 0)) | ((u <= 0) & (v <= 0) & (s <= 0))
        img[y0 : min(y1, h), x0 : min(x1, w)][hit] = (rgb[t].mean(axis=0) * light[t].mean()).clip(0, 255)
    for x, y in obstacles:
        cx, cy = int((x - lo[0]) * scale), int((hi[1] - y) * scale)
        if -1 <= cx <= w and -1 <= cy <= h:
            part = img[max(cy - 1, 0) : cy + 2, max(cx - 1, 0) : cx + 2]
            part[...] = (part * 0.6).astype(np.uint8)
    return img


GLYPH = 5


def annotate(img: np.ndarray, boxes: list[tuple[int, int, int, int, tuple[int, int, int]]], tint: float = 0.15) -> np.ndarray:
    """Boxes (x0, y0, x1, y1, colour) drawn with a tinted inside, and a label bar above each, moved down past at most 5 others that it would cover."""
    out, taken = img.copy(), []
    h, w, _ = out.shape
    for x0, y0, x1, y1, colour in boxes:
        x0, x1, y0, y1 = max(x0, 0), min(x1, w - 1), max(y0, 0), min(y1, h - 1)
        if x1 < x0 or y1 < y0:
            continue
        c = np.array(colour)
        part = out[y0 : y1 + 1, x0 : x1 + 1]
        part[...] = (part * (1 - tint) + c * tint).astype(np.uint8)
        out[[y0, y1], x0 : x1 + 1] = c
        out[y0 : y1 + 1, [x0, x1]] = c
        bar = [x0, max(0, y0 - GLYPH - 1), min(w - 1, x0 + 6 * GLYPH), max(0, y0 - 1)]
        for _ in range(5):
            if not any(bar[0] <= t[2] and t[0] <= bar[2] and bar[1] <= t[3] and t[1] <= bar[3] for t in taken):
                break
            bar[1], bar[3] = bar[1] + GLYPH + 2, bar[3] + GLYPH + 2
        taken.append(bar)
        out[bar[1] : bar[3] + 1, bar[0] : bar[2] + 1] = c
    return out


def terrain_artefacts(points: DataFrame, obstacles: DataFrame, target: int = 50_000) -> DataFrame:
    """Ground points -> scan_id, glb, png, vertices, triangles, z_min, z_max; a scan without a triangle is left out.

    Triangulated and decimated as tables; the few vertices that are left become the files of a scan in one task.
    """
    tri = mesh.triangulate(points)
    v, t = mesh.decimate(points.select("scan_id", "idx", *"xyz", *[F.coalesce(c, F.lit(d)).cast("int").alias(c) for c, d in zip("rgb", mesh.NO_COLOUR)]), tri, target)
    n = mesh.vertex_normals(v, t)
    kind = dict(points.dtypes)["scan_id"]
    rows = v.join(n, ["scan_id", "idx"]).select("scan_id", F.lit("v").alias("k"), "idx", *"xyz", "nx", "ny", "nz", *"rgb")
    none = [F.lit(None).cast("double").alias(c) for c in ("nx", "ny", "nz")] + [F.lit(None).cast("int").alias(c) for c in "rgb"]
    rows = rows.unionByName(t.select("scan_id", F.lit("t").alias("k"), F.col("tri").alias("idx"), *[F.col(f"i{i}").cast("double").alias(c) for i, c in enumerate("xyz")], *none))
    rows = rows.unionByName(obstacles.select("scan_id", F.lit("o").alias("k"), F.lit(0).cast("long").alias("idx"), *"xyz", *none))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        vs, ts, obs = g[g.k == "v"].sort_values("idx"), g[g.k == "t"].sort_values("idx"), g[g.k == "o"]
        empty = pd.DataFrame(columns=["scan_id", "glb", "png", "vertices", "triangles", "z_min", "z_max"])
        if not len(ts):
            return empty
        tris = np.searchsorted(vs["idx"].to_numpy(), ts[["x", "y", "z"]].to_numpy().astype(np.int64))
        colours = np.hstack([vs[["r", "g", "b"]].to_numpy(np.uint8), np.full((len(vs), 1), 255, np.uint8)])
        data = glb([{"name": "terrain", "positions": vs[["x", "y", "z"]].to_numpy(), "normals": vs[["nx", "ny", "nz"]].to_numpy(), "colours": colours, "triangles": tris}])
        img = png(plan_view(vs[["x", "y", "z", "r", "g", "b"]], tris, obs[["x", "y"]].to_numpy()))
        return pd.DataFrame({"scan_id": [g["scan_id"].iloc[0]], "glb": [data], "png": [img], "vertices": [len(vs)], "triangles": [len(tris)], "z_min": [vs["z"].min()], "z_max": [vs["z"].max()]})

    return rows.groupBy("scan_id").applyInPandas(run, f"scan_id {kind}, glb binary, png binary, vertices long, triangles long, z_min double, z_max double")


UP = (0.0, 0.0, 1.0)


def _zone_buffers(b: pa.RecordBatch) -> list[list[tuple] | None]:
    """The `buffers` of each zone of a batch, None for one without a face: convex quadrangles together, others one by one."""
    rings, kinds = b.column("ring"), b.column("kind").to_pylist()
    heights = b.column("height_inches").to_numpy(zero_copy_only=False).astype(float)
    out: list = [None] * b.num_rows
    rest = np.ones(b.num_rows, bool)
    for rows, pos, tris in mesh.extruded_quads(rings, kinds, heights):
        rest[rows] = False
        normal = mesh.normals_of_many(pos, tris, UP)
        pos, normal = (np.stack([x[:, :, 0], x[:, :, 2], -x[:, :, 1]], axis=2) for x in (pos.astype("<f4"), normal.astype("<f4")))
        t, many = tris.astype("<u4").tobytes(), pos.shape[1]
        for i, p, n, lo, hi in zip(rows.tolist(), pos, normal, pos.min(axis=1).tolist(), pos.max(axis=1).tolist()):
            out[i] = [("POSITION", p.tobytes(), "VEC3", 5126, 34962, many, (lo, hi)), ("NORMAL", n.tobytes(), "VEC3", 5126, 34962, many, None), ("indices", t, "SCALAR", 5125, 34963, tris.size, None)]
    for i in np.flatnonzero(rest).tolist():
        pos, t = mesh.extrude([(p["x"], p["y"]) for p in rings[i].as_py() or []], kinds[i], heights[i])
        if len(t):
            out[i] = buffers({"positions": pos, "normals": mesh.normals(pos, t, UP), "triangles": t})
    return out


def _scenes(batches):
    """Zones in order of scene and id -> scenes; a scene may go on in the next batch."""
    now, parts, rows = None, [], []

    def close():
        tris = sum(p["buffers"][-1][5] for p in parts) // 3
        rows.append((*now, glb(parts), len(parts), tris))

    def made():
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["project_id", "tier", "glb", "zone_count", "triangles"])

    for b in batches:
        for project, tier, zone, category, data in zip(*(b.column(c).to_pylist() for c in ("project_id", "tier", "zone_id", "category")), _zone_buffers(b)):
            if (project, tier) != now:
                if now is not None:
                    close()
                now, parts = (project, tier), []
            if data:
                parts.append({"name": str(zone), "buffers": data, "colour": BASE_COLOURS.get(category, (0.7, 0.7, 0.7, 1.0))})
        if rows:
            yield made()
            rows.clear()
    if now is not None:
        close()
        yield made()


def scene_artefacts(zones: DataFrame) -> DataFrame:
    """(project_id, tier, zone_id, ring, kind, height_inches, category) -> a GLB per project and tier, a node per zone in order of its id."""
    z = zones.select(F.col("project_id").cast("long").alias("project_id"), "tier", "zone_id", "ring", "kind", F.col("height_inches").cast("double").alias("height_inches"), "category")
    z = z.repartition("project_id", "tier").sortWithinPartitions("project_id", "tier", F.col("zone_id").asc_nulls_last())
    return z.mapInArrow(_scenes, "project_id long, tier string, glb binary, zone_count long, triangles long")


def project_geojson(projects: DataFrame, zones: DataFrame, assignments: DataFrame) -> DataFrame:
    """project_id -> a FeatureCollection text of its zones, with status, tiers, scan_ref, created_at and updated_at as foreign members.

    Null labels and scan_refs are left out. Zones come in order of their id, tiers from good to best with their assignments in
    order; a project without any has none. A document is one row, so a project's zones have to fit into one.
    """
    # only what differs between zones is shuffled, and assignments once; what a document says around it is put there afterwards
    f = zones.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("zone_id", "ring", "zone_type", "label"))).alias("fs"))
    t = assignments.groupBy("project_id").agg(F.collect_list(F.struct(F.col("tier").alias("level"), "zone_id", "material_id")).alias("ts"))

    def feature(z):
        coords = F.array(F.transform(z["ring"], lambda p: F.array(p["x"], p["y"])))
        geometry = F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates"))
        return F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(z["zone_id"].alias("id"), z["zone_type"].alias("zone_type"), z["label"].alias("label")).alias("properties"))

    def of_level(x):
        own = F.filter("ts", lambda a: a["level"].eqNullSafe(x["level"]))
        return F.struct(x["level"].alias("level"), F.sort_array(F.transform(own, lambda a: F.struct(a["zone_id"].alias("zone_id"), a["material_id"].alias("material_id")))).alias("assignments"))

    place = lambda level: F.array_position(F.array(*[F.lit(x) for x in TIERS]), level)
    levels = F.sort_array(F.array_distinct(F.transform("ts", lambda a: F.struct(place(a["level"]).alias("at"), a["level"].alias("level")))))
    j = projects.join(f, "project_id", "left").join(t, "project_id", "left")
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    doc = F.struct(
        F.lit("FeatureCollection").alias("type"), F.coalesce(F.transform("fs", feature), F.array()).alias("features"), "project_id", "status", "scan_ref",
        F.coalesce(F.transform(levels, of_level), F.array()).alias("tiers"), time("created_at"), time("updated_at"),
    )
    return j.select("project_id", F.to_json(doc).alias("geojson"))


# Levels of tiers in order, and states of projects.
TIERS = ["good", "better", "best"]
STATES = ["draft", "quoted", "approved", "complete"]
FEATURES = (
    "type string, project_id long, status string, scan_ref string, created_at string, updated_at string, tiers array<struct<level:string,assignments:array<struct<zone_id:string,material_id:long>>>>, "
    "features array<struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:struct<id:string,zone_type:string,label:string>>>"
)


def read_documents(docs: DataFrame, col: str = "geojson") -> DataFrame:
    """docs with the parsed document d and its first fault, null where it is whole: the document's own members first, then the features in their order."""
    fault = F.lit(None).cast("string")
    for c in reversed(("created_at", "updated_at")):
        fault = F.when(F.col(f"d.{c}").isNull(), f"missing {c}").when(F.col(f"d.{c}").try_cast("timestamp").isNull(), f"invalid {c}").otherwise(fault)
    fault = F.when(F.col("d.tiers").isNull(), "missing tiers").when(F.exists("d.tiers", lambda t: ~F.coalesce(t["level"].isin(TIERS), F.lit(False))), "invalid tiers").otherwise(fault)
    fault = F.when(F.col("d.status").isNull(), "missing status").when(~F.col("d.status").isin(STATES), "invalid status").otherwise(fault)
    fault = F.when(F.col("d.project_id").isNull(), "missing project_id").otherwise(fault)
    fault = F.when(F.coalesce(F.col("d.type") != "FeatureCollection", F.lit(True)), "expected FeatureCollection").otherwise(fault)

    def of_feature(f):
        p, g = f["properties"], f["geometry"]
        return (
            F.when(p.isNull(), "feature missing properties").when(p["id"].isNull(), "zone missing id").when(p["zone_type"].isNull(), "zone missing zone_type")
            .when(g.isNull(), "feature missing geometry").when(~g["type"].eqNullSafe("Polygon"), "expected Polygon")
        )

    first = F.get(F.filter(F.transform("d.features", of_feature), lambda x: x.isNotNull()), F.lit(0))
    # a generated column is made once a row; one of a projection would be parsed again for every member that a filter on the fault looks at
    return docs.select("*", F.explode(F.array(F.from_json(col, FEATURES))).alias("d")).withColumn("fault", F.coalesce(fault, first))


def parse_project_geojson(docs: DataFrame, col: str = "geojson") -> DataFrame:
    """FeatureCollection texts -> a row per zone: project_id, status, scan_ref, created_at, updated_at, zone_id, zone_type, label, ring; texts with a fault give none."""
    time = lambda c: F.col(f"d.{c}").try_cast("timestamp").alias(c)
    z = read_documents(docs, col).where("fault is null").select("d.project_id", "d.status", "d.scan_ref", time("created_at"), time("updated_at"), F.explode("d.features").alias("f"))
    ring = F.transform(F.get("f.geometry.coordinates", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return z.select("project_id", "status", "scan_ref", "created_at", "updated_at", F.col("f.properties.id").alias("zone_id"), F.col("f.properties.zone_type").alias("zone_type"), F.col("f.properties.label").alias("label"), ring.cast(geo.RING).alias("ring"))


def parse_project_tiers(docs: DataFrame, col: str = "geojson") -> DataFrame:
    """FeatureCollection texts -> a row per assignment: project_id, tier, zone_id, material_id; texts with a fault give none."""
    t = read_documents(docs, col).where("fault is null").select("d.project_id", F.explode("d.tiers").alias("t"))
    return t.select("project_id", F.col("t.level").alias("tier"), F.explode("t.assignments").alias("a")).select("project_id", "tier", "a.zone_id", "a.material_id")


def write_log(classified: DataFrame, path: str) -> None:
    """Append classifications as JSON lines."""
    classified.write.mode("append").json(path)

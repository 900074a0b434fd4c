"""Scenes that are made many at a time are those made one by one."""

from __future__ import annotations

import json
import struct

import numpy as np

from sitesmith.functions import geo
from sitesmith.operators import mesh
from sitesmith.sources import artefacts

RINGS = [
    [(0, 0), (4, 0), (4, 3), (0, 3), (0, 0)], [(0, 0), (0, 3), (4, 3), (4, 0), (0, 0)], [(0, 0), (4, 0), (5, 3), (0, 3)], [(0, 0), (4, 0), (1, 1), (0, 4), (0, 0)], [(0, 0), (4, 0), (4, 4), (0, 0)],
    [(0, 0), (10, 0), (10, 5), (5, 5), (5, 10), (0, 10), (0, 0)], [(0, 0), (1, 1), (0, 0)], [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], [], [(1, 1), (2, 1), (3, 1), (1, 4), (1, 1)],
]


def test_scenes_equal_zones_one_by_one(spark):
    kinds = ["fills", "sits_on_top", "builds_up", None]
    rows = [(p, t, f"z{p}-{i}", [{"x": float(x), "y": float(y)} for x, y in r], kinds[(i + p) % 4], float(i + p), ["edging", "fill", None][(i + p) % 3]) for p in range(5) for t in ("good", "best") for i, r in enumerate(RINGS[p:])]
    rows += [(9, "good", "null", None, "fills", 1.0, "fill"), (None, "good", "x", rows[0][3], "fills", 1.0, "fill"), (None, "good", "y", rows[0][3], "fills", 1.0, "fill")]
    z = spark.createDataFrame(rows, f"project_id long, tier string, zone_id string, ring {geo.RING}, kind string, height_inches double, category string")
    want = {}
    for r in sorted(rows, key=lambda r: r[2]):
        parts = want.setdefault(r[:2], [])
        pos, t = mesh.extrude([(p["x"], p["y"]) for p in r[3] or []], r[4], r[5])
        if len(t):
            parts.append({"name": r[2], "positions": pos, "normals": mesh.normals(pos, t, (0.0, 0.0, 1.0)), "triangles": t, "colour": artefacts.BASE_COLOURS.get(r[6], (0.7, 0.7, 0.7, 1.0))})
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for size in ("3", before):
            spark.conf.set(name, size)
            got = {(r["project_id"], r["tier"]): (bytes(r["glb"]), r["zone_count"], r["triangles"]) for r in artefacts.scene_artefacts(z).collect()}
            assert got == {k: (artefacts.glb(p), len(p), sum(len(x["triangles"]) for x in p)) for k, p in want.items()}
    finally:
        spark.conf.set(name, before)


def test_file_of_a_scene():
    pos, t = mesh.extrude([(0, 0), (4, 0), (4, 3), (0, 3)], "builds_up", 12)
    data = artefacts.glb([{"name": n, "positions": pos, "normals": mesh.normals(pos, t), "triangles": t, "colour": (0.1, 0.2, 0.3, 1.0)} for n in "ab"])
    assert struct.unpack("<I", data[8:12])[0] == len(data)
    n = struct.unpack("<I", data[12:16])[0]
    doc = json.loads(data[20 : 20 + n])
    assert len(doc["materials"]) == 1 and doc["accessors"][0]["max"] == [4.0, 1.0, 0.0] and doc["meshes"][1]["primitives"][0] == {"attributes": {"POSITION": 3, "NORMAL": 4}, "indices": 5, "material": 0}
    v = doc["bufferViews"][5]
    assert np.frombuffer(data, "<u4", 36, 28 + n + v["byteOffset"]).tolist() == t.ravel().tolist()


def test_one_sweep_gives_all_results():
    a, b = [[(0, 0), (4, 0), (4, 4), (0, 4)]], [[(2, 1), (6, 1), (5, 6), (2, 3)], [(3, 2), (4, 2), (3.5, 3)]]
    ops = ["union", "difference", "intersection"]
    got = mesh.booleans(a, b, ops)
    assert got == [mesh.boolean(a, b, op) for op in ops]
    union, less, both = (sum(map(mesh.ring_area, rings)) for rings in got)
    assert abs(less + both - 16) < 1e-9 and abs(union - less - sum(map(mesh.ring_area, mesh.boolean(b, [], "union")))) < 1e-9


def test_lines_are_held_one_at_a_time(spark, monkeypatch):
    """What a task of line_simplify makes of its rows is let go before the next line is made."""
    import pandas as pd

    from sitesmith.plans import artefacts as plans

    seen = []

    class Rows:
        def groupBy(self, *_):
            return self

        def agg(self, *_):
            return self

        def mapInPandas(self, run, _):
            import tracemalloc

            for users in (10, 200):
                tracemalloc.start()
                list(run([pd.DataFrame({"user_id": range(users), "peaks": [6] * users})]))
                seen.append(tracemalloc.get_traced_memory()[1])
                tracemalloc.stop()

    monkeypatch.setattr(plans.bind, "t", lambda *_: Rows())
    plans.line_simplify(spark, "")
    assert seen[1] < 3 * seen[0]

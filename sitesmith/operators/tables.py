"""Table functions for SQL: cells of sun hours, gaps between features, faces of extruded zones.

`register` makes them known to a session. Each takes a table argument, checks its columns when the query is analysed, and
keeps the type of its key. The DataFrame functions of the same work stay the faster way; these are for SQL users.
"""

from __future__ import annotations

import datetime
import math

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from sitesmith.functions.solar import METRES_PER_DEGREE, OBLIQUITY, RAD, SAMPLES
from sitesmith.operators.mesh import solid

FEET_PER_METRE = 3.28084


def _columns(table: AnalyzeArgument, name: str, wanted: list[str]) -> dict:
    """Types of a table argument's columns by name; an error names those it lacks."""
    if not table.isTable:
        raise ValueError(f"{name} takes a table: {name}(TABLE(...))")
    types = {f.name: f.dataType for f in table.dataType.fields}
    if lacking := [c for c in wanted if c not in types]:
        raise ValueError(f"{name} needs columns {', '.join(wanted)}; the table lacks {', '.join(lacking)}")
    return types


def _doubles(*names: str) -> list[StructField]:
    return [StructField(n, DoubleType()) for n in names]


def sun_altitude(lat, lng, epoch):
    """Altitude of the sun in degrees, by numpy broadcasting; the same series as `solar.sun_position`."""
    d = epoch / 86400.0 - 10957.5
    m = (357.5291 + 0.98560028 * d) * RAD
    lon = m + (1.9148 * np.sin(m) + 0.02 * np.sin(2 * m) + 0.0003 * np.sin(3 * m)) * RAD + 102.9372 * RAD + math.pi
    dec, ra = np.arcsin(np.sin(lon) * math.sin(OBLIQUITY)), np.arctan2(np.sin(lon) * math.cos(OBLIQUITY), np.cos(lon))
    ha, phi = (280.16 + 360.9856235 * d) * RAD + lng * RAD - ra, lat * RAD
    return np.arcsin(np.sin(phi) * np.sin(dec) + np.cos(phi) * np.cos(dec) * np.cos(ha)) / RAD


class RadianceGrid:
    """(site_id, south, north, west, east), metres, first day, last day, days -> site_id, row, col, lat, lng, avg_hours.

    Row 0 is southernmost. A row of cells is worked on at a time, so an area of any size fits. An area with a null bound has no cells.
    """

    @staticmethod
    def analyze(areas: AnalyzeArgument, metres: AnalyzeArgument, first: AnalyzeArgument, last: AnalyzeArgument, days: AnalyzeArgument) -> AnalyzeResult:
        types = _columns(areas, "radiance_grid", ["site_id", "south", "north", "west", "east"])
        return AnalyzeResult(StructType([StructField("site_id", types["site_id"]), StructField("row", IntegerType()), StructField("col", IntegerType()), *_doubles("lat", "lng", "avg_hours")]))

    def eval(self, area, metres, first, last, days):
        south, north, west, east = area["south"], area["north"], area["west"], area["east"]
        if None in (south, north, west, east):
            return
        cells = lambda side: max(math.ceil(round(side / float(metres), 9)), 1)
        w, h = cells((east - west) * METRES_PER_DEGREE * math.cos((south + north) / 2 * RAD)), cells((north - south) * METRES_PER_DEGREE)
        start, span = datetime.date.fromisoformat(str(first)), (datetime.date.fromisoformat(str(last)) - datetime.date.fromisoformat(str(first))).days
        offsets = [math.floor((i + 0.5) / days * span) for i in range(days)] if days > 0 and span > 0 else [0]
        noon = (start - datetime.date(1970, 1, 1)).days
        epochs = ((noon + np.array(offsets, float))[:, None] * 86400.0 + np.arange(SAMPLES) * 300.0).ravel()
        lng = west + (np.arange(w) + 0.5) / w * (east - west)
        for r in range(h):
            lat = south + (r + 0.5) / h * (north - south)
            for at in range(0, w, 256):
                up = np.round(sun_altitude(lat, lng[at : at + 256, None], epochs), 9) > 0
                for c, n in enumerate(up.sum(axis=1).tolist(), at):
                    yield area["site_id"], r, c, lat, float(lng[c]), n * 5.0 / 60.0 / len(offsets)


class MeasureGaps:
    """(scan_id, cluster_id, cx, cy, spread_ft and the ground's nx, ny, nz, d), feet -> the gaps of each scan's features.

    The function itself asks for a scan at a time in order of cx, so that only features within reach of the
    last one are kept, however many a scan has. Features without a place are in no gap.
    """

    @staticmethod
    def analyze(features: AnalyzeArgument, max_ft: AnalyzeArgument) -> AnalyzeResult:
        types = _columns(features, "measure_gaps", ["scan_id", "cluster_id", "cx", "cy", "spread_ft", "nx", "ny", "nz", "d"])
        schema = [StructField("scan_id", types["scan_id"]), StructField("feature_a", types["cluster_id"]), StructField("feature_b", types["cluster_id"])]
        schema += _doubles("distance_ft", "clear_width_ft", "clear_length_ft", "area_sqft", "ground_ft")
        return AnalyzeResult(StructType(schema), partitionBy=[PartitioningColumn("scan_id")], orderBy=[OrderingColumn("cx")])

    def __init__(self):
        self.near = []

    def eval(self, f, max_ft):
        if f["cx"] is None or f["cy"] is None:
            return
        max_ft = float(max_ft)
        self.near = [g for g in self.near if (f["cx"] - g["cx"]) * FEET_PER_METRE <= max_ft * (1 + 1e-9)]
        for g in self.near:
            a, b = (f, g) if f["cluster_id"] < g["cluster_id"] else (g, f)
            distance = math.hypot(a["cx"] - b["cx"], a["cy"] - b["cy"]) * FEET_PER_METRE
            width = distance - (a["spread_ft"] / 2 + b["spread_ft"] / 2)
            if round(distance, 9) > max_ft or round(width, 9) <= 0:
                continue
            length = min(a["spread_ft"], b["spread_ft"])
            mx, my = (a["cx"] + b["cx"]) / 2, (a["cy"] + b["cy"]) / 2
            ground = 0.0 if abs(f["nz"]) < 1e-6 else -((f["nx"] * mx + f["ny"] * my + f["d"]) / f["nz"]) * FEET_PER_METRE
            yield f["scan_id"], a["cluster_id"], b["cluster_id"], distance, width, length, width * length, ground
        self.near.append(f)


class ExtrudeZone:
    """(zone_id, ring, kind, height_inches) -> zone_id, face and its corners ax ay az ... cz in feet, z up; no rows for a ring without a face."""

    @staticmethod
    def analyze(zones: AnalyzeArgument) -> AnalyzeResult:
        types = _columns(zones, "extrude_zone", ["zone_id", "ring", "kind", "height_inches"])
        return AnalyzeResult(StructType([StructField("zone_id", types["zone_id"]), StructField("face", IntegerType()), *_doubles(*(p + d for p in "abc" for d in "xyz"))]))

    def eval(self, zone):
        pos, tris = solid([(p["x"], p["y"]) for p in zone["ring"] or []], zone["kind"], zone["height_inches"])
        key = zone["zone_id"]
        for n, (a, b, c) in enumerate(tris):
            yield key, n, *pos[a], *pos[b], *pos[c]


FUNCTIONS = {"radiance_grid": RadianceGrid, "measure_gaps": MeasureGaps, "extrude_zone": ExtrudeZone}


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session's SQL."""
    for name, cls in FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls))

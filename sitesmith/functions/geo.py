"""Planar geometry over rings: arrays of struct<x double, y double>, closed (first point repeated) and in feet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"
POLYGON = f"struct<exterior:{RING},holes:array<{RING}>>"
FEET_PER_METRE = 3.28084


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, Column) else x.cast("double").alias("x"),
                    F.lit(y).cast("double").alias("y") if not isinstance(y, Column) else y.cast("double").alias("y"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def close_ring(ring: Column) -> Column:
    """Repeats the first point at the end unless it is there already."""
    done = F.size(ring) == 0
    same = F.element_at(ring, 1) == F.element_at(ring, -1)
    return F.when(done | ring.isNull(), ring).when(same & (F.size(ring) > 1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def open_ring(ring: Column) -> Column:
    same = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.when(same, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def _fold(ring: Column, term) -> Column:
    n = F.size(ring)
    pairs = F.zip_with(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), term)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def ring_area(ring: Column) -> Column:
    """Unsigned shoelace area; 0 for null or fewer than four points of a closed ring."""
    return F.when(F.size(ring) >= 4, F.abs(_fold(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2.0).otherwise(0.0)


def ring_perimeter(ring: Column) -> Column:
    step = lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
    return F.when(F.size(ring) >= 2, _fold(ring, step)).otherwise(0.0)


def area_sqft(polygon: Column) -> Column:
    """Exterior less holes."""
    holes = F.aggregate(F.coalesce(polygon["holes"], F.array().cast(f"array<{RING}>")), F.lit(0.0), lambda s, h: s + ring_area(h))
    return F.abs(ring_area(polygon["exterior"]) - holes)


def perimeter_ft(polygon: Column) -> Column:
    """Of the exterior ring only."""
    return ring_perimeter(polygon["exterior"])


def multi_area_sqft(polygons: Column) -> Column:
    return F.aggregate(polygons, F.lit(0.0), lambda s, p: s + area_sqft(p))


def multi_perimeter_ft(polygons: Column) -> Column:
    return F.aggregate(polygons, F.lit(0.0), lambda s, p: s + perimeter_ft(p))


def volume_cuft(area: Column, depth_inches: Column) -> Column:
    return area * (depth_inches / 12.0)


def volume_cuyd(area: Column, depth_inches: Column) -> Column:
    return volume_cuft(area, depth_inches) / 27.0


def contains(ring: Column, px: Column, py: Column) -> Column:
    """Ray casting: an odd number of edges crosses the ray to the right."""
    def crossing(a, b):
        straddles = (a["y"] > py) != (b["y"] > py)
        at = (b["x"] - a["x"]) * (py - a["y"]) / F.when(b["y"] == a["y"], None).otherwise(b["y"] - a["y"]) + a["x"]
        return F.when(straddles & (px < at), 1.0).otherwise(0.0)
    return (_fold(ring, crossing) % 2) == 1


def nearest_vertex(ring: Column, px: Column, py: Column) -> Column:
    """struct<d2, i>: squared distance and 0-based place of the nearest vertex, the first of equals."""
    ds = F.transform(ring, lambda p, i: F.struct(((p["x"] - px) * (p["x"] - px) + (p["y"] - py) * (p["y"] - py)).alias("d2"), i.alias("i")))
    return F.array_min(ds)


def to_geojson(ring: Column) -> Column:
    """A Polygon geometry as text."""
    coords = F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")))


def from_geojson(text: Column) -> Column:
    """Polygon geometry text -> struct<exterior, holes>; null for other types or bad text."""
    g = F.from_json(text, "type string, coordinates array<array<array<double>>>")
    points = lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))

    def polygon(g):
        rings = g["coordinates"]
        n = F.size(rings)
        holes = F.transform(F.slice(rings, 2, F.greatest(n - 1, F.lit(0))), points)
        return F.when((g["type"] == "Polygon") & (n > 0), F.struct(points(F.get(rings, F.lit(0))).alias("exterior"), holes.alias("holes")))

    # the variable of a lambda is the text parsed once, however often it is used
    return F.get(F.transform(F.array(g), polygon), F.lit(0))


def gap_rectangle(ax: Column, ay: Column, bx: Column, by: Column, length_ft: Column, width_ft: Column) -> Column:
    """A rectangle in feet at the midpoint of two points in metres, its length across and its width along their line."""
    ax, ay, bx, by = (c * FEET_PER_METRE for c in (ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    size = F.sqrt(dx * dx + dy * dy)
    ux = F.when(size > 1e-6, dx / size).otherwise(1.0)
    uy = F.when(size > 1e-6, dy / size).otherwise(0.0)
    mx, my, hw, hl = (ax + bx) / 2, (ay + by) / 2, width_ft / 2, length_ft / 2
    corner = lambda s, t: point(mx + s * hw * ux - t * hl * uy, my + s * hw * uy + t * hl * ux)
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))


def rect_union_area(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    return (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - rect_overlap_area(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1)


def rect_overlap_area(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    zero = F.lit(0.0)
    return F.greatest(F.least(ax1, bx1) - F.greatest(ax0, bx0), zero) * F.greatest(F.least(ay1, by1) - F.greatest(ay0, by0), zero)


def near_first_vertex(ring: Column, px: Column, py: Column, threshold: float) -> Column:
    """Whether a point would close an open ring of three vertices or more."""
    p = F.get(ring, F.lit(0))
    d2 = (p["x"] - px) * (p["x"] - px) + (p["y"] - py) * (p["y"] - py)
    return (F.size(ring) >= 3) & F.coalesce(F.sqrt(d2) <= threshold, F.lit(False))

"""Sources about a site as tables: geocodes, parcels and tree canopy, each looked up by a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesmith.functions import geo, text
from sitesmith.operators.joins import radius_join

# Degrees to a foot at the known site, and how near in degrees a parcel has to be.
FEET_PER_LAT, FEET_PER_LNG = 364_567.0, 290_854.0
NEAR_DEGREES = 0.005


def geocoded(sites: DataFrame, geocodes: DataFrame, address: str = "address") -> DataFrame:
    """sites with lat and lng of their address; geocodes (address, lat, lng) are compared without case and runs of white space. Unknown addresses give nulls."""
    known = geocodes.select(text.normalize_address(F.col("address")).alias("__norm"), "lat", "lng").dropDuplicates(["__norm"])
    return sites.withColumn("__norm", text.normalize_address(F.col(address))).join(known, "__norm", "left").drop("__norm")


def not_geocoded(sites: DataFrame) -> DataFrame:
    """Sites whose address no geocode has: the error rows of a lookup."""
    return sites.where("lat is null or lng is null")


def near(sites: DataFrame, parcels: DataFrame, degrees: float = NEAR_DEGREES) -> DataFrame:
    """Pairs (a: site, b: parcel) less than `degrees` apart in latitude and in longitude, by an equi-join of cells."""
    half = degrees * 2**0.5
    j = radius_join(sites.withColumns({"y": F.col("lat"), "x": F.col("lng")}), parcels.withColumns({"y": F.col("lat"), "x": F.col("lng")}), half, ["x", "y"])
    return j.where((F.abs(F.col("a.lat") - F.col("b.lat")) < degrees) & (F.abs(F.col("a.lng") - F.col("b.lng")) < degrees)).select("a", "b")


def lot_ring(lat: Column, lng: Column, width_ft: float = 25.0, depth_ft: float = 120.0) -> Column:
    """A rectangular lot around a point, in degrees (x is longitude)."""
    w, d = F.lit(width_ft / 2) * F.lit(1.0 / FEET_PER_LNG), F.lit(depth_ft / 2) * F.lit(1.0 / FEET_PER_LAT)
    return geo.rectangle(lng - w, lat - d, lng + w, lat + d)


def canopy_within(boxes: DataFrame, trees: DataFrame, key: str) -> DataFrame:
    """(key, south, north, west, east) and trees (lat, lng, height_ft, spread_ft, confidence) -> key, trees: an array in order of height.

    Boxes of some hundred metres meet the trees in cells of a hundredth of a degree: an equi-join, no pair outside a box's cells.
    """
    size = 0.01
    cell = lambda c: F.floor(c / size).cast("long")
    b = boxes.withColumn("cy", F.explode(F.sequence(cell(F.col("south")), cell(F.col("north"))))).withColumn("cx", F.explode(F.sequence(cell(F.col("west")), cell(F.col("east")))))
    t = trees.withColumns({"cy": cell(F.col("lat")), "cx": cell(F.col("lng"))})
    j = b.join(t, ["cy", "cx"]).where("lat > south and lat < north and lng > west and lng < east")
    return j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("height_ft", "spread_ft", "confidence"))).alias("trees"))


def baseline_summary(baselines: DataFrame) -> DataFrame:
    """(site_id, lot_sqft, trees, sun array<double>) -> site_id, lot_sqft, trees, avg_sun_hours: 0 where there is no sun value."""
    total = F.aggregate("sun", F.lit(0.0), lambda s, x: s + x)
    return baselines.select("site_id", "lot_sqft", "trees", F.when(F.size("sun") > 0, total / F.size("sun")).otherwise(0.0).alias("avg_sun_hours"))


def plan_view_analysis(features: DataFrame, lots: DataFrame) -> DataFrame:
    """A rule-made analysis of each lot's classified features: counts by category, the share of the lot that they cover and what is left.

    Stands in for a language model's reading of the plan view; (site_id, category, area_sqft) and (site_id, lot_sqft).
    """
    by = features.groupBy("site_id").agg(F.count("*").alias("features"), F.count_if(F.col("category").isin("tree", "planting")).alias("plants"), F.sum("area_sqft").alias("covered_sqft"))
    j = lots.select("site_id", "lot_sqft").join(by, "site_id", "left").fillna({"features": 0, "plants": 0, "covered_sqft": 0.0})
    return j.withColumn("open_sqft", F.greatest(F.col("lot_sqft") - F.col("covered_sqft"), F.lit(0.0)))

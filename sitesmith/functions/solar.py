"""Sun position, sun hours and radiance grids, as column expressions over UTC times."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAD = math.pi / 180.0
OBLIQUITY = 23.4393 * RAD
SAMPLES = 288
METRES_PER_DEGREE = 111_320.0
FULL_SUN, PART_SUN, PART_SHADE = 6.0, 4.0, 2.0


def days_since_j2000(epoch_seconds: Column) -> Column:
    return epoch_seconds / 86400.0 - 10957.5


def _longitude(d: Column) -> Column:
    m = (357.5291 + 0.98560028 * d) * RAD
    centre = (1.9148 * F.sin(m) + 0.02 * F.sin(2.0 * m) + 0.0003 * F.sin(3.0 * m)) * RAD
    return m + centre + 102.9372 * RAD + math.pi


def equatorial(d: Column) -> tuple[Column, Column]:
    """Declination and right ascension, in radians."""
    lon = _longitude(d)
    return F.asin(F.sin(lon) * math.sin(OBLIQUITY)), F.atan2(F.sin(lon) * math.cos(OBLIQUITY), F.cos(lon))


def sun_position(lat: Column, lng: Column, epoch_seconds: Column) -> tuple[Column, Column]:
    """Altitude, and azimuth clockwise from north in [0, 360), in degrees."""
    d = days_since_j2000(epoch_seconds)
    dec, ra = equatorial(d)
    ha = (280.16 + 360.9856235 * d) * RAD + lng * RAD - ra
    phi = lat * RAD
    altitude = F.asin(F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(ha)) / RAD
    azimuth = (F.atan2(F.sin(ha), F.cos(ha) * F.sin(phi) - F.tan(dec) * F.cos(phi)) + math.pi) / RAD
    return altitude, F.pmod(azimuth, F.lit(360.0))


def daily_sun(days: DataFrame, keys: list[str], lat: str = "lat", lng: str = "lng", day: str = "day") -> DataFrame:
    """Per key and UTC day: sun_hours (five-minute samples with the sun up), midnight_sun and polar_night.

    The samples are an explode of fixed size and meet in a partial sum, so their number never
    travels. The altitude is compared after rounding to 9 places.
    """
    s = days.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))))
    epoch = F.unix_timestamp(F.col(day).cast("timestamp")).cast("double") + F.col("__s") * 300.0
    up = F.round(sun_position(F.col(lat), F.col(lng), epoch)[0], 9) > 0
    out = s.groupBy(*keys, day).agg(F.sum(up.cast("long")).alias("n"))
    return out.select(
        *keys, day, (F.col("n") * 5.0 / 60.0).alias("sun_hours"), (F.col("n") == SAMPLES).alias("midnight_sun"), (F.col("n") == 0).alias("polar_night")
    )


def seasonal_summary(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Over daily_sun() rows: average, least and most hours, polar day counts and days."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return daily.groupBy(*keys).agg(
        z(F.avg("sun_hours")).alias("avg_hours"), z(F.min("sun_hours")).alias("min_hours"), z(F.max("sun_hours")).alias("max_hours"),
        F.sum(F.col("midnight_sun").cast("long")).alias("midnight_sun_days"), F.sum(F.col("polar_night").cast("long")).alias("polar_night_days"), F.count("*").alias("days"),
    )


def grid_dimensions(south: Column, north: Column, west: Column, east: Column, metres: float) -> tuple[Column, Column]:
    """Cells across and up, at least one each."""
    scale = METRES_PER_DEGREE * F.cos((south + north) / 2.0 * RAD)
    size = lambda c: F.greatest(F.ceil(F.round(c / metres, 9)), F.lit(1)).cast("int")
    return size((east - west) * scale), size((north - south) * METRES_PER_DEGREE)


def sample_dates(start: Column, end: Column, count: int) -> Column:
    """Middles of `count` equal parts of a range; the start alone for an empty range or no count."""
    days = F.datediff(end, start)
    if count <= 0:
        return F.array(start)
    many = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.date_add(start, F.floor((i + 0.5) / count * days).cast("int")))
    return F.when(days <= 0, F.array(start)).otherwise(many)


def radiance_grid(areas: DataFrame, keys: list[str], metres: float = 50.0, start: str = "2024-03-01", end: str = "2024-09-30", count: int = 6) -> DataFrame:
    """(south, north, west, east) per key -> row, col, lat, lng, avg_hours of each cell; row 0 is southernmost. No shade is modelled."""
    w, h = grid_dimensions(F.col("south"), F.col("north"), F.col("west"), F.col("east"), metres)
    cells = areas.withColumn("w", w).withColumn("h", h)
    cells = cells.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    cells = cells.withColumn("lat", F.col("south") + (F.col("row") + 0.5) / F.col("h") * (F.col("north") - F.col("south")))
    cells = cells.withColumn("lng", F.col("west") + (F.col("col") + 0.5) / F.col("w") * (F.col("east") - F.col("west")))
    cells = cells.withColumn("day", F.explode(sample_dates(F.lit(start).cast("date"), F.lit(end).cast("date"), count)))
    daily = daily_sun(cells, [*keys, "row", "col", "lat", "lng"])
    return daily.groupBy(*keys, "row", "col", "lat", "lng").agg(F.avg("sun_hours").alias("avg_hours"))


def light_category(hours: Column) -> Column:
    return F.when(hours >= FULL_SUN, "full_sun").when(hours >= PART_SUN, "part_sun").when(hours >= PART_SHADE, "part_shade").otherwise("full_shade")


def light_label(category: Column) -> Column:
    return F.initcap(F.replace(category, F.lit("_"), F.lit(" ")))


def light_range(category: Column) -> Column:
    return F.when(category == "full_sun", "6+ hours").when(category == "part_sun", "4-6 hours").when(category == "part_shade", "2-4 hours").otherwise("<2 hours")


def baseline_bounds(lat: Column, lng: Column, metres: float = 100.0) -> tuple[Column, Column, Column, Column]:
    """south, north, west, east of the box within `metres` of a place."""
    dlat, dlng = metres / METRES_PER_DEGREE, metres / (METRES_PER_DEGREE * F.cos(lat * RAD))
    return lat - dlat, lat + dlat, lng - dlng, lng + dlng

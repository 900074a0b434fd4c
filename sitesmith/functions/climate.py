"""Frost dates, hardiness and Sunset zones and growing seasons by latitude bands and rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values. Bands of abs(latitude), [from, to): (from, to, coastal days, last spring day, first fall day).
FROST_NORTH = [
    (20.0, 25.0, -5, 32, 350), (25.0, 27.5, -7, 45, 335), (27.5, 30.0, -7, 60, 320), (30.0, 32.5, -7, 75, 305),
    (32.5, 35.0, -10, 90, 295), (35.0, 37.5, -10, 100, 285), (37.5, 40.0, -10, 110, 275), (40.0, 42.5, -10, 120, 265),
    (42.5, 45.0, -10, 130, 255), (45.0, 47.5, -10, 140, 250), (47.5, 50.0, -10, 145, 245), (50.0, 52.5, -10, 150, 240),
    (52.5, 55.0, -10, 155, 235), (55.0, 60.0, -7, 160, 230), (60.0, 70.0, -5, 170, 220),
]
FROST_SOUTH = [
    (20.0, 25.0, -5, 244, 166), (25.0, 30.0, -7, 258, 152), (30.0, 35.0, -7, 273, 135), (35.0, 40.0, -10, 288, 121),
    (40.0, 50.0, -10, 305, 105), (50.0, 60.0, -5, 320, 91),
]
FROST_VARIANCE_DAYS = 14
# (from, to, least winter temperature in F, coastal degrees).
COLD_NORTH = [
    (20.0, 25.0, 40.0, 5.0), (25.0, 27.5, 30.0, 8.0), (27.5, 30.0, 22.0, 10.0), (30.0, 32.5, 15.0, 10.0), (32.5, 35.0, 8.0, 15.0),
    (35.0, 37.5, 0.0, 15.0), (37.5, 40.0, -8.0, 15.0), (40.0, 42.5, -12.0, 18.0), (42.5, 45.0, -18.0, 22.0), (45.0, 47.5, -25.0, 35.0),
    (47.5, 50.0, -30.0, 35.0), (50.0, 52.5, -35.0, 55.0), (52.5, 55.0, -40.0, 55.0), (55.0, 60.0, -45.0, 45.0), (60.0, 70.0, -50.0, 35.0),
]
COLD_SOUTH = [
    (20.0, 25.0, 40.0, 5.0), (25.0, 30.0, 28.0, 8.0), (30.0, 35.0, 18.0, 10.0), (35.0, 40.0, 8.0, 12.0), (40.0, 50.0, -5.0, 15.0),
    (50.0, 60.0, -25.0, 10.0), (60.0, 70.0, -45.0, 5.0),
]
COLD_TROPICS = (50.0, 5.0)
# Rectangles in order of precedence: (south, north, west, east, zone).
SUNSET = [
    (37.55, 37.82, -122.52, -122.38, 17), (37.35, 37.55, -122.52, -122.38, 17), (37.75, 37.90, -122.38, -122.20, 16),
    (37.55, 37.75, -122.45, -122.20, 16), (37.82, 37.95, -122.30, -122.10, 16), (37.20, 37.55, -122.10, -121.70, 15),
    (37.30, 37.50, -122.10, -121.85, 15), (37.50, 37.70, -122.15, -121.90, 15), (37.65, 38.05, -122.10, -121.60, 14),
    (37.55, 37.75, -121.95, -121.60, 14),
]
CELL = 2.5
_TROPIC = 20.0


def band_table(spark: SparkSession, north: list[tuple], south: list[tuple], columns: str) -> DataFrame:
    """Bands cut into cells of 2.5 degrees, keyed by hemisphere and cell: a lookup by equality instead of by range."""
    rows = []
    for is_north, bands in ((True, north), (False, south)):
        for low, high, *values in bands:
            rows += [(is_north, int(i), *values) for i in range(int(low / CELL), int(high / CELL))]
    return spark.createDataFrame(rows, f"north boolean, cell int, {columns}")


def band_join(sites: DataFrame, bands: DataFrame, north: list[tuple], south: list[tuple], lat: str = "lat") -> DataFrame:
    """Left join of sites to their band; latitudes beyond the last band take it. Bands are a few dozen fixed rows."""
    last = lambda b: int(b[-1][1] / CELL) - 1
    is_north = F.col(lat) >= 0
    cell = F.least(F.floor(F.abs(F.col(lat)) / CELL).cast("int"), F.when(is_north, last(north)).otherwise(last(south)))
    keyed = sites.withColumn("north", is_north).withColumn("cell", cell)
    return keyed.join(F.broadcast(bands), ["north", "cell"], "left").drop("north", "cell")


def _day_range(median: Column) -> Column:
    return F.struct(
        F.greatest(median - FROST_VARIANCE_DAYS, F.lit(1)).alias("early"), median.alias("median"), F.least(median + FROST_VARIANCE_DAYS, F.lit(366)).alias("late")
    )


def with_frost_dates(sites: DataFrame) -> DataFrame:
    """(lat, elev, coastal) -> with spring and fall, structs of early, median and late day of year, and confidence."""
    bands = band_table(sites.sparkSession, FROST_NORTH, FROST_SOUTH, "coastal_days int, spring_day int, fall_day int")
    j = band_join(sites, bands, FROST_NORTH, FROST_SOUTH)
    shift = F.when(F.col("elev") > 0, F.round(F.col("elev") / 300.0 * 4.0)).otherwise(0).cast("int")
    coast = F.when(F.col("coastal"), F.col("coastal_days")).otherwise(0)
    clamp = lambda c: F.least(F.greatest(c, F.lit(1)), F.lit(366))
    tropic = F.abs(F.col("lat")) < _TROPIC
    fixed = lambda e, m, late: F.struct(F.lit(e).alias("early"), F.lit(m).alias("median"), F.lit(late).alias("late"))
    return j.select(
        *sites.columns,
        F.when(tropic, fixed(1, 15, 32)).otherwise(_day_range(clamp(F.col("spring_day") + shift + coast))).alias("spring"),
        F.when(tropic, fixed(335, 350, 366)).otherwise(_day_range(clamp(F.col("fall_day") - shift - coast))).alias("fall"),
        F.when(tropic | ~F.abs(F.col("lat")).between(25.0, 55.0), "low").otherwise("medium").alias("confidence"),
    )


def with_hardiness(sites: DataFrame) -> DataFrame:
    """(lat, elev, coastal) -> with min_temp_f, zone (1..13), subzone (a or b) and zone_label."""
    bands = band_table(sites.sparkSession, COLD_NORTH, COLD_SOUTH, "least_f double, coast_f double")
    j = band_join(sites, bands, COLD_NORTH, COLD_SOUTH)
    tropic = F.abs(F.col("lat")) < _TROPIC
    base = F.when(tropic, COLD_TROPICS[0]).otherwise(F.col("least_f"))
    coast = F.when(F.col("coastal"), F.when(tropic, COLD_TROPICS[1]).otherwise(F.col("coast_f"))).otherwise(0.0)
    high = F.when(F.col("elev") > 0, F.col("elev") / 300.0 * 3.5).otherwise(0.0)
    j = j.select(*sites.columns, (base + coast - high).alias("min_temp_f"))
    zone = F.least(F.greatest(F.floor((F.col("min_temp_f") + 60.0) / 10.0).cast("int") + 1, F.lit(1)), F.lit(13))
    sub = F.when(F.pmod(F.col("min_temp_f") + 60.0, F.lit(10.0)) < 5.0, "a").otherwise("b")
    return j.withColumn("zone", zone).withColumn("subzone", sub).withColumn("zone_label", F.concat(F.col("zone").cast("string"), "subzone"))


def sunset_zone(lat: Column, lng: Column) -> Column:
    """The first rectangle that holds the place, edges included; null outside."""
    out = None
    for south, north, west, east, zone in SUNSET:
        hit = lat.between(south, north) & lng.between(west, east)
        out = F.when(hit, zone) if out is None else out.when(hit, zone)
    return out


def season_days(spring: Column, fall: Column) -> Column:
    return F.when(fall >= spring, fall - spring).otherwise(366 - spring + fall)


def growing_season(spring: Column, fall: Column) -> Column:
    """From frost structs: typical, short and long days, frost-free start and end."""
    return F.struct(
        season_days(spring["median"], fall["median"]).alias("typical_days"), season_days(spring["late"], fall["early"]).alias("short_days"),
        season_days(spring["early"], fall["late"]).alias("long_days"), spring["median"].alias("frost_free_start"), fall["median"].alias("frost_free_end"),
    )


def climate_profile(sites: DataFrame) -> DataFrame:
    """Frost dates, hardiness, Sunset zone and growing season of sites (lat, lng, elev, coastal)."""
    out = with_hardiness(with_frost_dates(sites))
    return out.withColumn("sunset", sunset_zone(F.col("lat"), F.col("lng"))).withColumn("season", growing_season(F.col("spring"), F.col("fall")))

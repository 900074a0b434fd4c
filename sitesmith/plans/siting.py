"""Climate, sun and geometry queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesmith.functions import climate, geo, money, solar, text
from sitesmith.operators import joins, services, tables
from sitesmith.plans import bind

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _bands(name: str, north: list, south: list) -> str:
    rows = [f"({str(n).lower()}, {', '.join(str(float(v)) + '::DOUBLE' for v in b)}, {i == len(t) - 1})" for n, t in ((True, north), (False, south)) for i, b in enumerate(t)]
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(rows)}) v(north, low, high, {'cd, sp, fa' if len(north[0]) == 5 else 'tf, cf'}, is_last))"


_ON = "ON north = (lat >= 0) AND abs(lat) >= low AND (abs(lat) < high OR is_last)"


def _frost(bay: bool = False) -> str:
    return f"""{bind.sites_sql(bay)}, {_bands('fb', climate.FROST_NORTH, climate.FROST_SOUTH)},
a AS (SELECT s.*, CASE WHEN elev > 0 THEN round(elev / 300.0::DOUBLE * 4.0::DOUBLE) ELSE 0 END::INT AS adj, CASE WHEN coastal THEN cd ELSE 0 END::INT AS co, sp::INT AS sp, fa::INT AS fa FROM s LEFT JOIN fb {_ON}),
b AS (SELECT *, least(greatest(sp + adj + co, 1), 366) AS spm, least(greatest(fa - adj - co, 1), 366) AS fam FROM a),
f AS (SELECT site_id, lat, lng, elev, coastal, CASE WHEN abs(lat) < 20 THEN 1 ELSE greatest(spm - 14, 1) END AS spring_early, CASE WHEN abs(lat) < 20 THEN 15 ELSE spm END AS spring_median,
 CASE WHEN abs(lat) < 20 THEN 32 ELSE least(spm + 14, 366) END AS spring_late, CASE WHEN abs(lat) < 20 THEN 335 ELSE greatest(fam - 14, 1) END AS fall_early,
 CASE WHEN abs(lat) < 20 THEN 350 ELSE fam END AS fall_median, CASE WHEN abs(lat) < 20 THEN 366 ELSE least(fam + 14, 366) END AS fall_late,
 CASE WHEN abs(lat) < 25 OR abs(lat) > 55 THEN 'low' ELSE 'medium' END AS confidence FROM b)"""


_HARD = f"""{_bands('hb', climate.COLD_NORTH, climate.COLD_SOUTH)},
ha AS (SELECT s.*, CASE WHEN abs(lat) < 20 THEN 50 ELSE tf END + CASE WHEN coastal THEN CASE WHEN abs(lat) < 20 THEN 5 ELSE cf END ELSE 0 END - CASE WHEN elev > 0 THEN elev / 300.0::DOUBLE * 3.5::DOUBLE ELSE 0 END AS tmin FROM s LEFT JOIN hb {_ON}),
hz AS (SELECT site_id, tmin, least(greatest(floor((tmin + 60) / 10)::INT + 1, 1), 13) AS zone, CASE WHEN (tmin + 60) - 10 * floor((tmin + 60) / 10) < 5 THEN 'a' ELSE 'b' END AS subzone FROM ha)"""
_SUNSET = "CASE " + " ".join(f"WHEN lat BETWEEN {s}::DOUBLE AND {n}::DOUBLE AND lng BETWEEN {w}::DOUBLE AND {e}::DOUBLE THEN {z}" for s, n, w, e, z in climate.SUNSET) + " END"
_DAYS = lambda a, b: f"CASE WHEN {b} >= {a} THEN {b} - {a} ELSE 366 - {a} + {b} END"


def _flat_frost(df: DataFrame) -> list:
    return [F.col(f"{s}.{p}").alias(f"{s}_{p}") for s in ("spring", "fall") for p in ("early", "median", "late")]


@query(f"WITH {_frost()} SELECT site_id, spring_early, spring_median, spring_late, fall_early, fall_median, fall_late, confidence FROM f")
def frost_dates(spark: SparkSession, d: str) -> DataFrame:
    df = climate.with_frost_dates(bind.sites(spark, d))
    return df.select("site_id", *_flat_frost(df), "confidence")


@query(f"WITH {bind.sites_sql()}, {_HARD} SELECT site_id, round(tmin, 6) AS min_temp_f, zone, subzone, zone::VARCHAR || subzone AS zone_label FROM hz")
def hardiness(spark: SparkSession, d: str) -> DataFrame:
    return climate.with_hardiness(bind.sites(spark, d)).select("site_id", F.round("min_temp_f", 6).alias("min_temp_f"), "zone", "subzone", "zone_label")


@query(f"WITH {bind.sites_sql(True)} SELECT site_id, {_SUNSET} AS sunset FROM s")
def sunset_zone(spark: SparkSession, d: str) -> DataFrame:
    return bind.sites(spark, d, True).select("site_id", climate.sunset_zone(F.col("lat"), F.col("lng")).alias("sunset"))


@query(f"WITH {_frost()} SELECT site_id, {_DAYS('spring_median', 'fall_median')} AS typical_days, {_DAYS('spring_late', 'fall_early')} AS short_days, {_DAYS('spring_early', 'fall_late')} AS long_days, spring_median AS frost_free_start, fall_median AS frost_free_end FROM f")
def growing_season(spark: SparkSession, d: str) -> DataFrame:
    df = climate.with_frost_dates(bind.sites(spark, d))
    return df.select("site_id", climate.growing_season(F.col("spring"), F.col("fall")).alias("s")).select("site_id", "s.*")


@query(f"WITH {_frost(True)}, {_HARD} SELECT site_id, spring_median, fall_median, confidence, zone::VARCHAR || subzone AS zone_label, {_SUNSET} AS sunset, {_DAYS('spring_median', 'fall_median')} AS typical_days FROM f JOIN hz USING (site_id)")
def climate_profile(spark: SparkSession, d: str) -> DataFrame:
    p = climate.climate_profile(bind.sites(spark, d, True))
    return p.select("site_id", F.col("spring.median").alias("spring_median"), F.col("fall.median").alias("fall_median"), "confidence", "zone_label", "sunset", F.col("season.typical_days").alias("typical_days"))


# --- sun ---
R = f"({math.pi!r}::DOUBLE / 180.0::DOUBLE)"


def _sun(src: str) -> str:
    """CTE 'p' with alt and az from rows of `src` (lat, lng, epoch)."""
    return f"""s1 AS (SELECT *, epoch / 86400.0::DOUBLE - 10957.5::DOUBLE AS dd FROM {src}), s2 AS (SELECT *, (357.5291::DOUBLE + 0.98560028::DOUBLE * dd) * {R} AS m FROM s1),
s3 AS (SELECT *, m + (1.9148::DOUBLE * sin(m) + 0.02::DOUBLE * sin(2 * m) + 0.0003::DOUBLE * sin(3 * m)) * {R} + 102.9372::DOUBLE * {R} + pi() AS l FROM s2),
s4 AS (SELECT *, asin(sin(l) * sin(23.4393::DOUBLE * {R})) AS de, (280.16::DOUBLE + 360.9856235::DOUBLE * dd) * {R} + lng * {R} - atan2(sin(l) * cos(23.4393::DOUBLE * {R}), cos(l)) AS ha, lat * {R} AS phi FROM s3),
p AS (SELECT *, asin(sin(phi) * sin(de) + cos(phi) * cos(de) * cos(ha)) / {R} AS alt, (atan2(sin(ha), cos(ha) * sin(phi) - tan(de) * cos(phi)) + pi()) / {R} AS az FROM s4)"""


_SITE = "st AS (SELECT n_nationkey AS site_id, (n_nationkey * 37 % 140)::DOUBLE - 70 AS lat, (n_nationkey * 91 % 360)::DOUBLE - 180 AS lng FROM nation)"
_DAILY = """dl AS (SELECT site_id, lat, lng, day, count(*) FILTER (WHERE round(alt, 9) > 0) AS n FROM p GROUP BY ALL),
dy AS (SELECT site_id, lat, lng, day, n * 5.0::DOUBLE / 60.0::DOUBLE AS sun_hours, n = 288 AS midnight_sun, n = 0 AS polar_night FROM dl)"""


def _days_sql(days: str) -> str:
    return f"{_SITE}, dd0 AS (SELECT st.*, day, epoch(day::TIMESTAMP) + i * 300.0::DOUBLE AS epoch FROM st, (SELECT unnest({days}) AS day), (SELECT unnest(range(288)) AS i))"


def _sites(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return bind.t(spark, d, "nation").select(k.alias("site_id"), ((k * 37 % 140).cast("double") - 70).alias("lat"), ((k * 91 % 360).cast("double") - 180).alias("lng"))


_SOLSTICES = "['2024-03-20'::DATE, '2024-06-20'::DATE, '2024-09-22'::DATE, '2024-12-21'::DATE]"


def _solstices(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.explode(F.array(*[F.lit(x).cast("date") for x in ("2024-03-20", "2024-06-20", "2024-09-22", "2024-12-21")])))


@query(f"""WITH ev AS (SELECT event_id, ((user_id * 37) % 140)::DOUBLE - 70 AS lat, ((user_id * 91) % 360)::DOUBLE - 180 AS lng, epoch(date_trunc('second', ts)) AS epoch FROM events), {_sun('ev')}
SELECT event_id, round(alt, 5) AS altitude, round(az, 5) AS azimuth FROM p""")
def sun_position(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    alt, az = solar.sun_position((u * 37 % 140).cast("double") - 70, (u * 91 % 360).cast("double") - 180, F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double"))
    return bind.t(spark, d, "events").select("event_id", F.round(alt, 5).alias("altitude"), F.round(az, 5).alias("azimuth"))


@query(f"WITH {_days_sql(_SOLSTICES)}, {_sun('dd0')}, {_DAILY} SELECT site_id, day, round(sun_hours, 6) AS sun_hours, midnight_sun, polar_night FROM dy")
def daily_sun_hours(spark: SparkSession, d: str) -> DataFrame:
    return solar.daily_sun(_solstices(_sites(spark, d)), ["site_id"]).withColumn("sun_hours", F.round("sun_hours", 6))


_WEEKS = "generate_series('2024-01-01'::TIMESTAMP, '2024-12-30'::TIMESTAMP, INTERVAL 14 DAY)::DATE[]"


@query(f"""WITH {_days_sql(_WEEKS)}, {_sun('dd0')}, {_DAILY}
SELECT site_id, round(avg(sun_hours), 6) AS avg_hours, round(min(sun_hours), 6) AS min_hours, round(max(sun_hours), 6) AS max_hours, count(*) FILTER (WHERE midnight_sun) AS midnight_sun_days, count(*) FILTER (WHERE polar_night) AS polar_night_days, count(*) AS days FROM dy GROUP BY site_id""")
def seasonal_sun(spark: SparkSession, d: str) -> DataFrame:
    s = _sites(spark, d).withColumn("day", F.explode(F.expr("sequence(DATE'2024-01-01', DATE'2024-12-30', INTERVAL 14 DAY)")))
    out = solar.seasonal_summary(solar.daily_sun(s, ["site_id"]), ["site_id"])
    return out.select("site_id", *[F.round(c, 6).alias(c) for c in ("avg_hours", "min_hours", "max_hours")], "midnight_sun_days", "polar_night_days", "days")


_YEAR = "generate_series('2024-01-01'::TIMESTAMP, '2024-12-31'::TIMESTAMP, INTERVAL 1 DAY)::DATE[]"


@query(f"""WITH {_days_sql(_YEAR)}, {_sun('dd0')}, {_DAILY}
SELECT site_id, round(sum(sun_hours), 5) AS hours, round(avg(sun_hours), 6) AS avg_hours, count(*) FILTER (WHERE midnight_sun) AS midnight_sun_days, count(*) FILTER (WHERE polar_night) AS polar_night_days, count(*) AS days FROM dy GROUP BY site_id""")
def annual_sun(spark: SparkSession, d: str) -> DataFrame:
    """Every day of a leap year, the last included."""
    s = _sites(spark, d).withColumn("day", F.explode(F.expr("sequence(DATE'2024-01-01', DATE'2024-12-31', INTERVAL 1 DAY)")))
    out = solar.seasonal_summary(solar.daily_sun(s, ["site_id"]), ["site_id"])
    return out.select("site_id", F.round(F.col("avg_hours") * F.col("days"), 5).alias("hours"), F.round("avg_hours", 6).alias("avg_hours"), "midnight_sun_days", "polar_night_days", "days")


@query(f"""WITH {_days_sql(_SOLSTICES)}, {_sun('dd0')}, {_DAILY}, c AS (SELECT site_id, day, CASE WHEN sun_hours >= 6 THEN 'full_sun' WHEN sun_hours >= 4 THEN 'part_sun' WHEN sun_hours >= 2 THEN 'part_shade' ELSE 'full_shade' END AS category FROM dy)
SELECT *, CASE category WHEN 'full_sun' THEN 'Full Sun' WHEN 'part_sun' THEN 'Part Sun' WHEN 'part_shade' THEN 'Part Shade' ELSE 'Full Shade' END AS label,
 CASE category WHEN 'full_sun' THEN '6+ hours' WHEN 'part_sun' THEN '4-6 hours' WHEN 'part_shade' THEN '2-4 hours' ELSE '<2 hours' END AS hours FROM c""")
def light_category(spark: SparkSession, d: str) -> DataFrame:
    c = solar.daily_sun(_solstices(_sites(spark, d)), ["site_id"]).select("site_id", "day", solar.light_category(F.col("sun_hours")).alias("category"))
    return c.select("*", solar.light_label(F.col("category")).alias("label"), solar.light_range(F.col("category")).alias("hours"))


_BOX = f"""bx AS (SELECT site_id, clat - 100.0::DOUBLE / 111320.0::DOUBLE AS south, clat + 100.0::DOUBLE / 111320.0::DOUBLE AS north, clng - 100.0::DOUBLE / (111320.0::DOUBLE * cos(clat * {R})) AS west, clng + 100.0::DOUBLE / (111320.0::DOUBLE * cos(clat * {R})) AS east FROM ct),
gr AS (SELECT *, greatest(ceil(round((east - west) * (111320.0::DOUBLE * cos((south + north) / 2 * {R})) / 50.0::DOUBLE, 9)), 1)::INT AS w, greatest(ceil(round((north - south) * 111320.0::DOUBLE / 50.0::DOUBLE, 9)), 1)::INT AS h FROM bx),
ce AS (SELECT site_id, r AS "row", c AS col, south + (r + 0.5::DOUBLE) / h * (north - south) AS lat, west + (c + 0.5::DOUBLE) / w * (east - west) AS lng FROM gr, (SELECT unnest(range(10)) AS r), (SELECT unnest(range(10)) AS c) WHERE r < h AND c < w),
dd0 AS (SELECT ce.*, day, epoch(day::TIMESTAMP) + i * 300.0::DOUBLE AS epoch FROM ce, (SELECT '2024-03-01'::DATE + floor((k + 0.5::DOUBLE) / 6 * 213)::INT AS day FROM (SELECT unnest(range(6)) AS k)), (SELECT unnest(range(288)) AS i))"""


def _boxes(df: DataFrame) -> DataFrame:
    s, n, w, e = solar.baseline_bounds(F.col("clat"), F.col("clng"))
    return df.select("site_id", s.alias("south"), n.alias("north"), w.alias("west"), e.alias("east"))


@query(f"""WITH ct AS (SELECT r_regionkey AS site_id, 37.7::DOUBLE + r_regionkey AS clat, -122.4::DOUBLE + r_regionkey AS clng FROM region), {_BOX}, {_sun('dd0')},
dl AS (SELECT site_id, "row", col, day, count(*) FILTER (WHERE round(alt, 9) > 0) * 5.0::DOUBLE / 60.0::DOUBLE AS h FROM p GROUP BY ALL)
SELECT site_id, "row", col, round(avg(h), 6) AS avg_hours FROM dl GROUP BY ALL""")
def radiance_grid(spark: SparkSession, d: str) -> DataFrame:
    c = bind.t(spark, d, "region").select(F.col("r_regionkey").alias("site_id"), (F.lit(37.7) + F.col("r_regionkey")).alias("clat"), (F.lit(-122.4) + F.col("r_regionkey")).alias("clng"))
    return solar.radiance_grid(_boxes(c), ["site_id"]).select("site_id", "row", "col", F.round("avg_hours", 6).alias("avg_hours"))


@query(f"""WITH ct AS (SELECT n_nationkey AS site_id, 30.7::DOUBLE + n_nationkey AS clat, -122.4::DOUBLE + n_nationkey AS clng FROM nation), {_BOX}, {_sun('dd0')},
dl AS (SELECT site_id, "row", col, day, count(*) FILTER (WHERE round(alt, 9) > 0) * 5.0::DOUBLE / 60.0::DOUBLE AS h FROM p GROUP BY ALL)
SELECT site_id, "row", col, round(avg(h), 6) AS avg_hours FROM dl GROUP BY ALL""")
def radiance_grid_sql(spark: SparkSession, d: str) -> DataFrame:
    """The grid around a site a nation, by the table function."""
    tables.register(spark)
    k = F.col("n_nationkey")
    c = bind.t(spark, d, "nation").select(k.alias("site_id"), (F.lit(30.7) + k).alias("clat"), (F.lit(-122.4) + k).alias("clng"))
    return spark.sql("SELECT site_id, `row`, col, round(avg_hours, 6) AS avg_hours FROM radiance_grid(TABLE({areas}), 50.0, '2024-03-01', '2024-09-30', 6)", areas=_boxes(c))


@query("SELECT o_orderkey AS id, [('2024-01-01'::DATE + (o_orderkey % 30)::INT) + floor((k + 0.5::DOUBLE) / 4 * (o_orderkey % 200))::INT FOR k IN range(CASE WHEN o_orderkey % 200 = 0 THEN 1 ELSE 4 END)] AS days FROM orders")
def sample_dates(spark: SparkSession, d: str) -> DataFrame:
    start = F.expr("date_add(DATE'2024-01-01', cast(o_orderkey % 30 as int))")
    return bind.t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), solar.sample_dates(start, F.date_add(start, (F.col("o_orderkey") % 200).cast("int")), 4).alias("days"))


_TREES = [(37.7602, -122.4861, 25.0, 15.0), (37.7600, -122.4864, 18.0, 12.0), (37.7603, -122.4863, 30.0, 20.0)]


@query(f"""WITH ad AS (SELECT c_custkey AS site_id, CASE WHEN c_custkey % 50 = 0 THEN '  1234 Noriega ST,  San Francisco, CA ' ELSE c_name END AS address FROM customer),
ct AS (SELECT site_id, {bind.SITE[0]}::DOUBLE AS clat, {bind.SITE[1]}::DOUBLE AS clng FROM ad WHERE trim(regexp_replace(lower(address), '\\s+', ' ', 'g')) = '{bind.ADDRESS}'), {_BOX}, {_sun('dd0')},
dl AS (SELECT site_id, "row", col, day, count(*) FILTER (WHERE round(alt, 9) > 0) * 5.0::DOUBLE / 60.0::DOUBLE AS h FROM p GROUP BY ALL), av AS (SELECT site_id, "row", col, avg(h) AS h FROM dl GROUP BY ALL)
SELECT site_id, round(avg(h), 5) AS avg_sun_hours, count(*) AS cells, 3::BIGINT AS trees, 3000.0::DOUBLE AS lot_sqft FROM av GROUP BY site_id""")
def site_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Known addresses -> lot, trees in the box and average sun of the grid around."""
    c = bind.t(spark, d, "customer").select(F.col("c_custkey").alias("site_id"), F.when(F.col("c_custkey") % 50 == 0, "  1234 Noriega ST,  San Francisco, CA ").otherwise(F.col("c_name")).alias("address"))
    known = spark.createDataFrame([(bind.ADDRESS, *bind.SITE)], "norm string, clat double, clng double")
    found = c.withColumn("norm", text.normalize_address(F.col("address"))).join(F.broadcast(known), "norm")
    # sun and trees are those of a place, however many sites are there
    places = _boxes(found.select(F.col("norm").alias("site_id"), "clat", "clng").distinct())
    grid = solar.radiance_grid(places, ["site_id"]).groupBy("site_id").agg(F.round(F.coalesce(F.avg("avg_hours"), F.lit(0.0)), 5).alias("avg_sun_hours"), F.count("*").alias("cells"))
    trees = spark.createDataFrame(_TREES, "tlat double, tlng double, height_ft double, spread_ft double")
    in_box = places.join(F.broadcast(trees), (F.col("tlat") > F.col("south")) & (F.col("tlat") < F.col("north")) & (F.col("tlng") > F.col("west")) & (F.col("tlng") < F.col("east"))).groupBy("site_id").agg(F.count("*").alias("trees"))
    at = grid.join(in_box, "site_id", "left").withColumnRenamed("site_id", "norm")
    ring = geo.rectangle(F.lit(-12.5), F.lit(-60.0), F.lit(12.5), F.lit(60.0))
    return found.select("site_id", "norm").join(at, "norm").select("site_id", "avg_sun_hours", "cells", F.coalesce("trees", F.lit(0)).cast("long").alias("trees"), geo.ring_area(ring).alias("lot_sqft"))


# --- services that fail ---
def _assessed(lat: float | None, lng: float | None) -> dict:
    """A county's record, as a service in Python would give it: none without a place, none north of a line."""
    if lat is None:
        return None
    if lat > 37.6:
        raise ValueError("outside the county")
    return {"width_ft": 30.0 + round(lat * 10) % 3, "depth_ft": 100.0}


@query("""WITH c AS (SELECT c_custkey AS site_id, c_custkey % 3 < 2 AS known, c_custkey % 3 = 2 AND c_custkey % 2 = 0 AS given, 37.0::DOUBLE + c_custkey % 10 / 10.0::DOUBLE AS lat FROM customer),
g AS (SELECT *, CASE WHEN known THEN 'table' WHEN given THEN 'given' END AS geocoder, CASE WHEN known OR given THEN lat END AS place FROM c)
SELECT site_id, geocoder, CASE WHEN known THEN 'live: no network' WHEN given THEN 'live: no network|table: unknown address' ELSE 'live: no network|table: unknown address|given: no coordinates' END AS geocode_errors,
 CASE WHEN place IS NULL THEN NULL WHEN place > 37.6 THEN 'rule' ELSE 'county' END AS assessor, CASE WHEN place IS NULL THEN 'county: no answer|rule: no place' WHEN place > 37.6 THEN 'county: ValueError: outside the county' ELSE '' END AS parcel_errors,
 CASE WHEN place > 37.6 THEN 3000 ELSE (30 + round(place * 10)::INT % 3) * 100 END::DOUBLE AS lot_sqft FROM g""")
def site_services(spark: SparkSession, d: str) -> DataFrame:
    """Geocodes from a service that is down, a table and what the request brings; lots from a Python service that refuses some places, else by rule. Every site keeps its row."""
    k = F.col("c_custkey")
    lat = F.lit(37.0) + k % 10 / 10.0
    sites = bind.t(spark, d, "customer").select(k.alias("site_id"), F.concat(F.lit("  "), F.upper("c_name"), F.lit("  Main St")).alias("address"), F.when((k % 3 == 2) & (k % 2 == 0), lat).alias("given_lat"))
    known = bind.t(spark, d, "customer").where("c_custkey % 3 < 2").select(lat.alias("lat"), F.lit(-122.4).alias("lng"), F.concat("c_name", F.lit(" main st")).alias("known"))
    norm = text.normalize_address
    table = services.Looked("table", known, norm(F.col("known")), norm(F.col("address")), "unknown address")
    given = services.Ruled("given", F.when(F.col("given_lat").isNotNull(), F.struct(F.col("given_lat").alias("lat"), F.lit(-122.4).alias("lng"), F.lit("").alias("known"))), "no coordinates")
    g = services.ask(sites, [services.Failing("live", "no network"), table, given], "struct<lat:double,lng:double,known:string>")
    g = g.select("site_id", F.col("service").alias("geocoder"), F.array_join("errors", "|").alias("geocode_errors"), F.round("result.lat", 6).alias("lat"), "result.lng")
    size = "width_ft double, depth_ft double"
    rule = services.Ruled("rule", F.when(F.col("lat").isNotNull(), F.struct(F.lit(25.0).alias("width_ft"), F.lit(120.0).alias("depth_ft"))), "no place")
    p = services.ask(g, [services.Called("county", _assessed, size, ["lat", "lng"]), rule], f"struct<{size.replace(' double', ':double')}>")
    return p.select("site_id", "geocoder", "geocode_errors", F.col("service").alias("assessor"), F.array_join("errors", "|").alias("parcel_errors"), (F.col("result.width_ft") * F.col("result.depth_ft")).alias("lot_sqft"))


_STYLES = ", ".join(f"('{c}', {i}, '{s}', '{p}', {w}::DOUBLE, {h}::DOUBLE)" for c, styles in services.PLANTERS.items() for i, (s, p, w, h) in enumerate(styles))


@query(f"""WITH r AS (SELECT p_partkey AS gap_id, (p_size % 20)::DOUBLE AS area, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 10)::DOUBLE END AS sun FROM part),
l AS (SELECT *, CASE WHEN sun IS NULL THEN 'part_shade' WHEN sun >= 6 THEN 'full_sun' WHEN sun >= 4 THEN 'part_sun' WHEN sun >= 2 THEN 'part_shade' ELSE 'full_shade' END AS light FROM r), s(light, i, style, plant, spacing, depth) AS (VALUES {_STYLES})
SELECT gap_id, CASE WHEN area > 0 THEN 'rules' END AS service, (CASE WHEN area > 0 THEN 1 ELSE 2 END)::INT AS failed, style, plant, floor(area / ((spacing / 12) * (spacing / 12)))::BIGINT AS plants, round(area * depth / 324, 6) AS soil_cuyd
FROM l LEFT JOIN s ON l.light = s.light AND area > 0""")
def planter_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Three styles for each gap by rule, after a service that is down; a gap without area keeps a row without a style."""
    k = F.col("p_partkey")
    gaps = bind.t(spark, d, "part").select(k.alias("gap_id"), (F.col("p_size") % 20).cast("double").alias("area_sqft"), F.when(k % 7 != 0, (k % 10).cast("double")).alias("sun_hours"))
    e = services.ask(gaps, [services.Failing("live", "no network"), services.estimate_planter()], services.ESTIMATE)
    e = e.select("gap_id", "service", F.size("errors").alias("failed"), "area_sqft", F.explode_outer("result").alias("s"))
    plants = F.when(F.col("s").isNotNull(), money.plant_count(F.col("area_sqft"), F.col("s.spacing")))
    return e.select("gap_id", "service", "failed", "s.style", "s.plant", plants.alias("plants"), F.round(money.soil_volume_cuyd(F.col("area_sqft"), F.col("s.depth")), 6).alias("soil_cuyd"))


# --- geometry ---
@query(f"WITH {bind.ZONES} SELECT zone_id, w * h AS area_sqft, 2 * (w + h) AS perimeter_ft, round(w * h * 4 / 12.0::DOUBLE, 6) AS volume_cuft, round(w * h * 4 / 12.0::DOUBLE / 27.0::DOUBLE, 6) AS volume_cuyd FROM z")
def zone_measures(spark: SparkSession, d: str) -> DataFrame:
    z = bind.measured(bind.zones(spark, d))
    return z.select("zone_id", F.col("area").alias("area_sqft"), F.col("perimeter").alias("perimeter_ft"), F.round(geo.volume_cuft(F.col("area"), F.lit(4.0)), 6).alias("volume_cuft"), F.round(geo.volume_cuyd(F.col("area"), F.lit(4.0)), 6).alias("volume_cuyd"))


@query(f"WITH {bind.ZONES} SELECT zone_id, w * h - (w / 2) * (h / 2) AS area, 2 * (w * h - (w / 2) * (h / 2)) AS multi_area, 4 * (w + h) AS multi_perimeter FROM z")
def polygon_with_hole(spark: SparkSession, d: str) -> DataFrame:
    """Zones with a rectangular hole of half their sides, alone and twice as a multipolygon."""
    z = bind.zones(spark, d)
    hole = geo.rectangle(F.col("w") / 4, F.col("h") / 4, F.col("w") * 3 / 4, F.col("h") * 3 / 4)
    p = F.struct(F.col("ring").alias("exterior"), F.array(hole).alias("holes"))
    return z.select("zone_id", geo.area_sqft(p).alias("area"), geo.multi_area_sqft(F.array(p, p)).alias("multi_area"), geo.multi_perimeter_ft(F.array(p, p)).alias("multi_perimeter"))


_PT = "(owner % 40)::DOUBLE + 0.25::DOUBLE AS px, (material_id % 20)::DOUBLE + 0.25::DOUBLE AS py"


def _probe(z: DataFrame) -> tuple:
    return (F.col("owner") % 40).cast("double") + 0.25, (F.col("material_id") % 20).cast("double") + 0.25


@query(f"WITH {bind.ZONES}, q AS (SELECT *, {_PT} FROM z) SELECT zone_id, px < w AND py < h AS inside FROM q")
def point_in_zone(spark: SparkSession, d: str) -> DataFrame:
    z = bind.zones(spark, d)
    return z.select("zone_id", geo.contains(F.col("ring"), *_probe(z)).alias("inside"))


@query(f"WITH {bind.ZONES}, q AS (SELECT *, {_PT} FROM z) SELECT project_id, max_by(zone_id, (material_id, zone_id)) AS top_zone FROM q WHERE px < w AND py < h GROUP BY project_id")
def top_zone_hit(spark: SparkSession, d: str) -> DataFrame:
    z = bind.zones(spark, d)
    return z.where(geo.contains(F.col("ring"), *_probe(z))).groupBy("project_id").agg(F.max_by("zone_id", F.struct("material_id", "zone_id")).alias("top_zone"))


@query(f"""WITH {bind.ZONES}, q AS (SELECT *, {_PT} FROM z), v AS (SELECT zone_id, [px * px + py * py, (px - w) * (px - w) + py * py, (px - w) * (px - w) + (py - h) * (py - h), px * px + (py - h) * (py - h)] AS ds FROM q)
SELECT zone_id, list_position(ds, list_min(ds)) - 1 AS vertex, list_min(ds) AS d2 FROM v""")
def nearest_vertex(spark: SparkSession, d: str) -> DataFrame:
    z = bind.zones(spark, d)
    v = geo.nearest_vertex(geo.open_ring(F.col("ring")), *_probe(z))
    return z.select("zone_id", v["i"].alias("vertex"), v["d2"].alias("d2"))


@query(f"WITH {bind.ZONES} SELECT zone_id, w * h AS area, 5 AS points, true AS same FROM z")
def geojson_round_trip(spark: SparkSession, d: str) -> DataFrame:
    z = bind.zones(spark, d).withColumn("g", geo.to_geojson(F.col("ring"))).withColumn("p", geo.from_geojson(F.col("g")))
    return z.select("zone_id", geo.area_sqft(F.col("p")).alias("area"), F.size("p.exterior").alias("points"), (F.col("p.exterior") == F.col("ring")).alias("same"))


@query(f"""WITH {bind.ZONES}, b AS (SELECT zone_id, w, h, (owner % 30)::DOUBLE AS ox, (material_id % 10)::DOUBLE AS oy FROM z),
o AS (SELECT *, greatest(least(w, ox + 10) - greatest(0, ox), 0) * greatest(least(h, oy + 8) - greatest(0, oy), 0) AS ov FROM b)
SELECT zone_id, w * h + 80 - ov AS union_area, w * h - ov AS difference_area FROM o""")
def rect_union_area(spark: SparkSession, d: str) -> DataFrame:
    z = bind.zones(spark, d)
    ox, oy, zero = (F.col("owner") % 30).cast("double"), (F.col("material_id") % 10).cast("double"), F.lit(0.0)
    args = (zero, zero, F.col("w"), F.col("h"), ox, oy, ox + 10, oy + 8)
    return z.select("zone_id", geo.rect_union_area(*args).alias("union_area"), (F.col("w") * F.col("h") - geo.rect_overlap_area(*args)).alias("difference_area"))


@query("""WITH b(name, low, high) AS (VALUES ('small', 900.0::DOUBLE, 950.0::DOUBLE), ('mid', 950.0::DOUBLE, 1100.0::DOUBLE), ('big', 1500.0::DOUBLE, 2500.0::DOUBLE))
SELECT p_partkey AS id, name AS band FROM part LEFT JOIN b ON p_retailprice >= low AND p_retailprice < high""")
def band_lookup(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame([("small", 900.0, 950.0), ("mid", 950.0, 1100.0), ("big", 1500.0, 2500.0)], "name string, low double, high double")
    return joins.band_join(bind.t(spark, d, "part"), bands, "p_retailprice", cell=50.0).select(F.col("p_partkey").alias("id"), F.col("name").alias("band"))

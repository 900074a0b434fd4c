"""Queries of listings, inserts, ownership, site sources, scenes, documents and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesmith.functions import codes, geo, text
from sitesmith.operators import mesh, points, quote, reconcile, site, store
from sitesmith.operators.graph import shared_path
from sitesmith.plans import bind
from sitesmith.plans.quoting import ROLLUP, TOTALS, _items, _priced

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


AT = "2024-06-01 00:00:00"


def _at():
    return F.lit(AT).cast("timestamp")


# --- listings ---
def _tenants(spark, d):
    return bind.t(spark, d, "customer").select(F.col("c_custkey").alias("tenant_id"), F.col("c_name").alias("name"))


@query("SELECT c_custkey AS tenant_id, c_name AS name FROM customer WHERE c_custkey = 7 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey = -1")
def tenant_by_id(spark: SparkSession, d: str) -> DataFrame:
    """One tenant, and an id that nobody has, which gives no row."""
    t = _tenants(spark, d)
    return store.by_id(t, "tenant_id", 7).unionByName(store.by_id(t, "tenant_id", -1))


@query(f"WITH {bind.materials_sql()} SELECT material_id % 10 AS tenant_id, material_id, name, unit, price, row_number() OVER (PARTITION BY material_id % 10 ORDER BY name, material_id)::INT AS place FROM m")
def materials_by_tenant(spark: SparkSession, d: str) -> DataFrame:
    """Every tenant's materials in order of name."""
    m = bind.materials(spark, d).withColumn("tenant_id", F.col("material_id") % 10)
    return store.listed(m, "tenant_id", ["name", "material_id"]).select("tenant_id", "material_id", "name", "unit", "price", "place")


@query(f"WITH {bind.ZONES} SELECT project_id, tier, zone_id, material_id, row_number() OVER (PARTITION BY project_id, tier ORDER BY owner, zone_id)::INT AS place FROM z")
def assignments_by_tier(spark: SparkSession, d: str) -> DataFrame:
    """Every project's assignments of each tier in the order in which they were made."""
    return store.listed(bind.zones(spark, d), ["project_id", "tier"], ["owner", "zone_id"]).select("project_id", "tier", "zone_id", "material_id", "place")


@query(f"""WITH {bind.ZONES}, s AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY label, owner, zone_id)::INT AS place, w::BIGINT || '.0' AS x, h::BIGINT || '.0' AS y FROM z)
SELECT project_id, zone_id, label, tier, place, '{{"type":"Polygon","coordinates":[[[0.0,0.0],[' || x || ',0.0],[' || x || ',' || y || '],[0.0,' || y || '],[0.0,0.0]]]}}' AS geometry FROM s""")
def zones_by_project(spark: SparkSession, d: str) -> DataFrame:
    """Every project's zones in order of label, with their geometry as text."""
    z = store.listed(bind.zones(spark, d), "project_id", ["label", "owner", "zone_id"])
    return z.select("project_id", "zone_id", "label", "tier", "place", geo.to_geojson(F.col("ring")).alias("geometry"))


_MD5 = "md5('t' || user_id % 40)"
_HYPHENS = lambda m: f"substr({m}, 1, 8) || '-' || substr({m}, 9, 4) || '-' || substr({m}, 13, 4) || '-' || substr({m}, 17, 4) || '-' || substr({m}, 21, 12)"


@query(f"""WITH t AS (SELECT c_custkey AS customer, 't' || c_custkey % 40 AS t, c_custkey FROM customer WHERE c_custkey % 40 < 35), ow AS (SELECT t, count(*) AS customers FROM t GROUP BY t),
r AS (SELECT event_id AS request_id, event_id % 9 AS way, 't' || user_id % 40 AS t, {_HYPHENS(_MD5)} AS id FROM events)
SELECT request_id, (CASE WHEN way < 5 THEN 200 ELSE 400 END)::INT AS status, CASE way WHEN 5 THEN 'missing X-Tenant-Id header' WHEN 6 THEN 'X-Tenant-Id header is not valid UTF-8' WHEN 7 THEN 'X-Tenant-Id is not a valid UUID' WHEN 8 THEN 'X-Tenant-Id is not a valid UUID' END AS error,
 CASE WHEN way < 5 THEN id END AS tenant_id, CASE WHEN way < 5 THEN coalesce(customers, 0) ELSE 0 END::BIGINT AS customers FROM r LEFT JOIN ow USING (t)""")
def tenant_requests(spark: SparkSession, d: str) -> DataFrame:
    """A request per event with its tenant's id in one of five ways, or none, or a bad one; how many customers each sees."""
    uuid = lambda t: F.regexp_replace(F.md5(t), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    own = bind.t(spark, d, "customer").where("c_custkey % 40 < 35").select(uuid(F.concat(F.lit("t"), (F.col("c_custkey") % 40).cast("string"))).alias("tenant_id"), "c_custkey")
    name = F.concat(F.lit("t"), (F.col("user_id") % 40).cast("string"))
    way, plain = F.col("event_id") % 9, uuid(name)
    header = F.when(way == 0, plain).when(way == 1, F.upper(plain)).when(way == 2, F.concat(F.lit("{"), plain, F.lit("}"))).when(way == 3, F.concat(F.lit("urn:uuid:"), plain)).when(way == 4, F.md5(name))
    header = header.when(way == 6, F.concat(plain, F.lit("\u00e9"))).when(way == 7, F.substring(plain, 1, 35)).when(way == 8, F.lit(""))
    r = store.of_requests(bind.t(spark, d, "events").select(F.col("event_id").alias("request_id"), header.alias("tenant_header")), own.groupBy("tenant_id").agg(F.count("*").alias("customers")))
    return r.select("request_id", "status", "error", "tenant_id", F.coalesce("customers", F.lit(0)).alias("customers"))


# --- inserts, updates, ownership, replacement ---
@query(f"SELECT md5(c_custkey::VARCHAR || '|' || c_name) AS project_id, c_custkey AS tenant_id, 'draft' AS status, TIMESTAMP '{AT}' AS created_at, TIMESTAMP '{AT}' AS updated_at FROM customer")
def project_insert(spark: SparkSession, d: str) -> DataFrame:
    """A new project for every tenant."""
    new = _tenants(spark, d).select("tenant_id", "name", F.lit("draft").alias("status"))
    at = _at()
    return store.inserted(new, "project_id", ["tenant_id", "name"], at).select("project_id", "tenant_id", "status", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at")])


@query(f"""WITH {bind.materials_sql()} SELECT material_id, CASE WHEN material_id % 17 = 0 THEN (price + 1)::DECIMAL(12,4) ELSE price END AS price,
 CASE WHEN material_id % 17 = 0 THEN TIMESTAMP '{AT}' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at, false AS not_found FROM m
UNION ALL SELECT material_id + 1000000000, (price + 1)::DECIMAL(12,4), TIMESTAMP '{AT}', true FROM m WHERE material_id % 170 = 0""")
def material_update(spark: SparkSession, d: str) -> DataFrame:
    """New prices bump updated_at; changes to materials that do not exist are reported."""
    m = bind.materials(spark, d).select("material_id", "price").withColumn("updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    up = m.select("material_id", (F.col("price") + 1).cast("decimal(12,4)").alias("price")).where("material_id % 17 = 0")
    up = up.unionByName(up.where("material_id % 10 = 0").withColumn("material_id", F.col("material_id") + 1000000000))
    done = store.touched(m, up, "material_id", ["price"], _at()).withColumn("not_found", F.lit(False))
    lost = store.not_found(m, up, "material_id").select("material_id", "price", _at().alias("updated_at"), F.lit(True).alias("not_found"))
    return done.unionByName(lost).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query(f"WITH {bind.ZONES} SELECT zone_id, project_id, CASE WHEN material_id % 3 <> 0 THEN 'moved' ELSE label END AS label FROM z")
def zone_ownership(spark: SparkSession, d: str) -> DataFrame:
    """A change to every zone, a third of which name another project: these take no effect."""
    z = bind.zones(spark, d).select("zone_id", "project_id", "label")
    claim = bind.zones(spark, d).select("zone_id", (F.col("project_id") + F.when(F.col("material_id") % 3 == 0, 1).otherwise(0)).alias("project_id"), F.lit("moved").alias("label"))
    return store.updated(z, store.zone_changes(claim, z), "zone_id")


@query(f"WITH {bind.ZONES} SELECT project_id, zone_id, label FROM z WHERE project_id % 10 <> 4 UNION ALL SELECT DISTINCT project_id, 'new-' || project_id, 'lawn' FROM z WHERE project_id % 20 = 4")
def bulk_zone_replace(spark: SparkSession, d: str) -> DataFrame:
    """All zones of a tenth of the projects replaced: by one new zone in half of these, by none in the others."""
    z = bind.zones(spark, d).select("project_id", "zone_id", "label")
    targets = z.where("project_id % 10 = 4").select("project_id").distinct()
    new = targets.where("project_id % 20 = 4").select("project_id", F.concat(F.lit("new-"), F.col("project_id").cast("string")).alias("zone_id"), F.lit("lawn").alias("label"))
    return store.replaced_for(z, targets, new, ["project_id"])


@query(f"""WITH {bind.ZONES}, a AS (SELECT project_id, count(*) AS zones FROM z GROUP BY project_id),
b AS (SELECT project_id, CASE WHEN project_id % 20 = 4 THEN 1 ELSE zones END AS zones FROM a WHERE project_id % 20 <> 14)
SELECT 'before' AS seen, * FROM a UNION ALL SELECT 'after', * FROM b""")
def zone_replace_on_files(spark: SparkSession, d: str) -> DataFrame:
    """The same replacement on stored zones: a reader that was there before sees the old zones, one that comes after the new."""
    z = bind.zones(spark, d).select("project_id", "zone_id", "label")
    table = store.Groups(spark, shared_path(spark, "zone-groups"), ["project_id"])
    table.replace(z)
    before = table.read()
    targets = before.where("project_id % 10 = 4").select("project_id").distinct()
    new = targets.where("project_id % 20 = 4").select("project_id", F.concat(F.lit("new-"), F.col("project_id").cast("string")).alias("zone_id"), F.lit("lawn").alias("label"))
    table.replace(new, targets)
    n = lambda df, seen: df.groupBy("project_id").agg(F.count("*").alias("zones")).select(F.lit(seen).alias("seen"), "project_id", "zones")
    return n(before, "before").unionByName(n(table.read(), "after"))


@query("SELECT 'projects/' || o_orderkey || '/status.txt' AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'closed ' || o_orderkey ELSE o_orderstatus END AS text FROM orders")
def object_store(spark: SparkSession, d: str) -> DataFrame:
    """An object a project, a fifth of which are put a second time; what is read is the newest."""
    k = F.col("o_orderkey")
    o = bind.t(spark, d, "orders").select(F.concat(F.lit("projects/"), k.cast("string"), F.lit("/status.txt")).alias("key"), F.col("o_orderstatus").alias("data"), k)
    path = shared_path(spark, "objects")
    store.put_objects(o, path, 1)
    store.put_objects(o.where(k % 5 == 0).withColumn("data", F.concat(F.lit("closed "), k.cast("string"))), path, 2)
    return store.get_objects(spark, path).select("key", F.col("data").cast("string").alias("text"))


@query("SELECT p_partkey AS id, t AS overrides, CASE WHEN p_partkey % 4 = 1 THEN (p_partkey % 50)::DECIMAL(12,4) END AS price, p_partkey % 4 = 3 AS bad FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '{\"price\": ' || p_partkey % 50 || '}' WHEN 2 THEN '{\"depth_inches\": 4}' ELSE '{price ' || p_partkey END AS t FROM part)")
def override_json(spark: SparkSession, d: str) -> DataFrame:
    """Override texts of assignments, those that are no JSON set aside."""
    k = F.col("p_partkey")
    num = lambda c: c.cast("string")
    t = F.when(k % 4 == 1, F.concat(F.lit('{"price": '), num(k % 50), F.lit("}"))).when(k % 4 == 2, '{"depth_inches": 4}').when(k % 4 == 3, F.concat(F.lit("{price "), num(k)))
    a = bind.t(spark, d, "part").select(k.alias("id"), t.alias("overrides"))
    bad = quote.bad_overrides(a)
    good = a.join(bad.select("id"), "id", "left_anti").select("id", "overrides", quote.overrides(F.col("overrides"))["price"].alias("price"), F.lit(False).alias("bad"))
    return good.unionByName(bad.select("id", "overrides", F.lit(None).cast("decimal(12,4)").alias("price"), F.lit(True).alias("bad")))


@query(f"WITH {_priced()}, {TOTALS}, x AS (SELECT project_id, tier, (project_id % 500)::DECIMAL(18,2) AS tax FROM tot WHERE project_id % 3 <> 0) SELECT tot.project_id, tot.tier, items, subtotal, coalesce(x.tax, 0)::DECIMAL(18,2) AS tax, (subtotal + coalesce(x.tax, 0))::DECIMAL(18,2) AS total FROM tot LEFT JOIN x USING (project_id, tier)")
def quote_tax(spark: SparkSession, d: str) -> DataFrame:
    """Totals with a tax for two thirds of the projects."""
    items = _items(spark, d)
    taxes = items.select("project_id", "tier").distinct().where("project_id % 3 <> 0").withColumn("tax", (F.col("project_id") % 500).cast("decimal(18,2)"))
    return quote.totals(items, taxes)


# --- scenes ---
@query(f"""WITH {bind.ZONES}, {bind.materials_sql(True)}, j AS (SELECT z.*, m.material_id IS NULL AS lost FROM z LEFT JOIN m ON z.material_id = m.material_id)
SELECT project_id, tier, count(*) AS zone_count, count(*) * 8 AS vertices, count(*) * 12 AS triangles, 0::BIGINT AS missing FROM j GROUP BY ALL HAVING NOT bool_or(lost)
UNION ALL SELECT project_id, tier, 0, 0, 0, count(*) FILTER (WHERE lost) FROM j GROUP BY ALL HAVING bool_or(lost)""")
def scene_join(spark: SparkSession, d: str) -> DataFrame:
    """Scenes from assignments, zones and materials; a tier with a missing material has none."""
    z = bind.zones(spark, d)
    made, lost = mesh.scene_zones(z.select("project_id", "tier", "zone_id", "material_id"), z, bind.materials(spark, d, True))
    good = mesh.scene_metadata(made).withColumn("missing", F.lit(0).cast("long"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("zone_count", "vertices", "triangles")]
    return good.unionByName(lost.groupBy("project_id", "tier").agg(F.count("*").alias("missing")).select("project_id", "tier", *zero, "missing"))


# --- documents ---
def _projects(spark, d):
    return bind.t(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), F.concat(F.lit("Project "), F.col("o_orderkey").cast("string")).alias("name"), F.concat(F.lit("Priority "), "o_orderpriority").alias("address"), F.lit("Green Co").alias("company"))


_FIRST = "fi AS (SELECT project_id, min_by(tier, list_position(['good', 'better', 'best'], tier)) AS tier FROM ru GROUP BY project_id)"
_NOTE = "label || ' zone (' || (z.w * z.h)::BIGINT || '.0 sq ft) featuring ' || materials || ' — designed to complement the overall landscape vision for Project ' || ru.project_id || '.'"


@query(f"WITH {_priced()}, {ROLLUP}, {_FIRST} SELECT ru.project_id, ru.zone_id, ru.label AS zone_label, ru.{_NOTE} AS note FROM ru JOIN fi USING (project_id, tier) JOIN (SELECT zone_id, w, h FROM z) z USING (zone_id)")
def zone_callouts(spark: SparkSession, d: str) -> DataFrame:
    z = bind.measured(bind.zones(spark, d)).select("zone_id", F.col("area").alias("area_sqft"))
    return quote.zone_callouts(quote.zone_rollup(_items(spark, d)), z, _projects(spark, d))


@query(f"""WITH {_priced()}, {ROLLUP}, {TOTALS}, {_FIRST}, t AS (SELECT project_id, count(*) AS tiers, max_by(total, -list_position(['good', 'better', 'best'], tier)) AS total, max_by(tier, -list_position(['good', 'better', 'best'], tier)) AS tier FROM tot GROUP BY project_id),
c AS (SELECT project_id, count(*) AS callouts FROM ru JOIN fi USING (project_id, tier) GROUP BY project_id)
SELECT project_id, tiers, callouts, upper(tier[1]) || tier[2:] || ' Package for Project ' || project_id AS headline, 'All-inclusive $' || format('{{:,.2f}}', total) || ' pricing' AS second,
 'Thank you for choosing Green Co for your Project ' || project_id || ' project at Priority ' || o_orderpriority || '.' AS thanks FROM t JOIN c USING (project_id) JOIN orders ON o_orderkey = project_id""")
def proposal_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each project's proposal as one JSON document, read again."""
    z = bind.measured(bind.zones(spark, d))
    docs = quote.proposal_documents(quote.line_items(bind.assignments(z), z, bind.materials(spark, d), areas=True), _projects(spark, d))
    p = F.from_json("document", "intro_paragraph string, tier_narratives array<struct<tier_level string, headline string, description string, differentiators array<string>>>, zone_callouts array<struct<zone_label string, note string>>, closing_paragraph string")
    r = docs.select("project_id", F.explode(F.array(p)).alias("p"))  # parsed once for all its members
    return r.select(
        "project_id", F.size("p.tier_narratives").cast("long").alias("tiers"), F.size("p.zone_callouts").cast("long").alias("callouts"), F.col("p.tier_narratives")[0]["headline"].alias("headline"),
        F.col("p.tier_narratives")[0]["differentiators"][1].alias("second"), F.concat(F.substring_index("p.intro_paragraph", ".", 1), F.lit(".")).alias("thanks"),
    )


# --- site sources ---
_GEO = "g AS (SELECT s_suppkey, upper(s_name) || '   ST' AS address, (s_suppkey * 37 % 1400) / 10.0::DOUBLE - 70 AS lat, (s_suppkey * 91 % 3600) / 10.0::DOUBLE - 180 AS lng FROM supplier)"


def _geocodes(spark, d):
    k = F.col("s_suppkey")
    return bind.t(spark, d, "supplier").select("s_suppkey", F.concat(F.upper("s_name"), F.lit("   ST")).alias("address"), ((k * 37 % 1400) / 10.0 - 70).alias("lat"), ((k * 91 % 3600) / 10.0 - 180).alias("lng"))


@query(f"""WITH {_GEO}, o AS (SELECT o_orderkey AS site_id, ' ' || (SELECT min(s_name) FROM supplier)[:-10] || lpad((o_custkey % 200)::VARCHAR, 9, '0') || ' st ' AS address FROM orders)
SELECT site_id, lat, lng, lat IS NULL AS not_found FROM o LEFT JOIN g ON trim(regexp_replace(lower(g.address), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(o.address), '\\s+', ' ', 'g'))""")
def geocode(spark: SparkSession, d: str) -> DataFrame:
    """Addresses looked up in a table of geocodes, in whatever case and spacing; those it lacks are told."""
    g = _geocodes(spark, d)
    stem = bind.t(spark, d, "supplier").agg(F.min("s_name").alias("n")).select(F.expr("substring(n, 1, length(n) - 9)").alias("stem"))
    o = bind.t(spark, d, "orders").join(F.broadcast(stem), F.lit(True)).select(F.col("o_orderkey").alias("site_id"), F.concat(F.lit(" "), "stem", F.lpad((F.col("o_custkey") % 200).cast("string"), 9, "0"), F.lit(" st ")).alias("address"))
    found = site.geocoded(o, g.select("address", "lat", "lng"))
    return found.select("site_id", "lat", "lng", F.col("lat").isNull().alias("not_found"))


_LOTS = "lo AS (SELECT c_custkey AS lot_id, (c_custkey * 37 % 1400) / 10.0::DOUBLE - 70 + (c_custkey % 9 - 4) / 500.0::DOUBLE AS lat, (c_custkey * 91 % 3600) / 10.0::DOUBLE - 180 + (c_custkey % 7 - 3) / 500.0::DOUBLE AS lng FROM customer)"


@query(f"WITH {_GEO}, {_LOTS} SELECT s_suppkey AS site_id, lot_id FROM g JOIN lo ON abs(g.lat - lo.lat) < 0.005::DOUBLE AND abs(g.lng - lo.lng) < 0.005::DOUBLE")
def parcel_near(spark: SparkSession, d: str) -> DataFrame:
    """Parcels less than a two hundredth of a degree from a site in latitude and in longitude."""
    k = F.col("c_custkey")
    lots = bind.t(spark, d, "customer").select(k.alias("lot_id"), ((k * 37 % 1400) / 10.0 - 70 + (k % 9 - 4) / 500.0).alias("lat"), ((k * 91 % 3600) / 10.0 - 180 + (k % 7 - 3) / 500.0).alias("lng"))
    return site.near(_geocodes(spark, d).select(F.col("s_suppkey").alias("site_id"), "lat", "lng"), lots).select("a.site_id", "b.lot_id")


@query(f"""WITH {_GEO} SELECT s_suppkey AS site_id, round(lng - 12.5::DOUBLE / 290854.0::DOUBLE, 9) AS west, round(lat - 60.0::DOUBLE / 364567.0::DOUBLE, 9) AS south, round(lng + 12.5::DOUBLE / 290854.0::DOUBLE, 9) AS east, round(lat + 60.0::DOUBLE / 364567.0::DOUBLE, 9) AS north FROM g""")
def lot_polygon(spark: SparkSession, d: str) -> DataFrame:
    """The corners of a lot of 25 by 120 feet around each site, in degrees."""
    g = _geocodes(spark, d).withColumn("ring", site.lot_ring(F.col("lat"), F.col("lng")))
    at = lambda i, c: F.round(F.col("ring")[i][c], 9)
    return g.select(F.col("s_suppkey").alias("site_id"), at(0, "x").alias("west"), at(0, "y").alias("south"), at(2, "x").alias("east"), at(2, "y").alias("north"))


_TREES = "tr AS (SELECT p_partkey, (p_partkey * 37 % 1400) / 10.0::DOUBLE - 70 + (p_partkey % 11 - 5) / 1000.0::DOUBLE AS lat, (p_partkey * 91 % 3600) / 10.0::DOUBLE - 180 + (p_partkey % 13 - 6) / 1000.0::DOUBLE AS lng, p_size::DOUBLE AS height_ft FROM part)"


@query(f"""WITH {_GEO}, {_TREES}, b AS (SELECT s_suppkey AS site_id, lat - 0.0045::DOUBLE AS south, lat + 0.0045::DOUBLE AS north, lng - 0.0045::DOUBLE AS west, lng + 0.0045::DOUBLE AS east FROM g)
SELECT site_id, count(*) AS trees, max(height_ft) AS tallest, sum(height_ft / 2) AS spreads, round(avg(site_id % 5 + 2.0::DOUBLE), 6) AS avg_sun_hours FROM b JOIN tr ON lat > south AND lat < north AND lng > west AND lng < east GROUP BY site_id""")
def canopy_summary(spark: SparkSession, d: str) -> DataFrame:
    """Trees in a box around each site, with the sun of its grid, as a summary of the baseline."""
    g = _geocodes(spark, d).select(F.col("s_suppkey").alias("site_id"), *[(F.col(c) + s * 0.0045).alias(n) for c, s, n in (("lat", -1, "south"), ("lat", 1, "north"), ("lng", -1, "west"), ("lng", 1, "east"))])
    k = F.col("p_partkey")
    trees = bind.t(spark, d, "part").select(((k * 37 % 1400) / 10.0 - 70 + (k % 11 - 5) / 1000.0).alias("lat"), ((k * 91 % 3600) / 10.0 - 180 + (k % 13 - 6) / 1000.0).alias("lng"), F.col("p_size").cast("double").alias("height_ft"), (F.col("p_size") / 2).alias("spread_ft"), F.lit(0.5).alias("confidence"))
    found = site.canopy_within(g, trees, "site_id").withColumn("lot_sqft", F.lit(3000.0)).withColumn("sun", F.array_repeat((F.col("site_id") % 5 + 2).cast("double"), 4))
    s = site.baseline_summary(found)
    return s.select("site_id", F.size("trees").cast("long").alias("trees"), F.array_max("trees.height_ft").alias("tallest"), F.aggregate("trees.spread_ft", F.lit(0.0), lambda a, x: a + x).alias("spreads"), F.round("avg_sun_hours", 6).alias("avg_sun_hours"))


@query(f"""WITH {bind.ZONES}, f AS (SELECT project_id AS site_id, CASE label WHEN 'bed' THEN 'planting' WHEN 'lawn' THEN 'planting' WHEN 'patio' THEN 'hardscape' ELSE 'structure' END AS category, w * h AS area FROM z),
b AS (SELECT site_id, count(*) AS features, count(*) FILTER (WHERE category = 'planting') AS plants, sum(area) AS covered_sqft FROM f GROUP BY site_id)
SELECT o_orderkey AS site_id, coalesce(features, 0) AS features, coalesce(plants, 0) AS plants, round(coalesce(covered_sqft, 0), 6) AS covered_sqft, round(greatest(2000.0::DOUBLE - coalesce(covered_sqft, 0), 0), 6) AS open_sqft FROM orders LEFT JOIN b ON site_id = o_orderkey""")
def plan_view_analysis(spark: SparkSession, d: str) -> DataFrame:
    z = bind.measured(bind.zones(spark, d))
    cat = F.when(F.col("label").isin("bed", "lawn"), "planting").when(F.col("label") == "patio", "hardscape").otherwise("structure")
    f = z.select(F.col("project_id").alias("site_id"), cat.alias("category"), F.col("area").alias("area_sqft"))
    lots = bind.t(spark, d, "orders").select(F.col("o_orderkey").alias("site_id"), F.lit(2000.0).alias("lot_sqft"))
    a = site.plan_view_analysis(f, lots)
    return a.select("site_id", "features", "plants", F.round("covered_sqft", 6).alias("covered_sqft"), F.round("open_sqft", 6).alias("open_sqft"))


# --- features ---
@query(f"""WITH {bind.CLOUD}, k AS (SELECT *, (['tree', 'planting', 'structure', 'hardscape', 'utility', 'other'])[idx % 6 + 1] AS category FROM c WHERE idx % 4 <> 0)
SELECT scan_id, idx AS cluster_id, category || ' ' || idx || ' (' || format('{{:.2f}}', (idx % 100) / 100.0::DOUBLE) || ')' AS text, CASE WHEN category IN ('tree', 'planting') THEN 34 WHEN category = 'structure' THEN 107 WHEN category = 'hardscape' THEN 217 WHEN category = 'utility' THEN 239 ELSE 156 END AS red, x, y FROM k""")
def feature_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with the classification of the same id; those without one are left out."""
    c = bind.cloud(spark, d).withColumnRenamed("idx", "cluster_id")
    k = F.element_at(F.array(*[F.lit(x) for x in ("tree", "planting", "structure", "hardscape", "utility", "other")]), (F.col("cluster_id") % 6 + 1).cast("int"))
    classes = c.where("cluster_id % 4 <> 0").select("scan_id", "cluster_id", F.concat_ws(" ", k, "cluster_id").alias("label"), k.alias("category"), (F.col("cluster_id") % 100 / 100.0).alias("confidence"))
    return points.annotations(c.select("scan_id", "cluster_id", "x", "y"), classes).select("scan_id", "cluster_id", "text", F.col("colour")[0].alias("red"), "x", "y")


@query(f"WITH {bind.BIG_CLOUD} SELECT scan_id, CASE WHEN z <= 0.3::DOUBLE THEN 0 ELSE 1 END AS part, count(*) AS n, min(x) AS low, max(x) AS high FROM c GROUP BY ALL")
def ground_then_obstacles(spark: SparkSession, d: str) -> DataFrame:
    c = points.concatenated(bind.big_cloud(spark, d).withColumn("is_ground", F.col("z") <= 0.3))
    return c.groupBy("scan_id", "part").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))


def _near(a: str, b: str) -> str:
    return f"abs({a}.h - {b}.h) <= 5 AND ({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) <= 1.0::DOUBLE"


def _mutual(a: str, b: str, out: str) -> str:
    return f"""{out}p AS (SELECT {a}.id AS ai, {b}.id AS bi, ({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) AS d2 FROM {a} JOIN {b} ON {_near(a, b)}),
{out}q AS (SELECT *, row_number() OVER (PARTITION BY ai ORDER BY d2, bi) AS ra, row_number() OVER (PARTITION BY bi ORDER BY d2, ai) AS rb FROM {out}p), {out} AS (SELECT ai, bi FROM {out}q WHERE ra = 1 AND rb = 1)"""


#: Features of three sources in all scans, which lie apart.
_SOURCES = """a AS (SELECT scan_id * 1000000 + idx AS id, x * 100 + scan_id * 1000 AS x, y * 100 AS y, 10 + idx % 20 AS h FROM c), b AS (SELECT scan_id * 1000000 + idx AS id, x * 100 + scan_id * 1000 + 0.4::DOUBLE AS x, y * 100 - 0.3::DOUBLE AS y, 11 + idx % 20 AS h FROM c WHERE idx % 3 <> 0),
e AS (SELECT scan_id * 1000000 + idx AS id, x * 100 + scan_id * 1000 - 0.2::DOUBLE AS x, y * 100 + 0.1::DOUBLE AS y, 9 + idx % 20 AS h FROM c WHERE idx % 5 <> 1)"""


def _sources(spark, d):
    c = bind.cloud(spark, d)
    k = (F.col("scan_id") * 1000000 + F.col("idx")).cast("long")
    of = lambda df, dx, dy, h: df.select(k.alias("id"), (F.col("x") * 100 + F.col("scan_id") * 1000 + dx).alias("x"), (F.col("y") * 100 + dy).alias("y"), (h + F.col("idx") % 20).alias("height_ft"))
    return of(c, 0.0, 0.0, 10), of(c.where("idx % 3 <> 0"), 0.4, -0.3, 11), of(c.where("idx % 5 <> 1"), -0.2, 0.1, 9)


@query(f"""WITH {bind.CLOUD}, {_SOURCES}, {_mutual('a', 'b', 'm')}
SELECT ai AS scan_feature, bi AS satellite_feature, 'both' AS origin FROM m UNION ALL SELECT id, NULL, 'scan' FROM a WHERE id NOT IN (SELECT ai FROM m) UNION ALL SELECT NULL, id, 'satellite' FROM b WHERE id NOT IN (SELECT bi FROM m)""")
def reconcile_features(spark: SparkSession, d: str) -> DataFrame:
    a, b, _ = _sources(spark, d)
    return reconcile.reconcile(a, b, 1.0, 5.0)


@query(f"""WITH {bind.CLOUD}, {_SOURCES}, {_mutual('a', 'b', 'm')},
w AS (SELECT ai AS s, bi AS t FROM m UNION ALL SELECT id, NULL FROM a WHERE id NOT IN (SELECT ai FROM m) UNION ALL SELECT NULL, id FROM b WHERE id NOT IN (SELECT bi FROM m)),
g AS (SELECT s, t, CASE WHEN s IS NOT NULL THEN s * 2 ELSE t * 2 + 1 END AS id, coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, coalesce(a.h, b.h) AS h FROM w LEFT JOIN a ON a.id = s LEFT JOIN b ON b.id = t), {_mutual('g', 'e', 'n')},
r AS (SELECT s, t, bi AS p FROM g LEFT JOIN n ON g.id = ai UNION ALL SELECT NULL, NULL, id FROM e WHERE id NOT IN (SELECT bi FROM n))
SELECT s AS scan_feature, t AS satellite_feature, p AS plan_feature, concat_ws('+', CASE WHEN s IS NOT NULL THEN 'scan' END, CASE WHEN t IS NOT NULL THEN 'satellite' END, CASE WHEN p IS NOT NULL THEN 'plan' END) AS origin FROM r""")
def reconcile_three(spark: SparkSession, d: str) -> DataFrame:
    """Features of a scan, of satellite data and of a plan view, and who saw them."""
    return reconcile.reconcile_three(*_sources(spark, d), 1.0, 5.0)


# --- codes and contacts ---
_KINDS = {k: (v, n) for n, (k, v) in enumerate(codes.CODES.items())}
_CODE_SQL = " UNION ALL ".join(f"SELECT p_partkey AS id, '{k}' AS kind, ({[*v, 'bogus']})[(p_partkey + {n}) % {len(v) + 1} + 1] AS code, {v} AS known FROM part" for k, (v, n) in _KINDS.items())


@query(f"SELECT id, kind, code, CASE WHEN list_contains(known, code) THEN list_position(known, code) - 1 END AS place, NOT list_contains(known, code) AS unknown FROM ({_CODE_SQL})")
def enum_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of all five kinds to their places; unknown ones are set aside with a null place."""
    p, out = bind.t(spark, d, "part"), None
    for k, (v, n) in _KINDS.items():
        code = F.element_at(F.array(*[F.lit(x) for x in [*v, "bogus"]]), ((F.col("p_partkey") + n) % (len(v) + 1) + 1).cast("int"))
        rows = p.select(F.col("p_partkey").alias("id"), F.lit(k).alias("kind"), code.alias("code"))
        good = rows.join(codes.unknown(rows, "code", k).select("id"), "id", "left_anti").withColumn("place", codes.ordinal(codes.checked(F.col("code"), k), k)).withColumn("unknown", F.lit(False))
        both = good.unionByName(codes.unknown(rows, "code", k).withColumn("place", F.lit(None).cast("int")).withColumn("unknown", F.lit(True)))
        out = both if out is None else out.unionByName(both)
    return out


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN '555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') END AS phone, CASE WHEN c_custkey % 2 = 0 THEN lower(replace(c_name, '#', '.')) || '@example.com' END AS email FROM customer")
def contact_fields(spark: SparkSession, d: str) -> DataFrame:
    """Phone and email of contact objects, either of which may be missing."""
    k = F.col("c_custkey")
    c = F.to_json(F.struct(F.when(k % 3 != 0, F.concat(F.lit("555-"), F.lpad((k % 10000).cast("string"), 4, "0"))).alias("phone"), F.when(k % 2 == 0, F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))).alias("email")))
    return bind.t(spark, d, "customer").withColumn("contact", c).select(k.alias("id"), text.contact_field(F.col("contact"), "phone").alias("phone"), text.contact_field(F.col("contact"), "email").alias("email"))


@query("SELECT p_partkey AS id, ((p_partkey % 40)::DOUBLE / 10) * ((p_partkey % 40)::DOUBLE / 10) + 1 <= 4 AND p_partkey % 3 <> 0 AS closes FROM part")
def near_first_vertex(spark: SparkSession, d: str) -> DataFrame:
    """Whether a point a few feet from the first vertex closes a ring of two or three vertices."""
    k = F.col("p_partkey")
    ring = F.array(geo.point(0.0, 0.0), geo.point(5.0, 0.0), geo.point(5.0, 5.0))
    ring = F.when(k % 3 != 0, ring).otherwise(F.slice(ring, 1, 2))
    return bind.t(spark, d, "part").select(k.alias("id"), geo.near_first_vertex(ring, (k % 40).cast("double") / 10, F.lit(1.0), 2.0).alias("closes"))

"""Quote, planter, proposal and money queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesmith.functions import money, text
from sitesmith.operators import quote
from sitesmith.plans import bind

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _items(spark, d, gaps=False):
    z = bind.measured(bind.zones(spark, d))
    return quote.line_items(bind.assignments(z), z, bind.materials(spark, d, gaps))


def _priced(gaps: bool = False) -> str:
    qty = "CASE unit WHEN 'sq_ft' THEN w * h WHEN 'linear_ft' THEN 2 * (w + h) WHEN 'each' THEN 1.0::DOUBLE WHEN 'cu_yd' THEN w * h * depth_inches / 12.0::DOUBLE / 27.0::DOUBLE END"
    return f"""{bind.ZONES}, {bind.materials_sql(gaps)},
p AS (SELECT z.*, m.name AS material_name, unit, price, depth_inches, {qty} AS q,
  CASE WHEN unit IS NULL THEN 'missing_material' WHEN unit = 'cu_yd' AND depth_inches IS NULL THEN 'missing_depth' END AS violation
  FROM z LEFT JOIN m ON z.material_id = m.material_id),
i AS (SELECT project_id, tier, zone_id, label, material_id, material_name, unit, round_even(q::DECIMAL(22,10), 4)::DECIMAL(18,4) AS quantity, price AS unit_price,
  round_even(q::DECIMAL(22,10) * price, 2)::DECIMAL(18,2) AS line_total FROM p WHERE violation IS NULL)"""


TOTALS = "tot AS (SELECT project_id, tier, count(*) AS items, sum(line_total)::DECIMAL(18,2) AS subtotal, 0::DECIMAL(18,2) AS tax, sum(line_total)::DECIMAL(18,2) AS total FROM i GROUP BY ALL)"
ITEMS = "project_id, tier, zone_id, label, material_id, material_name, unit, quantity, unit_price, line_total"


@query(f"WITH {_priced()} SELECT {ITEMS} FROM i")
def quote_line_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d)


@query(f"WITH {_priced()}, {TOTALS} SELECT tot.*, o_orderstatus AS status FROM tot JOIN orders ON o_orderkey = project_id")
def quote_totals(spark: SparkSession, d: str) -> DataFrame:
    orders = bind.t(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), F.col("o_orderstatus").alias("status"))
    return quote.totals(_items(spark, d)).join(orders, "project_id")


@query(f"""WITH {bind.ZONES}, {bind.materials_sql()}, e AS (SELECT event_id, (props::JSON->>'$.k')::DECIMAL(12,4) AS k FROM events),
p AS (SELECT z.project_id, z.tier, z.zone_id, CASE unit WHEN 'sq_ft' THEN w * h WHEN 'linear_ft' THEN 2 * (w + h) WHEN 'each' THEN 1.0::DOUBLE WHEN 'cu_yd' THEN w * h * depth_inches / 12.0::DOUBLE / 27.0::DOUBLE END AS q, coalesce(k, price) AS price
FROM z JOIN m USING (material_id) LEFT JOIN e ON z.project_id = e.event_id)
SELECT project_id, tier, zone_id, round_even(q::DECIMAL(22,10) * price::DECIMAL(12,4), 2)::DECIMAL(18,2) AS line_total FROM p WHERE q IS NOT NULL""")
def quote_with_overrides(spark: SparkSession, d: str) -> DataFrame:
    z = bind.measured(bind.zones(spark, d))
    e = bind.t(spark, d, "events").select(F.col("event_id").alias("project_id"), F.from_json(F.regexp_replace("props", '"k"', '"price"'), "price decimal(12,4)")["price"].alias("price_override"))
    a = bind.assignments(z).drop("price_override").join(e, "project_id", "left")
    return quote.line_items(a, z, bind.materials(spark, d)).select("project_id", "tier", "zone_id", "line_total")


@query(f"WITH {_priced(True)} SELECT project_id, tier, zone_id, material_id, violation FROM p WHERE violation IS NOT NULL")
def quote_violations(spark: SparkSession, d: str) -> DataFrame:
    z = bind.measured(bind.zones(spark, d))
    return quote.violations(bind.assignments(z), z, bind.materials(spark, d, True))


@query(f"WITH {_priced(True)} SELECT {ITEMS} FROM i WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.project_id = i.project_id AND p.tier = i.tier AND violation IS NOT NULL)")
def quote_clean_tiers(spark: SparkSession, d: str) -> DataFrame:
    z = bind.measured(bind.zones(spark, d))
    return quote.clean_line_items(bind.assignments(z), z, bind.materials(spark, d, True))


@query(f"""WITH {_priced()}, k AS (SELECT *, concat_ws('/', label, material_id % 5) AS slot FROM i)
SELECT project_id, slot AS zone_id, coalesce(min(label) FILTER (WHERE tier = 'good'), min(label) FILTER (WHERE tier = 'better'), min(label) FILTER (WHERE tier = 'best'), 'Zone') AS label,
 sum(line_total) FILTER (WHERE tier = 'good')::DECIMAL(18,2) AS good, sum(line_total) FILTER (WHERE tier = 'better')::DECIMAL(18,2) AS better, sum(line_total) FILTER (WHERE tier = 'best')::DECIMAL(18,2) AS best
FROM k GROUP BY project_id, slot""")
def tier_comparison(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    return quote.compare_tiers(items.withColumn("zone_id", F.concat_ws("/", "label", F.col("material_id") % 5)))


@query(f"""WITH {_priced()}, cat AS (SELECT p_partkey AS material_id, upper(p_name) AS name FROM part WHERE p_partkey % 13 <> 0)
SELECT project_id, tier, zone_id, label, string_agg(coalesce(cat.name, material_name), ', ' ORDER BY coalesce(cat.name, material_name)) AS materials, count(*) AS n_materials FROM i LEFT JOIN cat USING (material_id) GROUP BY ALL""")
def rollup_names(spark: SparkSession, d: str) -> DataFrame:
    """Materials of zones by the names of a catalog that has changed since the quote, in which a thirteenth of them is gone."""
    catalog = bind.materials(spark, d, gaps=True).select("material_id", F.upper("name").alias("name"))
    return quote.zone_rollup(_items(spark, d), catalog)


ROLLUP = "ru AS (SELECT project_id, tier, zone_id, label, string_agg(coalesce(material_name, ''), ', ' ORDER BY material_name) AS materials, count(*) AS n_materials FROM i GROUP BY ALL)"


@query(f"WITH {_priced()}, {ROLLUP} SELECT * FROM ru")
def proposal_zone_rollup(spark: SparkSession, d: str) -> DataFrame:
    return quote.zone_rollup(_items(spark, d))


@query(f"""WITH {_priced()}, {ROLLUP}, {TOTALS},
n AS (SELECT project_id, tier, count(*) AS n, string_agg(label, ', ' ORDER BY label) AS zones FROM ru GROUP BY ALL),
f AS (SELECT n.*, '$' || format('{{:,.2f}}', total) AS amount FROM n JOIN tot USING (project_id, tier))
SELECT project_id, tier, upper(tier[1]) || tier[2:] || ' Package for Project ' || project_id AS headline,
 'This ' || tier || ' option for Project ' || project_id || ' at Priority ' || o_orderpriority || ' transforms your outdoor space across ' || n || ' zones (' || zones || ') with carefully selected materials and professional installation, totaling ' || amount || '.' AS description,
 'Covers ' || n || ' distinct zones|All-inclusive ' || amount || ' pricing|Professional installation and cleanup' AS differentiators
FROM f JOIN orders ON o_orderkey = project_id""")
def proposal_narrative(spark: SparkSession, d: str) -> DataFrame:
    projects = bind.t(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), F.concat(F.lit("Project "), F.col("o_orderkey").cast("string")).alias("name"), F.concat(F.lit("Priority "), "o_orderpriority").alias("address"))
    return quote.rollup_narrative(quote.zone_rollup(_items(spark, d), totals=True), projects)


@query("""WITH a AS (SELECT c_custkey, (c_acctbal - 3000)::DECIMAL(18,2) AS v FROM customer)
SELECT c_custkey AS id, CASE WHEN v < 0 THEN '-$' ELSE '$' END || format('{:,.2f}', abs(v)) AS dollars,
 (['sq ft', 'cu yd', 'lin ft', 'ea'])[c_custkey % 4 + 1] AS unit FROM a""")
def money_format(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("sq_ft", "cu_yd", "linear_ft", "each")]), (k % 4 + 1).cast("int"))
    return bind.t(spark, d, "customer").select(k.alias("id"), money.format_dollars((F.col("c_acctbal") - 3000).cast("decimal(18,2)")).alias("dollars"), money.unit_label(unit).alias("unit"))


def plants(spark: SparkSession, d: str) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(w) for w in bind.PLANT_WORDS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    name = F.concat_ws(" ", "p_name", word, F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("("), (F.col("p_size") % 20).cast("string"), F.lit('" spacing)'))))
    return bind.t(spark, d, "part").select(F.col("p_partkey").alias("plant_id"), name.alias("name"), (F.col("p_size") % 20).cast("double").alias("spacing"), (F.col("p_partkey") % 100).alias("style_id"))


PLANTS = f"""pl AS (SELECT p_partkey AS plant_id, concat_ws(' ', p_name, ({bind.PLANT_WORDS})[p_partkey % 8 + 1], CASE WHEN p_partkey % 3 = 0 THEN '(' || (p_size % 20) || '" spacing)' END) AS name,
 (p_size % 20)::DOUBLE AS spacing, p_partkey % 100 AS style_id FROM part)"""
PRICE = f"""CASE WHEN regexp_matches(lower(name), '{'|'.join(money.GRASSES)}') THEN 15.00 WHEN regexp_matches(lower(name), '{'|'.join(money.ANNUALS)}') THEN 8.00
 WHEN regexp_matches(lower(name), '{'|'.join(money.SUCCULENTS)}') THEN 12.00 ELSE 12.00 END::DECIMAL(12,2)"""


@query(f"WITH {PLANTS} SELECT plant_id, name, {PRICE} AS unit_price, CASE WHEN name LIKE '%spacing)' THEN spacing::INT ELSE 6 END AS spacing FROM pl")
def plant_price_category(spark: SparkSession, d: str) -> DataFrame:
    return plants(spark, d).select("plant_id", "name", money.price_category(F.col("name")).alias("unit_price"), money.spacing_in_name(F.col("name")).alias("spacing"))


@query(f"WITH {PLANTS} SELECT plant_id, CASE WHEN spacing > 0 THEN floor(100.5::DOUBLE / ((spacing / 12.0::DOUBLE) * (spacing / 12.0::DOUBLE)))::BIGINT ELSE 0 END AS plant_count, round(100.5::DOUBLE * spacing / 324.0::DOUBLE, 6) AS soil_cuyd FROM pl")
def plant_counts(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("spacing")
    return plants(spark, d).select("plant_id", money.plant_count(F.lit(100.5), s).alias("plant_count"), F.round(money.soil_volume_cuyd(F.lit(100.5), s), 6).alias("soil_cuyd"))


@query(f"""WITH {PLANTS}, c AS (SELECT style_id, name, spacing, 40.0::DOUBLE + style_id AS area, count(*) OVER (PARTITION BY style_id) AS n FROM pl),
q AS (SELECT *, CASE WHEN spacing > 0 THEN floor((area / n) / ((spacing / 12.0::DOUBLE) * (spacing / 12.0::DOUBLE)))::BIGINT ELSE 0 END AS k, {PRICE} AS price FROM c),
s AS (SELECT style_id, sum(k)::BIGINT AS plants, sum(round_even(k::DECIMAL(18,0) * price, 2))::DECIMAL(18,2) AS plant_cost, (any_value(area) * (style_id % 12 + 1) / 324.0::DOUBLE)::DECIMAL(22,10) AS v FROM q GROUP BY style_id)
SELECT style_id, plants, plant_cost, round_even(v, 3)::DECIMAL(18,3) AS soil_cuyd, round_even(v * 45.00, 2)::DECIMAL(18,2) AS soil_cost, (plant_cost + round_even(v * 45.00, 2))::DECIMAL(18,2) AS total_cost FROM s""")
def planter_styles(spark: SparkSession, d: str) -> DataFrame:
    s = plants(spark, d).groupBy("style_id").agg(F.sort_array(F.collect_list(F.struct("name", "spacing"))).alias("plants"))
    return quote.planter_styles(s.withColumn("area", F.lit(40.0) + F.col("style_id")).withColumn("depth_inches", (F.col("style_id") % 12 + 1).cast("double")))


@query("""SELECT coalesce(area, 'total') AS area, count(*) AS scenarios, round(sum(v), 4) AS value FROM
 (SELECT event_type AS area, (event_id % 60) * ((event_id % 5) + (user_id % 5)) / 10.0::DOUBLE AS v FROM events) GROUP BY ROLLUP (area)""")
def value_scores(spark: SparkSession, d: str) -> DataFrame:
    e = bind.t(spark, d, "events")
    return quote.value_scores(e.select(F.col("event_type").alias("area"), (F.col("event_id") % 60).alias("minutes"), (F.col("event_id") % 5).alias("integration"), (F.col("user_id") % 5).alias("polish")))


@query("""SELECT c_custkey AS id, trim(regexp_replace(lower('  ' || c_name || '   Main  ST,  ' || c_mktsegment || ' '), '\\s+', ' ', 'g')) AS address,
 lower(regexp_replace(c_name || ' (v1.0)/' || c_mktsegment, '[^\\p{L}\\p{N}_-]', '-', 'g')) AS filename FROM customer""")
def address_filename(spark: SparkSession, d: str) -> DataFrame:
    c = bind.t(spark, d, "customer")
    a = F.concat(F.lit("  "), "c_name", F.lit("   Main  ST,  "), "c_mktsegment", F.lit(" "))
    return c.select(F.col("c_custkey").alias("id"), text.normalize_address(a).alias("address"), text.sanitize_filename(F.concat("c_name", F.lit(" (v1.0)/"), "c_mktsegment")).alias("filename"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS address FROM documents")
def address_normalise(spark: SparkSession, d: str) -> DataFrame:
    return bind.t(spark, d, "documents").select("doc_id", text.normalize_address(F.col("text")).alias("address"))


@query("""SELECT event_id, (props::JSON->>'$.k')::VARCHAR AS contact, CASE WHEN try_cast(props::JSON->>'$.k' AS BIGINT) > 0 THEN (props::JSON->>'$.k')::BIGINT ELSE 60 END AS limit_value FROM events""")
def contact_extract(spark: SparkSession, d: str) -> DataFrame:
    k = text.contact_field(F.col("props"), "k")
    return bind.t(spark, d, "events").select("event_id", k.alias("contact"), text.positive_limit(k, 60).alias("limit_value"))


@query("""SELECT user_id, count(*) AS messages, count(*) FILTER (WHERE event_id % 7 <> 0) AS parsed, (sum((props::JSON->>'$.k')::BIGINT) FILTER (WHERE event_id % 7 <> 0))::BIGINT AS k FROM events GROUP BY user_id""")
def sse_parse(spark: SparkSession, d: str) -> DataFrame:
    """Event bodies framed as one stream per user, every seventh cut short, and parsed again."""
    body = F.when(F.col("event_id") % 7 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    framed = bind.t(spark, d, "events").select("user_id", F.concat(F.lit("data: "), body).alias("frame")).groupBy("user_id").agg(F.concat_ws("\n\n", F.collect_list("frame")).alias("stream"))
    m = framed.select("user_id", F.explode(text.sse_messages(F.col("stream"))).alias("m")).withColumn("k", F.from_json("m", "k long, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    good = F.col("k._corrupt_record").isNull()
    return m.groupBy("user_id").agg(F.count("*").alias("messages"), F.sum(good.cast("long")).alias("parsed"), F.sum(F.when(good, F.col("k.k"))).alias("k"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'unknown' WHEN r > 200 AND g > 200 AND b > 200 THEN 'white'
 WHEN greatest(r, g, b) - least(r, g, b) < 30 AND greatest(r, g, b) > 50 THEN 'gray' WHEN g > 80 AND g > r * 1.2::DOUBLE AND g > b * 1.2::DOUBLE THEN 'green'
 WHEN r > 80 AND r > g AND g > 40 AND b < g THEN 'brown' ELSE 'mixed' END AS colour,
 CASE WHEN h < 0.1 OR s < 0.1 THEN 'irregular' WHEN h / s > 3 THEN 'columnar' WHEN h / s < 0.5 THEN 'flat' WHEN p_partkey % 2 = 0 THEN 'conical' ELSE 'spreading' END AS profile
FROM (SELECT p_partkey, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_partkey * 29 % 256 AS b, (p_size % 25)::DOUBLE AS h, (p_partkey % 9)::DOUBLE AS s FROM part)""")
def colour_profile(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    c = lambda m: F.when(k % 11 != 0, k * m % 256)
    return bind.t(spark, d, "part").select(k.alias("id"), text.classify_rgb(c(7), c(13), c(29)).alias("colour"), text.vertical_profile((F.col("p_size") % 25).cast("double"), (k % 9).cast("double"), k % 2 == 0).alias("profile"))


@query("""SELECT o_orderkey AS id, CASE WHEN n >= 1000000 THEN format('{:.1f}', n / 1e6) || ' MB' WHEN n >= 1000 THEN format('{:.0f}', n / 1e3) || ' KB' ELSE n || ' B' END AS bytes, format('{:,}', n) AS count_text
FROM (SELECT o_orderkey, (o_orderkey * 7919 % 3000000)::BIGINT AS n FROM orders UNION ALL SELECT -o_orderkey, o_orderkey % 30 * 100000 + 50000 FROM orders UNION ALL SELECT -1000000000 - o_orderkey, o_orderkey % 1000 * 1000 + 500 FROM orders)""")
def size_text(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of all kinds, and those halfway between two texts."""
    k = F.col("o_orderkey")
    o = bind.t(spark, d, "orders").select(F.explode(F.array(*[F.struct(i.alias("id"), v.alias("n")) for i, v in ((k, k * 7919 % 3000000), (-k, k % 30 * 100000 + 50000), (-1000000000 - k, k % 1000 * 1000 + 500))])).alias("v")).select("v.*")
    n = F.col("n")
    return o.select("id", text.byte_size(n).alias("bytes"), text.count_text(n).alias("count_text"))

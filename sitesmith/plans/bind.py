"""Domain tables derived from the test tables with integer arithmetic, in Spark and, as CTEs, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesmith.functions import geo

ZONE_TYPES = ["bed", "patio", "path", "lawn", "wall", "edging"]
PLANT_WORDS = ["Fescue", "Petunia", "Agave", "Sedge", "Marigold", "Sedum", "Maple", "Rose"]
ADDRESS = "1234 noriega st, san francisco, ca"
SITE = (37.7601, -122.4862)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files have fewer splits than there are cores: then reading is no measure of the work that follows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def zones(spark: SparkSession, d: str) -> DataFrame:
    """A zone per line item: a rectangle of l_quantity x (1 + 3 l_linenumber) feet."""
    li = spread(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"))
    w, h = F.col("l_quantity"), (1 + F.col("l_linenumber") * 3).cast("double")
    ring = geo.rectangle(F.lit(0.0), F.lit(0.0), w, h)
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long")).alias("zone_id"),
        F.col("l_orderkey").alias("project_id"), F.col("l_partkey").alias("material_id"), F.col("l_suppkey").alias("owner"),
        F.when(F.col("l_returnflag") == "A", "good").when(F.col("l_returnflag") == "N", "better").otherwise("best").alias("tier"),
        w.alias("w"), h.alias("h"), F.element_at(F.array(*[F.lit(z) for z in ZONE_TYPES]), (F.col("l_linenumber") % 6 + 1).cast("int")).alias("label"), ring.alias("ring"),
    )


ZONES = f"""z AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT, round(l_extendedprice * 100)::BIGINT) AS zone_id,
  l_orderkey AS project_id, l_partkey AS material_id, l_suppkey AS owner,
  CASE l_returnflag WHEN 'A' THEN 'good' WHEN 'N' THEN 'better' ELSE 'best' END AS tier, l_quantity AS w, (1 + l_linenumber * 3)::DOUBLE AS h,
  ({ZONE_TYPES})[l_linenumber % 6 + 1] AS label FROM lineitem)"""


def measured(z: DataFrame) -> DataFrame:
    return z.withColumn("area", geo.ring_area(F.col("ring"))).withColumn("perimeter", geo.ring_perimeter(F.col("ring")))


def materials(spark: SparkSession, d: str, gaps: bool = False) -> DataFrame:
    """A material per part; with gaps, those whose key 13 divides are missing."""
    p = t(spark, d, "part")
    p = p.where("p_partkey % 13 <> 0") if gaps else p
    unit = F.element_at(F.array(*[F.lit(u) for u in ("sq_ft", "cu_yd", "linear_ft", "each")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select(
        F.col("p_partkey").alias("material_id"), F.col("p_name").alias("name"), unit.alias("unit"), F.col("p_retailprice").cast("decimal(12,4)").alias("price"),
        F.when(F.col("p_size") % 7 != 0, (F.col("p_size") % 12 + 1).cast("double")).alias("depth_inches"), F.col("p_type").alias("category"),
    )


def materials_sql(gaps: bool = False) -> str:
    return f"""m AS (SELECT p_partkey AS material_id, p_name AS name, (['sq_ft', 'cu_yd', 'linear_ft', 'each'])[p_partkey % 4 + 1] AS unit, p_retailprice::DECIMAL(12,4) AS price,
  CASE WHEN p_size % 7 <> 0 THEN (p_size % 12 + 1)::DOUBLE END AS depth_inches, p_type AS category FROM part {'WHERE p_partkey % 13 <> 0' if gaps else ''})"""


def assignments(z: DataFrame) -> DataFrame:
    return z.select("project_id", "tier", "zone_id", "material_id", F.lit(None).cast("decimal(12,4)").alias("price_override"), F.lit(None).cast("double").alias("depth_override"))


def sites(spark: SparkSession, d: str, bay: bool = False) -> DataFrame:
    """A site per customer over the world, or over the Bay Area."""
    k = F.col("c_custkey")
    if bay:
        lat, lng = F.lit(37.2) + (k * 37 % 91) / 100.0, F.lit(-122.6) + (k * 91 % 111) / 100.0
    else:
        lat, lng = (k * 37 % 1400) / 10.0 - 70, (k * 91 % 3600) / 10.0 - 180
    # a latitude is a whole number of hundredths, so that band edges are exact on every engine
    return t(spark, d, "customer").select(k.alias("site_id"), F.round(lat, 2).alias("lat"), F.round(lng, 2).alias("lng"), F.col("c_acctbal").alias("elev"), (k % 2 == 0).alias("coastal"))


def sites_sql(bay: bool = False) -> str:
    lat, lng = ("37.2::DOUBLE + (c_custkey * 37 % 91) / 100.0::DOUBLE", "-122.6::DOUBLE + (c_custkey * 91 % 111) / 100.0::DOUBLE") if bay else (
        "(c_custkey * 37 % 1400) / 10.0::DOUBLE - 70", "(c_custkey * 91 % 3600) / 10.0::DOUBLE - 180")
    return f"s AS (SELECT c_custkey AS site_id, round({lat}, 2) AS lat, round({lng}, 2) AS lng, c_acctbal AS elev, c_custkey % 2 = 0 AS coastal FROM customer)"


def cloud(spark: SparkSession, d: str) -> DataFrame:
    """A small cloud: three dimensions of the embeddings, a scan a label; idx is the place in the scan."""
    from pyspark.sql import Window

    e = t(spark, d, "embeddings")
    k = F.col("vec_id")
    colour = lambda m: F.when(k % 11 != 0, (k * m % 256).cast("int"))
    idx = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").alias("scan_id"), idx.cast("long").alias("idx"), *[F.round(F.col("embedding")[i].cast("double"), 6).alias(c) for i, c in enumerate("xyz")],
                    colour(7).alias("r"), colour(13).alias("g"), colour(29).alias("b"))


CLOUD = """c AS (SELECT label AS scan_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx,
  round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, round(embedding[3]::DOUBLE, 6) AS z,
  CASE WHEN vec_id % 11 <> 0 THEN (vec_id * 7 % 256)::INT END AS r, CASE WHEN vec_id % 11 <> 0 THEN (vec_id * 13 % 256)::INT END AS g,
  CASE WHEN vec_id % 11 <> 0 THEN (vec_id * 29 % 256)::INT END AS b FROM embeddings)"""


def big_cloud(spark: SparkSession, d: str) -> DataFrame:
    """A point per line item, a scan a ship mode's worth of suppliers."""
    li = t(spark, d, "lineitem")
    colour = lambda m: F.when(F.col("l_suppkey") % 11 != 0, (F.col("l_partkey") * m % 256).cast("int"))
    return li.select(
        (F.col("l_suppkey") % 4).cast("int").alias("scan_id"), F.col("l_orderkey").alias("idx"), (F.col("l_quantity") / 10).alias("x"),
        (F.round(F.col("l_extendedprice") * 100).cast("long") % 997 / 100.0).alias("y"), (F.col("l_discount") * 10 + 0.0).alias("z"), colour(7).alias("r"), colour(13).alias("g"), colour(29).alias("b"),
    )


BIG_CLOUD = """c AS (SELECT (l_suppkey % 4)::INT AS scan_id, l_orderkey AS idx, l_quantity / 10 AS x, (round(l_extendedprice * 100)::BIGINT % 997) / 100.0::DOUBLE AS y, l_discount * 10 + 0.0::DOUBLE AS z,
  CASE WHEN l_suppkey % 11 <> 0 THEN (l_partkey * 7 % 256)::INT END AS r, CASE WHEN l_suppkey % 11 <> 0 THEN (l_partkey * 13 % 256)::INT END AS g,
  CASE WHEN l_suppkey % 11 <> 0 THEN (l_partkey * 29 % 256)::INT END AS b FROM lineitem)"""


#: Vertices on a side of a scan's grid.
SIDE = 64


def grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles of height fields: a vertex per order, 64 x 64 a scan, two triangles a square whose corners are there."""
    o = spread(t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey"))
    k, i = F.col("o_orderkey"), F.col("o_orderkey") % SIDE**2
    shade = lambda m: (F.col("o_custkey") * m % 256).cast("int")
    v = o.select(F.floor(k / SIDE**2).alias("scan_id"), i.alias("idx"), (i % SIDE + k * 37 % 8 / 16.0).alias("x"), (F.floor(i / SIDE) + k * 91 % 8 / 16.0).alias("y"), (F.round(F.col("o_totalprice") * 100) % 1000 / 400.0).alias("z"), shade(7).alias("r"), shade(13).alias("g"), shade(29).alias("b"))
    tri = lambda j, a, b, c: F.struct((F.col("idx") * 2 + j).alias("tri"), (F.col("idx") + a).alias("i0"), (F.col("idx") + b).alias("i1"), (F.col("idx") + c).alias("i2"))
    made = v.where((F.col("idx") % SIDE < SIDE - 1) & (F.col("idx") < SIDE * (SIDE - 1))).select("scan_id", F.explode(F.array(tri(0, 0, 1, SIDE), tri(1, 1, SIDE + 1, SIDE))).alias("t")).select("scan_id", "t.*")
    for c in ("i0", "i1", "i2"):
        made = made.join(v.select("scan_id", F.col("idx").alias(c)), ["scan_id", c], "left_semi")
    return v, made.select("scan_id", "tri", "i0", "i1", "i2")


GRID = f"""gv AS (SELECT o_orderkey AS k, o_orderkey // {SIDE**2} AS scan_id, o_orderkey % {SIDE**2} AS idx, o_orderkey % {SIDE} + (o_orderkey * 37 % 8) / 16.0::DOUBLE AS x, (o_orderkey % {SIDE**2}) // {SIDE} + (o_orderkey * 91 % 8) / 16.0::DOUBLE AS y,
  (round(o_totalprice * 100) % 1000) / 400.0::DOUBLE AS z FROM orders),
g2 AS (SELECT scan_id, idx * 2 + j AS tri, idx + j AS i0, CASE j WHEN 0 THEN idx + 1 ELSE idx + {SIDE + 1} END AS i1, idx + {SIDE} AS i2 FROM gv, (VALUES (0), (1)) u(j) WHERE idx % {SIDE} < {SIDE - 1} AND idx < {SIDE * (SIDE - 1)}),
gt AS (SELECT g2.*, p.x AS a_x, p.y AS a_y, p.z AS a_z, q.x AS b_x, q.y AS b_y, q.z AS b_z, r.x AS c_x, r.y AS c_y, r.z AS c_z FROM g2 JOIN gv p ON p.k = g2.scan_id * {SIDE**2} + i0 JOIN gv q ON q.k = g2.scan_id * {SIDE**2} + i1 JOIN gv r ON r.k = g2.scan_id * {SIDE**2} + i2)"""

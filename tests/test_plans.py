"""What the plans of queries do once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesmith.functions import geo
from sitesmith.operators import mesh, quote, store
from sitesmith.sources import artefacts


def optimized(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def documents(spark) -> DataFrame:
    projects = spark.createDataFrame([(1, "draft", None), (2, "quoted", "scans/2.ply")], "project_id long, status string, scan_ref string").withColumns({c: F.lit("2024-01-02").cast("date") for c in ("created_at", "updated_at")})
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 0))])
    zones = spark.createDataFrame([(1, "b", "bed", None), (1, "a", "wall", "left")], "project_id long, zone_id string, zone_type string, label string").withColumn("ring", ring)
    assigned = spark.createDataFrame([(1, "best", "b", 7), (1, "good", "b", 8), (1, "good", "a", 9), (1, "odd", "a", 3), (1, None, "a", 4)], "project_id long, tier string, zone_id string, material_id long")
    return artefacts.project_geojson(projects, zones, assigned)


def test_documents_are_parsed_once(spark):
    docs = documents(spark)
    for df in (artefacts.parse_project_tiers(docs), artefacts.parse_project_geojson(docs), artefacts.read_documents(docs).where("fault is null")):
        assert optimized(df).count("from_json(") == 1


def test_document_text(spark):
    zone = '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0.0,0.0],[4.0,0.0],[4.0,3.0],[0.0,0.0]]]},"properties":{"id":"%s","zone_type":"%s"%s}}'
    rest = '"created_at":"2024-01-02T00:00:00Z","updated_at":"2024-01-02T00:00:00Z"}'
    tier = lambda level, *a: '{%s"assignments":[%s]}' % (level, ",".join('{"zone_id":"%s","material_id":%d}' % x for x in a))
    tiers = ",".join([tier("", ("a", 4)), tier('"level":"odd",', ("a", 3)), tier('"level":"good",', ("a", 9), ("b", 8)), tier('"level":"best",', ("b", 7))])
    assert {r["project_id"]: r["geojson"] for r in documents(spark).collect()} == {
        1: '{"type":"FeatureCollection","features":[%s,%s],"project_id":1,"status":"draft","tiers":[%s],' % (zone % ("a", "wall", ',"label":"left"'), zone % ("b", "bed", ""), tiers) + rest,
        2: '{"type":"FeatureCollection","features":[],"project_id":2,"status":"quoted","scan_ref":"scans/2.ply","tiers":[],' + rest,
    }


def test_geometry_is_parsed_once(spark):
    text = F.when(F.col("id") == 0, '{"type":"Polygon","coordinates":[[[0,0],[1,0]],[[2,3]]]}').when(F.col("id") == 1, '{"type":"Polygon","coordinates":[]}')
    df = spark.range(3).select(text.alias("g")).select(geo.from_geojson(F.col("g")).alias("p"))
    assert optimized(df).count("from_json(") == 1
    assert [r["p"] and r["p"].asDict(True) for r in df.collect()] == [{"exterior": [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}], "holes": [[{"x": 2.0, "y": 3.0}]]}, None, None]


def test_updates_meet_their_rows_once(spark):
    """Rows of a null key stay, changes of unknown and null keys are left out."""
    old = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "k string, v int")
    new = spark.createDataFrame([(5, "b"), (6, "c"), (7, None)], "v int, k string")
    df = store.updated(old, new, "k")
    assert "Join" not in optimized(df)
    assert sorted((str(r["k"]), r["v"]) for r in df.collect()) == [("None", 4), ("a", 1), ("b", 5)]


def test_scenes_join_their_zones_once(spark):
    z = spark.createDataFrame([(1, "good", "a", 7), (1, "good", "b", 9), (1, "best", "c", 7), (1, None, "d", 7), (1, None, "e", 9)], "project_id long, tier string, zone_id string, material_id long").withColumn("ring", F.lit(0))
    m = spark.createDataFrame([(7, "stone", 1.0)], "material_id long, category string, depth_inches double")
    made, missing = mesh.scene_zones(z.drop("ring"), z, m)
    assert optimized(made).count("Join ") == 2
    assert sorted(r["zone_id"] for r in made.collect()) == ["c", "d"]
    assert sorted(r["zone_id"] for r in missing.collect()) == ["b", "e"]


def assigned(spark) -> tuple[DataFrame, DataFrame, DataFrame]:
    z = spark.createDataFrame([("a", 10.0, 14.0, "bed"), ("b", 4.0, 8.0, "path")], "zone_id string, area double, perimeter double, label string")
    m = spark.createDataFrame([(7, "Stone", "sq_ft", "2.5", None), (8, "Soil", "cu_yd", "3", None)], "material_id long, name string, unit string, price string, depth_inches double").withColumn("price", F.col("price").cast("decimal(12,4)"))
    rows = [(1, "good", "a", 7), (1, "good", "b", 8), (1, "best", "a", 7), (1, None, "a", 7), (1, None, "b", 9), (None, "best", "b", 7), (None, "best", "b", 8), (2, "best", "b", 7)]
    a = spark.createDataFrame(rows, "project_id long, tier string, zone_id string, material_id long").withColumns({"price_override": F.lit(None).cast("decimal(12,4)"), "depth_override": F.lit(None).cast("double")})
    return a, z, m


def test_clean_tiers_are_priced_once(spark):
    a, z, m = assigned(spark)
    df = quote.clean_line_items(a, z, m)
    assert optimized(df).count("Join ") == 2
    assert sorted(map(str, df.collect())) == sorted(map(str, quote.clean_tiers(quote.line_items(a, z, m), quote.violations(a, z, m)).collect()))


def test_callouts_read_the_rollup_once(spark):
    rollup = spark.createDataFrame([(1, "best", "a", "bed", "x"), (1, "better", "b", "path", "y"), (1, "better", "c", "path", "z"), (2, None, "d", "path", "z")], "project_id long, tier string, zone_id string, label string, materials string")
    areas = rollup.select("zone_id", F.lit(4.0).alias("area_sqft"))
    projects = spark.createDataFrame([(1, "One"), (2, "Two")], "project_id long, name string")
    df = quote.zone_callouts(rollup, areas, projects)
    assert optimized(df).count("Join ") == 2
    assert sorted((r["project_id"], r["zone_id"]) for r in df.collect()) == [(1, "b"), (1, "c")]


def test_narratives_price_once(spark):
    """The same text as from the totals of the items, from one pass over them."""
    a, z, m = assigned(spark)
    items = quote.line_items(a, z, m)
    projects = spark.createDataFrame([(1, "One", "A"), (2, "Two", "B")], "project_id long, name string, address string")
    df = quote.rollup_narrative(quote.zone_rollup(items, totals=True), projects)
    assert optimized(df).count("Join ") == 3
    assert sorted(map(str, df.collect())) == sorted(map(str, quote.narrative(quote.zone_rollup(items), quote.totals(items), projects).collect()))
    assert df.count() == 3

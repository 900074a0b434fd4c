"""Quotes: assignments joined with zones and materials, priced, totalled, compared by tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesmith.functions import geo, money

TIERS = ["good", "better", "best"]


def overrides(text: Column) -> Column:
    """Override JSON -> struct<price, depth_inches>; null for none; bad JSON raises in strict use, see bad_overrides()."""
    return F.from_json(text, "price decimal(12,4), depth_inches double")


def bad_overrides(assignments: DataFrame, col: str = "overrides") -> DataFrame:
    """Assignments whose override text is not a JSON object."""
    return assignments.where(F.col(col).isNotNull() & F.get_json_object(col, "$").isNull())


def priced(assignments: DataFrame, zones: DataFrame, materials: DataFrame) -> DataFrame:
    """Assignments of known zones with measures, unit, effective price and depth, quantity and violation.

    An assignment of an unknown zone is skipped, whatever its material. A known zone without its
    material is a missing_material violation; cubic yards without a depth a missing_depth one.
    Violations have no quantity.
    """
    j = assignments.join(zones.select("zone_id", "area", "perimeter", "label"), "zone_id")
    j = j.join(materials.select("material_id", F.col("name").alias("material_name"), "unit", F.col("price").alias("list_price"), F.col("depth_inches").alias("list_depth")), "material_id", "left")
    j = j.withColumn("price", F.coalesce("price_override", "list_price")).withColumn("depth_inches", F.coalesce("depth_override", "list_depth"))
    violation = F.when(F.col("unit").isNull(), "missing_material").when((F.col("unit") == "cu_yd") & F.col("depth_inches").isNull(), "missing_depth")
    return j.withColumn("quantity", money.quantity(F.col("unit"), F.col("area"), F.col("perimeter"), F.col("depth_inches"))).withColumn("violation", violation)


def line_items(assignments: DataFrame, zones: DataFrame, materials: DataFrame, strict: bool = False, areas: bool = False) -> DataFrame:
    """Line items of tiers; with strict, the first violation raises instead of being left out; with areas, the zone's area comes along."""
    p = priced(assignments, zones, materials)
    if strict:
        p = p.withColumn("violation", F.when(F.col("violation").isNotNull(), F.raise_error(F.concat(F.lit("quote: "), "violation"))))
    return _lines(p.where("violation is null"), *([F.col("area").alias("area_sqft")] if areas else []))


def _lines(good: DataFrame, *more: Column) -> DataFrame:
    return good.select(
        "project_id", "tier", "zone_id", "label", "material_id", "material_name", "unit",
        F.bround(money.as_quantity(F.col("quantity")), 4).cast("decimal(18,4)").alias("quantity"),
        F.col("price").cast("decimal(12,4)").alias("unit_price"), money.line_total(F.col("quantity"), F.col("price")).alias("line_total"), *more,
    )


def violations(assignments: DataFrame, zones: DataFrame, materials: DataFrame) -> DataFrame:
    return priced(assignments, zones, materials).where("violation is not null").select("project_id", "tier", "zone_id", "material_id", "violation")


def totals(items: DataFrame, taxes: DataFrame | None = None) -> DataFrame:
    """Per project and tier: items, subtotal (of rounded lines), tax amount and total."""
    t = items.groupBy("project_id", "tier").agg(F.count("*").alias("items"), F.sum("line_total").cast("decimal(18,2)").alias("subtotal"))
    tax = F.lit(0).cast("decimal(18,2)") if taxes is None else F.coalesce("tax", F.lit(0).cast("decimal(18,2)"))
    t = t if taxes is None else t.join(taxes, ["project_id", "tier"], "left")
    return t.select("project_id", "tier", "items", "subtotal", tax.alias("tax"), (F.col("subtotal") + tax).cast("decimal(18,2)").alias("total"))


def clean_tiers(items: DataFrame, bad: DataFrame) -> DataFrame:
    """Items of tiers without a violation: where one line fails, the quote of its tier fails."""
    return items.join(bad.select("project_id", "tier").distinct(), ["project_id", "tier"], "left_anti")


def clean_line_items(assignments: DataFrame, zones: DataFrame, materials: DataFrame) -> DataFrame:
    """The line items of clean_tiers from the assignments themselves, which are priced once."""
    known = F.col("project_id").isNotNull() & F.col("tier").isNotNull()
    bad = F.bool_or(F.col("violation").isNotNull()).over(Window.partitionBy("project_id", "tier")) & known
    return _lines(priced(assignments, zones, materials).withColumn("__bad", bad).where("violation is null and not __bad"))


def compare_tiers(items: DataFrame) -> DataFrame:
    """One row per project and zone with the total of each tier side by side and the first label that a tier has."""
    per = items.groupBy("project_id", "zone_id").agg(
        *[F.sum(F.when(F.col("tier") == t, F.col("line_total"))).cast("decimal(18,2)").alias(t) for t in TIERS],
        F.coalesce(*[F.min(F.when(F.col("tier") == t, F.col("label"))) for t in TIERS], F.lit("Zone")).alias("label"),
    )
    return per.select("project_id", "zone_id", "label", *TIERS)


def zone_rollup(items: DataFrame, catalog: DataFrame | None = None, totals: bool = False) -> DataFrame:
    """Per project, tier and zone: its materials by name, joined by commas, and their number.

    With a catalog (material_id, name), names are those of today's catalog; what is not in it keeps the line item's own name.
    With totals, the zone's total comes along, and the area that the items may have.
    """
    if catalog is not None:
        now = catalog.select("material_id", F.col("name").alias("__name"))
        items = items.join(now, "material_id", "left").withColumn("material_name", F.coalesce("__name", "material_name")).drop("__name")
    total = [F.sum("line_total").alias("total")] if totals else []
    total += [F.min("area_sqft").alias("area_sqft")] if totals and "area_sqft" in items.columns else []
    return items.groupBy("project_id", "tier", "zone_id", "label").agg(
        F.array_join(F.sort_array(F.collect_list(F.coalesce("material_name", F.lit("")))), ", ").alias("materials"), F.count("*").alias("n_materials"), *total
    )


# The sentences of a proposal.
CALLOUT = "%s zone (%s sq ft) featuring %s — designed to complement the overall landscape vision for %s."
INTRO = "Thank you for choosing %s for your %s project at %s. We are pleased to present this comprehensive landscape proposal tailored to your property's unique characteristics and your vision for a beautiful, functional outdoor living space."
CLOSING = "We at %s look forward to bringing your vision for %s to life. Our team is committed to quality craftsmanship and attention to detail throughout every phase of the project. Please don't hesitate to reach out with any questions."


def zone_callouts(rollup: DataFrame, areas: DataFrame, projects: DataFrame) -> DataFrame:
    """A note for each zone of a project's first tier (good before better before best)."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    first = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "tier"))).over(Window.partitionBy("project_id"))
    j = rollup.withColumn("__first", first).where(F.col("__first.tier") == F.col("tier")).join(areas.select("zone_id", "area_sqft"), "zone_id").join(projects.select("project_id", "name"), "project_id")
    return j.select("project_id", "zone_id", F.col("label").alias("zone_label"), F.format_string(CALLOUT, F.col("label"), F.col("area_sqft").cast("string"), F.col("materials"), F.col("name")).alias("note"))


def proposal_documents(items: DataFrame, projects: DataFrame) -> DataFrame:
    """One JSON document a project (name, address, company) with line items that have areas: intro, tiers in order, callouts by zone, closing.

    Items meet by project once: zones, tiers and the document are made of them where they are, and texts only where they are used.
    """
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier")).alias("rank")
    rollup = zone_rollup(items.where("project_id is not null and tier is not null").repartition("project_id"), totals=True)
    tiers = rollup.groupBy("project_id", "tier").agg(
        F.sort_array(F.collect_list("label")).alias("zones"), F.sum("total").cast("decimal(18,2)").alias("total"),
        F.sort_array(F.collect_list(F.struct("zone_id", "label", "area_sqft", "materials"))).alias("spots"),
    )
    per = tiers.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct(rank, "tier", "zones", "total"))).alias("tiers"), F.min_by("spots", F.struct(rank, "tier")).alias("spots"))
    j = per.join(projects, "project_id")
    name, address = F.col("name"), F.col("address")

    def told(t):
        n = _narration(t["tier"], t["zones"], t["total"], name, address)
        return F.struct(t["tier"].alias("tier_level"), n["headline"].alias("headline"), n["description"].alias("description"), F.split(n["differentiators"], "[|]").alias("differentiators"))

    def called(z):
        return F.struct(z["label"].alias("zone_label"), F.format_string(CALLOUT, z["label"], z["area_sqft"].cast("string"), z["materials"], name).alias("note"))

    doc = F.struct(
        F.format_string(INTRO, "company", "name", "address").alias("intro_paragraph"), F.transform("tiers", told).alias("tier_narratives"),
        F.transform("spots", called).alias("zone_callouts"), F.format_string(CLOSING, "company", "name").alias("closing_paragraph"),
    )
    return j.select("project_id", F.to_json(doc).alias("document"))


def narrative(rollup: DataFrame, quote_totals: DataFrame, projects: DataFrame) -> DataFrame:
    """Rule-made proposal text per project and tier."""
    zones = rollup.groupBy("project_id", "tier").agg(F.sort_array(F.collect_list("label")).alias("zones"))
    return _narrated(zones.join(quote_totals, ["project_id", "tier"]), projects)


def rollup_narrative(rollup: DataFrame, projects: DataFrame) -> DataFrame:
    """The narrative from a rollup with totals alone, without tax: one aggregation gives a tier's zones and its total."""
    tiers = rollup.where("tier is not null").groupBy("project_id", "tier").agg(F.sort_array(F.collect_list("label")).alias("zones"), F.sum("total").cast("decimal(18,2)").alias("total"))
    return _narrated(tiers, projects)


def _narrated(tiers: DataFrame, projects: DataFrame) -> DataFrame:
    j = tiers.join(projects.select("project_id", "name", "address"), "project_id")
    return j.select("project_id", "tier", *[c.alias(n) for n, c in _narration(*map(F.col, ("tier", "zones", "total", "name", "address"))).items()])


def _narration(tier: Column, zones: Column, total: Column, name: Column, address: Column) -> dict[str, Column]:
    amount = money.format_dollars(total)
    n = F.size(zones).cast("string")
    return {
        "headline": F.concat(F.initcap(tier), F.lit(" Package for "), name),
        "description": F.concat(F.lit("This "), tier, F.lit(" option for "), name, F.lit(" at "), address, F.lit(" transforms your outdoor space across "), n, F.lit(" zones ("),
                                F.array_join(zones, ", "), F.lit(") with carefully selected materials and professional installation, totaling "), amount, F.lit(".")),
        "differentiators": F.concat_ws("|", F.concat(F.lit("Covers "), n, F.lit(" distinct zones")), F.concat(F.lit("All-inclusive "), amount, F.lit(" pricing")),
                                       F.lit("Professional installation and cleanup")),
    }


def plantings(styles: DataFrame) -> DataFrame:
    """(style_id, area, depth_inches, plants array<struct<name, spacing>>) -> a row per plant: count and cost; the area is shared equally."""
    share = F.col("area") / F.greatest(F.size("plants"), F.lit(1))
    p = styles.select("style_id", share.alias("share"), F.explode("plants").alias("p"))
    return p.select(
        "style_id", F.col("p.name").alias("name"), money.plant_count(F.col("share"), F.col("p.spacing")).alias("plant_count"), money.price_category(F.col("p.name")).alias("unit_price")
    ).withColumn("plant_cost", F.bround(F.col("plant_count").cast("decimal(18,0)") * F.col("unit_price"), 2).cast("decimal(18,2)"))


def planter_styles(styles: DataFrame) -> DataFrame:
    """Per style: plants, plant cost, soil volume and cost, total."""
    plants = plantings(styles).groupBy("style_id").agg(F.sum("plant_count").alias("plants"), F.sum("plant_cost").cast("decimal(18,2)").alias("plant_cost"))
    soil = F.bround(money.as_quantity(money.soil_volume_cuyd(F.col("area"), F.col("depth_inches"))), 3).cast("decimal(18,3)")
    j = styles.select("style_id", soil.alias("soil_cuyd"), money.as_quantity(money.soil_volume_cuyd(F.col("area"), F.col("depth_inches"))).alias("raw")).join(plants, "style_id", "left")
    cost = F.bround(F.col("raw") * F.lit(money.SOIL_PRICE).cast("decimal(12,2)"), 2).cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    return j.select(
        "style_id", F.coalesce("plants", F.lit(0)).cast("long").alias("plants"), F.coalesce("plant_cost", zero).alias("plant_cost"), "soil_cuyd", cost.alias("soil_cost"),
        (F.coalesce("plant_cost", zero) + cost).cast("decimal(18,2)").alias("total_cost"),
    )


def value_scores(scenarios: DataFrame) -> DataFrame:
    """(area, minutes, integration, polish) -> minutes x stars / 10 by area, with the total in a last row."""
    s = scenarios.withColumn("value", F.col("minutes") * (F.col("integration") + F.col("polish")) / 10.0)
    return s.rollup("area").agg(F.count("*").alias("scenarios"), F.round(F.sum("value"), 4).alias("value")).select(F.coalesce("area", F.lit("total")).alias("area"), "scenarios", "value")


# What a planter of each tier is made of: name, unit, price of a unit or, with a spacing, of a plant, depth and spacing in inches.
PLANTER_MATERIALS = [
    ("good", "Echeveria 'Lola' (8\" spacing)", "sq_ft", 5.00, None, 8),
    ("good", "Planting soil", "cu_yd", 45.00, 6.0, None),
    ("better", "Carex praegracilis (12\" spacing)", "sq_ft", 8.00, None, 12),
    ("better", "Planting soil", "cu_yd", 45.00, 6.0, None),
    ("best", "Mixed annuals (6\" spacing)", "sq_ft", 3.00, None, 6),
    ("best", "Planting soil", "cu_yd", 45.00, 6.0, None),
    ("best", "Steel edging", "linear_ft", 3.25, None, None),
]


def planter_materials(spark) -> DataFrame:
    """tier and a material a row; plants are priced by the square foot that their spacing leaves them."""
    rows = [(t, f"{t}/{n}", n, u, p, d, s) for t, n, u, p, d, s in PLANTER_MATERIALS]
    m = spark.createDataFrame(rows, "tier string, material_id string, name string, unit string, plant_price double, depth_inches double, spacing int")
    by_foot = F.when(F.col("spacing").isNotNull(), F.col("plant_price") * 144 / (F.col("spacing") * F.col("spacing"))).otherwise(F.col("plant_price"))
    return m.select("tier", "material_id", "name", "unit", F.round(by_foot, 4).cast("decimal(12,4)").alias("price"), "depth_inches")


def gap_quotes(gaps: DataFrame, candidates: DataFrame) -> DataFrame:
    """A scan's gap as a planter bed between its two features, in three tiers: line items with project_id the scan.

    gaps: a row a scan, as of points.best_gap().
    """
    at = lambda n: candidates.select("scan_id", F.col("cluster_id").alias(f"feature_{n}"), F.col("cx").alias(f"{n}x"), F.col("cy").alias(f"{n}y"))
    j = gaps.join(at("a"), ["scan_id", "feature_a"]).join(at("b"), ["scan_id", "feature_b"])
    ring = geo.gap_rectangle(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.col("clear_length_ft"), F.col("clear_width_ft"))
    zones = j.select(F.col("scan_id").alias("project_id"), F.col("scan_id").cast("string").alias("zone_id"), F.lit("Planter").alias("label"), ring.alias("ring"))
    zones = zones.withColumn("area", geo.ring_area(F.col("ring"))).withColumn("perimeter", geo.ring_perimeter(F.col("ring")))
    materials = planter_materials(gaps.sparkSession)
    none = [F.lit(None).cast("decimal(12,4)").alias("price_override"), F.lit(None).cast("double").alias("depth_override")]
    # a handful of fixed rows: each zone gets the materials of every tier
    tiers = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(f"{t}/{n}").alias("material_id")) for t, n, *_ in PLANTER_MATERIALS])).alias("m")
    assignments = zones.select("project_id", "zone_id", tiers).select("project_id", "zone_id", "m.tier", "m.material_id", *none)
    return line_items(assignments, zones, materials)

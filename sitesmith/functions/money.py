"""Prices, quantities and labels of quotes; money rounds half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Soil and plant prices, keyword lists of plant names.
GRASSES = ["grass", "sedge", "carex", "fescue", "festuca", "hakonechloa", "mondo"]
ANNUALS = ["annual", "petunia", "marigold", "impatiens", "begonia"]
SUCCULENTS = ["succulent", "sedum", "echeveria", "agave", "aloe", "dymondia"]
GRASS_PRICE, ANNUAL_PRICE, SUCCULENT_PRICE, OTHER_PRICE, SOIL_PRICE = "15.00", "8.00", "12.00", "12.00", "45.00"


def quantity(unit: Column, area: Column, perimeter: Column, depth_inches: Column) -> Column:
    """How much of a material a zone takes; null for cubic yards without a depth."""
    return (
        F.when(unit == "sq_ft", area).when(unit == "linear_ft", perimeter).when(unit == "each", F.lit(1.0))
        .when(unit == "cu_yd", area * depth_inches / 12.0 / 27.0)
    )


def as_quantity(q: Column) -> Column:
    """A double as DECIMAL(22,10), wide enough for exact products with prices."""
    return q.cast("decimal(22,10)")


def line_total(q: Column, price: Column) -> Column:
    return F.bround(as_quantity(q) * price.cast("decimal(12,4)"), 2).cast("decimal(18,2)")


def format_dollars(amount: Column) -> Column:
    """-$1,234.50 from a decimal."""
    cents = F.bround(amount, 2)
    return F.concat(F.when(cents < 0, F.lit("-$")).otherwise(F.lit("$")), F.format_number(F.abs(cents), 2))


def unit_label(unit: Column) -> Column:
    return F.when(unit == "sq_ft", "sq ft").when(unit == "linear_ft", "lin ft").when(unit == "cu_yd", "cu yd").when(unit == "each", "ea").otherwise(unit)


def plant_count(area: Column, spacing_inches: Column) -> Column:
    """floor(area / (spacing / 12)^2); 0 for a spacing that isn't positive."""
    return F.when(spacing_inches > 0, F.floor(area / ((spacing_inches / 12.0) * (spacing_inches / 12.0)))).otherwise(0).cast("long")


def soil_volume_cuyd(area: Column, depth_inches: Column) -> Column:
    return area * depth_inches / 324.0


def price_category(name: Column) -> Column:
    low = F.lower(name)
    has = lambda words: low.rlike("|".join(words))
    price = lambda p: F.lit(p).cast("decimal(12,2)")
    return F.when(has(GRASSES), price(GRASS_PRICE)).when(has(ANNUALS), price(ANNUAL_PRICE)).when(has(SUCCULENTS), price(SUCCULENT_PRICE)).otherwise(price(OTHER_PRICE))


def spacing_in_name(name: Column, default: int = 6) -> Column:
    """Inches in a name like 'Fescue (8" spacing)'."""
    found = F.regexp_extract(name, r"\((\d+)\" spacing\)", 1)
    return F.when(found == "", F.lit(default)).otherwise(found.cast("int"))

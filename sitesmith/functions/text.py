"""Text and value helpers: addresses, file names, contacts, limits, event framing, colours, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_address(a: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(a), r"\s+", " "))


def sanitize_filename(s: Column) -> Column:
    return F.lower(F.regexp_replace(s, r"[^\p{L}\p{N}_-]", "-"))


def contact_field(contact_json: Column, field: str) -> Column:
    return F.get_json_object(contact_json, f"$.{field}")


def positive_limit(text: Column, fallback: int) -> Column:
    """A positive integer, or the fallback."""
    n = F.expr("NULL") if text is None else text.try_cast("long")
    return F.when(n > 0, n).otherwise(F.lit(fallback)).cast("long")


def sse_messages(text: Column) -> Column:
    """Bodies of the 'data: ' lines of a text of server-sent events."""
    frames = F.split(text, "\n\n")
    data = F.filter(F.transform(frames, F.trim), lambda x: x.startswith("data:"))
    return F.transform(data, lambda x: F.trim(F.substring(x, 6, 1_000_000)))


def rounded_half_even(x: Column) -> Column:
    """Tenths of a non-negative number as a long, rounded by the number's exact binary value, and half to even where it is a tie itself."""
    # ten times x as a sum of two exact products; err is what that sum lost
    a, b = x * 8.0, x * 2.0
    s = a + b
    err = (a - (s - (s - a))) + (b - (s - a))
    low = F.floor(s)
    up = (s - low > 0.5) | ((s - low == 0.5) & ((err > 0) | ((err == 0) & (low % 2 == 1))))
    return low + F.when(up, 1).otherwise(0)


def byte_size(n: Column) -> Column:
    """B, whole KB or MB with one decimal, in powers of a thousand."""
    tenths = rounded_half_even(n / 1e6)
    mb = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" MB"))
    return (
        F.when(n >= 1_000_000, mb)
        .when(n >= 1000, F.concat(F.bround(n.cast("decimal(20,0)") / 1000, 0).cast("decimal(20,0)").cast("string"), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def count_text(n: Column) -> Column:
    """Thousands separated by commas."""
    return F.format_number(n, 0)


def classify_rgb(r: Column, g: Column, b: Column) -> Column:
    """white, gray, green, brown or mixed by the first rule that holds; unknown without a colour."""
    spread = F.greatest(r, g, b) - F.least(r, g, b)
    return (
        F.when(r.isNull() | g.isNull() | b.isNull(), "unknown")
        .when((r > 200) & (g > 200) & (b > 200), "white")
        .when((spread < 30) & (F.greatest(r, g, b) > 50), "gray")
        .when((g > 80) & (g > r * 1.2) & (g > b * 1.2), "green")
        .when((r > 80) & (r > g) & (g > 40) & (b < g), "brown")
        .otherwise("mixed")
    )


def darken(channel: Column, factor: float = 0.6) -> Column:
    return (channel * factor).cast("int")


def blend(base: Column, tint: Column, alpha: float = 0.15) -> Column:
    return (base * (1 - alpha) + tint * alpha).cast("int")


#: Display colours of feature categories (r, g, b).
CATEGORY_COLOURS = {"tree": (34, 197, 94), "planting": (34, 197, 94), "structure": (107, 114, 128), "hardscape": (217, 119, 6), "utility": (239, 68, 68)}
OTHER_COLOUR = (156, 163, 175)


def category_colour(category: Column) -> Column:
    out = F.when(F.lit(False), F.array(F.lit(0)))
    for k, rgb in CATEGORY_COLOURS.items():
        out = out.when(category == k, F.array(*[F.lit(v) for v in rgb]))
    return out.otherwise(F.array(*[F.lit(v) for v in OTHER_COLOUR]))


def vertical_profile(height: Column, spread: Column, conical: Column) -> Column:
    ratio = height / spread
    return (
        F.when((height < 0.1) | (spread < 0.1), "irregular").when(ratio > 3.0, "columnar").when(ratio < 0.5, "flat")
        .when(conical, "conical").otherwise("spreading")
    )

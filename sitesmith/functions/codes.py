"""Enumerated codes, time stamps of logs and colour maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the store's check constraints.
CODES = {
    "status": ["draft", "quoted", "approved", "complete"],
    "zone_type": ["bed", "patio", "path", "lawn", "wall", "edging"],
    "category": ["hardscape", "softscape", "edging", "fill"],
    "unit": ["sq_ft", "cu_yd", "linear_ft", "each"],
    "tier": ["good", "better", "best"],
}


def checked(code: Column, kind: str) -> Column:
    """The code, or an error for one that is not of its kind; null stays null."""
    return F.when(code.isNull() | code.isin(CODES[kind]), code).otherwise(F.raise_error(F.concat(F.lit(f"unknown {kind}: "), code)))


def unknown(df: DataFrame, col: str, kind: str) -> DataFrame:
    """Rows to set aside because their code is not of its kind."""
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(CODES[kind]))


def ordinal(code: Column, kind: str) -> Column:
    """0-based place among the kind's codes; null for others."""
    at = F.array_position(F.array(*[F.lit(c) for c in CODES[kind]]), code)
    return F.when(at > 0, at - 1).cast("int")


def iso8601(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def file_stamp(iso: Column) -> Column:
    """A stamp that file names can hold."""
    return F.translate(F.replace(iso, F.lit("T"), F.lit("_")), ":Z", "-")


def civil_date(days: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def _bytes(*channels: Column) -> Column:
    return F.array(*[F.floor(c * 255).cast("int") for c in channels])


def heat(value: Column) -> Column:
    """0..1 from blue to red."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return _bytes(v, F.lit(0.0), 1 - v)


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """Channels of 0..255 from hue, saturation and value of 0..1: each falls off with its distance from the hue on the colour wheel."""
    def channel(shift: float) -> Column:
        k = F.pmod(h * 6 + shift, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))
    return _bytes(channel(5.0), channel(3.0), channel(1.0))


def id_colour(i: Column) -> Column:
    """A colour a cluster, hues a golden ratio apart."""
    return hsv_to_rgb(F.pmod(i * 0.618034, F.lit(1.0)), F.lit(0.85), F.lit(0.95))

"""Every registered query of the library and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitesmith.plans import artefacts, quoting, records, scanning, siting, storing, streams

MODULES = (quoting, siting, scanning, storing, artefacts, records, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}

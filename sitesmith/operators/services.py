"""Services that may fail: one protocol, table, rule, Python and failing variants, and a chain in which a failure is a row's and not the job's."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sitesmith.functions import solar
from sitesmith.operators.graph import small


class Answer(NamedTuple):
    """Requests, perhaps with columns more, and by row a result (null where there is none) and why there is none."""

    rows: DataFrame
    result: Column
    error: Column


class Service(Protocol):
    name: str

    def answer(self, requests: DataFrame, wanted: Column) -> Answer:
        """Answers for the rows that are wanted; what it says of others is not read."""


class Failing:
    """Answers nothing, for tests of what callers do then and for services that are switched off."""

    def __init__(self, name: str, error: str):
        self.name, self.error = name, error

    def answer(self, requests: DataFrame, wanted: Column) -> Answer:
        return Answer(requests, F.lit(None), F.lit(self.error))


class Looked:
    """The row of a table whose `key` equals the request's `by`; of several the least. The table is broadcast only if a count finds it small."""

    def __init__(self, name: str, table: DataFrame, key: Column, by: Column, error: str):
        self.name, self.by, self.error = name, by, error
        self.known = table.groupBy(key.alias("__key")).agg(F.min(F.struct(*table.columns)).alias("__row"))

    def answer(self, requests: DataFrame, wanted: Column) -> Answer:
        asked = requests.withColumn("__key", F.when(wanted, self.by)).join(small(self.known), "__key", "left")
        return Answer(asked.withColumnRenamed("__row", "__looked").drop("__key"), F.col("__looked"), F.lit(self.error))


class Ruled:
    """A column expression; null where the rule does not apply."""

    def __init__(self, name: str, rule: Column, error: str):
        self.name, self.rule, self.error = name, rule, error

    def answer(self, requests: DataFrame, wanted: Column) -> Answer:
        return Answer(requests, F.when(wanted, self.rule), F.lit(self.error))


class Called:
    """A Python function of the `inputs` that gives a dict or raises: the exception's text is the row's error. Rows that are not wanted are not called."""

    def __init__(self, name: str, function: Callable[..., dict | None], ddl: str, inputs: list[str]):
        self.name, self.function, self.ddl, self.inputs = name, function, ddl, inputs

    def answer(self, requests: DataFrame, wanted: Column) -> Answer:
        fields, function = StructType.fromDDL(self.ddl), self.function

        def call(want: pd.Series, *args: pd.Series) -> pd.DataFrame:
            rows = []
            for w, *values in zip(want, *args):
                row = dict.fromkeys(fields.names) | {"error": None}
                if w:
                    try:
                        got = function(*(None if pd.isna(v) else v for v in values))
                        row |= {"error": "no answer"} if got is None else got
                    except Exception as e:  # whatever a service raises is its answer for this row
                        row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            return pd.DataFrame(rows, columns=[*fields.names, "error"])

        made = F.pandas_udf(call, StructType([*fields.fields, StructField("error", StringType())]))
        rows = requests.withColumn("__called", made(wanted, *[F.col(c) for c in self.inputs]))
        result = F.struct(*[F.col(f"__called.{n}").alias(n) for n in fields.names])
        return Answer(rows, F.when(F.col("__called.error").isNull(), result), F.col("__called.error"))


def ask(requests: DataFrame, services: list[Service], ddl: str) -> DataFrame:
    """requests with result (of type ddl), the name of the service that gave it, and errors: what those before it said, 'name: why' each.

    Services are asked in order, each only for rows that none before has answered; a row that none answers has a null result and every service's error.
    """
    columns = requests.columns
    rows = requests.withColumns({"result": F.lit(None).cast(ddl), "service": F.lit(None).cast("string"), "errors": F.array().cast("array<string>")})
    for s in services:
        wanted = F.col("result").isNull()
        rows, result, error = s.answer(rows, wanted)
        rows = rows.withColumn("__new", F.when(wanted, result.cast(ddl)))
        got = F.col("__new").isNotNull()
        rows = rows.withColumns({
            "service": F.when(got, s.name).otherwise(F.col("service")),
            "errors": F.when(wanted & ~got, F.array_append("errors", F.concat(F.lit(s.name + ": "), F.coalesce(error, F.lit("no answer"))))).otherwise(F.col("errors")),
            "result": F.coalesce("__new", "result"),
        }).select(*columns, "result", "service", "errors")
    return rows


# Our own choice of plants for a gap: by light, from the least to the most costly, with spacing and depth of soil in inches.
PLANTERS = {
    "full_sun": [("Sedum carpet", "Sedum", 8.0, 4.0), ("Meadow strip", "Fescue", 12.0, 6.0), ("Flower border", "Petunia", 10.0, 8.0)],
    "part_sun": [("Sedge lawn", "Sedge", 12.0, 4.0), ("Marigold edge", "Marigold", 9.0, 6.0), ("Rose bed", "Rose", 24.0, 12.0)],
    "part_shade": [("Sedge drift", "Sedge", 14.0, 5.0), ("Fern bank", "Fern", 18.0, 7.0), ("Maple corner", "Maple", 48.0, 12.0)],
    "full_shade": [("Moss floor", "Moss", 6.0, 4.0), ("Fern grove", "Fern", 20.0, 8.0), ("Hellebore bed", "Hellebore", 16.0, 10.0)],
}
ESTIMATE = "array<struct<style:string,plant:string,spacing:double,depth:double>>"


def estimate_planter(name: str = "rules", area: str = "area_sqft", sun: str = "sun_hours") -> Ruled:
    """Three planter styles for a gap by its light; part shade where its sun is not known, none for a gap without area. Quantities are left to `quote.plantings`."""
    light = F.when(F.col(sun).isNull(), "part_shade").otherwise(solar.light_category(F.col(sun)))
    rule = None
    for category, styles in PLANTERS.items():
        value = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("style", "plant", "spacing", "depth"), s)]) for s in styles])
        rule = F.when(light == category, value) if rule is None else rule.when(light == category, value)
    return Ruled(name, F.when(F.col(area) > 0, rule), "gap without area")

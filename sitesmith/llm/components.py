"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesmith.llm.common import drop_path, new_path, stored


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links of longs -> (id, component) for every linked id; component is the smallest id reachable.

    Each round hooks neighbours onto the smallest neighbour in both directions and is written to
    the shared folder, so lineage stays one round long. Rounds grow with the logarithm of the
    longest path. Loops, repeated links and nulls are ignored; an empty table gives no rows.
    Joins are on a node and a table with one row a node, so AQE can split a hub.
    """
    spark = edges.sparkSession
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path, mark = new_path(spark, "components"), None
    now = stored(now, "components", path)  # read several times a round
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours hang on the smallest
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself hang on the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = new_path(spark, "components")
        small.write.parquet(new)
        now = spark.read.schema(small.schema).parquet(new)
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_path(spark, path)
        path = new
        if got == mark:
            roots = now.select(F.col("v").alias("id")).distinct()
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                roots.select("id", F.col("id").alias("component"))
            )
        mark = got
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

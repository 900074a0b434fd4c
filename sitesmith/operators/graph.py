"""Connected components for cluster operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder in spark.checkpoint.dir. Where none is set a local session gets a temporary one; on a cluster that is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sitesmith-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a table (some 50 bytes a row) is broadcast; beyond it joins shuffle.
SMALL_ROWS = 500_000


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """A stored table with a broadcast hint if it has at most `limit` rows, counted first; otherwise as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(a, b) links among nodes (id) -> (id, label), label the smallest id reachable.

    Every round a node takes the smallest label among its own, its neighbours' and its label's,
    so chains halve in length; each round is cut off at a table in the shared folder.
    """
    both = shared_table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = shared_table(nodes.select("id", F.col("id").alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(now.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = now.join(near, "id", "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("up"))
        step = shared_table(step.join(jump, "label", "left").select("id", F.least("label", F.coalesce("up", "label")).alias("label"), "old"), "labels")
        now = step.select("id", "label")
        if step.where("label <> old").isEmpty():
            return now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

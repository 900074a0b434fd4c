"""Stream sinks that write each batch once, and what runs behind an upload.

A sink keeps a folder a batch and a ledger of the batches that are whole. A batch that the ledger has is
not run again; one that was cut off before it got there is written over. Readers see what the ledger has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitesmith.sources import ply


class Ledger:
    """Numbers of whole batches, an empty file each, in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path
        self.store = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def has(self, batch: int) -> bool:
        return self.store.exists(self._at(f"batch-{batch}"))

    def add(self, batch: int) -> None:
        self.store.create(self._at(f"batch-{batch}"), True).close()

    def batches(self) -> list[int]:
        if not self.store.exists(self._at("")):
            return []
        return sorted(int(f.getPath().getName().removeprefix("batch-")) for f in self.store.listStatus(self._at("")) if f.getPath().getName().startswith("batch-"))


def write_once(stream: DataFrame, path: str, checkpoint: str, handle: Callable[[DataFrame], DataFrame] = lambda df: df, mode: str = "append", before: Callable[[int], None] | None = None) -> StreamingQuery:
    """Run what has come, batch by batch: handle(batch) is written to path once a batch, however often a batch runs.

    before(batch) runs when a batch's rows are written and its entry in the ledger is not; tests stop a stream there.
    """

    def run(df: DataFrame, batch: int) -> None:
        ledger = Ledger(df.sparkSession, f"{path}/ledger")
        if ledger.has(batch):
            return
        handle(df).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        if before:
            before(batch)
        ledger.add(batch)

    return stream.writeStream.foreachBatch(run).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_once(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all whole batches."""
    done = Ledger(spark, f"{path}/ledger").batches()
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/rows/batch={n}" for n in done])


def until_done(start: Callable[[], StreamingQuery], tries: int = 3) -> None:
    """Start a stream again from its checkpoint after a failure."""
    for left in reversed(range(tries)):
        try:
            start().awaitTermination()
            return
        except Exception:
            if not left:
                raise


def on_upload(spark: SparkSession, folder: str, path: str, checkpoint: str, handle: Callable[[DataFrame], DataFrame], files: int = 8, before: Callable[[int], None] | None = None) -> StreamingQuery:
    """PLY files that have come to a folder, some at a time, through handle(points) into path. A file is a scan, or a part of the scan whose folder it is in.

    The parts of a scan need not be in one batch: the first of them takes all that are there, and batches with no part beyond
    these leave the scan out. Parts that come later take it anew, whole; `read_uploads` shows what the last batch made of a scan.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    new = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.ply").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).load(folder).select("path")
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")

    def run(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        ledger = Ledger(spark, f"{path}/ledger")
        if ledger.has(batch):
            return
        came = {r["path"] for r in df.select("path").collect()}  # as many as `files`
        done = [b for b in ledger.batches() if b < batch]
        known = spark.read.schema("path string").parquet(*[f"{path}/files/batch={b}" for b in done]) if done else None
        if known is not None:
            came -= {r["path"] for r in known.where(F.col("path").isin(sorted(came))).collect()}
        paths = sorted(p for part in came for p in _scan_files(spark, root, part))
        paths = list(dict.fromkeys(paths))
        spark.createDataFrame([(p,) for p in paths], "path string").write.mode("overwrite").parquet(f"{path}/files/batch={batch}")
        if paths:
            handle(ply.read_scans(spark, paths)).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        if before:
            before(batch)
        ledger.add(batch)

    return new.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _scan_files(spark: SparkSession, root: str, file: str) -> list[str]:
    """The files of the scan that a file belongs to, as they are now: all of its folder, or itself where it lies in the root."""
    at = spark._jvm.org.apache.hadoop.fs.Path(file)
    if at.getParent().toUri().getPath().rstrip("/") == root:
        return [file]
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath() for f in store.listStatus(at.getParent()) if f.isFile()]
    return [n.toString() for n in names if n.getName().endswith(".ply") and not n.getName().startswith((".", "_"))]


def read_uploads(spark: SparkSession, path: str, schema: str, key: str = "scan_id") -> DataFrame:
    """The rows of all whole batches of uploads; of a scan that several have, those of the last."""
    store = Ledger(spark, f"{path}/rows")
    done = [n for n in Ledger(spark, f"{path}/ledger").batches() if store.store.exists(store._at(f"batch={n}"))]
    if not done:
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", f"{path}/rows").schema(f"{schema}, batch int").parquet(*[f"{path}/rows/batch={n}" for n in done])
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"], "left_semi").drop("batch")

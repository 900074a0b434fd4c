"""Shared helpers: table access, shared-folder tables, checked broadcasts, word splitting."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every operator here: maximal runs of characters that are not ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
SIMILARITY = 0.8
#: Rows up to which an id list (8 bytes a row) may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset a local session gets a temporary one; on a cluster that is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sitesmith-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished stages now rather than at some later collection."""
    gc.collect()
    spark._jvm.System.gc()


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if df has at most `limit` rows, counted first; otherwise df, and the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def split_words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def pieces_of(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `limit` bytes of the column, or of one row, so that few texts are Python objects at a time."""
    lengths = batch.column(column)
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(lengths), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


#: Rows that are sent to Python at a time where they hold texts: a batch is built outside the heap, and its buffers double as they grow.
TEXT_ROWS = 1000


def in_batches(df: DataFrame, run, ddl) -> DataFrame:
    """mapInArrow over rows with texts, in batches of TEXT_ROWS; the session keeps a smaller setting of its own."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name))
    if now <= 0 or now > TEXT_ROWS:
        conf.set(name, str(TEXT_ROWS))
    return df.mapInArrow(run, ddl)


class WordHash(dict):
    """word -> XXH64, remembered for up to `limit` words."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


#: What a worker process remembers between tasks, by the kind of work, and how to let go of it.
_HELD: dict[str, object] = {}
_WORK: list[str] = []


def remembered(kind: str, table: dict) -> dict:
    _HELD[kind] = table
    return table


def turn_to(kind: str) -> None:
    """Called as a task starts: a worker that changes to another kind of work lets go of what the others remember and gives the memory back."""
    if _WORK != [kind]:
        for other, table in _HELD.items():
            if other != kind:
                table.clear()
        _WORK[:] = [kind]
        give_back()


def give_back() -> None:
    """Return freed memory to the system, as allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):  # only glibc has it
        pass


_KNOWN = remembered("words", WordHash())


def known_words() -> WordHash:
    """The hashes of this process; a reused worker keeps the words it has met."""
    turn_to("words")
    return _KNOWN


def word_hashes(words: list[bytes], known: WordHash) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words; none if there are fewer than n words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    m = len(hashes) - n + 1
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + m]
    return mixed(out)


def shingle_hashes(words: list[bytes], known: WordHash, n: int = SHINGLE) -> np.ndarray:
    """Hashes of n-word shingles in order; the whole sequence if it is shorter; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    return rolled(word_hashes(words, known), min(n, len(words)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batches_of(rows, schema: pa.Schema, size: int = 4096):
    """Dicts of column lists from an iterator of tuples, as record batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

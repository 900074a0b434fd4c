"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesmith.llm.common import SHINGLE, SIMILARITY, in_batches, known_words, pieces_of, rolled, table, word_hashes, WordHash

#: MinHash functions, each a band of one row. A block holds an item whole in at most four times the
#: item's size, so a wholly contained item is missed with probability 0.75 ** 32 = 1e-4 at worst.
HASHES = 32
#: Benchmark text that is indexed and sent to tasks at a time; a larger benchmark is searched in so many passes.
BLOCK_BYTES = 32 << 20
MUL = np.random.default_rng(8).integers(1 << 62, 1 << 63, HASHES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BITS = np.uint64(24)


def words_of(text: bytes | None) -> list[bytes]:
    """Unicode-lower-cased words."""
    return text.decode("utf-8", "replace").lower().encode().split() if text else []


def minhash(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minima under every function of the stretches of h that begin at starts, as (function, stretch)."""
    out = np.empty((HASHES, len(starts)), np.uint64)
    for j in range(HASHES):
        np.minimum.reduceat(h * MUL[j], starts, out=out[j])
    return out


def tagged(sig: np.ndarray, size: int) -> np.ndarray:
    """Minima as keys that differ by function and size class."""
    return sig ^ (np.arange(HASHES, dtype=np.uint64)[:, None] << np.uint64(8) | np.uint64(size))


def bucket(keys: np.ndarray) -> np.ndarray:
    """16 bits from the middle of a key; minima are small numbers, so the first bits tell little."""
    return (keys >> _BITS & np.uint64(0xFFFF)).astype(np.int64)


class Index:
    """Benchmark items by size class (the next power of two of their shingle count).

    Items of fewer than five words are one shingle, their whole sequence, and are looked for
    among the documents' sequences of the same length; items of fewer than `least` words are left out.
    """

    def __init__(self, items: list[tuple[int, bytes]], n: int = SHINGLE, least: int = 1):
        self.n, known = n, WordHash()
        self.items, self.sets, self.sizes, keys, rows = [], [], {}, [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        for item, text in items:
            words = words_of(text)
            if len(words) < least:
                continue
            h = np.unique(rolled(word_hashes(words, known), min(n, len(words))))
            at = len(self.items)
            self.items.append(item)
            self.sets.append(h)
            if len(words) < n:
                self.short.setdefault(len(words), {}).setdefault(int(h[0]), []).append(at)
                continue
            size = int(len(words) - n).bit_length()
            self.sizes[size] = self.sizes.get(size, 0) + 1
            sig = tagged(minhash(h, np.zeros(1, np.int64)), size).ravel()
            keys.append(sig)
            rows.append(np.full(len(sig), at))
        keys, rows = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((keys, np.uint64), (rows, np.int64)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], rows[order]
        self.used = np.zeros(1 << 16, bool)
        self.used[bucket(self.keys)] = True

    def candidates(self, h: np.ndarray) -> np.ndarray:
        """Items that share a band with a block of h. Blocks of a class are two stretches of its size and overlap by one;
        stretches of a class are merged from those of the class below. `used` tells most keys apart from the index at once."""
        found, low, at = [], None, None
        for size in sorted(self.sizes):
            if low is None:
                low = minhash(h, np.arange(0, len(h), 1 << size))
            else:
                low = np.minimum.reduceat(low, np.arange(0, low.shape[1], 1 << (size - at)), axis=1)
            at = size
            keys = tagged(np.minimum(low[:, :-1], low[:, 1:]) if low.shape[1] > 1 else low, size).ravel()
            keys = np.unique(keys[self.used[bucket(keys)]])
            a, b = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            found += [self.rows[x:y] for x, y in zip(a[b > a], b[b > a])]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def search(self, text: bytes | None, known: WordHash, threshold: float) -> Iterator[tuple[int, int, int]]:
        """(item, its shingles that the text holds, its shingles) where their share is at least threshold."""
        words = words_of(text)
        if not words:
            return
        w = word_hashes(words, known)
        h = rolled(w, self.n)
        if len(h) and len(self.keys):
            own = None
            for at in self.candidates(h):
                own = np.unique(h) if own is None else own
                held = int(np.isin(self.sets[at], own, assume_unique=True).sum())
                if held >= threshold * len(self.sets[at]) - 1e-9:
                    yield self.items[at], held, len(self.sets[at])
        for length, of in self.short.items():
            got = set(rolled(w, length).tolist())
            for key, ats in of.items() if len(of) < len(got) else ((k, of[k]) for k in got if k in of):
                if key in got:
                    yield from ((self.items[at], 1, 1) for at in ats)


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The items in lists of at most `limit` bytes of text (or one item), streamed to the driver one partition at a time."""
    held, size = [], 0
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("binary"))
    for item, text in rows.toLocalIterator():
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append((item, bytes(text)))
        size += len(text)
    if held:
        yield held


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_item, containment): benchmark items of whose distinct five-word shingles a document holds the share `threshold` or more.

    Words are lower-cased. The benchmark is the query set; it is searched in blocks of bounded
    size against all documents, each in one pass without a shuffle, whole texts however long.
    Items shorter than five words count as held where their whole sequence occurs. Null or
    empty texts and items give no pairs; repeated rows repeat; extra columns are ignored.
    """
    spark, out = docs.sparkSession, None
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64())])
    ddl = "doc_id long, item_id long, n_shared long, n_item long"
    for items in blocks(benchmark):
        sent = spark.sparkContext.broadcast(Index(items))

        def run(batches, sent=sent):
            known = known_words()
            for b in (piece for batch in batches for piece in pieces_of(batch)):
                rows = [(d, *hit) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for hit in sent.value.search(t, known, threshold)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        got = in_batches(cols, run, ddl)
        out = got if out is None else out.unionByName(got)
    out = spark.createDataFrame([], ddl) if out is None else out
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents that hold no benchmark item of five words or more, all columns kept, without a shuffle.

    Shorter items stand in clean documents by chance and take none out. Null and empty texts stay; repeated rows stay or go alike.
    """
    for items in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(Index(items, least=SHINGLE))

        def run(batches, sent=sent):
            known = known_words()
            for b in (piece for batch in batches for piece in pieces_of(batch)):
                texts = (t.encode() if isinstance(t, str) else t for t in b.column("text").to_pylist())
                yield b.filter(pa.array([next(sent.value.search(t, known, threshold), None) is None for t in texts], pa.bool_()))

        docs = in_batches(docs, run, docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

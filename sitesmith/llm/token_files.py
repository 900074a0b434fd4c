"""Token-ID output in binary images: byte planes of fixed-size id blocks, each compressed, with an index."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitesmith.llm.common import in_batches, new_path, pieces_of, remembered, table, turn_to

MAGIC = b"SSTOK\x00\x01\x00"
#: Ids of a block; ids after which an image ends (at a document's end).
BLOCK_IDS = 1 << 16
IMAGE_IDS = 1 << 20
#: Bytes of text of a file on average.
FILE_BYTES = 32 << 20
END_ID = 2
LEVEL = 3
TOKENIZER = "word_bpe_49k.json"


def pack(docs: list[tuple[int | None, np.ndarray]], block_ids: int = BLOCK_IDS, level: int = LEVEL) -> bytes:
    """Documents in order as one image.

    Layout, little-endian: magic; u64 documents, ids, block size, blocks; a byte a document (1:
    it has an id), ids i64, token counts u64; per block its four planes' compressed lengths u32;
    the planes. Plane p of a block holds byte p of each of its ids.
    """
    ids = np.concatenate([x for _, x in docs]).astype("<u4") if docs else np.empty(0, "<u4")
    press = zstandard.ZstdCompressor(level=level)
    planes = []
    for at in range(0, len(ids), block_ids):
        by = ids[at : at + block_ids].view(np.uint8).reshape(-1, 4).T
        planes += [press.compress(np.ascontiguousarray(p).tobytes()) for p in by]
    head = struct.pack("<8s4Q", MAGIC, len(docs), len(ids), block_ids, len(planes) // 4)
    named = np.array([d is not None for d, _ in docs], np.uint8).tobytes()
    doc_ids = np.array([0 if d is None else d for d, _ in docs], "<i8").tobytes()
    counts = np.array([len(x) for _, x in docs], "<u8").tobytes()
    return b"".join([head, named, doc_ids, counts, np.array([len(p) for p in planes], "<u4").tobytes(), *planes])


class Image:
    """A packed image: documents' ids, token counts and blocks; any block is read alone through the index."""

    def __init__(self, data: bytes):
        magic, n, self.n_ids, self.block_ids, n_blocks = struct.unpack_from("<8s4Q", data)
        if magic != MAGIC:
            raise ValueError("not a token image")
        at = 40
        named = np.frombuffer(data, np.uint8, n, at)
        ids = np.frombuffer(data, "<i8", n, at := at + n)
        self.counts = np.frombuffer(data, "<u8", n, at := at + 8 * n).astype(np.int64)
        self.doc_ids = [int(d) if ok else None for d, ok in zip(ids, named)]
        lengths = np.frombuffer(data, "<u4", 4 * n_blocks, at := at + 8 * n).astype(np.int64)
        ends = at + 16 * n_blocks + np.cumsum(lengths)
        self.data, self.starts, self.ends = data, ends - lengths, ends

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.n_ids - k * self.block_ids)
        planes = np.empty((4, n), np.uint8)
        for p in range(4):
            a, b = self.starts[4 * k + p], self.ends[4 * k + p]
            planes[p] = np.frombuffer(zstandard.decompress(self.data[a:b], max_output_size=n), np.uint8)
        return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's ids, holding one block besides the document at a time."""
        block, k, at = np.empty(0, "<u4"), 0, 0
        for doc, n in zip(self.doc_ids, self.counts.tolist()):
            parts = []
            while n:
                if at == len(block):
                    block, k, at = self.block(k), k + 1, 0
                parts.append(block[at : at + n])
                at, n = at + len(parts[-1]), n - len(parts[-1])
            yield doc, np.concatenate(parts) if parts else np.empty(0, "<u4")


_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%$&*#|]*)\Z")


PROBES = ("The cat sat", "Ünïted Words again  and\tAgain", "ab")


class WordEncoder:
    """Encodes with a tokenizer of the tokenizers library whose pre-tokenizer drops white space, one word at a time.

    No piece of such a tokenizer crosses white space, so a text's ids are its words' ids in a
    row; up to `words` words met before are taken from a table, and up to `limit` of their parts from another. New words of letters, apart from trailing
    punctuation, are given to the library many at a time; `ends` tells where one's ids end.
    Anything else is encoded by itself. A tokenizer that does not behave so on PROBES (one that tells cases apart, or whose
    words depend on their neighbours) is given whole texts.
    """

    def __init__(self, path: str, limit: int = 600_000, words: int = 250_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.limit, self.words, self.known, self.cores = limit, min(words, limit), {}, {}
        self.ends = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith("</w>")
        whole = lambda t: self.library.encode(t, add_special_tokens=False).ids
        self.by_word = all(whole(t) == whole(t.lower()) == [i for w in t.split() for i in whole(w)] and all(self.ends[whole(w)[-1]] for w in t.split()) for t in PROBES)

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(words) or at[-1] != len(ids):
            return self._each(words)
        return [ids[a:b].tobytes() for a, b in zip([0, *at[:-1].tolist()], at.tolist())]

    def learn(self, words: list[bytes]) -> None:
        if len(self.cores) > self.limit:
            self.cores.clear()
        split, others = [], []
        for w in words:
            m = _SIMPLE.match(w.decode("utf-8", "replace"))
            if m:
                split.append((w, m[1].lower(), m[2]))
            else:
                others.append(w)
        if new := list({c for _, c, _ in split if c not in self.cores}):
            self.cores.update(zip(new, self._together(new)))
        if new := list({p for _, _, p in split if p not in self.cores}):
            self.cores.update(zip(new, self._each(new)))
        for w, core, tail in split:
            self.known[w] = self.cores[core] + self.cores[tail]
        if others:
            self.known.update(zip(others, self._each([w.decode("utf-8", "replace") for w in others])))

    def __call__(self, text: bytes | None) -> np.ndarray:
        if not self.by_word:
            return np.array(self.library.encode((text or b"").decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")
        words = text.split() if text else []
        try:
            return np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4")
        except KeyError:
            pass
        if len(self.known) > self.words:
            self.known.clear()
        parts = []
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            self.learn([w for w in dict.fromkeys(some) if w not in self.known])
            parts.append(b"".join(map(self.known.__getitem__, some)))
        return np.frombuffer(b"".join(parts), "<u4")


#: Encoders of this process by path; a reused worker keeps the words it has met.
_ENCODERS: dict[str, WordEncoder] = remembered("tokens", {})


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def images(texts: Iterable[tuple[int | None, bytes | None]], encode: Callable, end_id: int, image_ids: int = IMAGE_IDS):
    """(image number, ids, image) of documents in order; an image ends with the document that fills it."""
    held, size, number, end = [], 0, 0, np.array([end_id], "<u4")
    for doc, text in texts:
        ids = np.concatenate([encode(text), end])
        held.append((doc, ids))
        size += len(ids)
        if size >= image_ids:
            yield number, size, pack(held)
            held, size, number = [], 0, number + 1
    if held:
        yield number, size, pack(held)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, files: int | None = None) -> None:
    """Encode documents and write images, in ascending doc_id order (null first), as rows (file, image, n_ids, data) under path.

    Documents are dealt by ranges of doc_id and sorted within; a file is a range. Equal ids are
    ordered by a hash of their texts. The table is Parquet, so any store that Spark can write
    holds it, and a lost task is run again whole. Null text is empty; extra columns are ignored.
    """
    spark = docs.sparkSession
    source = tokenizer
    files = files or max(8, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    ordered = cols.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        from pyspark import TaskContext

        turn_to("tokens")
        encode = encoder(source or tokenizer_path())
        rows = ((d, t) for b in batches for p in pieces_of(b) for d, t in zip(p.column("doc_id").to_pylist(), p.column("text").to_pylist()))
        file = TaskContext.get().partitionId()
        for number, n, data in images(rows, encode, end_id):
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["file", "image", "n_ids", "data"])

    in_batches(ordered, run, "file int, image int, n_ids long, data binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the images under path: doc_id, file, image, place, start, n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            for file, image, data in zip(b.column("file").to_pylist(), b.column("image").to_pylist(), b.column("data").to_pylist()):
                rows, start = [], 0
                for place, (doc, ids) in enumerate(Image(data).documents()):
                    rows.append((doc, file, image, place, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "file", "image", "place", "within", "n_tokens", "ids_crc32"])

    held = spark.read.parquet(path)
    before = lambda over: F.coalesce(F.sum("n_ids").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a file meets in one task, one row an image in one file's
    per_file = held.groupBy("file").agg(F.sum("n_ids").alias("n_ids"))
    per_file = per_file.withColumn("file_start", before(Window.orderBy("file"))).drop("n_ids")
    index = held.select("file", "image", "n_ids").withColumn("image_start", before(Window.partitionBy("file").orderBy("image"))).drop("n_ids")
    docs = held.select("file", "image", "data").mapInArrow(run, "doc_id long, file int, image int, place int, within long, n_tokens long, ids_crc32 long")
    return docs.join(index.join(per_file, "file"), ["file", "image"]).select(
        "doc_id", "file", "image", "place", (F.col("file_start") + F.col("image_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokenized(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write documents' ids under path (a new folder in the shared one if none is given), read them back: doc_id, start, n_tokens, ids_crc32."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"))

"""PLY scans: the first `vertex` element of binary and ASCII files as (scan_id, idx, x, y, z, r, g, b).

`spark.read.format("ply")` after register(spark): a file is read in as many tasks as its vertices ask for, binary ones by
vertex ranges, ASCII ones by byte ranges after one pass that counts lines (read_scans runs it). A header that
is no PLY header fails when the query is planned. Columns that the reader's schema leaves out are not
converted. Written scans are folders of files of bounded size, each with a header of its own.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# PLY type names and numpy's.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4",
    "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
SCHEMA = "scan_id string, idx long, x double, y double, z double, r short, g short, b short"


class InvalidPly(ValueError):
    pass


@dataclass(frozen=True)
class Header:
    order: str  # "<", ">" or "" for ASCII
    count: int
    properties: tuple[tuple[str, str], ...]
    start: int
    first: int = 0  # the place of the file's first vertex in its scan

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, (self.order or "<") + t) for n, t in self.properties])


def header(data: bytes) -> Header:
    """Header of a file whose first element is `vertex`; x, y and z have to be float or double."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise InvalidPly("no PLY header")
    start = data.index(b"\n", end) + 1
    order, count, props, element, first = None, None, [], None, 0
    for line in data[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            order = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": ""}.get(w[1])
        elif w[:2] == ["comment", "first"] and len(w) == 3 and w[2].isdigit():
            first = int(w[2])
        elif w[:1] == ["element"]:
            if element is None and w[1] != "vertex":
                raise InvalidPly("the first element is not vertex")
            element = w[1] if element is None else "other"
            count = int(w[2]) if element == "vertex" else count
        elif w[:1] == ["property"] and element == "vertex":
            if w[1] == "list" or w[1] not in TYPES:
                raise InvalidPly(f"vertex property of type {w[1]}")
            props.append((w[2], TYPES[w[1]]))
    if order is None or count is None:
        raise InvalidPly("no format or no vertex element")
    kinds = dict(props)
    for axis in "xyz":
        if kinds.get(axis) not in ("f4", "f8"):
            raise InvalidPly(f"{axis} is missing or not a float")
    return Header(order, count, tuple(props), start, first)


def to_frame(h: Header, rows: np.ndarray, first: int) -> pd.DataFrame:
    """Vertices as columns; colours only if red, green and blue are all uchar. Coordinates pass through single precision."""
    out = pd.DataFrame({"idx": np.arange(first, first + len(rows), dtype=np.int64), **{a: rows[a].astype(np.float32).astype(np.float64) for a in "xyz"}})
    kinds = dict(h.properties)
    has = all(kinds.get(c) == "u1" for c in ("red", "green", "blue"))
    for short, name in zip("rgb", ("red", "green", "blue")):
        out[short] = pd.array(rows[name].astype(np.int16), dtype="Int16") if has else pd.array([pd.NA] * len(rows), dtype="Int16")
    return out


def parse(data: bytes, chunk: int = 1 << 20):
    """Frames of at most `chunk` vertices."""
    h = header(data)
    if h.order:
        size = h.dtype.itemsize
        if len(data) - h.start < size * h.count:
            raise InvalidPly("fewer vertices than the header says")
        for at in range(0, h.count, chunk):
            yield to_frame(h, np.frombuffer(data, h.dtype, min(chunk, h.count - at), h.start + at * size), at)
        return
    lines = data[h.start :].split(b"\n", h.count)[: h.count]
    if len(lines) < h.count or (h.count and not lines[-1].strip()):
        raise InvalidPly("fewer vertices than the header says")
    for at in range(0, h.count, chunk):
        values = [tuple(x.split()[: len(h.properties)]) for x in lines[at : at + chunk]]
        yield to_frame(h, np.array([tuple(float(v) for v in x) for x in values], np.dtype([(n, "f8") for n, _ in h.properties])), at)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """All PLY files under a path, a file a scan. Files are read by Spark, so any of its stores will do."""

    def run(frames):
        for f in frames:
            for path, data in zip(f["path"], f["content"]):
                for part in parse(data):
                    part.insert(0, "scan_id", path)
                    yield part

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def read_ply_split(spark: SparkSession, path: str, vertices_per_task: int = 1 << 21) -> DataFrame:
    """PLY files under a path (or one file) in tasks of at most so many vertices."""
    return read_scans(spark, path, vertices_per_task)


# --- the data source ---
#: Vertices that are converted at a time, bytes of an ASCII file to a task, and vertices to a written file.
BATCH, RANGE_BYTES, FILE_VERTICES = 1 << 16, 64 << 20, 1 << 22
COLOURS = {"r": "red", "g": "green", "b": "blue"}


def store_of(path: str):
    """The file system of a path and the path in it: a folder that all machines mount, or any store that Arrow opens."""
    from pyarrow import fs

    path = re.sub("^file:/(?!/)", "file:///", path)
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")


def chosen(options) -> list[tuple[str, int]]:
    """The files that a reader's options name: those of a list, or all under a path."""
    paths = json.loads(options["files"]) if "files" in options else [options["path"]]
    return [f for p in paths for f in files_of(p)]


def first_path(options) -> str:
    return next(iter(json.loads(options["files"])), "/") if "files" in options else options["path"]


def files_of(path: str) -> list[tuple[str, int]]:
    """PLY files under a path, or the file, with their sizes; names that begin with _ or . are left out."""
    from pyarrow import fs

    store, at = store_of(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(info.path, info.size)]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    shown = lambda f: not any(part[:1] in "._" for part in f.path[len(at) :].split("/") if part)
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".ply") and shown(f))


def header_of(store, file: str) -> Header:
    """The header of a file, however long its comments are."""
    with store.open_input_file(file) as f:
        data, size = b"", f.size()
        while b"end_header" not in data[-(1 << 20) :] and data[:3] in (b"", b"ply") and len(data) < min(size, 1 << 24):
            data += f.read(1 << 16)
        return header(data + f.read(16))


def scan_of(file: str) -> str:
    """A scan is a folder scan_id=..., or else a file by its path."""
    found = re.search(r"/scan_id=([^/]+)/[^/]*$", file)
    return found[1] if found else file


@dataclass
class Part(InputPartition):
    """Vertices first to first + count of a binary file, or lines that begin in bytes start to stop of an ASCII file, of which the first is line `first`."""

    file: str
    head: Header
    start: int
    stop: int
    first: int
    count: int


class PlySource(DataSource):
    """Options: path, or files (a JSON list of paths of one store); vertices (to a task), bytes (of an ASCII file to a task; needs index), index (a table of lines, see lines_of); for writing encoding (little, big, ascii) and vertices (to a file)."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        store, _ = store_of(first_path(self.options))
        for file, _ in chosen(self.options)[:1]:  # the others are looked at when the query is planned
            header_of(store, file)
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PlyReader(dict(self.options), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PlyWriter(dict(self.options), overwrite)


class PlyReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.options, self.columns = options, columns

    def partitions(self) -> list[Part]:
        per, out = int(self.options.get("vertices", 1 << 21)), []
        store, _ = store_of(first_path(self.options))
        lines = self.lines()
        for file, size in chosen(self.options):
            h = header_of(store, file)
            if h.order:
                if size - h.start < h.dtype.itemsize * h.count:
                    raise InvalidPly(f"{file}: fewer vertices than the header says")
                out += [Part(file, h, 0, 0, at, min(per, h.count - at)) for at in range(0, h.count, per)]
            elif file in lines:
                first = 0
                for start, stop, n in sorted(lines[file]):
                    if first < h.count and n:
                        out.append(Part(file, h, start, stop, first, min(n, h.count - first)))
                    first += n
                if first < h.count:
                    raise InvalidPly(f"{file}: fewer vertices than the header says")
            else:
                out.append(Part(file, h, h.start, size, 0, h.count))
        return out or [Part("", Header("<", 0, (), 0), 0, 0, 0, 0)]

    def lines(self) -> dict[str, list[tuple[int, int, int]]]:
        if "index" not in self.options:
            return {}
        import pyarrow.dataset as ds

        store, at = store_of(self.options["index"])
        out: dict[str, list[tuple[int, int, int]]] = {}
        for r in ds.dataset(at, filesystem=store, format="parquet").to_table().to_pylist():
            out.setdefault(r["file"], []).append((r["start"], r["stop"], r["lines"]))
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        store, _ = store_of(first_path(self.options))
        scan = scan_of(part.file)
        for first, rows in (binary_rows if part.head.order else ascii_rows)(store, part):
            yield self.batch(part.head, scan, first, rows)

    def batch(self, h: Header, scan: str, first: int, rows: np.ndarray) -> pa.RecordBatch:
        """The reader's columns of some vertices; colours only if red, green and blue are all uchar, coordinates through single precision."""
        kinds, n, out = dict(h.properties), len(rows), []
        coloured = all(kinds.get(c) == "u1" for c in COLOURS.values())
        for c in self.columns:
            if c == "scan_id":
                out.append(pa.array([scan]).take(pa.array(np.zeros(n, np.int32))))
            elif c == "idx":
                out.append(pa.array(rows["idx"].astype(np.int64) if "idx" in kinds else np.arange(h.first + first, h.first + first + n)))
            elif c in COLOURS:
                out.append(pa.array(rows[COLOURS[c]].astype(np.int16)) if coloured else pa.nulls(n, pa.int16()))
            else:
                out.append(pa.array(rows[c].astype(np.float32).astype(np.float64)))
        return pa.RecordBatch.from_arrays(out, names=self.columns)


def binary_rows(store, part: Part) -> Iterator[tuple[int, np.ndarray]]:
    kind = part.head.dtype
    with store.open_input_file(part.file) as f:
        f.seek(part.head.start + part.first * kind.itemsize)
        for at in range(0, part.count, BATCH):
            n = min(BATCH, part.count - at)
            yield part.first + at, np.frombuffer(f.read(n * kind.itemsize), kind, n)


def ascii_rows(store, part: Part) -> Iterator[tuple[int, np.ndarray]]:
    kind = np.dtype([(n, "f8") for n, _ in part.head.properties])
    width = len(part.head.properties)
    with store.open_input_file(part.file) as f:
        begun = part.start == part.head.start
        f.seek(part.start if begun else part.start - 1)
        at, rest, done = f.tell(), b"", 0
        while done < part.count:
            data = f.read(1 << 22)
            lines = (rest + data).split(b"\n")
            rest = lines.pop() if data else b""
            if not begun:
                lines, begun = lines[1:], bool(lines)
            take = lines[: part.count - done]
            if take:
                if not all(take):
                    raise InvalidPly(f"{part.file}: fewer vertices than the header says")
                if not data:
                    raise InvalidPly(f"{part.file}: ends within a line, whose last value may be cut")
                tokens = [x.split()[:width] for x in take]
                if min(map(len, tokens)) < width:
                    raise InvalidPly(f"{part.file}: a vertex of fewer values than the header says")
                yield part.first + done, np.array([tuple(map(float, t)) for t in tokens], kind)
            done += len(take)
            if not data:
                break
        if done < part.count:
            raise InvalidPly(f"{part.file}: fewer vertices than the header says")


class LineSource(DataSource):
    """How many lines begin in each byte range of the ASCII bodies under a path: the index pass, over all tasks."""

    @classmethod
    def name(cls) -> str:
        return "ply_lines"

    def schema(self) -> str:
        return "file string, start long, stop long, lines long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LineReader(dict(self.options))


class LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Part]:
        per, out = int(self.options.get("bytes", RANGE_BYTES)), []
        store, _ = store_of(first_path(self.options))
        for file, size in chosen(self.options):
            h = header_of(store, file)
            if not h.order:
                out += [Part(file, h, at, min(size, at + per), 0, 1) for at in range(h.start, size, per)]
        return out or [Part("", Header("", 0, (), 0), 0, 0, 0, 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.count:
            return
        store, _ = store_of(first_path(self.options))
        begins = int(part.start == part.head.start)
        with store.open_input_file(part.file) as f:
            at = part.start - 1 + begins
            f.seek(at)
            while at < part.stop - 1:
                data = f.read(min(1 << 22, part.stop - 1 - at))
                begins += data.count(b"\n")
                at += len(data)
        yield part.file, part.start, part.stop, begins


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class PlyWriter(DataSourceArrowWriter):
    """Rows of a scan as they come become files of at most `vertices` rows in a folder of the scan; rows with and without colours stand in different files.

    Files have hidden names until all tasks are done, so that a reader sees all of a write or nothing of it.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.limit = int(options.get("vertices", FILE_VERTICES))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = store_of(self.options["path"])
        files: list[str] = []
        held: dict[tuple[str, bool], list[np.ndarray]] = {}
        for b in batches:
            f = b.to_pandas()
            coloured = f[["r", "g", "b"]].notna().all(axis=1) if {"r", "g", "b"} <= set(f.columns) else pd.Series(False, index=f.index)
            for (scan, has), g in f.groupby([f["scan_id"].astype(str), coloured], sort=False):
                for other in [k for k in held if k[0] != scan]:  # rows come scan by scan
                    files.append(self.close(store, root, other[0], held.pop(other)))
                for at in range(0, len(g), self.limit):
                    held.setdefault((scan, has), []).append(packed(g.iloc[at : at + self.limit], bool(has)))
                    if sum(map(len, held[scan, has])) >= self.limit:
                        files.append(self.close(store, root, scan, held.pop((scan, has))))
        files += [self.close(store, root, k[0], v) for k, v in held.items()]
        return Written(files)

    def close(self, store, root: str, scan: str, parts: list[np.ndarray]) -> str:
        folder = f"{root}/scan_id={scan}"
        store.create_dir(folder, recursive=True)
        name = f"{folder}/.part-{uuid.uuid4().hex}.ply"
        with store.open_output_stream(name) as f:
            for data in file_pieces(parts, self.options.get("encoding", "little")):
                f.write(data)
        return name

    def commit(self, messages: list) -> None:
        store, _ = store_of(self.options["path"])
        try:
            old = [f for f, _ in files_of(self.options["path"])] if self.overwrite else []
        except FileNotFoundError:
            old = []
        for file in (f for m in messages if m for f in m.files):
            store.move(file, file.replace("/.part-", "/part-"))
        for file in old:
            store.delete_file(file)

    def abort(self, messages: list) -> None:
        store, _ = store_of(self.options["path"])
        for file in (f for m in messages if m for f in m.files):
            store.delete_file(file)


def packed(points: pd.DataFrame, coloured: bool) -> np.ndarray:
    """Vertices as the file holds them, 20 or 23 bytes each, so that a file's rows can be kept until their number is known."""
    rows = np.empty(len(points), np.dtype([("idx", "i8"), *((c, "f4") for c in "xyz"), *((c, "u1") for c in COLOURS.values() if coloured)]))
    for name in rows.dtype.names:
        rows[name] = points[{v: k for k, v in COLOURS.items()}.get(name, name)].to_numpy()
    return rows


def file_pieces(parts: list[np.ndarray], encoding: str) -> Iterator[bytes]:
    """A PLY file of some vertices of a scan, piece by piece: their places are a comment where they follow each other, else a property."""
    follow = all((np.diff(p["idx"]) == 1).all() for p in parts) and all(p["idx"][-1] + 1 == q["idx"][0] for p, q in zip(parts, parts[1:]))
    order = {"little": "<", "big": ">", "ascii": ""}[encoding]
    fields = [(n, parts[0].dtype[n].str[1:]) for n in parts[0].dtype.names if n != "idx"] + [("idx", "f8")] * (not follow)
    types = {"f4": "float", "u1": "uchar", "f8": "double"}
    props = "".join(f"property {types[t]} {n}\n" for n, t in fields)
    kind = {"little": "binary_little_endian", "big": "binary_big_endian", "ascii": "ascii"}[encoding]
    yield (f"ply\nformat {kind} 1.0\n" + (f"comment first {parts[0]['idx'][0]}\n" if follow else "") + f"element vertex {sum(map(len, parts))}\n{props}end_header\n").encode()
    for p in parts:
        rows = np.empty(len(p), np.dtype([(n, (order or "<") + t) for n, t in fields]))
        for name, _ in fields:
            rows[name] = p[name]
        yield rows.tobytes() if order else "".join(" ".join(map(str, r)) + "\n" for r in rows.tolist()).encode()


def file_bytes(points: pd.DataFrame, encoding: str, coloured: bool) -> bytes:
    return b"".join(file_pieces([packed(points, coloured)], encoding))


def register(spark: SparkSession) -> None:
    """Make the formats known; their classes go to workers as they are, so that no worker needs the package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    for source in (PlySource, LineSource):
        spark.dataSource.register(source)


def read_scans(spark: SparkSession, path: str | list[str], vertices: int = 1 << 21, range_bytes: int = RANGE_BYTES, columns: str = SCHEMA) -> DataFrame:
    """All scans under a path, or in the files of a list, ASCII files after one pass over them that counts lines.

    columns: the columns to read, as DDL; others are not converted.
    """
    from sitesmith.operators.graph import shared_path

    register(spark)
    where = {"files": json.dumps(path)} if isinstance(path, list) else {"path": path}
    lines = spark.read.format("ply_lines").options(bytes=range_bytes, **where).load()
    index = shared_path(spark, "ply-lines")
    lines.coalesce(1).write.parquet(index)  # a row for each range
    return spark.read.format("ply").schema(columns).options(vertices=vertices, index=index, **where).load()


def write_scans(points: DataFrame, path: str, encoding: str = "little", vertices: int = FILE_VERTICES, mode: str = "append") -> None:
    """Scans as PLY files under a path, a folder a scan, written over all tasks by ranges of scan and place."""
    register(points.sparkSession)
    cols = points.select(F.col("scan_id").cast("string").alias("scan_id"), F.col("idx").cast("long").alias("idx"), *[F.col(c).cast("double").alias(c) for c in "xyz"], *[F.col(c).cast("short").alias(c) for c in "rgb"])
    cols.repartitionByRange("scan_id", "idx").sortWithinPartitions("scan_id", "idx").write.format("ply").option("encoding", encoding).option("vertices", vertices).mode(mode).save(path)


def ply_bytes(points: pd.DataFrame, order: str = "<") -> bytes:
    """A binary PLY file of x, y, z and, without nulls, r, g, b."""
    colours = points[["r", "g", "b"]].notna().all().all() if {"r", "g", "b"} <= set(points.columns) else False
    fields = [("x", "f4"), ("y", "f4"), ("z", "f4")] + ([("red", "u1"), ("green", "u1"), ("blue", "u1")] if colours else [])
    rows = np.zeros(len(points), np.dtype([(n, order + t) for n, t in fields]))
    for n, c in (("x", "x"), ("y", "y"), ("z", "z"), *((("red", "r"), ("green", "g"), ("blue", "b")) if colours else ())):
        rows[n] = points[c].to_numpy()
    props = "".join(f"property {'uchar' if t == 'u1' else 'float'} {n}\n" for n, t in fields)
    kind = "little" if order == "<" else "big"
    return f"ply\nformat binary_{kind}_endian 1.0\nelement vertex {len(points)}\n{props}end_header\n".encode() + rows.tobytes()

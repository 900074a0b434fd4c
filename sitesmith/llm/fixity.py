"""WARC records and a Merkle fixity audit of replicas."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitesmith.llm.common import drop_path, new_path, stored, table

#: Children of a node on average: a node ends after a child whose hash ends in a zero digit (of 16).
FANOUT = 16
#: Levels between the records and the root, so that a file of FILE_RECORDS has some few nodes below its root.
DEPTH = 3
#: Records and bytes of a file on average.
FILE_RECORDS = 4096
FILE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
START = b"WARC/1."


# --- records and files ---

def record(url: str | None, body: bytes | None, number: int | None) -> bytes:
    """One WARC/1.1 resource record; a null url or body is empty."""
    body = body or b""
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if number is None else number}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def records(pages: DataFrame, body: str = "html") -> DataFrame:
    """(page_id, url, html) -> page_id, url, record: what record() makes, in column functions; nulls are empty."""
    b = F.coalesce(F.col(body).cast("binary"), F.lit(b"").cast("binary"))
    url = F.coalesce(F.col("url"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(b).cast("string"), F.lit("\r\n\r\n"),
    ).cast("binary")
    return pages.select("page_id", "url", F.concat(head, b, F.lit("\r\n\r\n").cast("binary")).alias("record"))


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _whole(data: bytes, at: int) -> tuple[int, dict[str, str], int] | None:
    """(end, headers, start of the body) of the record at `at` if it is one and ends where it says."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0 or not data.startswith(START, at):
        return None
    headers = _headers(data[at:end])
    size = headers.get("Content-Length", "")
    stop = end + 4 + (int(size) if size.isdecimal() else -1)
    if data.find(START + b"1\r\n", at + 1, end) >= 0:  # the header itself was cut off within
        return None
    return (stop + 4, headers, end + 4) if stop >= end + 4 and data[stop : stop + 4] == b"\r\n\r\n" else None


def parse_warc(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, body) of each record of an uncompressed WARC file, by Content-Length; a damaged one raises."""
    at = 0
    while at < len(data):
        got = _whole(data, at)
        if got is None:
            raise ValueError(f"no whole record at byte {at}")
        stop, headers, body = got
        yield at, stop - at, headers, data[body : stop - 4]
        at = stop


def scan_warc(data: bytes) -> Iterator[tuple[int, int, str | None]]:
    """(offset, length, record id) of everything in a possibly damaged WARC file, without a gap.

    A record that does not end where it says reaches to the next line that begins a record, so
    damage costs what it touches; its id is read if its header still has one.
    """
    at = 0
    while at < len(data):
        got = _whole(data, at)
        if got:
            stop, headers, _ = got
        else:
            stop = data.find(START + b"1\r\n", at + 1)
            stop = len(data) if stop < 0 else stop
            end = data.find(b"\r\n\r\n", at, stop)
            headers = _headers(data[at : stop if end < 0 else end])
        yield at, stop - at, headers.get("WARC-Record-ID")
        at = stop


def file_count(pages: DataFrame, body: str = "html") -> int:
    n, size = pages.agg(F.count("*"), F.sum(F.octet_length(body))).first()
    return max(1, -(-n // FILE_RECORDS), -(-(size or 0) // FILE_BYTES))


def dealt(recs: DataFrame, files: int) -> DataFrame:
    """Records with the file that a hash of page_id and url gives them."""
    name = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")))
    return recs.withColumn("file", (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % files).cast("long"))


def warc_files(recs: DataFrame, files: int = 200) -> DataFrame:
    """(file, page_id, url, record) -> (file, data): each file's records, nulls first, by page_id, url and bytes, as one WARC body.

    A file is held by one task, so dealt() bounds its size, and tasks are as many as files; no file is made of no records.
    """

    def run(batches):
        now, held = None, []
        for b in batches:
            for file, rec in zip(b.column("file").to_pylist(), b.column("record").to_pylist()):
                if file != now:
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["file", "data"])
                    now, held = file, []
                held.append(rec)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["file", "data"])

    rows = recs.select(F.col("file").cast("long").alias("file"), "page_id", "url", "record")
    return rows.repartition(files, "file").sortWithinPartitions("file", "page_id", "url", "record").select("file", "record").mapInArrow(run, "file long, data binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Uncompressed .warc files under path -> (file, data), a file named by a hash of its name without the folder."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(path).select(F.xxhash64(name).alias("file"), F.col("content").alias("data"))


# --- trees ---

def leaf_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def grown(leaves: list[tuple[str, int]]) -> list[list[tuple[str, int, int]]]:
    """(hash, bytes) of a file's records in order -> its nodes by level, (hash, bytes, parent's number); the last level is the root.

    A node's children are a stretch that ends by what its last child hashes to, so a lost or
    added record moves no other boundary than its own. A node hashes its children's hashes and
    byte counts in order: offsets within it are fixed, offsets in the file are not part of it.
    """
    out, row = [], leaves
    for level in range(DEPTH + 1):
        top, ups, groups = level == DEPTH, [], [[]]
        for h, size in row:
            ups.append(len(groups) - 1)
            groups[-1].append((h, size))
            if not top and h.endswith("0"):
                groups.append([])
        if not groups[-1] and len(groups) > 1:
            groups.pop()
        out.append([(h, size, up) for (h, size), up in zip(row, ups)])
        row = [(hashlib.sha256("|".join(f"{size}:{h}" for h, size in g).encode()).hexdigest(), sum(size for _, size in g)) for g in groups]
    return [*out, [(*row[0], 0)]]


TREE_DDL = "file long, level int, node int, up int, hash string, offset long, length long, key string"


def trees(files: DataFrame) -> DataFrame:
    """(file, data) of WARC files -> every node of their trees; level 0 are the records, with their ids."""

    def run(batches):
        for b in batches:
            for file, data in zip(b.column("file").to_pylist(), b.column("data").to_pylist()):
                found = list(scan_warc(data or b""))
                levels = grown([(leaf_hash(data[at : at + n]), n) for at, n, _ in found])
                for level, nodes in enumerate(levels):
                    at, rows = 0, []
                    for i, (h, n, up) in enumerate(nodes):
                        rows.append((file, level, i, up, h, at, n, found[i][2] if level == 0 else None))
                        at += n
                    if rows:
                        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in TREE_DDL.split(", ")])

    return files.select(F.col("file").cast("long"), F.col("data").cast("binary").alias("data")).mapInArrow(run, TREE_DDL)


def settle(a: list[tuple], b: list[tuple]) -> Iterator[tuple[tuple | None, tuple | None, str]]:
    """Records (node, key, hash, ...) of two replicas' differing branches of one file -> (of a, of b, status) of those that differ.

    Equal records are paired in order, and those outside a longest common order are "moved".
    Others are "corrupt" where both replicas hold the id, or hold as yet unpaired records between the
    same neighbours; what is left is "missing" (from b) or "extra" (in b).
    """
    a, b = sorted(a), sorted(b)
    where: dict[str, list[int]] = defaultdict(list)
    for j in range(len(b) - 1, -1, -1):
        where[b[j][2]].append(j)
    pairs = [(i, where[x[2]].pop()) for i, x in enumerate(a) if where.get(x[2])]
    tails, ends, before = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        tails[at:], ends[at:] = [j, *tails[at + 1 :]], [k, *ends[at + 1 :]]
        before[k] = ends[at - 1] if at else -1
    k, steady = (ends[-1] if ends else -1), set()
    while k >= 0:
        steady.add(k)
        k = before[k]
    yield from ((a[i], b[j], "moved") for k, (i, j) in enumerate(pairs) if k not in steady)
    fixed = [pairs[k] for k in sorted(steady)]
    left, right = sorted(set(range(len(a))) - {i for i, _ in pairs}), sorted(set(range(len(b))) - {j for _, j in pairs})
    keys: dict[str, list[int]] = defaultdict(list)
    for j in reversed(right):
        if b[j][1] is not None:
            keys[b[j][1]].append(j)
    same = [(i, keys[a[i][1]].pop()) for i in left if a[i][1] is not None and keys.get(a[i][1])]
    gaps: dict[int, list[int]] = defaultdict(list)
    taken = {j for _, j in same}
    js = [j for _, j in fixed]
    for j in reversed(right):
        if j not in taken:
            gaps[bisect_left(js, j)].append(j)
    got = {i for i, _ in same}
    firsts = [i for i, _ in fixed]
    for i in left:
        if i not in got and gaps.get(gap := bisect_left(firsts, i)):
            same.append((i, gaps[gap].pop()))
    yield from ((a[i], b[j], "corrupt") for i, j in same)
    got, taken = {i for i, _ in same}, {j for _, j in same}
    yield from ((a[i], None, "missing") for i in left if i not in got)
    yield from ((None, b[j], "extra") for j in right if j not in taken)


FOUND_DDL = "file long, key string, status string, offset long, length long, offset_b long, length_b long"


def _settled(a: pa.Table, b: pa.Table) -> pa.Table:
    names = ["node", "key", "hash", "offset", "length"]
    x, y = (list(zip(*(t.column(n).to_pylist() for n in names))) for t in (a, b))
    file = (a if a.num_rows else b).column("file")[0].as_py()
    rows = [(file, (p or q)[1], s, *(p[3:] if p else (None, None)), *(q[3:] if q else (None, None))) for p, q, s in settle(x, y)]
    types = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4]
    cols = list(zip(*rows)) or [()] * 7
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in FOUND_DDL.split(", ")])


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, data) of two replicas -> the records that differ: file, key (record id), status, offset and length in a, offset_b, length_b.

    Every tree is built and stored once. Roots are compared first; then, level by level, only
    children of nodes that differ: those of the same file and hash on both sides are equal, as
    many as both have. What differs in the lowest nodes is settled a file at a time; a file's
    records bound that. status: corrupt, missing (only a), extra (only b), moved (another order).
    A file that one replica lacks is missing or extra whole. Records without an id, repeated
    ids and equal records are records like any other. Empty replicas give no rows.
    """
    spark, path = a.sparkSession, [new_path(a.sparkSession, f"fixity-{s}") for s in "ab"]
    both = [stored(trees(x), "fixity", p) for x, p in zip((a, b), path)]
    order = Window.partitionBy("file", "hash").orderBy("node")
    steps, differ = [], [None, None]
    for level in range(DEPTH + 1, 0, -1):
        kids = []
        for t, up in zip(both, differ):
            k = t.where(F.col("level") == level)
            if up is not None:
                k = k.join(up.select("file", F.col("node").alias("up")), ["file", "up"], "left_semi")
            kids.append(k.select("file", "node", "hash", F.row_number().over(order).alias("nth")))
        differ = []
        for x, y in (kids, kids[::-1]):
            steps.append(new_path(spark, "fixity-level"))
            differ.append(stored(x.join(y, ["file", "hash", "nth"], "left_anti").select("file", "node"), "fixity-level", steps[-1]))
    leaves = [t.where("level = 0").join(d.select("file", F.col("node").alias("up")), ["file", "up"], "left_semi").select("file", "node", "key", "hash", "offset", "length") for t, d in zip(both, differ)]
    out = stored(leaves[0].groupBy("file").cogroup(leaves[1].groupBy("file")).applyInArrow(_settled, FOUND_DDL), "fixity-found")
    for p in (*path, *steps):
        drop_path(spark, p)
    return out


# --- the query ---

#: Faults of the second replica by page_id, the first that holds: (divisor, rest, what happens to the record).
FAULTS = [(389, 7, "end"), (211, 5, "lost"), (601, 9, "start"), (97, 13, "byte"), (503, 3, "url")]


def damaged(recs: DataFrame) -> DataFrame:
    """A replica with faults by rule (FAULTS): its last 16 bytes lost, the record lost, its first byte or one in its middle another, or another id and url.

    Records without a page_id are left alone.
    """
    other = lambda at: F.concat(F.expr(f"substring(record, 1, {at})"), F.when(F.expr(f"substring(record, {at} + 1, 1) = X'00'"), F.lit(b"\x01")).otherwise(F.lit(b"\x00")), F.expr(f"substring(record, {at} + 2)"))
    made = {
        "end": F.expr("substring(record, 1, length(record) - 16)"), "lost": F.lit(None).cast("binary"), "start": other("0"), "byte": other("length(record) - 10"),
        "url": F.expr("cast(replace(cast(record as string), '<urn:page:', '<urn:copy:') as binary)"),
    }
    out = F.col("record")
    for divisor, rest, what in reversed(FAULTS):
        out = F.when(F.col("page_id") % divisor == rest, made[what]).otherwise(out)
    return recs.withColumn("record", out).where("record is not null")


def op5_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC files of one replica, the same with faults by rule as the other; the faults that the audit finds."""
    pages = table(spark, sf_dir, "pages")
    files = file_count(pages)
    recs = dealt(records(pages), files)
    return audit(warc_files(recs, files), warc_files(damaged(recs), files))


def _oracle() -> str:
    head = len(record("", b"", None)) - 1  # without the digits of the length
    when = " ".join(f"WHEN page_id % {d} = {r} THEN '{what}'" for d, r, what in FAULTS)
    return f"""
WITH n AS (SELECT greatest(1, ceil(count(*) / {FILE_RECORDS}.0), ceil(coalesce(sum(strlen(html)), 0) / {FILE_BYTES}.0))::BIGINT AS files FROM pages),
p AS (SELECT page_id, url, html, CASE {when} END AS fault,
    {head} + strlen(coalesce(page_id::VARCHAR, '')) + strlen(coalesce(url, '')) + strlen(coalesce(strlen(html), 0)::VARCHAR) + coalesce(strlen(html), 0) AS length,
    ('0x' || substr(md5(coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')), 1, 8))::BIGINT % (SELECT files FROM n) AS file FROM pages),
b AS (SELECT *, CASE fault WHEN 'lost' THEN NULL WHEN 'end' THEN length - 16 ELSE length END AS length_b FROM p),
o AS (SELECT *, coalesce(sum(length) OVER w, 0)::BIGINT AS start, coalesce(sum(length_b) OVER w, 0)::BIGINT AS start_b FROM b
  WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS FIRST, url NULLS FIRST, html NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT file, '<urn:page:' || coalesce(page_id::VARCHAR, '') || '>' AS key, CASE fault WHEN 'lost' THEN 'missing' ELSE 'corrupt' END AS status,
  start AS "offset", length::BIGINT AS length, CASE WHEN length_b IS NOT NULL THEN start_b END AS offset_b, length_b::BIGINT AS length_b
FROM o WHERE fault IS NOT NULL
"""


#: The faults by rule, without any tree.
ORACLE = _oracle()

"""Exact removal of repeated byte strings by bucket-pointer refinement of sampled suffixes.

A window is a string of DEPTH bytes. Sorting all suffixes would write one row a byte; instead a
window is represented by one suffix in it, chosen by its content alone (the smallest name of eight
bytes among the first SPAN places), so that equal windows choose the same one and a run of some
SPAN / 2 windows, a class, shares it.

1. Initial buckets: suffixes by the name of their first GRAM bytes. A bucket of one place is alone.
2. Names of later offsets: the name of 2h bytes is made of the names of h bytes here and h bytes
   later, again and again up to DEPTH; the names of a class's first and last window name all its bytes.
3. Bucket pointers: a window that has an alone bucket at a later offset inside it is alone itself and
   is not looked at again. In a bucket whose classes all have one name every window is repeated.
4. What is left, classes of buckets with several names, is refined again, each differing class once
   whatever the number of its copies: runs of STEPS[0] windows fall into buckets by the bytes that all windows
   of the run share, and a run alone in its bucket is done with, as are runs whose bytes are all equal;
   the others are cut once more, at last to single windows, whose bucket decides.

All buckets are aggregations with partial sums where rows are read, so that a passage that a third
of all documents share is no larger a group than any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesmith.llm.common import drop_path, free_shuffles, in_batches, mixed, new_path, pieces_of, signed, stored, table, turn_to

DEPTH, GRAM, SPAN = 400, 64, 193
#: Windows to a run, refinement by refinement.
STEPS = (16, 1)
#: Windows of a text that are named at a time.
BLOCK = 1 << 16
#: Spans, or keys of texts (16 bytes), that are sent to all tasks; where a count finds more, all texts are shuffled to them.
SENT = 1_000_000
NO_END = (1 << 31) - 1
_C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW, _SHIFT = np.uint64(0xFFFFFFFF), np.uint64(29)

KEY = ["k1", "k2"]


def names(data: np.ndarray, *depths: int) -> list[np.ndarray]:
    """Names of the strings of each of the (ascending) depths at every place where one fits; the first depth is 8."""
    n = len(data) - 7
    if n <= 0:
        return [np.empty(0, np.uint64) for _ in depths]
    x = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        x[r::8] = data[r : r + (len(data) - r) // 8 * 8].view("<u8")
    now = before = mixed(x * _C + _D)
    have, out = 8, []
    for depth in depths:
        while have < depth:
            step = min(have, depth - have)
            if len(now) <= step:
                now = now[:0]
            else:
                now = now[:-step] * _C
                now += before[step:]
                now ^= now >> _SHIFT
            before, have = now, have + step
        out.append(now)
    return out


def sliding_least(v: np.ndarray, span: int) -> np.ndarray:
    """The least of every `span` consecutive values."""
    now, have = v, 1
    while 2 * have <= span:
        now, have = np.minimum(now[:-have], now[have:]), 2 * have
    m = len(v) - span + 1
    return np.minimum(now[:m], now[span - have : span - have + m])


def classes(data: np.ndarray, depth: int, gram: int, span: int) -> tuple[np.ndarray, ...]:
    """(gram, hull, whole, first, last, at) of the classes of a text.

    Places beyond the last window, whose suffix can still be chosen, are classes of their own
    without a hull (whole false), as the same bytes inside another text may be windows.
    """
    ends = ((0, len(data) - depth + 1, True), (max(0, len(data) - depth + 1), len(data) - span - gram + 2, False))
    got: list[list] = []
    for begin, end, whole in ends:
        for s in range(begin, end, BLOCK):
            e = min(end, s + BLOCK)
            cut = data[s : e - 1 + (max(depth, span + gram - 1) if whole else span + gram - 1)]
            if whole:
                small, grams, wide = names(cut, 8, gram, depth)
            else:
                (small, grams), wide = names(cut, 8, gram), None
            v = (small[: e - s + span - 1] & ~_LOW) | np.arange(e - s + span - 1, dtype=np.uint64)
            at = (sliding_least(v, span) & _LOW).astype(np.int64)
            first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
            last = np.concatenate((first[1:] - 1, [e - s - 1]))
            none = np.zeros(len(first), np.uint64)
            part = [grams[at[first]], wide[first] if whole else none, wide[last] if whole else none, np.full(len(first), whole), first + s, last + s, at[first] + s]
            if got and whole and got[-1][6][-1] == part[6][0]:  # a class goes on from the block before
                got[-1][2][-1], got[-1][5][-1] = part[2][0], part[5][0]
                part = [x[1:] for x in part]
            if len(part[0]):
                got.append(part)
    if not got:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, bool),) + (np.empty(0, np.int64),) * 3
    grams, left, right, whole, first, last, at = (np.concatenate(x) for x in zip(*got))
    hull = mixed(mixed(left * _C + right) + (last - first).astype(np.uint64) * _D + (at - first).astype(np.uint64) * _C)
    if not whole[-1]:
        last[-1] = NO_END
    return grams, hull, whole, first, last, at


def text_keys() -> list[Column]:
    """128 bits of a text, as two numbers; null texts are empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(F.lit(i), text).alias(k) for i, k in enumerate(KEY, 11)]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, and the text's key."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *text_keys())


def sampled(texts: DataFrame, depth: int, gram: int, span: int) -> DataFrame:
    """The classes of all texts, a row each."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("gram", pa.int64()), ("hull", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("at", pa.int32())])

    def run(batches):
        turn_to("suffixes")
        for b in (piece for batch in batches for piece in pieces_of(batch)):
            k1, k2 = (b.column(k).to_numpy() for k in KEY)
            held, size = [], 0
            for i, text in enumerate(b.column("text")):
                got = classes(np.frombuffer(text.as_buffer(), np.uint8), depth, gram, span)
                if len(got[0]):
                    held.append((np.full(len(got[0]), k1[i]), np.full(len(got[0]), k2[i]), *got))
                    size += len(got[0])
                if held and (size > 50_000 or i == b.num_rows - 1):
                    yield batch_of(held, schema)
                    held, size = [], 0
            if held:
                yield batch_of(held, schema)

    def batch_of(held, schema):
        a, b, grams, hull, whole, first, last, at = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(signed(grams)), pa.array(signed(hull), mask=~whole), *(pa.array(x.astype(np.int32)) for x in (first, last, at))], schema=schema)

    return in_batches(texts.select(*KEY, "text"), run, "k1 long, k2 long, gram long, hull long, first int, last int, at int")


def pruned(alive: DataFrame, ahead: int) -> DataFrame:
    """Per text the runs of windows known to be repeated and the classes to be refined, from its classes in shared buckets.

    A window is alone if a class that begins at most `ahead` places later, or its own, is in no shared bucket.
    """
    out = "k1 long, k2 long, runs array<struct<a: int, b: int>>, open array<struct<gram: long, hull: long, first: int, last: int, at: int>>"
    span = pa.struct([("a", pa.int32()), ("b", pa.int32())])
    cls = pa.struct([("gram", pa.int64()), ("hull", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("at", pa.int32())])

    def run(batches):
        for batch in batches:
            for b in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                lists, values = b.column("found").offsets.to_numpy(), b.column("found").flatten()
                first, last, at, gram, hull, kind = (values.field(i).to_numpy(zero_copy_only=False) for i in range(6))
                lists = lists - lists[0]
                runs, opened = [], []
                for x, y in zip(lists[:-1], lists[1:]):
                    o = x + np.argsort(first[x:y], kind="stable")
                    f, l, k = first[o].astype(np.int64), last[o].astype(np.int64), kind[o]
                    # where the run of shared classes that this one stands in ends
                    breaks = np.append(l[:-1] + 1 != f[1:], True)
                    stop = l[np.flatnonzero(breaks)[np.searchsorted(np.flatnonzero(breaks), np.arange(len(o)))]]
                    to = np.minimum(l, np.where(stop == NO_END, NO_END, stop - ahead))
                    same, many = k == 1, (k == 2) & (to >= f)
                    runs.append([{"a": int(a), "b": int(z)} for a, z in zip(f[same], l[same])])
                    opened.append([{"gram": int(gram[i]), "hull": int(hull[i]), "first": int(a), "last": int(z), "at": int(at[i])} for i, a, z in zip(o[many], f[many], to[many])])
                yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(runs, pa.list_(span)), pa.array(opened, pa.list_(cls))], names=["k1", "k2", "runs", "open"])

    return alive.mapInArrow(run, out)


def cut(texts: DataFrame, depth: int, step: int) -> DataFrame:
    """The wanted classes in runs of at most `step` windows, cut at multiples of it before the chosen suffix.

    back0 to back1: how far before the suffix (at) the run's windows begin. core: the name of what all windows of
    a whole run there share; hull: the name of the run's bytes.
    """
    cols = ["gram", "owner", "many", "k1", "k2", "at", "back0", "back1", "core", "hull"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def of(data: np.ndarray, k1: int, k2: int, wanted: list[dict]) -> pa.RecordBatch:
        gram, owner, many, first, last, at = (np.array([w[c] for w in wanted]) for c in ("gram", "hull", "many", "first", "last", "at"))
        low, high = (at - last) // step, (at - first) // step
        who = np.repeat(np.arange(len(wanted)), high - low + 1)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[who]
        back0, back1 = np.maximum(nth * step, (at - last)[who]), np.minimum(nth * step + step - 1, (at - first)[who])
        core, hull = np.empty(len(who), np.uint64), np.empty(len(who), np.uint64)
        ends = np.maximum.accumulate(last) + depth
        for x in np.split(np.arange(len(wanted)), np.flatnonzero(first[1:] >= ends[:-1]) + 1):
            begin = first[x[0]]
            inner, wide = names(data[begin : ends[x[-1]]], 8, depth - step + 1, depth)[1:]
            rows = slice(*np.searchsorted(who, [x[0], x[-1] + 1]))
            place, from_, to = at[who[rows]] - begin, back0[rows], back1[rows]
            core[rows] = mixed(inner[place - nth[rows] * step] + nth[rows].astype(np.uint64) * _D)
            hull[rows] = mixed(wide[place - to] * _C + wide[place - from_] + (from_ << 32 | to).astype(np.uint64) * _D)
        full = [gram[who], owner[who], many[who], np.full(len(who), k1), np.full(len(who), k2), at[who], back0, back1, signed(core), signed(hull)]
        return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(full, types)], names=cols)

    def run(batches):
        turn_to("suffixes")
        for b in (piece for batch in batches for piece in pieces_of(batch, limit=1 << 20)):
            for text, k1, k2, wanted in zip(b.column("text"), b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("wanted").to_pylist()):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                wanted.sort(key=lambda w: w["first"])
                for i in range(0, len(wanted), 256):
                    yield of(data, k1, k2, wanted[i : i + 256])

    return in_batches(texts.select("text", *KEY, "wanted"), run, "gram long, owner long, many boolean, k1 long, k2 long, at int, back0 int, back1 int, core long, hull long")


def having(texts: DataFrame, found: DataFrame, sent: int) -> DataFrame:
    """The texts whose keys are in found, so that others are not shuffled; all texts where more than `sent` keys would have to be sent to find out."""
    keys = found.select(*KEY)
    return texts.join(F.broadcast(keys), KEY, "left_semi") if keys.limit(sent + 1).count() <= sent else texts


def refined(texts: DataFrame, base: DataFrame, items: DataFrame, depth: int, steps: tuple[int, ...], sent: int, paths: list[str]) -> DataFrame:
    """gram, hull, back0, back1: where the windows of the items begin, before their suffix, that are repeated.

    items: one row a differing class (gram, hull), where a copy of it stands, and whether there are many.
    """
    wanted = items.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "hull", "many", "first", "last", "at")).alias("wanted"))
    paths.append(new_path(items.sparkSession, "suffix-wanted"))
    wanted = stored(wanted.join(base, KEY).select(*KEY, F.col("doc_id").alias("id"), "wanted"), "", paths[-1])
    found = having(texts, wanted, sent).join(wanted, KEY).where(F.col("doc_id").eqNullSafe(F.col("id")))
    paths.append(new_path(items.sparkSession, "suffix-runs"))
    runs = stored(cut(found, depth, steps[0]), "", paths[-1])
    free_shuffles(items.sparkSession)
    buckets = runs.groupBy("gram", "core").agg(F.max("many").alias("several"), F.min("owner").alias("o0"), F.max("owner").alias("o1"), F.min("hull").alias("h0"), F.max("hull").alias("h1"))
    buckets = buckets.where(F.col("several") | (F.col("o0") != F.col("o1"))).select("gram", "core", (F.col("h0") == F.col("h1")).alias("same"))
    shared = runs.join(buckets, ["gram", "core"])
    out = ["gram", "owner", "back0", "back1"]
    if len(steps) == 1:
        return shared.select(*out).withColumnRenamed("owner", "hull")
    paths.append(new_path(items.sparkSession, "suffix-open"))
    shared = stored(shared.drop("core"), "", paths[-1])
    opened = shared.where(~F.col("same"))
    here = F.struct(*KEY, (F.col("at") - F.col("back1")).alias("first"), (F.col("at") - F.col("back0")).alias("last"), "at")
    once = opened.groupBy("gram", "hull").agg((F.max("many") | (F.min("owner") != F.max("owner"))).alias("many"), F.min(here).alias("w")).select("gram", "hull", "many", "w.*")
    deeper = refined(texts, base, once, depth, steps[1:], sent, paths).withColumnsRenamed({"back0": "from", "back1": "to"})
    deeper = opened.select("gram", "hull", "owner").join(deeper, ["gram", "hull"]).select("gram", "owner", F.col("from").alias("back0"), F.col("to").alias("back1"))
    return shared.where("same").select(*out).unionByName(deeper).withColumnRenamed("owner", "hull")


def repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, span: int = SPAN, steps: tuple[int, ...] = STEPS, sent: int = SENT) -> DataFrame:
    """k1, k2 (the key of a text), spans: array<struct<a, b>>, the bytes [a, b) of the text that a repeated window covers.

    A window is repeated if its bytes also begin anywhere else, in the same document or another.
    Texts without one are left out. Of a text that several rows hold, all is repeated if it is `depth` bytes or longer.
    """
    if span + gram > depth + 1 or gram < 8:
        raise ValueError("a chosen suffix's first bytes must lie inside its window")
    spark, texts = docs.sparkSession, keyed(docs)
    paths = [new_path(spark, x) for x in ("suffix-texts", "suffix-shared", "suffix-classes")]
    base = stored(texts.select("doc_id", *KEY, F.length("text").alias("n")).groupBy(*KEY).agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.max("n").alias("n")), "", paths[0])
    classes_path = paths.pop()
    # of a text that many rows hold one row is enough, where the list of such texts can be sent
    twins = base.where("copies > 1").select(*KEY, F.col("doc_id").alias("id"), F.lit(True).alias("twin"))
    once = texts
    if twins.limit(sent + 1).count() <= sent:
        once = texts.join(F.broadcast(twins), KEY, "left").where(F.col("twin").isNull() | F.col("doc_id").eqNullSafe(F.col("id")))
    found = stored(sampled(once, depth, gram, span), "", classes_path)
    place = F.xxhash64(*KEY, "at")
    real = F.when(F.col("hull").isNotNull(), place)
    buckets = found.groupBy("gram").agg(F.min(place).alias("p0"), F.max(place).alias("p1"), F.min(real).alias("r0"), F.max(real).alias("r1"), F.min("hull").alias("h0"), F.max("hull").alias("h1"))
    # 0: no two windows, 1: all classes have one name, 2: several names
    kind = F.when(F.col("hull").isNull() | ~(F.col("r0") < F.col("r1")), 0).when(F.col("h0") == F.col("h1"), 1).otherwise(2).cast("int")
    buckets = buckets.where(F.col("p0") != F.col("p1")).select("gram", "r0", "r1", "h0", "h1")
    paths.append(new_path(spark, "suffix-buckets"))
    buckets = stored(buckets, "", paths[-1])  # so that a hot bucket's rows can be split over tasks
    free_shuffles(spark)
    alive = found.join(buckets, "gram").select(*KEY, F.struct("first", "last", "at", "gram", F.coalesce("hull", F.lit(0)).alias("hull"), kind.alias("kind")).alias("c"))
    shared = stored(pruned(alive.groupBy(*KEY).agg(F.collect_set("c").alias("found")), depth + 1 - span - gram), "", paths[1])
    drop_path(spark, classes_path)
    free_shuffles(spark)

    opened = shared.select(*KEY, F.explode("open").alias("c")).select(*KEY, "c.*")
    here = F.xxhash64(*KEY, "at")
    once = opened.groupBy("gram", "hull").agg((F.min(here) != F.max(here)).alias("many"), F.min(F.struct(*KEY, "first", "last", "at")).alias("w")).select("gram", "hull", "many", "w.*")
    backs_path = new_path(spark, "suffix-backs")
    backs = stored(refined(texts, base, once, depth, steps, sent, paths).groupBy("gram", "hull").agg(F.collect_set(F.struct("back0", "back1")).alias("backs")), "", backs_path)
    paths.append(backs_path)
    single = opened.join(backs, ["gram", "hull"]).select(*KEY, F.explode("backs").alias("r"), "at").select(*KEY, (F.col("at") - F.col("r.back1")).alias("a"), (F.col("at") - F.col("r.back0")).alias("b"))
    runs = shared.select(*KEY, F.explode("runs").alias("r")).select(*KEY, "r.a", "r.b")
    several = base.where((F.col("copies") > 1) & (F.col("n") >= depth)).select(*KEY, F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("spans"))
    covered = merged(runs.unionByName(single).groupBy(*KEY).agg(F.collect_list(F.struct("a", "b")).alias("runs")), depth)
    out = stored(covered.join(several, KEY, "left_anti").unionByName(several), "suffix-spans")
    for p in paths:
        drop_path(spark, p)
    free_shuffles(spark)
    return out


def merged(runs: DataFrame, depth: int) -> DataFrame:
    """Byte spans that windows beginning at places a to b cover."""
    span = pa.struct([("a", pa.int32()), ("b", pa.int32())])

    def run(batches):
        for b in batches:
            lists, values = b.column("runs").offsets.to_numpy(), b.column("runs").flatten()
            first, last = (values.field(i).to_numpy().astype(np.int64) for i in range(2))
            lists, out = lists - lists[0], []
            for x, y in zip(lists[:-1], lists[1:]):
                o = x + np.argsort(first[x:y], kind="stable")
                f, l = first[o], np.maximum.accumulate(last[o] + depth)
                new = np.append(True, f[1:] > l[:-1])
                out.append([{"a": int(p), "b": int(q)} for p, q in zip(f[new], l[np.append(np.flatnonzero(new)[1:] - 1, len(o) - 1)])])
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(out, pa.list_(span))], names=["k1", "k2", "spans"])

    return runs.mapInArrow(run, "k1 long, k2 long, spans array<struct<a: int, b: int>>")


def without_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, span: int = SPAN, steps: tuple[int, ...] = STEPS, sent: int = SENT) -> DataFrame:
    """doc_id, n_bytes, spans: array<struct<a, b>>, kept: the text's bytes without the spans; one row for each of docs.

    Every byte goes that a string of `depth` bytes covers which also begins anywhere else, the first occurrence
    included. Cuts may fall inside a character, so kept is bytes. Null texts are empty; texts shorter than
    `depth` stay as they are; repeated rows of `depth` bytes or more lose all; rows without an id count as any; extra columns are ignored.
    """
    spans = repeats(docs, depth, gram, span, steps, sent)
    rows = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    joined = keyed(docs).join(F.broadcast(spans) if rows <= sent else spans, KEY, "left")
    joined = joined.select("doc_id", F.length("text").cast("long").alias("n_bytes"), F.coalesce("spans", F.expr("cast(array() as array<struct<a: int, b: int>>)")).alias("spans"), "text")
    # what stands before each span, then what stands after the last
    begins = F.concat(F.array(F.lit(0)), F.col("spans.b"))
    ends = F.concat(F.col("spans.a"), F.array(F.col("n_bytes").cast("int")))
    piece = lambda i: F.substring("text", F.get(begins, i) + 1, F.get(ends, i) - F.get(begins, i))
    parts = F.transform(F.sequence(F.lit(0), F.size("spans")), piece)
    kept = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.unhex(F.array_join(F.transform(parts, F.hex), "")))
    return joined.select("doc_id", "n_bytes", "spans", kept.alias("kept"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

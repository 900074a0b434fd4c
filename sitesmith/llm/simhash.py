"""SimHash near-duplicate groups by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitesmith.llm.common import SIMILARITY, drop_path, free_shuffles, in_batches, known_words, maybe_broadcast, mixed, new_path, pieces_of, shingle_hashes, split_words, stored, table, turn_to
from sitesmith.llm.components import connected_components

SEED = 42
WORDS = 3
RADIUS = 2
#: Shingles whose bits are added up at a time; bounds memory on very long texts.
BLOCK = 1 << 16


def fingerprint(text: bytes | None, n: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash over n-word shingles (repeats count) of the ASCII-lower-cased text; 0 without words."""
    words = split_words(text.lower() if text else None)
    if not words:
        return 0
    n = min(n, len(words))
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - n + 1].tolist()
    ends = ends[n - 1 :].tolist()
    ones, total = np.zeros(64, np.int64), len(starts)
    for at in range(0, total, BLOCK):
        cut = [joined[a:b] for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])]
        h = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(seed)), np.dtype("<u8"), len(cut))
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp long). Other columns are not read. Null text counts as empty."""

    def run(batches):
        turn_to("fingerprints")
        for b in batches:
            fps = [fingerprint(t) for piece in pieces_of(b) for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    return in_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), run, "doc_id long, fp long")


def ball_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) -> verified links (u, v) that keep the components of all pairs within `radius`.

    Every fingerprint emits all variants within half the radius: itself and its 64 one-bit
    flips. Two fingerprints within 2 bits share a variant, and a variant has at most 65
    sources, so no group is large. All sources of a variant lie within 2 bits of each other;
    each is linked to the smallest, the links are made distinct and their distance is checked.
    """
    if radius != 2:
        raise ValueError("variants within one bit cover a radius of two")
    variants = fps.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("bit")).select(
        "fp", F.when(F.col("bit") < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, bit)"))).alias("variant")
    )
    low = F.min("fp").over(Window.partitionBy("variant"))
    pairs = variants.withColumn("u", low).where("u <> fp").select("u", F.col("fp").alias("v")).distinct()
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fingerprint, component_id), one row per input row.

    Exact copies share a fingerprint and meet in a partial aggregation, so a group of copies is
    one node of the link graph. Null or empty texts have fingerprint zero and link like any
    other. Repeated rows repeat. A null doc_id keeps its row; it names a component only if no
    member has an id. An empty table gives no rows. Extra columns are ignored.
    """
    fps = stored(fingerprints(docs), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    comp = connected_components(ball_links(nodes.select("fp"))).withColumnRenamed("id", "fp")
    named = nodes.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = named.select("fp", "component").join(firsts, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# --- near copies at a Jaccard similarity: several short fingerprints, balls of radius one, exact verification ---

#: Chance with which a pair of similarity just SIMILARITY shares a ball in some table; it grows quickly above that.
RECALL = 0.97


def table_plan(n_texts: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(tables, bits of each) for so many texts.

    A fingerprint's bits grow with the logarithm of the texts, so that two texts that have
    nothing in common seldom meet. Sets of similarity j have an angle of acos(2j / (1 + j)) and differ in
    each bit with that share of pi; tables are as many as give `recall` for a distance of two in one.
    """
    width = min(32, max(16, n_texts.bit_length() + 6))
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    near = sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(RADIUS + 1))
    return math.ceil(math.log(1 - recall) / math.log(1 - near)), width


def sketch(shingles: np.ndarray, tables: int, width: int) -> np.ndarray:
    """SimHash bits of a set of shingle hashes, cut into `tables` numbers of `width` bits."""
    if len(shingles) == 0:
        return np.zeros(tables, np.int64)
    bits = []
    for k in range(-(-tables * width // 64)):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(shingles), BLOCK):
            h = mixed(shingles[at : at + BLOCK] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
        bits.append(2 * ones > len(shingles))
    grid = np.concatenate(bits)[: tables * width].reshape(tables, width)
    return grid @ (np.int64(1) << np.arange(width, dtype=np.int64))


def lower_words(text: bytes | None) -> list[bytes]:
    return split_words(text.lower() if text else None)


def text_key(words: list[bytes]) -> int:
    """A signed 64-bit hash of a word sequence."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def sketches(docs: DataFrame, tables: int, width: int) -> DataFrame:
    """(doc_id, mark, text) -> doc_id, mark, node, t0, t1, ...: texts of the same lower-cased words are one node."""
    names = ["doc_id", "mark", "node", *(f"t{i}" for i in range(tables))]

    def run(batches):
        known = known_words()
        for b in batches:
            for piece in pieces_of(b):
                nodes, rows = [], []
                for text in piece.column("text").to_pylist():
                    words = lower_words(text)
                    nodes.append(text_key(words))
                    rows.append(sketch(np.unique(shingle_hashes(words, known)), tables, width))
                cols = np.array(rows, np.int64).reshape(-1, tables).T
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("mark"), pa.array(nodes, pa.int64()), *(pa.array(c) for c in cols)], names=names)

    return in_batches(docs, run, ", ".join(f"{n} long" for n in names))


def _shingle_sets(batches):
    known = known_words()
    for b in batches:
        for piece in pieces_of(b):
            words = [lower_words(t) for t in piece.column("text").to_pylist()]
            sets = [np.unique(shingle_hashes(w, known)).tobytes() for w in words]
            yield pa.RecordBatch.from_arrays([pa.array([text_key(w) for w in words], pa.int64()), pa.array(sets, pa.binary())], names=["node", "s"])


def _similar(similarity: float):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("s"), b.column("s2")):  # a pair's bytes at a time, not copied
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(ok, pa.bool_())], names=["u", "v", "ok"])

    return run


def _set_rows(batches):
    """A row a shingle: the node, its group, the size of its set."""
    for b in batches:
        for node, g, s in zip(b.column("node").to_pylist(), b.column("g").to_pylist(), b.column("s")):
            h = np.frombuffer(s.as_buffer(), np.int64)
            cols = [np.full(len(h), x, np.int64) for x in (node, g, len(h))]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(h)], names=["node", "g", "n", "h"])


def prefix_pairs(tokens: DataFrame, similarity: float = SIMILARITY, keep=stored) -> DataFrame:
    """(node, g, n, h): sets of n hashes -> pairs (u, v) of different g, among them every pair of Jaccard similarity `similarity` or more.

    Hashes are put in order of how many of the sets have them. Sets of sizes n <= m that are alike share at least
    c = similarity / (1 + similarity) * (n + m) hashes, no fewer than the same share of 2n and than similarity * m. So the first that they share is among the
    first n - c + 1 of the one and m - c + 1 of the other: a set sends as many as it can need as the smaller and as the larger one, once each,
    and the places of a shared hash tell whether c are left. Hashes that one set alone has count in the order but are
    not sent: sets that share a frame and differ in more than a ninth or so, however many, meet nobody.
    Steps are written by keep(table, tag), so that the shuffles of one are gone before those of the next are there.
    """
    shared = keep(tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "near-shared")
    free_shuffles(tokens.sparkSession)
    sets = keep(tokens.join(maybe_broadcast(shared), "h").groupBy("node", "g", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("hs")), "near-ordered")
    free_shuffles(tokens.sparkSession)
    share, eps = similarity / (1 + similarity), 1e-9
    gone = F.col("n") - F.size("hs")  # places before those in hs
    first = lambda least: (F.floor(F.col("n") * (1 - least) + eps) + 1).cast("int")
    sent = sets.withColumns({"most": first(similarity), "few": first(2 * share), "gone": gone}).where("most > gone")
    sent = sent.select("node", "g", "n", "few", "gone", F.posexplode(F.expr("slice(hs, 1, most - gone)")).alias("i", "x")).select("node", "g", "n", "few", (F.col("gone") + F.col("i")).alias("at"), F.col("x.h").alias("h"))
    larger = sent.select(F.col("node").alias("w"), F.col("g").alias("wg"), F.col("n").alias("m"), F.col("at").alias("wat"), "h")
    left = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("wat"))
    alike = (F.col("n") <= F.col("m")) & (F.col("n") >= similarity * F.col("m") - eps) & (left >= share * (F.col("n") + F.col("m")) - eps)
    met = sent.where("at < few").drop("few").join(larger, "h").where(F.col("g") != F.col("wg")).where(alike)
    return met.select(F.least("node", "w").alias("u"), F.greatest("node", "w").alias("v")).distinct()


#: Members of a bucket up to which all of them are compared with each other: at most seven or eight pairs a member.
PAIRED = 16
#: Variants that a task makes at a time, so that its table of buckets stays in memory.
TASK_VARIANTS = 1_000_000
#: Variants of a node that are shuffled at a time; tables beyond that follow when the shuffles of those before are gone.
NODE_VARIANTS = 140
#: Nodes up to which their bits are sent to all tasks (some 100 bytes each); beyond it pairs and bits are shuffled.
SENT_NODES = 500_000


def numbers(nodes: DataFrame, tables: range) -> DataFrame:
    """(node, t0, t1, ...) -> (node, num): each number of the given tables with its table before it."""
    ids = ", ".join(f"shiftleft({i}L, 40) | t{i}" for i in tables)
    return nodes.select("node", F.expr(f"explode(array({ids}))").alias("num"))


def flipped(nums: DataFrame, width: int) -> DataFrame:
    """A column key beside num: it and each of its one-bit flips."""
    key = F.when(F.col("bit") < 0, F.col("num")).otherwise(F.col("num").bitwiseXOR(F.expr("shiftleft(1L, bit)")))
    return nums.select("*", F.explode(F.sequence(F.lit(-1), F.lit(width - 1))).alias("bit")).withColumn("key", key).drop("bit")


def near_links(texts: DataFrame, nodes: DataFrame, tables: int, width: int, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v) of nodes whose five-word shingle sets have a Jaccard similarity of `similarity` or more, each verified.

    nodes has node, mark, t0, ...; texts has mark and text. Every number of a node emits itself
    and its one-bit flips; nodes within two bits share such a variant. A variant's bucket is
    aggregated to its size, smallest and largest node and the exclusive or of all: that tells the members of a
    bucket of two or three, which are nearly all. Of those of up to PAIRED members all are compared with each other. In a larger one all are
    compared with its smallest node. Where that leaves
    more than one group in a bucket, all its members meet by `prefix_pairs`, which finds every like pair of different groups
    among them; a row a shingle is made for members of such buckets only. Members of larger buckets are looked up by their number, which
    many share, and not by its variants. Tables are dealt with a few at a time (NODE_VARIANTS), so that disk is
    in proportion to the nodes; the number of jobs does not depend on the buckets. All bits together rule out unlike pairs first; shingle sets are read again for the
    others. The joins of buckets have one row a key on one side, so a bucket of any size is split by AQE.
    """
    spark = nodes.sparkSession
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    far = tables * width * p + 4 * math.sqrt(tables * width * p * (1 - p))
    size = nodes.count()
    few = size <= SENT_NODES
    packed = [(F.shiftleft(f"t{i}", 32).bitwiseOR(F.col(f"t{i + 1}")) if i + 1 < tables else F.col(f"t{i}")).alias(f"f{i // 2}") for i in range(0, tables, 2)]
    fp = nodes.select("node", *packed, "mark")
    links, paths = None, []

    def kept(df, tag):
        paths.append(new_path(spark, tag))
        return stored(df, tag, paths[-1])

    def likely(pairs):
        """The given pairs (u, v), repeats included, that all bits together leave, once each, with the marks of their texts."""
        sides = [fp.withColumnsRenamed({c: f"{c}_{x}" for c in fp.columns}).withColumnRenamed(f"node_{x}", x) for x in "uv"]
        rows = pairs if few else pairs.distinct()
        for x, side in zip("uv", sides):
            rows = rows.join(F.broadcast(side) if few else side, x)
        apart = sum(F.bit_count(F.col(f"f{i}_u").bitwiseXOR(F.col(f"f{i}_v"))) for i in range(len(packed)))
        rows = rows.where(apart <= far).select("u", "v", "mark_u", "mark_v")
        return rows.distinct() if few else rows

    def similar(pairs):
        """The likely pairs whose shingle sets are alike."""
        needed = pairs.select(F.col("mark_u").alias("mark")).unionByName(pairs.select(F.col("mark_v").alias("mark"))).distinct()
        sets = kept(in_batches(texts.join(maybe_broadcast(needed), "mark", "left_semi").select("text"), _shingle_sets, "node long, s binary").dropDuplicates(["node"]), "near-sets")
        both = pairs.select("u", "v").join(sets.withColumnRenamed("node", "u"), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("s2")), "v")
        out = stored(in_batches(both, _similar(similarity), "u long, v long, ok boolean").where("ok").select("u", "v"), "near-links")
        free_shuffles(spark)
        return out

    pair = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    lo, hi, mid = F.col("lo"), F.col("hi"), F.col("x").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
    each = F.expr("flatten(transform(ns, (x, i) -> transform(slice(ns, i + 2, size(ns)), y -> struct(least(x, y) AS u, greatest(x, y) AS v))))")
    met, larger, held = [], [], []
    step = max(1, -(-tables // max(1, -(-tables * (width + 1) // NODE_VARIANTS))))
    for at in range(0, tables, step):
        some_tables = range(at, min(tables, at + step))
        parts = max(1, -(-size * len(some_tables) * (width + 1) // TASK_VARIANTS))
        all_ = flipped(numbers(nodes.repartition(parts, "node"), some_tables), width)
        buckets = all_.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor("node").alias("x")).where("n > 1")
        path = new_path(spark, "near-buckets")
        buckets = stored(buckets, "near-buckets", path)
        free_shuffles(spark)
        pairs = buckets.where("n <= 3").select(F.explode(F.when(F.col("n") == 2, F.array(pair(lo, hi))).otherwise(F.array(pair(lo, hi), pair(lo, mid), pair(mid, hi)))).alias("p")).select("p.*")
        large = buckets.where("n > 3").select("key", "n", "lo")
        nums = numbers(nodes, some_tables)
        open_ = kept(flipped(nums.select("num").distinct(), width).join(maybe_broadcast(large), "key"), "near-open")
        members = kept(nums.join(maybe_broadcast(open_.select("num").distinct()), "num", "left_semi"), "near-members")
        small = open_.where(F.col("n") <= PAIRED).select("key", "num").join(members, "num")
        some = small.groupBy("key").agg(F.collect_list("node").alias("ns")).select(F.explode(each).alias("p")).select("p.*")
        open_ = open_.where(F.col("n") > PAIRED)
        first = open_.select("num", "lo").distinct().join(members, "num").where("node <> lo").select(F.col("lo").alias("u"), F.col("node").alias("v"))
        met.append(kept(likely(pairs.unionByName(some).unionByName(first)), "near-likely"))
        larger.append(open_.select("key", "num"))
        held.append(members)
        drop_path(spark, path)
        free_shuffles(spark)
    links = similar(kept(reduce(DataFrame.unionByName, met).distinct(), "near-pairs"))
    # who is in one group already need not be compared; of buckets that hold several groups every member is
    group = connected_components(links).select(F.col("id").alias("node"), F.col("component").alias("g"))
    larger, members = reduce(DataFrame.unionByName, larger), reduce(DataFrame.unionByName, held)
    members = members.join(maybe_broadcast(larger.select("num").distinct()), "num", "left_semi")
    grouped = kept(members.join(maybe_broadcast(group), "node", "left").withColumn("g", F.coalesce("g", "node")), "near-grouped")
    spread = grouped.groupBy("num").agg(F.min("g").alias("a"), F.max("g").alias("b"))
    several = larger.join(spread, "num").groupBy("key").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("key")
    nums = larger.join(several, "key", "left_semi").select("num").distinct()
    who = kept(grouped.join(nums, "num", "left_semi").select("g", "node").distinct(), "near-who")
    free_shuffles(spark)
    if not who.isEmpty():
        marks = who.join(fp, "node").select("mark").distinct()
        sets = in_batches(texts.join(maybe_broadcast(marks), "mark", "left_semi").select("text"), _shingle_sets, "node long, s binary").dropDuplicates(["node"])
        tokens = kept(in_batches(sets.join(who, "node").select("node", "g", "s"), _set_rows, "node long, g long, n long, h long"), "near-tokens")
        links = links.unionByName(similar(kept(likely(kept(prefix_pairs(tokens, similarity, kept), "near-met")), "near-likely")))
    links = stored(links.distinct(), "near-links")
    for path in paths:
        drop_path(spark, path)
    return links


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, mark, node, component), a row per input row; mark is a hash of the text as it is.

    Near copies have five-word shingle sets (of lower-cased words; the whole sequence of shorter texts) of Jaccard
    similarity `similarity` or more, and groups are what such links join. Null and empty texts are copies of each other.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("mark"), F.col("text").cast("binary").alias("text"))
    tables, width = table_plan(docs.count(), similarity, recall)
    rows = stored(sketches(texts, tables, width), "near-sketches")
    nodes = stored(rows.groupBy("node").agg(F.min("mark").alias("mark"), *[F.min(f"t{i}").alias(f"t{i}") for i in range(tables)]), "near-nodes")
    comp = connected_components(near_links(texts.select("mark", "text"), nodes, tables, width, similarity)).withColumnRenamed("id", "node")
    return rows.select("doc_id", "mark", "node").join(maybe_broadcast(comp), "node", "left").withColumn("component", F.coalesce("component", "node"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near copies, all columns kept: the one with the smallest doc_id, a null one last.

    Of rows with that doc_id one stays, whichever text they have (the least hash), and one of equal rows. Only ids and hashes
    of what goes are joined with the documents; rows that occur once more than they should are made distinct by themselves.
    """
    groups = stored(near_groups(docs, similarity).select("doc_id", "mark", "component"), "near-groups")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")).alias("first"))
    sized = groups.groupBy("component", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark").agg(F.count("*").alias("n"))
    sized = stored(sized.join(first, "component").select("no_id", "id", "mark", "n", (F.struct("no_id", "id", "mark") == F.col("first")).alias("stays")), "near-verdicts")
    gone = maybe_broadcast(sized.where("not stays").select("no_id", "id", "mark"))
    cols = docs.columns
    rows = docs.withColumns({"__n": F.col("doc_id").isNull(), "__i": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__m": F.coalesce(F.xxhash64("text"), F.lit(0))})

    def same(t):
        return (rows["__n"] == t["no_id"]) & (rows["__i"] == t["id"]) & (rows["__m"] == t["mark"])

    left = rows.join(gone, same(gone), "left_anti")
    twice = sized.where("stays and n > 1").select("no_id", "id", "mark")
    if twice.isEmpty():
        return left.select(*cols)
    names = {"no_id": "__n", "id": "__i", "mark": "__m"}
    twice = maybe_broadcast(twice.withColumnsRenamed(names))
    return left.join(twice, list(names.values()), "left_anti").select(*cols).unionByName(left.join(twice, list(names.values()), "left_semi").dropDuplicates(list(names.values())).select(*cols))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))

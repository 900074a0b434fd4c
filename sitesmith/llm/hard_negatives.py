"""Hard negatives by a pivot table: inner products bracketed by distances to pivots, survivors checked exactly.

A row x becomes (x, sqrt(M - |x|^2)) with M the largest |x|^2, an anchor q becomes (q, 0); then
|q - x|^2 = M + |q|^2 - 2 q.x, so that a higher score is a smaller distance. Every row's distances to a
few pivots are stored once; by the triangle inequality |d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p)
for every pivot p, which brackets the score of any pair from two short lists of numbers. Rows stand in
the order of their nearest pivot and the distance to it, so that whole batches fall outside a bracket.

Anchors are the query set: blocks of bounded size are sent to the tasks that read the table, each block
in two passes (positives, then negatives) without a shuffle of rows; what a task finds meets in a window.
Results are exact: a row is passed over only where its bracket says that it cannot be among the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitesmith.llm.common import drop_path, new_path, stored, table

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 30, 90
#: Pivots, chosen far from each other among a sample: the rows with the smallest hashes of their ids, SAMPLE of them.
PIVOTS, SAMPLE = 8, 2048
#: Bytes of anchors that are sent to the tasks at a time.
BLOCK_BYTES = 16 << 20
#: Rows that are compared at a time, and the table's rows to a partition.
BATCH, SLICE = 1024, 16_384
#: Sums of products below this are exact in doubles; larger components are multiplied as integers, without pruning.
EXACT = 2.0**52
#: A bracket is widened by this share of the largest number in it.
SLACK = 1e-9


def vectors_of(column: pa.ListArray, dim: int) -> np.ndarray:
    """Lists as rows of a matrix; what shorter ones lack is zero."""
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lens) and (lens == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lens), dim), flat.dtype)
    out[np.arange(dim) < lens[:, None]] = flat
    return out


class Space:
    """The augmented space: its dimensions, the largest squared norm and the pivots."""

    def __init__(self, dim: int, most: float, largest: int, sample: np.ndarray):
        self.dim, self.most = dim, most
        self.wide = float(largest) ** 2 * dim >= EXACT
        x = sample.astype(np.float64)
        lifted = self.lift(x)
        picked = [0] if len(x) else []
        gap = np.full(len(x), np.inf)
        while 0 < len(picked) < min(PIVOTS, len(x)):
            gap = np.minimum(gap, ((x - x[picked[-1]]) ** 2).sum(1) + (lifted - lifted[picked[-1]]) ** 2)
            picked.append(int(gap.argmax()))
        self.pivots, self.lifted = x[picked], lifted[picked]
        self.norms = (self.pivots**2).sum(1) + self.lifted**2

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (x**2).sum(1), 0))

    def distances(self, x: np.ndarray, lifted: np.ndarray | float = 0.0) -> np.ndarray:
        """To every pivot, from rows with their lift or from anchors without."""
        lifted = np.broadcast_to(lifted, len(x))
        square = ((x**2).sum(1) + lifted**2)[:, None] + self.norms - 2 * (x @ self.pivots.T + lifted[:, None] * self.lifted)
        return np.sqrt(np.maximum(square, 0))

    def bracket(self, q2: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score of distances between near and far."""
        whole = self.most + q2
        slack = SLACK * np.maximum(whole, 1)
        return (whole - far**2) / 2 - slack, (whole - near**2) / 2 + slack

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.wide:
            return q @ x.T
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)

    def candidates(self, q: np.ndarray, apart: np.ndarray, to: np.ndarray, at_least: np.ndarray, at_most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, row) of the pairs whose bracket meets at_least .. at_most of the anchor.

        apart: the anchors' distances to the pivots; to: the rows'. The batch as a whole is tried first.
        """
        if self.wide or not len(to):
            return tuple(x.ravel() for x in np.indices((len(q), len(to))))
        q2 = (q.astype(np.float64) ** 2).sum(1)
        lo, hi = to.min(0), to.max(0)
        near = np.maximum(np.maximum(apart - hi, lo - apart), 0).max(1)
        least, largest = self.bracket(q2, near, (apart + hi).min(1))
        left = np.flatnonzero((largest >= at_least) & (least <= at_most))
        who, rows = [], []
        for some in (left[i : i + BATCH] for i in range(0, len(left), BATCH)):
            near, far = np.zeros((len(some), len(to))), np.full((len(some), len(to)), np.inf)
            for j in range(to.shape[1]):
                a, b = apart[some, j, None], to[None, :, j]
                np.maximum(near, np.abs(a - b), out=near)
                np.minimum(far, a + b, out=far)
            least, largest = self.bracket(q2[some, None], near, far)
            a, r = np.nonzero((largest >= at_least[some, None]) & (least <= at_most[some, None]))
            who.append(some[a])
            rows.append(r)
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (who, rows))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the first k by score, descending, then id."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        over = np.flatnonzero(score >= cut)
        return over[np.lexsort((ids[over], -score[over]))[:k]]
    return np.lexsort((ids, -score))[:k]


class Found:
    """The first k rows of each of m lists as they come, and the score below which a further row cannot be among them."""

    def __init__(self, m: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.astype(np.float64).copy()
        self.rows: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 2 for _ in range(m)]

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, d = (np.concatenate(x) for x in zip(self.rows[i], (score, ids)))
        o = best(s, d, self.k)
        self.rows[i] = s[o], d[o]
        if len(o) == self.k:
            self.least[i] = max(self.least[i], s[o[-1]])


class Block:
    """Anchors that are sent to the tasks, with the sample's rows as first bounds."""

    def __init__(self, space: Space, anchors: dict[str, np.ndarray], sample: dict[str, np.ndarray]):
        self.space, self.sample = space, sample
        self.row, self.id, self.label, self.vec = (anchors[c] for c in ("row", "id", "label", "vec"))
        self.apart = space.distances(self.vec.astype(np.float64))
        self.positive = None

    def with_bounds(self) -> Block:
        """What the sample says of the k-th best, without the anchors themselves."""

        def kth(s: np.ndarray, k: int) -> float:
            return float(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else -np.inf

        n, sample = len(self.row), self.sample
        self.least = np.full(n if self.positive is None else self.positive.shape, np.inf)
        for i in range(n):
            s, alike = self.space.scores(self.vec[i : i + 1], sample["vec"])[0], sample["label"] == self.label[i]
            if self.positive is None:
                self.least[i] = kth(s[alike & (sample["row"] != self.row[i])], POSITIVES)
                continue
            for j in np.flatnonzero(self.there[i]):
                p = self.positive[i, j]
                self.least[i, j] = max(-(-LOW * p // 100), kth(s[~alike & (100 * s >= LOW * p) & (100 * s <= HIGH * p)], NEGATIVES))
        del self.sample
        return self

    def positives(self, batches: Iterator[dict[str, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
        found = Found(len(self.row), POSITIVES, self.least)
        for b in batches:
            for label in np.intersect1d(b["label"], self.label):
                who, rows = np.flatnonzero(self.label == label), np.flatnonzero(b["label"] == label)
                a, r = self.space.candidates(self.vec[who], self.apart[who], b["dist"][rows], found.least[who], np.full(len(who), np.inf))
                for i, mine, s in self.checked(who[a], rows[r], b):
                    other = b["row"][mine] != self.row[i]
                    ok = other & (s >= found.least[i])
                    if ok.any():
                        found.add(i, s[ok], b["id"][mine[ok]])
        for i, (s, d) in enumerate(found.rows):
            if len(s):
                yield np.full(len(s), self.row[i]), np.zeros(len(s), np.int64), s, d

    def checked(self, anchors: np.ndarray, rows: np.ndarray, b: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Exact scores of candidate pairs, which come in the order of their anchors."""
        who, begin = np.unique(anchors, return_index=True)
        end = np.append(begin[1:], len(anchors))
        dense = 4 * len(anchors) > len(who) * len(b["row"])
        if dense and len(who):
            scores = self.space.scores(self.vec[who], b["vec"])
        for n, (i, x, y) in enumerate(zip(who, begin, end)):
            mine = rows[x:y]
            yield i, mine, scores[n, mine] if dense else self.space.scores(self.vec[i : i + 1], b["vec"][mine])[0]

    def negatives(self, batches: Iterator[dict[str, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
        n, k = self.positive.shape
        found = Found(n * k, NEGATIVES, self.least.ravel())
        least = found.least.reshape(n, k)
        top = np.where(self.there, HIGH * self.positive.astype(np.float64) / 100, -np.inf).max(1) if n else np.empty(0)
        for b in batches:
            a, r = self.space.candidates(self.vec, self.apart, b["dist"], least.min(1), top)
            for i, mine, s in self.checked(a, r, b):
                differ = b["label"][mine] != self.label[i]
                for j in np.flatnonzero(self.there[i]):
                    p = self.positive[i, j]
                    ok = differ & (s >= least[i, j]) & (100 * s >= LOW * p) & (100 * s <= HIGH * p)
                    if ok.any():
                        found.add(i * k + j, s[ok], b["id"][mine[ok]])
        for at, (s, d) in enumerate(found.rows):
            if len(s):
                yield np.full(len(s), self.row[at // k]), np.full(len(s), at % k + 1), s, d

    def over(self, index: DataFrame, step: str) -> DataFrame:
        """anchor, nth, score, id: what each task's rows give, by one of the two steps."""
        spark, dim = index.sparkSession, self.space.dim
        sent = spark.sparkContext.broadcast(self.with_bounds())
        schema = pa.schema([(c, pa.int64()) for c in ("anchor", "nth", "score", "id")])

        def run(batches):
            def parts():
                for whole in batches:
                    for at in range(0, whole.num_rows, BATCH):
                        b = whole.slice(at, BATCH)
                        yield {c: b.column(c).to_numpy() for c in ("row", "id", "label")} | {"vec": vectors_of(b.column("vec"), dim), "dist": vectors_of(b.column("dist"), len(sent.value.space.pivots))}

            for got in getattr(sent.value, step)(parts()):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], schema=schema)

        return index.mapInArrow(run, "anchor long, nth long, score long, id long")


def numbered(vectors: DataFrame) -> DataFrame:
    """row, id, label, vec: rows that take part, with a number of their own."""
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull())
    return vectors.where(sound).select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vec").cast("array<long>")).withColumn("row", F.monotonically_increasing_id())


def arrays(rows: list, dim: int) -> dict[str, np.ndarray]:
    out = {c: np.array([r[c] for r in rows], np.int64) for c in ("row", "id", "label")}
    out["vec"] = np.array([list(r["vec"]) + [0] * (dim - len(r["vec"])) for r in rows], np.int64).reshape(len(rows), dim)
    return out


def hard_negatives(vectors: DataFrame, anchors: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: id, label, vec (integers). Rows for which the condition `anchors` (over id and label) holds are
    anchors. A score is the inner product, ties go to the smaller id. Each anchor's positives are its first
    POSITIVES other rows of the same label; for each, the first NEGATIVES rows of another label whose score
    lies between LOW and HIGH hundredths of the positive's (none where that is negative). Rows with a
    null id, label, vector or component take no part; what shorter vectors lack is zero; repeated rows
    are rows of their own, so an anchor's copy is one of its positives and an anchor's lists come
    once for each row of its id. Scores must fit in 64 bits. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    out_ddl = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    base_path, index_path = new_path(spark, "vectors"), new_path(spark, "pivot-table")
    base = stored(numbered(vectors), "", base_path)
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, dim, most, largest = base.agg(F.count("*"), F.max(F.size("vec")), F.max(square), F.max(F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: F.greatest(s, F.abs(x))))).first()
    if not n or not dim:
        return spark.createDataFrame([], out_ddl)
    sample = arrays(base.orderBy(F.xxhash64("id"), "row").limit(SAMPLE).collect(), dim)
    space = Space(dim, most, largest, sample["vec"])

    def measured(batches):
        for b in batches:
            x = vectors_of(b.column("vec"), dim).astype(np.float64)
            d = space.distances(x, space.lift(x))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "id", "label", "vec")), pa.array(list(d), pa.list_(pa.float64()))], names=["row", "id", "label", "vec", "dist"])

    index = base.select("row", "id", "label", "vec").mapInArrow(measured, "row long, id long, label long, vec array<long>, dist array<double>")
    nearest = F.array_min("dist")
    index = index.repartitionByRange(max(1, -(-n // SLICE)), F.array_position("dist", nearest), nearest, "row").sortWithinPartitions(F.array_position("dist", nearest), nearest, "row")
    index = stored(index, "", index_path)
    drop_path(spark, base_path)

    out = None
    for rows in blocks(index.where(anchors).select("row", "id", "label", "vec").orderBy("id", "row"), block_bytes // (8 * dim + 200)):
        block = Block(space, arrays(rows, dim), sample)
        first = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
        pos = block.over(index, "positives").withColumn("nth", first).where(F.col("nth") <= POSITIVES).collect()
        block = Block(space, arrays(rows, dim), sample)
        at = {r: i for i, r in enumerate(block.row.tolist())}
        block.positive, block.there = np.zeros((len(rows), POSITIVES), np.int64), np.zeros((len(rows), POSITIVES), bool)
        for r in pos:
            block.positive[at[r["anchor"]], r["nth"] - 1], block.there[at[r["anchor"]], r["nth"] - 1] = r["score"], r["score"] >= 0
        ids = spark.createDataFrame([(r["anchor"], int(block.id[at[r["anchor"]]]), r["nth"], r["id"], r["score"]) for r in pos], "anchor long, anchor_id long, nth long, positive_id long, positive_score long")
        rank = F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id"))
        neg = block.over(index, "negatives").withColumn("rank", rank).where(F.col("rank") <= NEGATIVES)
        got = neg.join(ids, ["anchor", "nth"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], out_ddl) if out is None else out


def blocks(rows: DataFrame, size: int) -> Iterator[list]:
    """The rows in lists of at most `size`."""
    held: list = []
    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) >= max(1, size):
            yield held
            held = []
    if held:
        yield held


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components become floor(256 x); every seventh row's label is moved on by one; anchors are the rows whose id 100 divides."""
    df = table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return hard_negatives(df.where(finite).select(F.col("vec_id").alias("id"), label.alias("label"), vec.alias("vec")), F.col("id") % 100 == 0)


ORACLE = """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS alike, list_dot_product(a.v, e.v)::BIGINT AS score
    FROM e AS a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0
), positive AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id) AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
    FROM positive JOIN pairs AS n USING (anchor_id)
    WHERE NOT n.alike AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""

"""Quality classifier: interpolated modified Kneser-Ney n-grams, thresholded per language."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesmith.llm.common import drop_path, free_shuffles, in_batches, maybe_broadcast, new_path, pieces_of, remembered, signed, stored, table, turn_to

#: Characters of a gram. They are code points as they are, digits as one; NUL stands before and after a text.
ORDER = 4
#: Trusted text is dealt over so many folds; a trusted document is scored by the models of the other folds only.
FOLDS = 2
POOLED = "*"
#: Share of trusted text that a language's threshold keeps.
QUANTILE = 0.99
#: Characters of average text that every document is taken to hold besides its own, so that a few words decide little.
PRIOR = 60
#: Grams looked at together; a longer text is read in stretches.
BLOCK = 1 << 20
#: Distinct grams (16 bytes each) up to which their probabilities are broadcast; beyond it they are joined with blocks of documents.
BROADCAST_GRAMS = 4_000_000
#: Bytes of text of a block of that join.
BLOCK_BYTES = 16 << 20
#: Orders whose probabilities are written before the next is begun.
STORED = (2, ORDER)
HEAD, TAIL = b"\0\0\0\0" * (ORDER - 1), b"\0\0\0\0"


def stretches(text: bytes | None) -> Iterator[bytes]:
    """A text between end marks as UTF-32, cut every BLOCK grams with ORDER - 1 characters of overlap; none if it has no words."""
    if not text or not text.strip():
        return
    whole = HEAD + text.decode("utf-8", "replace").encode("utf-32-le") + TAIL
    n = len(whole) // 4 - ORDER + 1
    for at in range(0, n, BLOCK):
        yield whole[4 * at : 4 * (min(at + BLOCK, n) + ORDER - 1)]


def joined(cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches in a row: their code points, the places where grams within one of them begin, and each stretch's number of grams."""
    points = np.frombuffer(b"".join(cuts), "<u4").copy()
    points[(points >= 48) & (points <= 57)] = 48
    size = np.array([len(c) // 4 for c in cuts], np.int64)
    inside = np.ones(len(points), bool)
    ends = np.cumsum(size)
    for back in range(1, ORDER):
        inside[ends - back] = False
    return points, np.flatnonzero(inside), size - ORDER + 1


def keys_of(points: np.ndarray, at: np.ndarray, lang: str) -> np.ndarray:
    """64-bit keys of the grams of a language that begin at the given places."""
    key = np.full(len(points) - ORDER + 1, xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for i in range(ORDER):
        key = (key ^ points[i : len(points) - ORDER + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key[at]


def strings_of(points: np.ndarray, at: np.ndarray) -> list[str]:
    long = points[at[:, None] + np.arange(ORDER)].tobytes().decode("utf-32-le")
    return [long[i : i + ORDER] for i in range(0, len(long), ORDER)]


def gathered(batches, names: tuple[str, ...]) -> Iterator[tuple[tuple, list[bytes]]]:
    """(values of the named columns, stretches) where some BLOCK grams of the same values have met."""
    held: dict[tuple, list[bytes]] = {}
    size: dict[tuple, int] = {}
    for b in batches:
        for piece in pieces_of(b):
            for *who, text in zip(*(piece.column(c).to_pylist() for c in (*names, "text"))):
                who = tuple(who)
                for cut in stretches(text):
                    held.setdefault(who, []).append(cut)
                    size[who] = size.get(who, 0) + len(cut) // 4
                    if size[who] > BLOCK:
                        yield who, held.pop(who)
                        size[who] = 0
    yield from held.items()


def _count(batches):
    turn_to("grams")
    for (lang, fold), cuts in gathered(batches, ("lang", "fold")):
        points, at, _ = joined(cuts)
        _, first, n = np.unique(keys_of(points, at, lang), return_index=True, return_counts=True)
        names = strings_of(points, at[first])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([fold] * len(n), pa.int32()), pa.array(names), pa.array(n, pa.int64())], names=["lang", "fold", "g", "n"])


#: Keys that a worker has sent, by their last bits; what another key has displaced is sent again and made distinct by Spark.
_SENT = remembered("grams", {})
SENT_BITS = 20


def _distinct(batches):
    turn_to("grams")
    _SENT.clear()
    sent = _SENT["keys"] = np.zeros(1 << SENT_BITS, np.uint64)
    for (lang,), cuts in gathered(batches, ("lang",)):
        points, at, _ = joined(cuts)
        keys = keys_of(points, at, lang)
        slots = (keys & np.uint64(len(sent) - 1)).astype(np.int64)
        new = np.flatnonzero(sent[slots] != keys)
        if len(new):
            _, first = np.unique(keys[new], return_index=True)
            new = new[first]
            sent[slots[new]] = keys[new]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(new)), pa.array(strings_of(points, at[new]))], names=["lang", "g"])
    _SENT.clear()


def gram_counts(trusted: DataFrame) -> DataFrame:
    """(lang, fold, text) -> (lang, g, n0, n1, ...): counts of each gram in each fold, over all rows, and over all languages as lang '*'.

    Each task sends a row per distinct gram, fold and block.
    """
    own = in_batches(trusted.select("lang", F.col("fold").cast("int").alias("fold"), F.col("text").cast("binary").alias("text")), _count, "lang string, fold int, g string, n long")
    own = stored(own.groupBy("lang", "g").agg(*[F.sum(F.when(F.col("fold") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(FOLDS)]), "grams")
    pooled = own.groupBy("g").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(FOLDS)])
    return own.where(F.col("lang") != POOLED).unionByName(pooled.withColumn("lang", F.lit(POOLED)))


def discounts(orders: list[DataFrame]) -> DataFrame:
    """Gram counts by order -> (order, lang, and for each fold f: below_f, d1_f, d2_f, d3_f), a row an order and language.

    Chen and Goodman's three discounts come from the counts of counts of the model; a discount
    whose counts are missing falls back to its index times 0.5, so that mass remains. below is
    the share of each character where nothing is known: one of those seen or one unseen; null for a fold without text.
    """
    out = None
    for k, c in enumerate(orders, 1):
        of = [F.sum((F.col(f"n{f}") == i).cast("double")).alias(f"c{i}_{f}") for f in range(FOLDS) for i in (1, 2, 3, 4)]
        seen = [F.count_if(F.col(f"n{f}") > 0).alias(f"seen_{f}") for f in range(FOLDS)]
        got = c.groupBy("lang").agg(*of, *seen).withColumn("order", F.lit(k))
        out = got if out is None else out.unionByName(got)
    cols = []
    for f in range(FOLDS):
        c = {i: F.col(f"c{i}_{f}") for i in (1, 2, 3, 4)}
        y = F.when(c[1] + c[2] > 0, c[1] / (c[1] + 2 * c[2])).otherwise(0.5)
        cols.append(F.when(F.col(f"seen_{f}") > 0, 1.0 / (F.col(f"seen_{f}") + 1)).alias(f"below_{f}"))
        for i in (1, 2, 3):
            raw = i - (i + 1) * y * c[i + 1] / F.when(c[i] > 0, c[i])
            cols.append(F.when(raw > 0.05, raw).otherwise(F.lit(0.5 * i)).alias(f"d{i}_{f}"))
    return stored(out.select("order", "lang", *cols), "gram-discounts")


def probabilities(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """Gram counts and the grams asked for (lang, g) -> (lang, g, p0, p1, ...): probability by each fold's model, null where a fold has no text of lang.

    From one character up to ORDER, what is asked meets the seen grams and contexts of its
    order in joins dealt by gram: p of a gram is its discounted share plus the context's left
    over mass times p of the gram without its first character. Lower orders count distinct left
    neighbours; below one character all are alike, one of them unseen. The larger orders are
    stored, which keeps plans short and lets go of their shuffles.
    """
    spark, folds = counts.sparkSession, range(FOLDS)
    orders, paths = [counts], [new_path(spark, "grams-lower")]
    for k in range(ORDER - 1, 0, -1):
        left = [F.count_if(F.col(f"n{f}") > 0).alias(f"n{f}") for f in folds]
        orders.insert(0, orders[0].groupBy("lang", F.substring("g", 2, k).alias("g")).agg(*left))
    lower = stored(reduce(DataFrame.unionByName, [c.withColumn("k", F.lit(k)) for k, c in enumerate(orders[:-1], 1)]), "grams-lower", paths[-1])
    orders = [lower.where(F.col("k") == k).drop("k") for k in range(1, ORDER)] + [counts]
    known = discounts(orders)
    asked = asked.join(maybe_broadcast(known.where("order = 1").select("lang")), "lang", "left_semi")
    p = None
    for k, c in enumerate(orders, 1):
        of = maybe_broadcast(known.where(F.col("order") == k).drop("order"))
        c = c.withColumn("h", F.substring("g", 1, k - 1)).join(of, "lang")
        cut = [F.expr(f"CASE n{f} WHEN 1 THEN d1_{f} WHEN 2 THEN d2_{f} ELSE d3_{f} END") for f in folds]
        sums = [F.sum(f"n{f}").cast("double").alias(f"total_{f}") for f in folds] + [F.sum(F.least(cut[f], F.col(f"n{f}"))).alias(f"cut_{f}") for f in folds]
        ctx = c.groupBy("lang", "h").agg(*sums)
        own = c.select("lang", "g", *[F.greatest(F.col(f"n{f}") - cut[f], F.lit(0.0)).alias(f"own_{f}") for f in folds])
        want = asked.select("lang", F.substring("g", ORDER - k + 1, k).alias("g")).distinct() if k < ORDER else asked
        if p is None:
            want = want.join(of.select("lang", *[f"below_{f}" for f in folds]), "lang")
        else:
            low = p.select("lang", F.col("g").alias("low"), *[F.col(f"p{f}").alias(f"below_{f}") for f in folds])
            want = want.withColumn("low", F.substring("g", 2, k - 1)).join(low, ["lang", "low"]).drop("low")
        want = want.join(own, ["lang", "g"], "left").withColumn("h", F.substring("g", 1, k - 1)).join(ctx, ["lang", "h"], "left")
        # an unseen context leaves all to the shorter gram
        value = [F.expr(f"CASE WHEN coalesce(total_{f}, 0D) = 0 THEN below_{f} ELSE (coalesce(own_{f}, 0D) + cut_{f} * below_{f}) / total_{f} END").alias(f"p{f}") for f in folds]
        p = want.select("lang", "g", *value)
        if k in STORED:
            paths.append(new_path(spark, "grams-p"))
            p = stored(p, "grams-p", paths[-1])
            free_shuffles(spark)
    for path in paths[:-1]:
        drop_path(spark, path)
    return p


class Table:
    """Keys and, for each fold, negative log probabilities of the grams of some languages.

    A key lies where its last bits say; keys that others have displaced there are in a further
    such table, and so on. That is several times as quick as a binary search.
    """

    def __init__(self, keys: np.ndarray, nll: np.ndarray):
        self.keys, self.nll = keys, np.ascontiguousarray(nll)
        self.slots: list[np.ndarray] = []
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            slots = np.full(1 << (2 * len(left)).bit_length(), -1, np.int32)
            at = self._at(keys[left], len(self.slots), len(slots))
            slots[at] = left
            self.slots.append(slots)
            left = left[slots[at] != left]

    @staticmethod
    def _at(keys: np.ndarray, depth: int, size: int) -> np.ndarray:
        return ((keys >> np.uint64(7 * depth % 40)) & np.uint64(size - 1)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the given keys, all of which the table has unless it is empty for want of any trusted text."""
        if len(self.keys) == 0:
            return np.zeros((len(keys), self.nll.shape[1]))
        found = np.zeros(len(keys), np.int32)
        open_ = np.arange(len(keys))
        for depth, slots in enumerate(self.slots):
            k = keys[open_] if depth else keys
            i = slots[self._at(k, depth, len(slots))]
            hit = self.keys[i] == k
            found[open_[hit]] = i[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        return self.nll[found]


def keyed(names: list[str], langs: list[str]) -> np.ndarray:
    """Keys of grams given as strings, each with its language."""
    points = np.frombuffer("".join(names).encode("utf-32-le"), "<u4")
    at = np.arange(0, len(points), ORDER)
    out, langs = np.empty(len(at), np.uint64), np.array(langs, object)
    for lang in set(langs.tolist()):
        here = np.flatnonzero(langs == lang)
        out[here] = keys_of(points[(at[here][:, None] + np.arange(ORDER)).ravel()], np.arange(0, ORDER * len(here), ORDER), lang)
    return out


def _keyed(batches):
    for b in batches:
        if b.num_rows:
            key = signed(keyed(b.column("g").to_pylist(), b.column("lang").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(key), *(b.column(f"f{i}").cast(pa.float32()) for i in range(FOLDS))], names=["key", *(f"f{i}" for i in range(FOLDS))])


def scored(rows: list[tuple], made: Table) -> Iterator[tuple[float, int]]:
    """(lang, fold, text) rows -> summed negative log likelihood and grams of each, texts of a language together.

    A document with a fold is scored by the models of the other folds, any other by all; models
    are averaged in the log.
    """
    nll, n = np.zeros((len(rows), FOLDS)), np.zeros(len(rows), np.int64)
    waiting: dict[str, list] = {}
    size: dict[str, int] = {}

    def done(lang):
        size[lang] = 0
        who, cuts = zip(*waiting.pop(lang))
        points, at, sizes = joined(list(cuts))
        got = made.of(keys_of(points, at, lang))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for i, s, k in zip(who, np.add.reduceat(got, starts, axis=0, dtype=np.float64), sizes.tolist()):
            nll[i] += s
            n[i] += k

    for i, (lang, _, text) in enumerate(rows):
        for cut in stretches(text):
            waiting.setdefault(lang, []).append((i, cut))
            size[lang] = size.get(lang, 0) + len(cut) // 4
            if size[lang] > BLOCK:
                done(lang)
    for lang in list(waiting):
        done(lang)
    for (_, fold, _), s, k in zip(rows, nll, n.tolist()):
        of = s if fold is None or fold < 0 else np.delete(s, fold)
        yield float(of.mean()), k


def _scores(batches, sent):
    turn_to("grams")
    for b in batches:
        for piece in pieces_of(b):
            rows = list(zip(*(piece.column(c).to_pylist() for c in ("lang", "fold", "text"))))
            if rows:
                nll, n = zip(*scored(rows, sent.value))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("doc_id", "mark", "lang", "fold")), pa.array(nll, pa.float64()), pa.array(n, pa.int64())], names=SCORES)


SCORES = ["doc_id", "mark", "model", "fold", "nll", "n"]
SCORE_DDL = "doc_id long, mark long, model string, fold int, nll double, n long"


def _block_scores(docs: pa.Table, answers: pa.Table) -> pa.Table:
    key = np.array(answers.column("key").to_numpy(), np.int64).view(np.uint64)
    made = Table(key, np.stack([answers.column(f"f{i}").to_numpy() for i in range(FOLDS)], axis=1))
    rows = list(zip(*(docs.column(c).to_pylist() for c in ("lang", "fold", "text"))))
    nll, n = zip(*scored(rows, made)) if rows else ((), ())
    return pa.Table.from_arrays([*(docs.column(c) for c in ("doc_id", "mark", "lang", "fold")), pa.array(nll, pa.float64()), pa.array(n, pa.int64())], names=SCORES)


def _block_grams(batches):
    turn_to("grams")
    for (block, lang), cuts in gathered(batches, ("block", "lang")):
        points, at, _ = joined(cuts)
        keys = np.unique(keys_of(points, at, lang))
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(keys), pa.int64()), pa.array(signed(keys))], names=["block", "key"])


def scores(docs: DataFrame, counts: DataFrame, limit: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc_id, mark, lang, fold, text), lang a model's -> (doc_id, mark, model, fold, nll, n).

    The distinct grams of all documents get their probabilities by joins with the sharded
    counts. Where there are no more than `limit` of them they are sent to the tasks; otherwise
    documents are dealt into blocks by a hash, each block asks for its grams, and the answers
    meet its texts in one group of bounded size.
    """
    spark = docs.sparkSession
    asked = stored(in_batches(docs.select("lang", "text"), _distinct, "lang string, g string").distinct(), "grams-asked")
    p = probabilities(counts, asked)
    # a fold without text of the language takes another's word
    nll = [F.coalesce(*[-F.log(f"p{(i + j) % FOLDS}") for j in range(FOLDS)]).alias(f"f{i}") for i in range(FOLDS)]
    rows = p.select("lang", "g", *nll)
    ddl = "key long, " + ", ".join(f"f{i} float" for i in range(FOLDS))
    known = stored(rows.mapInArrow(_keyed, ddl), "grams-known")
    free_shuffles(spark)
    if known.count() <= limit:
        got = known.toArrow()
        key = got.column("key").to_numpy().view(np.uint64)
        sent = spark.sparkContext.broadcast(Table(key, np.stack([got.column(f"f{i}").to_numpy() for i in range(FOLDS)], axis=1)))
        return in_batches(docs, partial(_scores, sent=sent), SCORE_DDL)
    blocks = max(1, int((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    wanted = dealt.select("block", "lang", "text").repartition("block").mapInArrow(_block_grams, "block long, key long").distinct()
    answers = wanted.join(known, "key").select("block", *known.columns)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: _block_scores(a, b), SCORE_DDL)


def mark_of():
    """What tells apart rows of one doc_id."""
    return F.xxhash64(F.col("lang").cast("string"), F.col("text"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that labels call good in one row and neither bad nor toxic in any."""
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t <> 1").select("doc_id")


def fitted(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, limit: int = BROADCAST_GRAMS) -> tuple[DataFrame, DataFrame]:
    """Stored scores (doc_id, mark, model, fold, nll, n) of all documents, and (model, mean, threshold), a row a language.

    Trusted documents train, dealt over FOLDS by a hash of their ids, and each is scored by
    the models that have not seen it. mean is the nll a character of all trusted text;
    threshold is the quantile, over the language's trusted documents, of the nll a character
    after adding PRIOR characters of mean text. All trusted documents count.
    """
    ids = maybe_broadcast(trusted_ids(labels).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark_of().alias("mark"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text")).join(ids, "doc_id", "left")
    good = rows.where("fold is not null").select(F.coalesce("lang", F.lit(POOLED)).alias("lang"), "fold", "text")
    counts = gram_counts(good)
    langs = counts.select("lang").distinct().withColumn("model", F.col("lang"))
    rows = rows.join(maybe_broadcast(langs), "lang", "left").select("doc_id", "mark", F.coalesce("model", F.lit(POOLED)).alias("lang"), F.coalesce("fold", F.lit(-1)).alias("fold"), "text")
    got = stored(scores(rows, counts, limit), "perplexity")
    held = got.where("fold >= 0 and n > 0")
    held = held.where(F.col("model") != POOLED).unionByName(held.withColumn("model", F.lit(POOLED)))
    mean = held.groupBy("model").agg((F.sum("nll") / F.sum("n")).alias("mean"))
    value = F.expr(f"(nll + {PRIOR} * mean) / (n + {PRIOR})")
    fit = held.join(maybe_broadcast(mean), "model").groupBy("model", "mean").agg(F.percentile_approx(value, quantile, 20_000).alias("threshold"))
    return got, stored(fit, "thresholds")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, limit: int = BROADCAST_GRAMS) -> DataFrame:
    """One row per document: doc_id, model, n_symbols, perplexity (a character), threshold (a perplexity too), kept.

    Trusted text is what `labels` gives quality 1 and nowhere quality 0 or toxic. A document is kept if its
    perplexity, with PRIOR characters of average text, does not exceed its language's threshold; a tie is kept. Documents in a
    language without trusted text, or without a language, are scored by the model of all trusted text. Texts without words have
    perplexity 1 and are kept; without any trusted text all are kept and the threshold is null. Repeated
    rows repeat; a null doc_id is never trusted; extra columns are ignored.
    """
    return verdicts(*fitted(docs, labels, quantile, limit)).drop("mark")


def verdicts(got: DataFrame, fit: DataFrame) -> DataFrame:
    value = F.expr(f"(nll + {PRIOR} * mean) / (n + {PRIOR})")
    return got.join(maybe_broadcast(fit), "model", "left").select(
        "doc_id", "mark", "model", F.col("n").alias("n_symbols"),
        F.when(F.col("n") > 0, F.exp(F.col("nll") / F.col("n"))).otherwise(1.0).alias("perplexity"),
        F.exp("threshold").alias("threshold"),
        F.coalesce((value <= F.col("threshold")) | (F.col("n") == 0), F.lit(True)).alias("kept"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The documents that classify() keeps, all columns kept, nulls, repeated rows and ids as there.

    Only the rejected documents' ids and hashes of language and text are joined with the documents.
    """
    got, fit = fitted(docs, labels, quantile)
    out = verdicts(got, fit).where("not kept").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    return docs.join(maybe_broadcast(out), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (mark_of() == F.col("__mark")), "left_anti")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

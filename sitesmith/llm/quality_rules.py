"""Quality rules with risk-controlled thresholds: cutoffs that bound the false rejection of all rules together per stratum."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesmith.llm.common import in_batches, known_words, maybe_broadcast, pieces_of, rolled, stored, table, word_hashes, WordHash

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: False rejection of good documents allowed to all rules of a stratum together, and the chance, over all strata, that any exceeds it.
RISK = 0.05
DELTA = 0.05
#: One labelled document in so many, by a hash of its id, chooses the order in which cutoffs are tested; the others test them.
TUNING = 3
#: Cutoffs tried for each rule, from the most lenient to the strictest. A document fails above a cutoff.
RULES = {
    "symbol_share": ("n_symbols / greatest(word_chars, 1)", [0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02]),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", [0.19, 0.17, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01]),
    "dup_lines_per_100_words": ("100 * n_dup_lines / greatest(n_words, 1)", [20, 15, 12, 10, 8, 6, 5, 4, 3, 2, 1.5, 1, 0.5]),
    "word_length": ("word_chars / greatest(n_words, 1)", [40, 30, 25, 20, 18, 16, 14, 13, 12, 11, 10, 9, 8]),
    "word_shortness": ("n_words / greatest(word_chars, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.27, 0.25]),
}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CONT = np.zeros(256, bool)
_CONT[128:192] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def base_counts(text: bytes | None, known: WordHash) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole UTF-8 text."""
    words = text.split() if text else []
    if not words:
        return 0, 0, 0, 0, 0
    raw = np.frombuffer(text, np.uint8)
    chars = len(raw) - int((_SPACE[raw] | _CONT[raw]).sum())
    symbols = int(_SYMBOL[raw].sum())
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(b" \t\n\r\x0b\x0c"):
            seen.add(line)
    repeat = 0
    h = rolled(word_hashes(words, known), WINDOW)
    if len(h) > 1:
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if same.any():
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            repeat = int((np.cumsum(cover[:-1]) > 0).sum())
    return len(words), chars, symbols, dup, repeat


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text) -> doc_id, lang, the base counts and base_failed."""

    def run(batches):
        known = known_words()
        for b in (piece for batch in batches for piece in pieces_of(batch)):
            rows = [base_counts(t, known) for t in b.column("text").to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *[pa.array(c, pa.int64()) for c in zip(*rows)]], names=["doc_id", "lang", *NAMES])

    cols = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("binary").alias("text"))
    out = in_batches(cols, run, "doc_id long, lang string, " + ", ".join(f"{n} long" for n in NAMES))
    return out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k), X binomial(n, p): the terms from k downwards until they no longer count."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    if k > n * p:  # the upper tail is the shorter one
        term, total, i = math.exp(log), 0.0, k
        while i < n:
            term *= (n - i) / (i + 1) * p / (1 - p)
            total += term
            i += 1
            if term < total * 1e-17:
                break
        return 1.0 - total
    term, total, i = 1.0, 1.0, k
    while i > 0:
        term *= i / (n - i + 1) * (1 - p) / p
        total += term
        i -= 1
        if term < total * 1e-17:
            break
    return min(1.0, math.exp(log) * total)


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound at confidence 1 - delta on a rate of which k in n was seen."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > delta else (low, mid)
    return high


def notches() -> list:
    """For each rule the number of its cutoffs that a document exceeds: as cutoffs grow stricter, the first so many do not reject it."""
    out = []
    for rule, (value, grid) in RULES.items():
        # grids run from lenient to strict, so what exceeds one exceeds all that follow
        out.append((len(grid) - F.size(F.filter(F.array(*[F.lit(float(c)) for c in grid]), lambda c: F.expr(value) > c))).cast("int").alias(rule))
    return out


def rejected(at: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Documents (rows of notches()) that fail under the strictest cutoff number `cut` of each rule; -1 stands for no cutoff."""
    return (at <= cut[None, :]).any(axis=1)


def path(at: np.ndarray, good: np.ndarray, bad: np.ndarray, risk: float) -> list[np.ndarray]:
    """Ever stricter sets of cutoffs: the next is the one change of a rule that rejects most bad documents for the good ones it costs.

    `at` has distinct notches, good and bad the documents of each. Ends where no change rejects
    another bad document or the good ones rejected exceed `risk`.
    """
    cut, out = np.full(at.shape[1], -1), []
    while True:
        now = rejected(at, cut)
        best = None
        for r, (_, grid) in enumerate(RULES.values()):
            for c in range(int(cut[r]) + 1, len(grid)):
                new = ~now & (at[:, r] <= c)
                gain, cost = int(bad[new].sum()), int(good[new].sum())
                if gain and (best is None or gain / (1 + cost) > best[0]):
                    best = gain / (1 + cost), r, c
        if best is None:
            return out
        cut = cut.copy()
        cut[best[1]] = best[2]
        if good[rejected(at, cut)].sum() > risk * good.sum():
            return out
        out.append(cut)


def cutoffs(counts: list[tuple], risk: float = RISK, delta: float = DELTA) -> dict[str | None, tuple[np.ndarray, int, int, float]]:
    """Stratum -> (strictest cutoff of each rule that holds, good documents that tested it, of them rejected, bound).

    counts has (stratum, tuning, good, notches..., n) rows of labelled documents that passed the
    base rules. Each stratum gets delta over the number of strata (Bonferroni). Within one, path()
    of the tuning documents is a fixed sequence for the others: sets of cutoffs are tested in its order, each by
    the exact bound on the share of good documents that any of its rules rejects, and the last before the first whose
    bound exceeds `risk` is taken, which needs no further correction. A stratum where none holds is left out.
    """
    strata: dict[str | None, list] = {}
    for stratum, *rest in counts:
        strata.setdefault(stratum, []).append(rest)
    found = {}
    for stratum, rows in strata.items():
        tuning, good, n = (np.array([r[i] for r in rows], t) for i, t in ((0, bool), (1, bool), (-1, np.int64)))
        at = np.array([r[2:-1] for r in rows], np.int64)
        test = n * (~tuning & good)
        for cut in path(at, n * (tuning & good), n * (tuning & ~good), risk):
            k = int(test[rejected(at, cut)].sum())
            bound = upper_bound(k, int(test.sum()), delta / len(strata))
            if bound > risk:
                break
            found[stratum] = cut, int(test.sum()), k, bound
    return found


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good), a row a document: good if every label of it is 1."""
    rows = labels.where("doc_id is not null and quality is not null")
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, failed_rules and certified.

    kept is false where the base rules fail or a rule of the document's stratum exceeds its
    cutoff. A stratum is a language, null a stratum of its own. The holdout is every document in `labels`. certified
    says that the stratum has cutoffs whose risk is bounded; one with too few labels has none, and its
    documents are rejected by the base rules only. Null text has no words. Repeated
    rows repeat, each counted; extra columns are ignored. Distinct notches are at most the product of the grids' lengths.
    """
    rows = stored(measured(docs), "quality-rules")
    held = rows.where("not base_failed").join(maybe_broadcast(labelled(labels)), "doc_id")
    tuning = (F.pmod(F.xxhash64("doc_id"), F.lit(TUNING)) == 0).alias("tuning")
    counts = held.select("lang", tuning, "good", *notches()).groupBy("lang", "tuning", "good", *RULES).agg(F.count("*").alias("n"))
    found = cutoffs(sorted((tuple(r) for r in counts.collect()), key=repr), risk, delta)
    failed = []
    for stratum, (cut, *_) in found.items():
        here = F.col("lang").eqNullSafe(F.lit(stratum))
        failed += [F.when(here & (F.expr(value) > float(grid[c])), F.lit(rule)) for (rule, (value, grid)), c in zip(RULES.items(), cut.tolist()) if c >= 0]
    rules = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    known = [s for s in found if s is not None]
    certified = F.coalesce(F.col("lang").isin(known), F.lit(False)) | (F.col("lang").isNull() & F.lit(None in found))
    return rows.select(
        "doc_id", *NAMES, "base_failed", (~F.col("base_failed") & (F.size(rules) == 0)).alias("kept"), F.array_join(rules, ",").alias("failed_rules"), certified.alias("certified")
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Operator 11 against a version that looks at every window."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitesmith.llm import suffix_dedup
from sitesmith.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, k1 long, k2 long, gram string, spans int, n long"


def slow(rows, depth=400):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + depth] for _, b in texts for p in range(len(b) - depth + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if seen[b[p : p + depth]] > 1:
                gone[p : p + depth] = b"\1" * depth
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def fast(df, **how):
    out = suffix_dedup.without_repeats(df, **how)
    cols = ["doc_id", "n_bytes", F.col("n_bytes") - F.length("kept"), F.size("spans"), F.sha2("kept", 256)]
    return sorted((tuple(r) for r in out.select(*cols).collect()), key=repr)


def made(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "g", 3, 4) for i, t in rows], SCHEMA)


def test_whole_table(spark):
    df = suffix_dedup.op11_suffix_dedup(spark, SF)
    assert dict(df.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    want = slow([(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()])
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want and sum(r[2] for r in want) > 10_000


@pytest.mark.parametrize("seed, letters, how", [
    (1, "abcdefgh é", {"depth": 60, "gram": 16, "span": 25}), (2, "ab", {"depth": 60, "gram": 8, "span": 53}),
    (3, "ab", {"depth": 40, "gram": 32, "span": 9, "sent": 0}), (4, "a", {"depth": 50, "gram": 20, "span": 31}),
])
def test_pieces_put_together(spark, seed, letters, how):
    """Texts of shared pieces: overlaps, repeats inside a text, ends of texts inside others, runs of one letter."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 700))) for _ in range(10)]
    rows = []
    for i in range(50):
        cuts = [(x, rnd.randint(0, len(x)), rnd.randint(0, 300)) for x in rnd.choices(base, k=rnd.randint(0, 4))]
        rows.append((i, "".join(x[a : a + n] for x, a, n in cuts) if rnd.random() < 0.9 else None))
    want = slow(rows, how["depth"])
    assert fast(made(spark, rows), **how) == want and any(r[2] for r in want)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    exact = "".join(chr(97 + i * i % 23) + str(i) for i in range(200))[:400]
    rows = [
        (1, None), (2, ""), (3, "short"), (3, "short"), (4, long), (5, long[1000:200_000]), (6, "q" * 399), (7, "q" * 399), (8, "r" * 400),
        (None, exact), (9, exact), (9, exact), (None, exact + "!"), (10, "é" * 300), (11, "x" + "é" * 250 + "y"), (12, "s" * 500),
    ]
    assert fast(made(spark, rows)) == slow(rows)
    assert fast(made(spark, [])) == []


def test_a_passage_in_most_documents(spark):
    """One shared bucket of many rows, and exact copies."""
    passage = " ".join(f"law{i}" for i in range(90))
    rows = [(i, f"{i} first words {i * i}" * 9 + passage + f" end {i}") for i in range(300)] + [(1000 + i, passage) for i in range(200)]
    assert fast(made(spark, rows)) == slow(rows)


def test_the_end_of_a_text_is_no_reason_to_prune(spark):
    """A text that ends with another's window has no later suffix of its own there."""
    rnd = random.Random(7)
    body = "".join(rnd.choice("abcdefghij") for _ in range(2000))
    rows = [(0, body)] + [(1 + k, body[a : a + 60]) for k, a in enumerate(range(0, 1900, 37))]
    assert fast(made(spark, rows), depth=60, gram=16, span=20) == slow(rows, 60)


def test_chosen_suffixes_must_lie_in_their_window(spark):
    with pytest.raises(ValueError):
        suffix_dedup.repeats(made(spark, []), depth=40, gram=32, span=20)

"""Operator 13 against all pairs."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sitesmith.llm import hard_negatives

SF = "/root/testdata/sf0.001"


def slow(rows, anchor):
    """rows: (id, label, vec); repeated rows are rows."""
    rows = [r for r in rows if None not in r and None not in r[2]]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, label, v) in enumerate(rows):
        if not anchor(i):
            continue
        scored = [(-dot(v, w), j, l) for m, (j, l, w) in enumerate(rows) if m != n]
        for p, j, _ in sorted(x for x in scored if x[2] == label)[:5]:
            fit = sorted(x for x in scored if x[2] != label and -30 * p <= -100 * x[0] <= -90 * p)[:10]
            out += [(i, j, k, d, -p, -s) for k, (s, d, _) in enumerate(fit, 1)]
    return sorted(out)


def fast(spark, rows, **how):
    df = spark.createDataFrame([(i, l, v, 1, "x", 0.5) for i, l, v in rows], "id long, label long, vec array<long>, row long, dist string, score double")
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("id") % 5 == 0, **how).collect())


def test_whole_table(spark):
    df = hard_negatives.op13_hard_negatives(spark, SF)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got, want = sorted(tuple(r) for r in df.collect()), sorted(con.execute(hard_negatives.ORACLE).fetchall())
    assert got == want and len(got) > 100
    assert [t for _, t in df.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


@pytest.mark.parametrize("seed, size, blocks", [(1, 9, 16 << 20), (2, 200, 900), (3, 2, 16 << 20)])
def test_all_pairs(spark, monkeypatch, seed, size, blocks):
    """Clusters, many ties, several blocks of anchors, several batches, a sample smaller than the table."""
    monkeypatch.setattr(hard_negatives, "BATCH", 64)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 50)
    monkeypatch.setattr(hard_negatives, "SLICE", 100)
    rnd = random.Random(seed)
    centres = [[rnd.randint(-size, size) for _ in range(6)] for _ in range(7)]
    rows = []
    for i in range(400):
        c = rnd.choice(centres)
        rows.append((i, rnd.randint(0, 3), [x + rnd.randint(-size // 4 - 1, size // 4 + 1) for x in c]))
    assert fast(spark, rows, block_bytes=blocks) == slow(rows, lambda i: i % 5 == 0)


def test_odd_rows(spark):
    rows = [(5, 1, [3, 4]), (5, 1, [3, 4]), (6, 1, [3, 3]), (7, 2, [2, 2]), (7, 2, [2, 2]), (8, 2, []), (10, 2, [1]), (11, 1, None), (12, None, [1, 1]), (None, 1, [9, 9]), (13, 1, [None, 1]), (15, 3, [0, 0]), (16, 3, [-5, -5])]
    padded = [(i, l, v and v + [0] * (2 - len(v)) if v else ([0, 0] if v == [] else v)) for i, l, v in rows]
    assert fast(spark, rows) == slow(padded, lambda i: i % 5 == 0)
    assert fast(spark, []) == [] and fast(spark, [(5, 1, [])]) == []


def test_one_vector_many_times(spark):
    """A third of all rows are one vector."""
    rows = [(i, i % 4, [7, 1, 3]) for i in range(200)] + [(200 + i, i % 4, [i % 11, 5 - i % 7, i % 3]) for i in range(300)]
    assert fast(spark, rows) == slow(rows, lambda i: i % 5 == 0)


def test_large_components_are_exact(spark):
    rows = [(i, i % 2, [(1 << 28) + i * i % 17, i, -(1 << 27)]) for i in range(40)]
    assert fast(spark, rows) == slow(rows, lambda i: i % 5 == 0)


def test_brackets_hold(spark):
    """Every score lies in its bracket, and some pairs are outside of what is asked."""
    import numpy as np

    rnd = np.random.default_rng(1)
    x = np.rint(rnd.normal(0, 90, (300, 12)) + 400 * np.eye(12)[rnd.integers(0, 12, 300)]).astype(np.int64)
    space = hard_negatives.Space(12, float((x.astype(float) ** 2).sum(1).max()), int(abs(x).max()), x[:100])
    f = x.astype(float)
    to, apart = space.distances(f, space.lift(f)), space.distances(f)
    near, far = abs(apart[:, None] - to).max(2), (apart[:, None] + to).min(2)
    least, largest = space.bracket((f**2).sum(1)[:, None], near, far)
    s = x @ x.T
    assert (least <= s).all() and (s <= largest).all()
    top = np.sort(s, 1)[:, -10].astype(float)
    a, r = space.candidates(x, apart, to, top, np.full(300, math.inf))
    found = set(zip(a.tolist(), r.tolist()))
    assert all((i, j) in found for i, j in zip(*np.nonzero(s >= top[:, None]))) and len(found) < 300 * 300


def test_query_leaves_out_what_takes_no_part(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int, extra string"
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5], 1, "a"), (100, [0.5, 0.5], 1, "a"), (1, [0.4, 0.4], 3, "a"), (14, [0.4, 0.3], 0, "a"), (2, [inf, 1.0], 3, "a"), (3, [nan, 1.0], 3, "a"), (4, [None, 1.0], 3, "a"), (5, None, 3, "a"), (6, [0.5, 0.4], None, "a"), (None, [0.5, 0.4], 3, "a")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = sorted(tuple(r) for r in hard_negatives.op13_hard_negatives(spark, str(tmp_path)).collect())
    # row 0 is divisible by 7: its label is 2, so its only positive would be another of label 2
    assert got == sorted(con.execute(hard_negatives.ORACLE).fetchall())

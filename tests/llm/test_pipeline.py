"""The pipeline against its stages written out, and the SQL of operators that have it."""

from __future__ import annotations

import struct
import zlib

import duckdb
import pytest
from test_llm_ops import ODD, SF, slow_contained, slow_near_groups, slow_quality
from test_llm_ops import docs as odd_docs

import corpus_pipeline
from sitesmith.llm import mixing, queries, token_files
from sitesmith.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    res = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(cols) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == sorted(res.fetchall(), key=repr)


def slow_mix(rows):
    """id -> copies, written out from the description of the mix; rows are (id, text, lang, source)."""
    import hashlib
    import math
    import re

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    order = sorted({s for *_, s in rows}, key=lambda s: (s is None, s))
    total = {s: sum(size[i] for i, *_, x in rows if x == s) for s in order}
    weight, goal, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, 1.5 * sum(total.values())
    while open_ := [s for s in order if s not in goal]:
        part = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if part[s] > 2 * total[s]]
        goal |= {s: 2.0 * total[s] for s in over} or part
        left -= sum(2.0 * total[s] for s in over)
    out = {}
    for s in order:
        epochs = int(goal[s] // total[s]) if total[s] else 0
        keyed = []
        for i, t, _, x in rows:
            if x == s:
                u = (int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                keyed.append((-math.log(u) / max(0.1, 1 - 10 * len(re.findall(r"[#*$%&|<>]", t or "")) / max(len(t or ""), 1)), i))
        prior = 0
        for _, i in sorted(keyed):
            out[i] = (epochs + (prior + size[i] / 2 <= goal[s] - epochs * total[s])) if size[i] else 0
            prior += size[i]
    return out


def test_pipeline(spark):
    """run() against every stage written out in plain Python; the perplexities' model is the one of test_llm_ops."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    kept = {i for i, v in slow_quality(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]).items() if v[2]}
    rows = {r[0]: r for r in rows if r[0] in kept}
    group = slow_near_groups({i: r[1] for i, r in rows.items()})
    rows = {i: r for i, r in rows.items() if group[i] == i}
    bad = {d for d, _ in slow_contained(rows.values(), [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()])}
    rows = {i: r for i, r in rows.items() if i not in bad}
    lib = token_files.WordEncoder(token_files.tokenizer_path()).library
    want, at = [], 0
    for i, times in sorted(slow_mix(list(rows.values())).items()):
        ids = [*lib.encode(rows[i][1], add_special_tokens=False).ids, 2]
        for _ in range(times):
            want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
            at += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)


def test_pipeline_odd(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and columns of clashing names pass through every stage."""
    docs = odd_docs(spark, ODD)
    for t, df in (("labels", spark.createDataFrame([(6, 1, 0), (8, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, None), (2, "no such words in any of these")], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        names = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    # of the texts without words one stays until the mix, which takes no empty text; the equal long texts are one
    assert {r["doc_id"] for r in out} <= {4, 5, 6, 8, 9, None} and 6 in {r["doc_id"] for r in out} and 7 not in {r["doc_id"] for r in out}


def test_stages_keep_columns(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0

"""Operator 12 against a search over all edits with whole label strings."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from sitesmith.llm import conversation_repair as cr
from sitesmith.llm.common import table

SF = "/root/testdata/sf0.001"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def search(rows):
    """Best first over (cost, audit): every edit, every role, insertions anywhere; grammar checked by its regular expression."""
    fault = faults(rows)

    def hopeful(initials):
        return any(GRAMMAR.fullmatch(initials + end) for end in ("", "a", "ua"))

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, left = heapq.heappop(heap)
        if at == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in left)
        if (at, initials[-2:] if len(initials) > 1 else initials, audit) in done:
            continue
        done.add((at, initials[-2:] if len(initials) > 1 else initials, audit))
        steps = [(3, "I", at, (r, "")) for r in ("user", "assistant")] if not audit.endswith("III") else []
        if at < len(rows):
            role, text = rows[at]
            steps.append((4, "D", at + 1, None))
            if fault[at] in ("", "truncated"):
                more = 3 * (fault[at] == "truncated")
                steps += [(more, "K", at + 1, (role, text))] if role else []
                steps += [(3 + more, "R", at + 1, (r, text)) for r in ("user", "assistant")]
        for more, label, to, row in steps:
            now = initials + (row[0][:1] if row else "")
            if hopeful(now):
                heapq.heappush(heap, (cost + more, audit + label, to, now, left + ((row,) if row else ())))


def want(rows):
    """What the query returns, from (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c]
        sp = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20
        role, text = sp(role), sp(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            by[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for c, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, *_ in mine if t is not None]
        pairs = [(r, x) for _, r, x in mine]
        f = faults(pairs)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(pairs, pairs[1:]))
        cost, audit, left = search(pairs) if pairs else (0, "", "")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, tmp_path):
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], "conv_id long, turn long, role string, text string, nth int, symbols string, part int")
    df.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r) for r in cr.op12_conversation_repair(spark, str(tmp_path)).collect()), key=repr)


def test_whole_table(spark):
    df = cr.op12_conversation_repair(spark, SF)
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want(rows)
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"] * 2
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_conversations_at_random(spark, tmp_path, monkeypatch):
    """All kinds of faults, roles, ties and gaps; chunks of two rows."""
    monkeypatch.setattr(cr, "CHUNK", 2)
    rnd = random.Random(3)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "uncle", "", None], ["Yes.", "No!", "what", "", " \n", "A longer one. And", "Good? ", None, "x "]
    rows = []
    for c in range(250):
        for _ in range(rnd.randint(1, 6)):
            rows.append((c, rnd.choice([0, 1, 2, 3, 4, 9, None]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.6 else f"Text {rnd.random()}."))
    assert got(spark, rows, tmp_path) == want(rows)


def test_odd_tables(spark, tmp_path):
    assert got(spark, [], tmp_path) == []
    long = "word " * 400_000 + "end."
    rows = [(None, 0, "user", "Hello."), (None, 1, "assistant", "Hi."), (1, None, "user", None), (2, 3, None, "Text."), (3, 0, "user", long), (3, 0, "user", long), (3, 2, "assistant", long + "!")]
    dropped = next(i for i in range(100, 400) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone"))
    out = got(spark, rows, tmp_path)
    assert out == want(rows)
    assert next(r for r in out if r[0] == dropped) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_conversation_with_most_rows(spark, monkeypatch):
    """One conversation of thousands of rows lies in several tasks; its audit is that of the whole."""
    monkeypatch.setattr(cr, "CHUNK", 50)
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"Row {t}." if t % 5 else f"row {t}") for t in range(4000) if t % 11] + [(8, t, "user", "One.") for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        summary, repaired = cr.repair(df)
        one = {r["conv_id"]: r for r in summary.collect()}
        assert repaired.where("conv_id = 7").select("part").distinct().count() > 1
        sha = {r[0]: r[1] for r in cr.digests(repaired).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    pairs = [(r, x) for c, _, r, x in rows if c == 7]
    symbols = "".join(cr.SYMBOLS[f or "sound"][r[0]] for f, (r, _) in zip(faults(pairs), pairs))
    cost, labels, behind = cr.cheapest(symbols.encode())
    assert (one[7]["cost"], one[7]["audit"], one[7]["truncated"]) == (cost, "".join(labels) + behind, faults(pairs).count("truncated"))
    text = "\n".join(f"{r}:{x}" for r, x in cr.lines(cr.START, labels, behind, [r for r, _ in pairs], [x for _, x in pairs]))
    assert sha[7] == hashlib.sha256(text.encode()).hexdigest()
    assert one[8]["duplicate"] == 2 and one[8]["audit"] == "KDDI"


@pytest.mark.parametrize("seed", range(3))
def test_composition_against_search(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        rows = [(rnd.choice(["user", "assistant", "system", "x"]), rnd.choice(["a.", "b", "", "c."])) for _ in range(rnd.randint(0, 7))]
        symbols = "".join(cr.SYMBOLS[f or "sound"][r[0] if r[0] in "sua" else "-"] for f, (r, _) in zip(faults(rows), rows))
        cost, labels, behind = cr.cheapest(symbols.encode())
        text = "\n".join(f"{r}:{x}" for r, x in cr.lines(cr.START, labels, behind, [r for r, _ in rows], [x for _, x in rows]))
        assert (cost, "".join(labels) + behind, text) == search(rows)

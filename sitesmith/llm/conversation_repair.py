"""Repair of a conversation's structure by weighted finite-state composition.

Three machines are composed: an acceptor of the conversation's rows (a chain), an edit transducer
(keep, rerole, delete, insert) and an acceptor of role initials for the grammar (s?(ua)+)?. A state
of the composition is (row, insertions since it, grammar state); only states that a path reaches
are made. Weights are (cost, label string), lower cost first, then the string that sorts first.
Insertions cost, so no best path inserts more than a grammar needs between two rows, which makes the
composition acyclic; it is solved in topological order from its end, as putting a label in front
of two strings keeps their order. Arcs that leave one state bear different labels, so
where costs tie the first label decides, and no strings need be compared or kept: only the label chosen in each state.

Rows are sorted over all tasks by range, a long conversation in as many as it needs, and become a byte
each for the composition; texts stay where they are and are joined with their edits by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitesmith.llm.common import WORD_RE, drop_path, in_batches, new_path, stored, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Grammar states by what has been read: nothing, the system's turn, an user's turn, an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
#: The one initial that an inserted or renamed row can have in each state.
WANTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Rows to a chunk at most, and characters of text beyond which none is added.
CHUNK, CHUNK_BYTES = 1024, 64 << 10
FAULTS = ("sound", "truncated", "duplicate", "blank")
#: What a row is to the composition: its fault and its initial, as one byte.
SYMBOLS = {f: dict(zip("sua-", c)) for f, c in zip(FAULTS, ("sua-", "SUA_", "123.", "456:"))}
MEANING = {ord(c): (f, i) for f, by in SYMBOLS.items() for i, c in by.items()}


def tail(state: int) -> tuple[int, str]:
    """The cheapest insertions from a grammar state to the end."""
    if state in FINAL:
        return 0, ""
    cost, labels = tail(NEXT[state, WANTED[state]])
    return cost + INSERT, "I" + labels


@lru_cache(maxsize=65536)
def column(symbol: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """One row composed with the edits and the grammar: the cost of each grammar state before it, and the labels chosen up to and with the row.

    after: the costs of the grammar states behind the row.
    """
    fault, initial = MEANING[symbol]
    extra = TRUNCATED if fault == "truncated" else 0

    def best(state: int, inserted: int) -> tuple[int, str]:
        arcs = [(after[state] + DELETE, "D")]
        if fault in ("sound", "truncated"):
            if (state, initial) in NEXT:
                arcs.append((after[NEXT[state, initial]] + KEEP + extra, "K"))
            arcs.append((after[NEXT[state, WANTED[state]]] + REROLE + extra, "R"))
        if inserted < 2:
            cost, labels = best(NEXT[state, WANTED[state]], inserted + 1)
            arcs.append((cost + INSERT, "I" + labels))
        return min(arcs, key=lambda arc: (arc[0], arc[1][0]))

    found = [best(state, 0) for state in range(4)]
    return tuple(c for c, _ in found), tuple(labels for _, labels in found)


def cheapest(symbols: bytes) -> tuple[int, list[str], str]:
    """The cost of the best path, the labels up to and with each row, and those behind the last row."""
    cost = tuple(tail(state)[0] for state in range(4))
    base, chosen = 0, []
    for symbol in reversed(symbols):
        least = min(cost)
        base, cost = base + least, tuple(c - least for c in cost)  # so that few different columns exist
        cost, labels = column(symbol, cost)
        chosen.append(labels)
    total, state, out = base + cost[START], START, []
    for symbol, labels in zip(symbols, reversed(chosen)):
        out.append(labels[state])
        for label in labels[state]:
            state = after(state, label, MEANING[symbol][1])
    return total, out, tail(state)[1]


def after(state: int, label: str, initial: str) -> int:
    if label == "D":
        return state
    return NEXT[state, initial if label == "K" else WANTED[state]]


def faulted(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, seen, fault: each row's first fault; null roles and texts are one space.

    blank: no character but white space. duplicate: role and text stand in an earlier row (by turn, nulls first, then role and text).
    truncated: the last character that is no white space is none of . ! ?
    """
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text)
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(~F.col("text").rlike(WORD_RE), "blank").when(F.col("seen") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("sound")
    return rows.withColumn("seen", seen).withColumn("fault", fault)


def chunked(rows: DataFrame) -> DataFrame:
    """Chunks of at most CHUNK rows of a conversation in order: conv_id, part, nth, symbols, roles, texts.

    Rows are dealt by range of their order, so a long conversation lies in several tasks; part and nth order its chunks.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    initial = F.substring("role", 1, 1)
    symbol = F.create_map(*(F.lit(x) for f in FAULTS for i in "sua-" for x in (f + i, SYMBOLS[f][i])))
    rows = rows.withColumn("symbol", symbol[F.concat("fault", F.when(initial.isin("s", "u", "a"), initial).otherwise("-"))])
    # the range's bounds hold the begin of a text only; equal rows stay together
    parts = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text", "seen")
    kind = rows.schema["conv_id"].dataType.simpleString()
    text_list = pa.list_(pa.string())

    def run(batches):
        part, nth, conv, size = TaskContext.get().partitionId(), 0, None, 0
        held: list[tuple] = []
        done: list[tuple] = []

        def close():
            symbols, roles, texts = zip(*held)
            done.append((conv, part, nth, "".join(symbols), list(roles), list(texts)))

        for b in batches:
            known = b.column("conv_id").type
            for c, *row in zip(*(b.column(x).to_pylist() for x in ("conv_id", "symbol", "role", "text"))):
                if held and (c != conv or len(held) >= CHUNK or size > CHUNK_BYTES):
                    close()
                    nth, held, size = nth + 1 if c == conv else 0, [], 0
                conv = c
                held.append(row)
                size += len(row[2])
            if done:
                yield batch(done, known)
                done = []
        if held:
            close()
            yield batch(done, known)

    def batch(done, known):
        types = [known, pa.int32(), pa.int32(), pa.string(), text_list, text_list]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=["conv_id", "part", "nth", "symbols", "roles", "texts"])

    return in_batches(parts.select("conv_id", "symbol", "role", "text"), run, f"conv_id {kind}, part int, nth int, symbols string, roles array<string>, texts array<string>")


def solved(chunks: DataFrame) -> DataFrame:
    """Per conversation its counts, cost and audit, and the edits of its chunks: chunks of (part, nth, state before, labels by row); behind: labels after the last row."""
    kind = chunks.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, edits array<struct<part: int, nth: int, state: int, labels: array<string>, behind: string>>"

    def run(batches):
        for b in batches:
            out = []
            for parts in b.column("parts").to_pylist():
                parts.sort(key=lambda p: (p["part"], p["nth"]))
                symbols = "".join(p["symbols"] for p in parts).encode()
                cost, labels, behind = cheapest(symbols)
                faults, initials = zip(*(MEANING[x] for x in symbols))
                illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:]))
                edits, at, state = [], 0, START
                for p in parts:
                    mine = labels[at : at + len(p["symbols"])]
                    edits.append({"part": p["part"], "nth": p["nth"], "state": state, "labels": mine, "behind": behind if p is parts[-1] else ""})
                    for x, row in zip(mine, initials[at:]):
                        for label in x:
                            state = after(state, label, row)
                    at += len(mine)
                out.append((*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, "".join(labels) + behind, edits))
            edit = pa.struct([("part", pa.int32()), ("nth", pa.int32()), ("state", pa.int32()), ("labels", pa.list_(pa.string())), ("behind", pa.string())])
            types = [pa.int64()] * 5 + [pa.string(), pa.list_(edit)]
            cols = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *cols], names=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "edits"])

    grouped = chunks.groupBy("conv_id").agg(F.collect_list(F.struct("part", "nth", "symbols")).alias("parts"))
    return grouped.mapInArrow(run, ddl)


def lines(state: int, labels: list[str], behind: str, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows that the edits leave, in order."""
    for edit, role, text in zip([*labels, behind], [*roles, ""], [*texts, ""]):
        for label in edit:
            if label == "K":
                yield role, text
            elif label in "RI":
                yield ROLE[WANTED[state]], text if label == "R" else ""
            state = after(state, label, role[:1])


def repair(rows: DataFrame, paths: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, repaired): a row a conversation with its faults, cost and audit, and its rows after the cheapest edits.

    rows: conv_id, turn, role, text, ordered by turn, nulls first, then role and text. summary: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit. repaired: conv_id, part, nth, turns (role, text) in order, chunk by chunk.
    gaps: turns between the first and the last that no row has, nulls left out. illegal: neighbouring initials not su, ua or au.
    Conversations whose every row is deleted have no turns. Roles of another initial than s, u and a (an empty one too) cannot be kept. A null
    conv_id is a conversation; null roles and texts are one space; extra columns are ignored; repeated rows are
    duplicates; an empty table gives none. The tables that both results read from the shared folder are added to `paths`.
    """
    spark = rows.sparkSession
    marked = faulted(rows)
    kept = [new_path(spark, x) for x in ("chunks", "edits")]
    chunks = stored(chunked(marked), "", kept[0])
    edits = stored(solved(chunks.select("conv_id", "part", "nth", "symbols")), "", kept[1])
    if paths is not None:
        paths += kept
    turns = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"))
    summary = turns.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long"))).alias("t").join(edits.drop("edits").alias("e"), F.col("t.conv_id").eqNullSafe(F.col("e.conv_id")))
    summary = summary.select("t.*", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    mine = edits.select(F.col("conv_id").alias("c"), F.explode("edits").alias("e")).select("c", F.col("e.part").alias("p"), F.col("e.nth").alias("n"), "e.state", "e.labels", "e.behind")
    joined = chunks.join(mine, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("nth") == F.col("n"))).select("conv_id", "part", "nth", "state", "labels", "behind", "roles", "texts")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for b in batches:
            cols = [b.column(x).to_pylist() for x in ("state", "labels", "behind", "roles", "texts")]
            left = [[{"role": r, "text": t} for r, t in lines(*x)] for x in zip(*cols)]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("conv_id", "part", "nth")), pa.array(left, turn)], names=["conv_id", "part", "nth", "turns"])

    return summary, in_batches(joined, run, f"conv_id {kind}, part int, nth int, turns array<struct<role: string, text: string>>")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the turns as role:text, newline-joined; chunks pass one by one through the hash, a long conversation is never held whole."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches):
        conv, sha, begun, known = None, None, False, None
        done: list[tuple] = []
        for b in batches:
            known = b.column("conv_id").type
            for c, turns in zip(b.column("conv_id").to_pylist(), b.column("turns")):
                if sha is None or c != conv:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha, begun = c, hashlib.sha256(), False
                for t in turns.as_py():
                    sha.update(f"{chr(10) if begun else ''}{t['role']}:{t['text']}".encode())
                    begun = True
            if done:
                yield batch(done, known)
                done = []
        if sha is not None:
            yield batch([(conv, sha.hexdigest())], known)

    def batch(done, known):
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], known), pa.array([h for _, h in done], pa.string())], names=["conv_id", "repaired_sha256"])

    return in_batches(repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth"), run, f"conv_id {kind}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with known faults, by crc32 of `conv_id:turn` modulo 20 (nulls are one space): dropped (0), emptied (1), without . ! ? (2), twice (3), by the user (4)."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("kind") == 4, "user").otherwise(role)
    rows = rows.withColumn("kind", kind).where(F.col("kind") != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), "kind")
    return rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind", "n")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged by rule and repaired; one that has lost all rows has zeros, an empty audit and the empty string's hash."""
    rows = table(spark, sf_dir, "conversations")
    paths: list[str] = []
    summary, repaired = repair(damaged(rows), paths)
    got = summary.alias("s").join(digests(repaired).alias("d"), F.col("s.conv_id").eqNullSafe(F.col("d.conv_id"))).select("s.*", "repaired_sha256")
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    joined = ids.join(got, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    out = joined.select(F.col("id").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
    out = stored(out, "repaired")
    for path in paths:
        drop_path(spark, path)
    return out

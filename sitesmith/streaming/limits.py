"""Keyed limits and job state over event streams, each with a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

WINDOW_MS, MAX_IN_WINDOW, MAX_IN_SESSION = 60_000, 60, 200
JOB_ORDER = ["pending", "processing", "complete", "failed"]


def decide(times: list[int], kept: list[int], window_ms: int = WINDOW_MS, limit: int = MAX_IN_WINDOW) -> tuple[list[bool], list[int], list[int], list[int]]:
    """Sliding-window log over sorted times (ms): allowed, remaining, reset times, and the log after.

    Entries of window_ms ago or before are dropped; a request is refused when `limit` remain, and
    then not recorded. Reset is when the oldest entry leaves.
    """
    ok, left, reset, log = [], [], [], list(kept)
    for t in times:
        log = [x for x in log if x > t - window_ms]
        good = len(log) < limit
        if good:
            log.append(t)
        ok.append(good)
        left.append(limit - len(log))
        reset.append((log[0] if log else t) + window_ms)
    return ok, left, reset, log


def count_up(times: list[int], kept: list[int], limit: int, idle_ms: int | None) -> tuple[list[int], list[bool], list[int]]:
    """Counts over sorted times, whether each is within the limit, and [count, last time] after.

    A key that was idle for idle_ms starts anew, but for one that has used up its limit, which stays refused.
    """
    n, last = kept or (0, 0)
    counts, ok = [], []
    for t in times:
        if idle_ms is not None and n < limit and t - last >= idle_ms:
            n = 0
        n, last = n + 1, t
        counts.append(n)
        ok.append(n <= limit)
    return counts, ok, [n, last]


OUT = "key string, id long, ms long, allowed boolean, remaining int, reset_ms long"
SESSION_OUT = "key string, id long, ms long, count int, allowed boolean"


class Sliding:
    """The sliding-window log as a step over a key's requests in order."""

    def __init__(self, window_ms: int, limit: int):
        self.window_ms, self.limit = window_ms, limit

    def __call__(self, times: list[int], held: list[int]) -> tuple[dict, list[int]]:
        ok, left, reset, log = decide(times, held, self.window_ms, self.limit)
        return {"allowed": np.array(ok, bool), "remaining": np.array(left, np.int32), "reset_ms": np.array(reset, np.int64)}, log

    def forget_at(self, held: list[int]) -> int | None:
        return held[-1] + self.window_ms if held else None


class Session:
    """The session counter as a step over a key's requests in order."""

    def __init__(self, limit: int, idle_ms: int | None):
        self.limit, self.idle_ms = limit, idle_ms

    def __call__(self, times: list[int], held: list[int]) -> tuple[dict, list[int]]:
        counts, ok, held = count_up(times, held, self.limit, self.idle_ms)
        return {"count": np.array(counts, np.int32), "allowed": np.array(ok, bool)}, held

    def forget_at(self, held: list[int]) -> int | None:
        return held[1] + self.idle_ms if held and self.idle_ms is not None and held[0] < self.limit else None


def requests_of(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string"), F.col("id").cast("long"), F.col("ms").cast("long")).where("key is not null and ms is not null")


def in_order(requests: DataFrame, step, ddl: str) -> DataFrame:
    """Batch form: rows sorted by key and time stream through each task; what a step holds is bounded, so a hot key needs no memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for f in frames:
            parts = []
            for k, g in f.groupby("key", sort=False):
                if k != key:
                    key, held = k, []
                cols, held = step(g["ms"].tolist(), held)
                parts.append(g.assign(**cols))
            if parts:
                yield pd.concat(parts)

    return requests_of(requests).repartition("key").sortWithinPartitions("key", "ms", "id").mapInPandas(run, ddl)


#: Groups into which keys are dealt: a group is the unit of state, so that calls to the state store go by groups and batches, not by keys.
GROUPS = 1024


def packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(rows: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(rows).read_pandas()


class InOrder(StatefulProcessor):
    """Streaming form: a key's requests wait in state until the watermark has passed them and are then decided in order of
    time and id, so that what is decided depends neither on the order of arrival nor on batches, and a replay gives the same rows.

    The state is that of a group of keys: the requests that wait, a piece a batch, and what the step holds of each key. A timer stands at the
    first waiting request or at the first time at which the step's state of a key without one may be forgotten: a key without requests leaves no state behind.
    """

    def __init__(self, step):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.held = handle.getValueState("held", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()  # 0 before there is one
        came = [f for f in (f.loc[f["ms"] > now, ["key", "ms", "id"]] for f in rows) if len(f)]
        if came:
            self.waiting.appendList([(packed(f),) for f in came])
            self.handle.registerTimer(min(int(f["ms"].min()) for f in came))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        pieces = [unpacked(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        waiting = pd.concat(pieces, ignore_index=True) if pieces else pd.DataFrame({"key": pd.Series(dtype=object), "ms": np.empty(0, np.int64), "id": np.empty(0, np.int64)})
        held = {}
        if self.held.exists():
            f = unpacked(self.held.get()[0])
            held = {k: v.tolist() for k, v in zip(f["key"], f["held"])}
        due, waiting = waiting[waiting["ms"] <= now].sort_values(["key", "ms", "id"]), waiting[waiting["ms"] > now]
        if len(due):
            yield due[["key", "id", "ms"]].assign(**self.decided(due, held))
            if len(waiting):
                self.waiting.put([(packed(waiting),)])
            else:
                self.waiting.clear()
        busy, before = set(waiting["key"]), len(held)
        gone = {k: self.step.forget_at(v) for k, v in held.items() if k not in busy}
        held = {k: v for k, v in held.items() if v and (gone.get(k) is None or gone[k] > now)}
        if held and (len(due) or len(held) < before):
            self.held.update((packed(pd.DataFrame({"key": list(held), "held": list(held.values())})),))
        elif before and not held:
            self.held.clear()
        later = [t for k, t in gone.items() if t is not None and k in held]
        later += [int(waiting["ms"].min())] if len(waiting) else []
        if later:
            self.handle.registerTimer(int(min(later)))

    def decided(self, due: pd.DataFrame, held: dict[str, list[int]]) -> dict:
        """The step's columns for requests in order of key and time; what it holds of a key is replaced in held."""
        keys, times = due["key"].to_numpy(), due["ms"].tolist()
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist()
        cols = []
        for at, to in zip(starts, [*starts[1:], len(times)]):
            got, held[keys[at]] = self.step(times[at:to], held.get(keys[at], []))
            cols.append(got)
        return {c: np.concatenate([x[c] for x in cols]) for c in cols[0]}

    def close(self) -> None:
        pass


def stateful(requests: DataFrame, step, ddl: str, late: str, groups: int = GROUPS) -> DataFrame:
    """Requests that come later than `late` behind the newest are left out, as no decision waits for them; so are those of 1970's first moment and before."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = requests_of(requests).withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", late)
    return rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")).groupBy("group").transformWithStateInPandas(InOrder(step), ddl, "Append", "EventTime")


def sliding_limit(requests: DataFrame, window_ms: int = WINDOW_MS, limit: int = MAX_IN_WINDOW) -> DataFrame:
    """Batch form of the sliding-window log over (key, id, ms)."""
    return in_order(requests, Sliding(window_ms, limit), OUT)


def stream_sliding_limit(requests: DataFrame, window_ms: int = WINDOW_MS, limit: int = MAX_IN_WINDOW, late: str = "10 seconds") -> DataFrame:
    """Streaming form; a log is forgotten a window after the key's last request."""
    return stateful(requests, Sliding(window_ms, limit), OUT, late)


def session_limit(requests: DataFrame, limit: int = MAX_IN_SESSION, idle_ms: int | None = None) -> DataFrame:
    """Count per key, refusals included; allowed up to `limit`. Without idle_ms counts never end."""
    if idle_ms is not None:
        return in_order(requests, Session(limit, idle_ms), SESSION_OUT)
    n = F.row_number().over(Window.partitionBy("key").orderBy("ms", "id"))
    return requests.select("key", "id", "ms").withColumn("count", n).withColumn("allowed", F.col("count") <= limit)


def stream_session_limit(requests: DataFrame, limit: int = MAX_IN_SESSION, idle_ms: int = 86_400_000, late: str = "10 seconds") -> DataFrame:
    """Streaming form; a key that was idle for idle_ms is forgotten, but for one that has used up its limit."""
    return stateful(requests, Session(limit, idle_ms), SESSION_OUT, late)


def job_states(events: DataFrame) -> DataFrame:
    """Latest status per job: the furthest of pending, processing, complete, failed at its last time. Runs on streams in complete mode too."""
    rank = F.array_position(F.array(*[F.lit(s) for s in JOB_ORDER]), F.col("status"))
    last = F.max(F.struct("ms", rank.alias("rank"), "status"))
    return events.groupBy("job_id").agg(last.alias("v"), F.count("*").alias("events")).select("job_id", F.col("v.status").alias("status"), F.col("v.ms").alias("ms"), "events")


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Events by type and tumbling (or sliding) window of `ts`; with `late`, a watermark for streams."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))

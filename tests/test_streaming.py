"""Streams give the rows of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitesmith.streaming import limits, once


def requests(spark):
    rows = [("a", i, 1000 * i + 1) for i in range(8)] + [("b", 100 + i, 61_000 * i + 1) for i in range(4)]
    return spark.createDataFrame(rows, "key string, id long, ms long")


def run_stream(spark, build, tmp_path, name, before=None):
    """The requests in files by time, the last of which pushes the watermark past all others."""
    rows = requests(spark)
    path = str(tmp_path / "in")
    for low, high in ((0, 4000), (4000, 100_000), (100_000, 10**9)):
        rows.where((rows.ms >= low) & (rows.ms < high)).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("last", -1, 10**12)], rows.schema).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema("key string, id long, ms long").option("maxFilesPerTrigger", 1).parquet(path)
    stream = build(src)
    once.until_done(lambda: once.write_once(stream, str(tmp_path / f"out-{name}"), str(tmp_path / f"cp-{name}"), before=before))
    cols = [f"{c} {t}" for c, t in stream.dtypes]
    return sorted(tuple(r) for r in once.read_once(spark, str(tmp_path / f"out-{name}"), ", ".join(cols)).where("key <> 'last'").collect())


def stopper(at):
    stopped = []

    def before(batch):
        if batch == at and not stopped:
            stopped.append(batch)
            raise InterruptedError

    return before


def test_sliding_limit(spark, tmp_path):
    """Equal to the batch twin, though the stream is stopped before its ledger has a batch."""
    batch = sorted(map(tuple, limits.sliding_limit(requests(spark), 60_000, 5).collect()))
    assert [r[3] for r in batch if r[0] == "a"] == [True] * 5 + [False] * 3 and all(r[3] for r in batch if r[0] == "b")
    assert run_stream(spark, lambda s: limits.stream_sliding_limit(s, 60_000, 5), tmp_path, "sliding", stopper(2)) == batch


def test_late_rows_and_replays(spark, tmp_path):
    """Rows out of order within the delay are decided in order of time; one that comes after the watermark is left out."""
    path = str(tmp_path / "in")
    files = [[("a", 1, 5000), ("a", 2, 1000)], [("a", 3, 3000), ("a", 4, 30_000)], [("a", 6, 2000), ("a", 5, 28_000)], [("last", -1, 10**12)]]
    for f in files:
        spark.createDataFrame(f, "key string, id long, ms long").coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema("key string, id long, ms long").option("maxFilesPerTrigger", 1).parquet(path)
    s = limits.stream_sliding_limit(src, 10_000, 2, late="5 seconds")
    once.write_once(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = [tuple(r)[1:4] for r in once.read_once(spark, str(tmp_path / "out"), limits.OUT).where("key = 'a'").orderBy("ms").collect()]
    assert got == [(2, 1000, True), (3, 3000, True), (1, 5000, False), (5, 28_000, True), (4, 30_000, True)]


def test_refusals_are_not_recorded():
    ok, *_ = limits.decide([0, 1, 2, 60_000, 60_001], [], 60_000, 2)
    assert ok == [True, True, False, True, True]


def test_idle_sessions_start_anew_but_for_used_up_ones():
    assert limits.count_up([0, 10, 200, 201, 202, 900], [], 3, 100) == ([1, 2, 1, 2, 3, 4], [True] * 5 + [False], [4, 900])


def test_session_limit(spark, tmp_path):
    batch = sorted(map(tuple, limits.session_limit(requests(spark), 3, 50_000).collect()))
    assert [r[3] for r in batch if r[0] == "b"] == [1, 1, 1, 1]
    assert run_stream(spark, lambda s: limits.stream_session_limit(s, 3, 50_000), tmp_path, "session", stopper(1)) == batch


def test_a_batch_is_written_once(spark, tmp_path):
    """The ledger's batches are not run again; one that was written and not entered is written over."""
    path, runs = str(tmp_path / "in"), []
    for i in range(3):
        spark.createDataFrame([(i,)], "n long").coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema("n long").option("maxFilesPerTrigger", 1).parquet(path)

    def handle(df):
        runs.append(1)
        return df

    start = lambda: once.write_once(src, str(tmp_path / "out"), str(tmp_path / "cp"), handle, before=stop)
    stop = stopper(1)
    once.until_done(start)
    assert sorted(r["n"] for r in once.read_once(spark, str(tmp_path / "out"), "n long").collect()) == [0, 1, 2] and len(runs) == 4
    once.write_once(src, str(tmp_path / "out"), str(tmp_path / "another-checkpoint"), handle).awaitTermination()
    assert once.read_once(spark, str(tmp_path / "out"), "n long").count() == 3 and len(runs) == 4
    assert once.read_once(spark, str(tmp_path / "nothing"), "n long").count() == 0


def test_scan_to_quote(spark):
    """The whole way from files, held against what DuckDB's SQL of all its steps gave on these tables."""
    from conftest import SF

    from sitesmith.plans import streams

    want = {0: (5.4499, 66.0, 48.0, 240.0), 1: (3.8383, 46.0, 34.0, 220.0), 2: (5.6556, 68.0, 50.0, 243.0), 3: (6.1443, 74.0, 54.0, 250.0)}
    rows = [(s, t, 3 if t == "best" else 2, a, d) for s, (a, *by) in want.items() for t, d in zip(("good", "better", "best"), by)]
    assert sorted(map(tuple, streams.scan_to_quote(spark, SF).collect())) == sorted(rows)


def test_job_state_of_equal_times(spark):
    e = spark.createDataFrame([(1, "pending", 5), (1, "failed", 9), (1, "processing", 9)], "job_id int, status string, ms long")
    assert limits.job_states(e).select("status").first()[0] == "failed" and limits.windowed_counts(e.select(F.timestamp_millis("ms").alias("ts"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"))).count() == 1


def test_scans_of_many_files_are_whole(spark, tmp_path):
    """A scan's parts in several batches are processed together; a part that comes later takes the scan anew."""
    from sitesmith.sources import ply

    points = spark.range(40).select((F.col("id") % 2).cast("int").alias("scan_id"), (F.col("id") / 2).cast("long").alias("idx"), *[F.col("id").cast("double").alias(c) for c in "xyz"], *[F.lit(None).cast("int").alias(c) for c in "rgb"])
    folder, out, cp = (f"file://{tmp_path}/{n}" for n in ("up", "out", "cp"))
    count = lambda df: df.groupBy("scan_id").agg(F.count("*").alias("n"))
    start = lambda before: once.on_upload(spark, folder, out, cp, count, files=2, before=before)
    seen = lambda: sorted(map(tuple, once.read_uploads(spark, out, "scan_id string, n long").collect()))
    ply.write_scans(points, folder, vertices=4)
    stop = stopper(1)
    once.until_done(lambda: start(stop))
    assert seen() == [("0", 20), ("1", 20)]
    ply.write_scans(points.where("scan_id = 1").withColumn("idx", F.col("idx") + 20), folder, vertices=100)
    start(None).awaitTermination()
    assert seen() == [("0", 20), ("1", 40)]


class Held:
    """A list or value state and a handle in one, with its calls."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], set(), 0

    def getListState(self, name, schema):
        return self if name == "waiting" else Held()

    def getValueState(self, name, schema):
        self.value = Held()
        return self.value

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return self.rows[0] if self.single else list(self.rows)

    single = False

    def appendList(self, rows):
        self.calls, self.rows = self.calls + 1, self.rows + rows

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, rows

    def update(self, row):
        self.calls, self.rows, self.single = self.calls + 1, [row], True

    def clear(self):
        self.calls, self.rows = self.calls + 1, []

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_state_calls_do_not_grow_with_keys():
    """Keys of a group are decided each for itself in a fixed number of calls to the state store, and leave nothing behind when they are idle."""
    import pandas as pd

    for keys in (3, 3000):
        state = Held()
        p = limits.InOrder(limits.Session(2, 100))
        p.init(state)
        rows = pd.DataFrame([(f"k{i}", n, t) for i in range(keys) for n, t in enumerate((5, 9, 9 if i % 2 else 400))], columns=["key", "id", "ms"])
        list(p.handleInputRows((0,), iter([rows[::2], rows[1::2]]), Watermark(0)))
        first = pd.concat(p.handleExpiredTimer((0,), Watermark(10), None))
        assert len(first) == 3 * (keys // 2) + 2 * (keys - keys // 2) and first["allowed"].sum() == 2 * keys
        assert min(t for t in state.timers if t > 10) == 400
        last = pd.concat(p.handleExpiredTimer((0,), Watermark(1000), None))
        assert set(last["key"]) == {f"k{i}" for i in range(0, keys, 2)} and not last["allowed"].any()
        assert not state.rows and state.value.exists()  # those that used up their limit stay
        assert state.calls + state.value.calls < 15
    state = Held()
    p = limits.InOrder(limits.Sliding(100, 5))
    p.init(state)
    list(p.handleInputRows((0,), iter([rows[rows["ms"] < 10]]), Watermark(0)))
    list(p.handleExpiredTimer((0,), Watermark(10), None))
    assert state.value.exists() and max(state.timers) == 109
    list(p.handleExpiredTimer((0,), Watermark(200), None))
    assert not state.rows and not state.value.exists()

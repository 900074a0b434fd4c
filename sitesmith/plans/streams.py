"""Queries whose rows come through streams: tables dealt into files by arrival, streams stopped between batches and started again."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitesmith.operators import points, quote
from sitesmith.operators.graph import shared_path, shared_table
from sitesmith.plans import bind, scanning, storing
from sitesmith.sources import ply
from sitesmith.streaming import jobs, limits, once

Q, SQL = {}, {}

FILES = 3


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def arrived(rows: DataFrame, at: Column, last: DataFrame, tag: str) -> DataFrame:
    """A stream of rows in files by time of arrival, of which each batch takes one; `last` comes in a file of its own.

    Files are written one after the other, as a stream takes them by their age.
    """
    path = shared_path(rows.sparkSession, tag)
    rows = rows.withColumn("__at", at.cast("double"))
    cuts = [float("-inf"), *rows.approxQuantile("__at", [i / FILES for i in range(1, FILES)], 0.01), float("inf")]
    for low, high in zip(cuts, cuts[1:]):
        rows.where((F.col("__at") >= low) & (F.col("__at") < high)).drop("__at").coalesce(1).write.mode("append").parquet(path)
    last.coalesce(1).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(last.schema).option("maxFilesPerTrigger", 1).parquet(path)


@contextmanager
def few_states(spark: SparkSession):
    """As many state stores as cores, unless the session has fewer partitions already."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stopped_once(start: Callable[[Callable[[int], None]], object], at: int = 1) -> None:
    """Run a stream that is stopped after batch `at` is written and before the ledger has it, and starts again from its checkpoint."""
    stopped: list[int] = []

    def before(batch: int) -> None:
        if batch == at and not stopped:
            stopped.append(batch)
            raise InterruptedError("stopped between batches")

    once.until_done(lambda: start(before))


def through(stream: DataFrame, schema: str, tag: str) -> DataFrame:
    """A stream's rows, written once a batch, though it is stopped once."""
    spark = stream.sparkSession
    path, checkpoint = shared_path(spark, tag), shared_path(spark, f"{tag}-checkpoint")
    with few_states(spark):
        stopped_once(lambda before: once.write_once(stream, path, checkpoint, before=before))
    return once.read_once(spark, path, schema)


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests that arrive up to twenty minutes late, and one of a key of its own that comes after all others."""
    e = storing._events(spark, d).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), "ms")
    last = e.agg((F.max("ms") + 1_000_000_000).alias("ms")).select(F.lit("last").alias("key"), F.lit(-1).cast("long").alias("id"), F.coalesce("ms", F.lit(0)).cast("long").alias("ms"))
    return arrived(e, F.col("ms") + F.col("id") % 3 * 600_000, last, "requests")


@query(storing.SQL["ip_rate_limit"])
def rate_limit_stream(spark: SparkSession, d: str) -> DataFrame:
    """The sliding-window log over a stream of late requests in four batches: the rows of its batch twin."""
    s = limits.stream_sliding_limit(_requests(spark, d), storing.RATE_WINDOW, storing.RATE_MAX, late="1 hour")
    return through(s, limits.OUT, "rate-limit").where("key <> 'last'")


IDLE, SESSION = 43_200_000, 6


@query(f"""WITH RECURSIVE {storing._EV}, o AS (SELECT event_id, user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM ev),
r(user_id, n, event_id, ms, c) AS (SELECT user_id, n, event_id, ms, 1 FROM o WHERE n = 1
 UNION ALL SELECT o.user_id, o.n, o.event_id, o.ms, CASE WHEN r.c < {SESSION} AND o.ms - r.ms >= {IDLE} THEN 1 ELSE r.c + 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id::VARCHAR AS key, event_id AS id, ms, c::INT AS count, c <= {SESSION} AS allowed FROM r""")
def session_limit_stream(spark: SparkSession, d: str) -> DataFrame:
    """Session counters over a stream of late requests; a key idle for twelve hours is forgotten."""
    s = limits.stream_session_limit(_requests(spark, d), SESSION, IDLE, late="1 hour")
    return through(s, limits.SESSION_OUT, "session-limit").where("key <> 'last'")


@query(f"""WITH RECURSIVE {storing._EV}, o AS (SELECT event_id, user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM ev),
r(user_id, n, event_id, ms, c) AS (SELECT user_id, n, event_id, ms, 1 FROM o WHERE n = 1
 UNION ALL SELECT o.user_id, o.n, o.event_id, o.ms, CASE WHEN r.c < {SESSION} AND o.ms - r.ms >= {IDLE} THEN 1 ELSE r.c + 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id::VARCHAR AS key, event_id AS id, ms, c::INT AS count, c <= {SESSION} AS allowed FROM r""")
def session_limit_idle(spark: SparkSession, d: str) -> DataFrame:
    """The batch twin of session_limit_stream."""
    return limits.session_limit(storing._events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ms"), SESSION, IDLE)


_JOBS = """u AS (SELECT event_id AS job_id, ts AS created_at FROM events WHERE event_id % 2 = 0),
d AS (SELECT event_id AS job_id, ts + to_minutes(event_id % 50) AS completed_at, CASE WHEN event_id % 10 = 0 THEN 'failed' ELSE 'complete' END AS status, CASE WHEN event_id % 10 = 0 THEN 'parse' END AS error FROM events WHERE event_id % 2 = 0 AND event_id % 6 <> 0)"""
_OUTCOMES = f"""WITH {_JOBS} SELECT u.job_id, created_at, completed_at, coalesce(status, 'failed') AS status, CASE WHEN status IS NULL THEN 'timed out' ELSE error END AS error
FROM u LEFT JOIN d ON d.job_id = u.job_id AND completed_at BETWEEN created_at AND created_at + INTERVAL 30 MINUTE"""
JOB_OUT = "job_id long, created_at timestamp, completed_at timestamp, status string, error string"


def _jobs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Uploads, of which a third come twice, and completions up to 49 minutes later, of which a sixth never come and a quarter come twice."""
    k, at = F.col("event_id"), F.col("ts").cast("timestamp")
    e = bind.t(spark, d, "events").where(k % 2 == 0)
    up = e.select(k.alias("job_id"), at.alias("created_at"), F.explode(F.sequence(F.lit(0), F.when(k % 3 == 0, 1).otherwise(0))).alias("again"))
    done = e.where(k % 6 != 0).select(
        k.alias("job_id"), F.timestamp_micros(F.unix_micros(at) + k % 50 * 60_000_000).alias("completed_at"), F.when(k % 10 == 0, "failed").otherwise("complete").alias("status"),
        F.when(k % 10 == 0, "parse").alias("error"), F.explode(F.sequence(F.lit(0), F.when(k % 4 == 0, 1).otherwise(0))).alias("again"),
    )
    return up, done


def _shown(out: DataFrame) -> DataFrame:
    return out.select("job_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "completed_at")], "status", "error")


@query(_OUTCOMES)
def job_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Jobs with their completion or their timeout, from whole tables."""
    up, done = _jobs(spark, d)
    return _shown(jobs.job_outcomes(up, done))


@query(_OUTCOMES)
def job_outcomes_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from two streams, whose repeated events come ten minutes after the first."""
    up, done = _jobs(spark, d)
    end = up.agg(F.coalesce(F.max(F.unix_micros("created_at")), F.lit(0)).alias("t")).select(F.timestamp_micros(F.col("t") + 10**12).alias("t"))
    last_up = end.select(F.lit(-1).cast("long").alias("job_id"), F.col("t").alias("created_at"))
    last_done = end.select(F.lit(-2).cast("long").alias("job_id"), F.col("t").alias("completed_at"), F.lit("complete").alias("status"), F.lit(None).cast("string").alias("error"))
    seconds = lambda c: F.unix_micros(c) / 1e6 + F.col("again") * 600
    ups = arrived(up, seconds("created_at"), last_up.withColumn("again", F.lit(0)), "uploads")
    dones = arrived(done, seconds("completed_at"), last_done.withColumn("again", F.lit(0)), "completions")
    return _shown(through(jobs.job_outcomes(ups, dones), JOB_OUT, "job-outcomes").where("job_id >= 0"))


_READ = bind.CLOUD.replace("c AS (", "raw AS (", 1).replace("round(embedding[1]::DOUBLE, 6)", "round(embedding[1]::DOUBLE, 6)::FLOAT::DOUBLE").replace("round(embedding[2]::DOUBLE, 6)", "round(embedding[2]::DOUBLE, 6)::FLOAT::DOUBLE").replace("round(embedding[3]::DOUBLE, 6)", "round(embedding[3]::DOUBLE, 6)::FLOAT::DOUBLE")
_INV = f"(1.0::DOUBLE / {scanning.SMALL_VOX}::DOUBLE)"
#: The cloud after its voxel and outlier steps, with places counted anew.
_CLEAN = f"""{_READ}, vx AS (SELECT scan_id, min(idx) AS first, avg(x) AS x, avg(y) AS y, avg(z) AS z, floor(sum(r) / count(r))::INT AS r, floor(sum(g) / count(g))::INT AS g, floor(sum(b) / count(b))::INT AS b
 FROM raw GROUP BY scan_id, floor(x * {_INV}), floor(y * {_INV}), floor(z * {_INV})), c AS (SELECT scan_id, first AS idx, x, y, z, r, g, b FROM vx),
{scanning._KNN}, {scanning._MEAN}, {scanning._CUT}, cc AS (SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY idx) - 1 AS idx, x, y, z, r, g, b FROM c JOIN ok USING (scan_id, idx))"""
CONFIG = points.ScanConfig(scanning.SMALL_VOX, scanning.K, scanning.SIGMA, scanning.ITER, scanning.THR)
SCAN_OUT = "scan_id string, points long, ground long, obstacles long, inliers long, iteration int"


def processed(cloud: DataFrame) -> DataFrame:
    """A scan's points after cleaning, its ground and obstacles, and the plane that split them."""
    split, planes = points.process_scan(cloud, CONFIG)
    n = split.groupBy("scan_id").agg(F.count("*").alias("points"), F.count_if("is_ground").alias("ground"), F.count_if(~F.col("is_ground")).alias("obstacles"))
    return n.join(planes.select("scan_id", "inliers", "iteration"), "scan_id").select("scan_id", "points", "ground", "obstacles", F.col("inliers").cast("long").alias("inliers"), F.col("iteration").cast("int").alias("iteration"))


@query(f"""WITH {_CLEAN} SELECT * FROM (WITH c AS (SELECT * FROM cc), {scanning._PLANES}, {scanning._SPLIT}
SELECT scan_id, count(*) AS points, count(*) FILTER (WHERE is_ground) AS ground, count(*) FILTER (WHERE NOT is_ground) AS obstacles, any_value(inliers) AS inliers, any_value(iteration)::INT AS iteration FROM sp JOIN gp USING (scan_id) GROUP BY scan_id)""")
def upload_scans(spark: SparkSession, d: str) -> DataFrame:
    """Scans uploaded as PLY files, taken four at a time by a stream that is stopped between batches, each processed once."""
    folder, path, checkpoint = (shared_path(spark, t) for t in ("uploaded", "processed", "processed-checkpoint"))
    cloud = bind.cloud(spark, d)
    # a scan with uncoloured points is two files; uploads are whole files, so colours are left out
    ply.write_scans(cloud.withColumns({c: F.lit(None).cast("int") for c in "rgb"}), folder)
    stopped_once(lambda before: once.on_upload(spark, folder, path, checkpoint, processed, files=4, before=before))
    return once.read_uploads(spark, path, SCAN_OUT).withColumn("scan_id", F.col("scan_id").cast("int"))


def scene(spark: SparkSession, d: str) -> DataFrame:
    """Scans of a paved site: half the line items are ground, the others stand on seven heaps four metres apart."""
    k, p, cents = F.col("l_orderkey"), F.col("l_partkey"), F.round(F.col("l_extendedprice") * 100).cast("long")
    ground = k % 2 == 0
    x = F.when(ground, k * 7 % 301 / 10.0).otherwise(F.col("l_linenumber") * 4 + cents % 50 / 100.0)
    y = F.when(ground, p % 101 / 10.0).otherwise(5 + p % 50 / 100.0)
    z = F.when(ground, F.col("l_suppkey") % 3 / 1000.0).otherwise(0.3 + cents % 101 / 100.0)
    li = bind.t(spark, d, "lineitem").select((F.col("l_suppkey") % 4).cast("int").alias("scan_id"), *[c.cast("float").cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))], k.alias("k"), "l_linenumber", p.alias("p"), cents.alias("c"))
    idx = F.row_number().over(Window.partitionBy("scan_id").orderBy("k", "l_linenumber", "p", "c")) - 1
    return li.select("scan_id", idx.cast("long").alias("idx"), "x", "y", "z", *[F.lit(None).cast("int").alias(c) for c in "rgb"])


SCENE = points.ScanConfig(0.5, scanning.K, 3.0, scanning.ITER, scanning.THR)
EPS, MIN, FAR = 0.83, 2, 30.0


@query()
def scan_to_quote(spark: SparkSession, d: str) -> DataFrame:
    """From PLY files to quotes: read, cleaned, ground split off, obstacles clustered, the largest gap found and planted in three tiers.

    The SQL of all steps in one takes minutes on the smallest tables; the test holds what it gave there.
    """
    folder = shared_path(spark, "site-scans")
    ply.write_scans(scene(spark, d), folder)
    cloud = shared_table(ply.read_scans(spark, folder).withColumn("scan_id", F.col("scan_id").cast("int")), "site-cloud")
    split, planes = points.process_scan(cloud, SCENE)
    obstacles = shared_table(split.where("not is_ground"), "obstacles")
    clusters = points.dbscan(obstacles, EPS, MIN).drop("is_core")
    cands = shared_table(points.candidates(obstacles.join(clusters, ["scan_id", "idx"]), planes), "candidates")
    best = shared_table(points.best_gap(points.gaps(cands, planes, FAR)), "best-gaps")
    items = quote.gap_quotes(best, cands)
    total = items.groupBy("project_id", "tier").agg(F.count("*").alias("items"), F.sum("line_total").alias("total"))
    j = total.join(best.select(F.col("scan_id").alias("project_id"), "area_sqft"), "project_id")
    return j.select(F.col("project_id").alias("scan_id"), "tier", "items", F.round("area_sqft", 4).alias("area_sqft"), F.round(F.col("total").cast("double"), 0).alias("dollars"))

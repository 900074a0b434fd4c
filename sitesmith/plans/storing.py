"""Store, event and catalog queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesmith.functions import codes
from sitesmith.operators import store
from sitesmith.plans import bind
from sitesmith.streaming import limits

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _projects(spark, d):
    s = F.col("o_orderstatus")
    return bind.t(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("tenant_id"), F.when(s == "F", "complete").when(s == "O", "quoted").otherwise("draft").alias("status"), F.col("o_orderdate").alias("created_at"))


PROJ = "pr AS (SELECT o_orderkey AS project_id, o_custkey AS tenant_id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'quoted' ELSE 'draft' END AS status, o_orderdate AS created_at FROM orders)"


@query(f"WITH {PROJ} SELECT project_id, status, created_at, row_number() OVER (ORDER BY created_at DESC, project_id)::INT AS place FROM pr WHERE tenant_id = 7")
def tenant_projects(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    # a tenant's projects, listed in order
    p = store.of_tenant(_projects(spark, d), 7)
    return p.select("project_id", "status", "created_at", F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("created_at"), "project_id")).alias("place"))


@query(f"WITH {bind.materials_sql()} SELECT material_id, name, unit, price FROM m WHERE category = 'ECONOMY' AND contains(lower(name), 'ring')")
def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    return store.search(bind.materials(spark, d), "ECONOMY", "Ring").select("material_id", "name", "unit", "price")


@query(f"WITH {bind.materials_sql()}, k(category) AS (VALUES ('ECONOMY'), ('STANDARD'), ('PROMO'), ('LARGE'), ('NONE')) SELECT category, count(material_id) AS n FROM k LEFT JOIN m USING (category) GROUP BY category")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.category_counts(bind.materials(spark, d), ["ECONOMY", "STANDARD", "PROMO", "LARGE", "NONE"])


@query(f"WITH {PROJ} SELECT project_id, CASE WHEN tenant_id = 7 AND project_id % 2 = 0 THEN 'approved' ELSE status END AS status FROM pr")
def tenant_update(spark: SparkSession, d: str) -> DataFrame:
    """Changes to every other project; only those of tenant 7 take effect."""
    p = _projects(spark, d)
    changes = p.where("project_id % 2 = 0").withColumn("status", F.lit("approved"))
    mine = store.owned(changes, p, 7, "project_id")
    return store.updated(p, mine.select(*p.columns), "project_id").select("project_id", "status")


@query(f"WITH {bind.ZONES} SELECT 'zones' AS t, count(*) AS n, sum(project_id)::BIGINT AS s FROM z WHERE project_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderstatus <> 'F'")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    p = _projects(spark, d)
    left = store.cascade_delete(p.where("status = 'complete'"), "project_id", zones=bind.zones(spark, d), orders=p)
    one = lambda n: left[n].agg(F.lit(n).alias("t"), F.count("*").alias("n"), F.sum("project_id").alias("s"))
    return one("zones").unionByName(one("orders"))


@query(f"WITH {bind.ZONES} SELECT project_id, tier, zone_id, CASE WHEN project_id % 10 = 3 AND tier = 'good' THEN -1 ELSE material_id END AS material_id FROM z")
def tier_replace(spark: SparkSession, d: str) -> DataFrame:
    a = bind.zones(spark, d).select("project_id", "tier", "zone_id", "material_id")
    new = a.where("project_id % 10 = 3 and tier = 'good'").withColumn("material_id", F.lit(-1).cast("long"))
    return store.replaced(a, new, ["project_id", "tier"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return store.conflicts(bind.t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


_EV = "ev AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, (['draft', 'quoted', 'approved', 'complete'])[event_id % 4 + 1] AS status, (['pending', 'processing', 'complete', 'failed'])[event_id % 4 + 1] AS job FROM events)"


def _events(spark, d):
    at = lambda v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("event_id") % 4 + 1).cast("int"))
    return bind.t(spark, d, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), at(["draft", "quoted", "approved", "complete"]).alias("status"), at(["pending", "processing", "complete", "failed"]).alias("job"))


@query(f"""WITH {_EV}, l AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS before FROM ev)
SELECT event_id, status, before, before IS NULL OR status = 'draft' OR (before, status) IN (('draft', 'quoted'), ('quoted', 'approved'), ('approved', 'complete')) AS allowed FROM l""")
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    return store.status_moves(_events(spark, d), "user_id", "status", ["ms", "event_id"]).select("event_id", "status", "before", "allowed")


@query(f"""WITH {_EV} SELECT user_id AS job_id, max_by(job, (ms, list_position(['pending', 'processing', 'complete', 'failed'], job))) AS status, max(ms) AS ms, count(*) AS events FROM ev GROUP BY user_id""")
def job_latest(spark: SparkSession, d: str) -> DataFrame:
    return limits.job_states(_events(spark, d).select(F.col("user_id").alias("job_id"), F.col("job").alias("status"), "ms"))


@query(f"WITH {_EV}, n AS (SELECT event_id AS id, user_id AS key, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id)::INT AS count FROM ev) SELECT *, count <= 50 AS allowed FROM n")
def session_limit(spark: SparkSession, d: str) -> DataFrame:
    return limits.session_limit(_events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ms"), 50)


RATE_WINDOW, RATE_MAX = 21_600_000, 3


@query(f"""WITH RECURSIVE {_EV}, o AS (SELECT event_id, user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM ev),
r(user_id, n, event_id, ms, log, allowed) AS (SELECT user_id, n, event_id, ms, [ms], true FROM o WHERE n = 1
 UNION ALL SELECT o.user_id, o.n, o.event_id, o.ms, CASE WHEN len(list_filter(r.log, lambda x: x > o.ms - {RATE_WINDOW})) < {RATE_MAX} THEN list_append(list_filter(r.log, lambda x: x > o.ms - {RATE_WINDOW}), o.ms) ELSE list_filter(r.log, lambda x: x > o.ms - {RATE_WINDOW}) END,
  len(list_filter(r.log, lambda x: x > o.ms - {RATE_WINDOW})) < {RATE_MAX} FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id::VARCHAR AS key, event_id AS id, ms, allowed, ({RATE_MAX} - len(log))::INT AS remaining, log[1] + {RATE_WINDOW} AS reset_ms FROM r""")
def ip_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return limits.sliding_limit(_events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ms"), RATE_WINDOW, RATE_MAX)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    w = limits.windowed_counts(bind.t(spark, d, "events"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return limits.sessions(bind.t(spark, d, "events")).select("user_id", F.col("session_window.start").alias("start"), "n")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F', 'O') AND starts_with(o_orderpriority, '1')")
def request_filter(spark: SparkSession, d: str) -> DataFrame:
    r = bind.t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("origin"), F.col("o_orderstatus").alias("method"), F.col("o_orderpriority").alias("path"))
    return store.allowed_requests(r, ["1-URGENT", "2-HIGH"], ["F", "O"], "1").select("id")


# Shares of light, season length and climate zone in the planting score, and its classes.
FIT = {"light": 0.5, "season": 0.3, "zone": 0.2}
CLASSES = [(0.85, "excellent"), (0.65, "good"), (0.4, "marginal")]


@query("""WITH s AS (SELECT p_partkey AS plant_id, n_nationkey AS site_id, round(0.5::DOUBLE * (1 - least(abs(p_partkey % 9 - n_nationkey % 12), 6) / 6.0::DOUBLE)
 + 0.3::DOUBLE * least((150 + n_nationkey * 7) / (p_size * 7 + 30)::DOUBLE, 1) + 0.2::DOUBLE * greatest(1 - abs(p_partkey % 13 - n_nationkey % 13) / 4.0::DOUBLE, 0), 6) AS score FROM part JOIN nation ON p_partkey % 5 = n_regionkey)
SELECT *, CASE WHEN score >= 0.85 THEN 'excellent' WHEN score >= 0.65 THEN 'good' WHEN score >= 0.4 THEN 'marginal' ELSE 'not recommended' END AS class FROM s""")
def plant_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Plants at sites by the light they need, the days they take and their climate zone."""
    p, n = bind.t(spark, d, "part"), bind.t(spark, d, "nation")
    j = p.join(F.broadcast(n), p["p_partkey"] % 5 == n["n_regionkey"])  # nations are 25 fixed rows
    k, s = F.col("p_partkey"), F.col("n_nationkey")
    light = 1 - F.least(F.abs(k % 9 - s % 12), F.lit(6)) / 6.0
    season = F.least((150 + s * 7) / (F.col("p_size") * 7 + 30).cast("double"), F.lit(1.0))
    zone = F.greatest(1 - F.abs(k % 13 - s % 13) / 4.0, F.lit(0.0))
    score = F.round(FIT["light"] * light + FIT["season"] * season + FIT["zone"] * zone, 6)
    kind = F.lit("not recommended")
    for low, name in reversed(CLASSES):
        kind = F.when(F.col("score") >= low, name).otherwise(kind)
    return j.select(k.alias("plant_id"), s.alias("site_id"), score.alias("score")).withColumn("class", kind)


@query("""SELECT o_orderkey AS id, strftime(d, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(d, '%Y-%m-%d_%H-%M-%S') AS stamp, '1970-01-01'::DATE + (o_orderkey % 30000)::INT AS civil,
 (y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0 AS leap, list_position(['draft', 'quoted', 'approved', 'complete'], CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'quoted' ELSE 'draft' END) - 1 AS place
FROM (SELECT *, o_orderdate + to_seconds(o_orderkey % 86400) AS d, 1800 + o_orderkey % 700 AS y FROM orders)""")
def codes_and_stamps(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = F.col("o_orderstatus")
    iso = codes.iso8601(F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + k % 86400))
    status = codes.checked(F.when(s == "F", "complete").when(s == "O", "quoted").otherwise("draft"), "status")
    return bind.t(spark, d, "orders").select(k.alias("id"), iso.alias("iso"), codes.file_stamp(iso).alias("stamp"), codes.civil_date(k % 30000).alias("civil"), codes.is_leap(1800 + k % 700).alias("leap"), codes.ordinal(status, "status").alias("place"))


@query("""WITH h AS (SELECT p_partkey AS id, (p_partkey * 37 % 360 + 0.5::DOUBLE) / 360.0::DOUBLE AS h FROM part), c AS (SELECT id, h, floor(h * 6)::INT AS i, h * 6 - floor(h * 6) AS f, 0.95::DOUBLE AS v, 0.95::DOUBLE * (1 - 0.85::DOUBLE) AS p FROM h),
q AS (SELECT *, v * (1 - f * 0.85::DOUBLE) AS q, v * (1 - (1 - f) * 0.85::DOUBLE) AS t FROM c)
SELECT id, floor(255 * CASE i WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END)::INT AS r, floor(255 * CASE i WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q ELSE p END)::INT AS g,
 floor(255 * CASE i WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END)::INT AS b, floor(255 * h)::INT AS heat_red FROM q""")
def colour_maps(spark: SparkSession, d: str) -> DataFrame:
    h = (F.col("p_partkey") * 37 % 360 + 0.5) / 360.0
    rgb = codes.hsv_to_rgb(h, F.lit(0.85), F.lit(0.95))
    return bind.t(spark, d, "part").select(F.col("p_partkey").alias("id"), *[rgb[i].alias(c) for i, c in enumerate("rgb")], codes.heat(h)[0].alias("heat_red"))

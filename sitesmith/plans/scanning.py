"""Point cloud queries: downsampling, neighbours, ground, clusters, candidates, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitesmith.functions import geo
from sitesmith.operators import joins, points, tables
from sitesmith.operators.graph import shared_table
from sitesmith.plans import bind

Q, SQL = {}, {}
# means of six-digit coordinates can lie halfway between two results of rounding; 3e-10 moves them off on either engine
K, SIGMA, ITER, THR, EPS, MIN, VOX, FAR = 5, 1.0, 60, 0.03, 0.11, 4, 0.5, 6.0


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


INV = f"(1.0::DOUBLE / {VOX}::DOUBLE)"
_VOX = f"""v AS (SELECT scan_id, floor(x * {INV})::BIGINT AS ix, floor(y * {INV})::BIGINT AS iy, floor(z * {INV})::BIGINT AS iz, avg(x) AS x, avg(y) AS y, avg(z) AS z,
 floor(sum(r) / count(r))::INT AS r, floor(sum(g) / count(g))::INT AS g, floor(sum(b) / count(b))::INT AS b, count(*) AS n FROM c GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {bind.BIG_CLOUD}, {_VOX} SELECT scan_id, ix, iy, iz, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, r, g, b, n FROM v")
def voxel_downsample(spark: SparkSession, d: str) -> DataFrame:
    v = points.voxel_downsample(bind.big_cloud(spark, d), VOX)
    return v.select("scan_id", "ix", "iy", "iz", *[F.round(c, 6).alias(c) for c in "xyz"], "r", "g", "b", "n")


@query(f"WITH {bind.BIG_CLOUD} SELECT scan_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, count(*) AS n FROM c GROUP BY scan_id")
def cloud_bbox(spark: SparkSession, d: str) -> DataFrame:
    return points.bounding_box(bind.big_cloud(spark, d), ["scan_id"])


_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
_KNN = f"""nn AS (SELECT a.scan_id, a.idx, b.idx AS other, {_D2} AS d2, row_number() OVER (PARTITION BY a.scan_id, a.idx ORDER BY {_D2}, b.idx) AS rank FROM c a JOIN c b ON a.scan_id = b.scan_id)"""
_MEAN = f"md AS (SELECT scan_id, idx, sum(sqrt(d2)) / {K} AS mean_d FROM nn WHERE rank > 1 AND rank <= {K + 1} GROUP BY ALL)"
_CUT = f"cu AS (SELECT scan_id, avg(mean_d) + {SIGMA}::DOUBLE * stddev_pop(mean_d) AS cut, count(*) AS n FROM md GROUP BY scan_id), ok AS (SELECT md.scan_id, md.idx FROM md JOIN cu USING (scan_id) WHERE n <= {K} OR round(mean_d, 9) <= round(cut, 9))"


@query(f"WITH {bind.CLOUD}, {_KNN} SELECT scan_id, idx, other, rank::INT AS rank, round(d2, 9) AS d2 FROM nn WHERE rank <= {K}")
def knn(spark: SparkSession, d: str) -> DataFrame:
    n = joins.knn_join(bind.cloud(spark, d), K, points.XYZ, "idx", by=["scan_id"])
    return n.select("scan_id", F.col("key").alias("idx"), "other", "rank", F.round("d2", 9).alias("d2"))


@query(f"WITH {bind.CLOUD}, {_KNN}, {_MEAN}, {_CUT} SELECT scan_id, idx FROM ok")
def outlier_removal(spark: SparkSession, d: str) -> DataFrame:
    return points.remove_outliers(bind.cloud(spark, d), K, SIGMA).select("scan_id", "idx")


@query(f"WITH {bind.CLOUD} SELECT a.scan_id, a.idx, count(*) AS neighbours FROM c a JOIN c b ON a.scan_id = b.scan_id AND {_D2} <= {EPS}::DOUBLE * {EPS}::DOUBLE GROUP BY ALL")
def radius_neighbours(spark: SparkSession, d: str) -> DataFrame:
    c = bind.cloud(spark, d)
    return joins.radius_join(c, c, EPS, points.XYZ, by=["scan_id"]).groupBy(F.col("a.scan_id").alias("scan_id"), F.col("a.idx").alias("idx")).agg(F.count("*").alias("neighbours"))


_PLANES = f"""nc AS (SELECT scan_id, count(*)::BIGINT AS n FROM c GROUP BY scan_id HAVING count(*) >= 3),
t0 AS (SELECT scan_id, n, it, (it + 1000003) * 7919 % n AS i0, 1 + (it + 1000003) * 104729 % (n - 1) AS o1, 1 + (it + 1000003) * 15485863 % (n - 2) AS o2 FROM nc, (SELECT unnest(range({ITER})) AS it)),
t1 AS (SELECT scan_id, it, i0, (i0 + o1) % n AS i1, (i0 + o2 + CASE WHEN o2 >= o1 THEN 1 ELSE 0 END) % n AS i2 FROM t0),
pc AS (SELECT t1.scan_id, it, p.x AS px, p.y AS py, p.z AS pz, q.x - p.x AS ux, q.y - p.y AS uy, q.z - p.z AS uz, r.x - p.x AS vx, r.y - p.y AS vy, r.z - p.z AS vz
 FROM t1 JOIN c p ON p.scan_id = t1.scan_id AND p.idx = i0 JOIN c q ON q.scan_id = t1.scan_id AND q.idx = i1 JOIN c r ON r.scan_id = t1.scan_id AND r.idx = i2),
cr AS (SELECT *, uy * vz - uz * vy AS cx, uz * vx - ux * vz AS cy, ux * vy - uy * vx AS cz FROM pc),
cn AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS len, CASE WHEN cz < 0 THEN -1 ELSE 1 END AS sg FROM cr),
pl AS (SELECT scan_id, it, cx / len * sg AS nx, cy / len * sg AS ny, cz / len * sg AS nz, -(cx / len * sg * px + cy / len * sg * py + cz / len * sg * pz) AS dd FROM cn WHERE len >= 1e-10),
vt AS (SELECT pl.scan_id, it, nx, ny, nz, dd, count(*) FILTER (WHERE abs(round(nx * x + ny * y + nz * z + dd, 9)) <= {THR}) AS inliers FROM pl JOIN c USING (scan_id) GROUP BY ALL),
gp AS (SELECT scan_id, nx, ny, nz, dd AS d, inliers, it AS iteration FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY inliers DESC, it) AS rk FROM vt) WHERE rk = 1 AND inliers > 0)"""
_SPLIT = f"sp AS (SELECT c.*, nx * x + ny * y + nz * z + d AS height, abs(round(nx * x + ny * y + nz * z + d, 9)) <= {THR} AS is_ground FROM c JOIN gp USING (scan_id))"


def _planes(spark, d):
    c = bind.cloud(spark, d)
    return c, shared_table(points.ground_planes(c, ITER, THR), "planes")


@query(f"WITH {bind.CLOUD}, {_PLANES} SELECT scan_id, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz, round(d, 6) AS d, inliers, iteration::INT AS iteration FROM gp")
def ransac_plane(spark: SparkSession, d: str) -> DataFrame:
    _, p = _planes(spark, d)
    return p.select("scan_id", *[F.round(c, 6).alias(c) for c in ("nx", "ny", "nz", "d")], "inliers", "iteration")


@query(f"WITH {bind.CLOUD}, {_PLANES}, {_SPLIT} SELECT scan_id, idx, is_ground, round(height, 6) AS height FROM sp")
def ground_split(spark: SparkSession, d: str) -> DataFrame:
    c, p = _planes(spark, d)
    return points.split_ground(c, p, THR).select("scan_id", "idx", "is_ground", F.round("height", 6).alias("height"))


SMALL_VOX = 0.25
_RAW = bind.CLOUD.replace("c AS (", "raw AS (", 1)
# centres are rounded, so that both engines go on from the same cloud
_SMALL = f"""vx AS (SELECT scan_id, min(idx) AS first, round(avg(x) + 3e-10, 6) AS x, round(avg(y) + 3e-10, 6) AS y, round(avg(z) + 3e-10, 6) AS z FROM raw GROUP BY scan_id, floor(x * (1.0::DOUBLE / {SMALL_VOX}::DOUBLE)), floor(y * (1.0::DOUBLE / {SMALL_VOX}::DOUBLE)), floor(z * (1.0::DOUBLE / {SMALL_VOX}::DOUBLE))),
c AS (SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY first) - 1 AS idx, x, y, z FROM vx)"""


@query(f"""WITH {_RAW}, {_SMALL}, {_KNN}, {_MEAN}, {_CUT}, {_PLANES}, {_SPLIT},
s AS (SELECT scan_id, count(*) FILTER (WHERE is_ground) AS ground, count(*) FILTER (WHERE NOT is_ground) AS obstacles,
 coalesce((max(x) FILTER (WHERE is_ground) - min(x) FILTER (WHERE is_ground)) * (max(y) FILTER (WHERE is_ground) - min(y) FILTER (WHERE is_ground)), 0) AS area,
 min(height) FILTER (WHERE NOT is_ground) AS lo, max(height) FILTER (WHERE NOT is_ground) AS hi FROM sp GROUP BY scan_id),
n AS (SELECT scan_id, count(*) AS points FROM raw GROUP BY scan_id), v AS (SELECT scan_id, count(*) AS voxels FROM c GROUP BY scan_id), o AS (SELECT scan_id, count(*) AS clean FROM ok GROUP BY scan_id)
SELECT scan_id, points, voxels, clean, voxels - clean AS outliers, round(voxels / points::DOUBLE, 9) AS retained, ground, obstacles, round(area, 6) AS ground_area_m2, round(lo, 6) AS obstacle_low, round(hi, 6) AS obstacle_high
FROM n JOIN v USING (scan_id) JOIN o USING (scan_id) JOIN s USING (scan_id)""")
def scan_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts and measures of each step, from the cloud of voxel centres on."""
    raw = bind.cloud(spark, d)
    v = points.voxel_downsample(raw, SMALL_VOX).select("scan_id", "idx", *[F.round(F.col(c) + 3e-10, 6).alias(c) for c in points.XYZ], "r", "g", "b")
    c = shared_table(points.reindexed(v), "voxels")
    p = shared_table(points.ground_planes(c, ITER, THR), "planes")
    r = points.scan_report(raw, c, points.remove_outliers(c, K, SIGMA), points.split_ground(c, p, THR))
    return r.select("scan_id", "points", "voxels", "clean", "outliers", F.round("retained", 9).alias("retained"), "ground", "obstacles", *[F.round(x, 6).alias(x) for x in ("ground_area_m2", "obstacle_low", "obstacle_high")])


_DB = f"""ln AS (SELECT a.scan_id, a.idx AS a, b.idx AS b FROM c a JOIN c b ON a.scan_id = b.scan_id AND {_D2} <= {EPS}::DOUBLE * {EPS}::DOUBLE),
co AS (SELECT scan_id, a AS idx FROM ln GROUP BY ALL HAVING count(*) >= {MIN}),
cl AS (SELECT ln.* FROM ln JOIN co p ON p.scan_id = ln.scan_id AND p.idx = a JOIN co q ON q.scan_id = ln.scan_id AND q.idx = b),
re(scan_id, idx, root) AS (SELECT scan_id, idx, idx FROM co UNION SELECT re.scan_id, cl.b, re.root FROM re JOIN cl ON cl.scan_id = re.scan_id AND cl.a = re.idx),
rt AS (SELECT scan_id, idx, min(root) AS root FROM re GROUP BY ALL),
nb AS (SELECT scan_id, idx, dense_rank() OVER (PARTITION BY scan_id ORDER BY root) - 1 AS cluster_id FROM rt),
bo AS (SELECT ln.scan_id, ln.b AS idx, min(cluster_id) AS border FROM ln JOIN nb ON nb.scan_id = ln.scan_id AND nb.idx = ln.a GROUP BY ALL),
db AS (SELECT c.*, nb.cluster_id IS NOT NULL AS is_core, coalesce(nb.cluster_id, border)::INT AS cluster_id FROM c LEFT JOIN nb USING (scan_id, idx) LEFT JOIN bo USING (scan_id, idx))"""


@query(f"WITH RECURSIVE {bind.CLOUD}, {_DB} SELECT scan_id, idx, is_core, cluster_id FROM db")
def dbscan(spark: SparkSession, d: str) -> DataFrame:
    return points.dbscan(bind.cloud(spark, d), EPS, MIN)


@query(f"""WITH RECURSIVE {bind.CLOUD}, {_DB}, sd AS (SELECT scan_id, cluster_id, min(idx) AS seed FROM db WHERE is_core GROUP BY ALL),
fc AS (SELECT b.scan_id, b.idx, min(q.cluster_id) AS won FROM db b JOIN db q ON q.scan_id = b.scan_id AND q.is_core AND NOT b.is_core AND (q.x - b.x) * (q.x - b.x) + (q.y - b.y) * (q.y - b.y) + (q.z - b.z) * (q.z - b.z) <= {EPS}::DOUBLE * {EPS}::DOUBLE
 JOIN sd ON sd.scan_id = q.scan_id AND sd.cluster_id = q.cluster_id WHERE q.idx = seed OR b.idx > seed GROUP BY ALL)
SELECT scan_id, idx, is_core, CASE WHEN is_core THEN cluster_id ELSE won END AS cluster_id FROM db LEFT JOIN fc USING (scan_id, idx)""")
def dbscan_first_come(spark: SparkSession, d: str) -> DataFrame:
    """Clusters with the border rule of a scan in order."""
    c = bind.cloud(spark, d)
    return points.first_come(c, EPS, shared_table(points.dbscan(c, EPS, MIN), "clusters"))


@query(f"""WITH RECURSIVE {bind.CLOUD}, {_DB} SELECT scan_id, cluster_id, count(*) AS n, round(avg(x) + 3e-10, 6) AS cx, round(avg(y) + 3e-10, 6) AS cy, round(avg(z) + 3e-10, 6) AS cz, min(x) AS min_x, max(x) AS max_x FROM db WHERE cluster_id IS NOT NULL GROUP BY ALL""")
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    c = bind.cloud(spark, d)
    j = c.join(points.dbscan(c, EPS, MIN), ["scan_id", "idx"]).where("cluster_id is not null")
    return j.groupBy("scan_id", "cluster_id").agg(F.count("*").alias("n"), *[F.round(F.avg(x) + 3e-10, 6).alias("c" + x) for x in "xyz"], F.min("x").alias("min_x"), F.max("x").alias("max_x"))


_FT = "3.28084::DOUBLE"
_CAND = f"""one AS (SELECT db.scan_id, cluster_id, count(*) AS point_count, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1,
 max(abs(nx * x + ny * y + nz * z + d)) * {_FT} AS height_ft, floor(sum(r) / count(r)) AS r, floor(sum(g) / count(g)) AS g, floor(sum(b) / count(b)) AS b FROM db JOIN gp USING (scan_id) WHERE cluster_id IS NOT NULL GROUP BY ALL),
hv AS (SELECT db.scan_id, db.cluster_id, count(*) FILTER (WHERE z <= (z0 + z1) / 2) AS nl, count(*) FILTER (WHERE z > (z0 + z1) / 2) AS nu,
 greatest(max(x) FILTER (WHERE z <= (z0 + z1) / 2) - min(x) FILTER (WHERE z <= (z0 + z1) / 2), max(y) FILTER (WHERE z <= (z0 + z1) / 2) - min(y) FILTER (WHERE z <= (z0 + z1) / 2)) AS sl,
 greatest(max(x) FILTER (WHERE z > (z0 + z1) / 2) - min(x) FILTER (WHERE z > (z0 + z1) / 2), max(y) FILTER (WHERE z > (z0 + z1) / 2) - min(y) FILTER (WHERE z > (z0 + z1) / 2)) AS su
 FROM db JOIN one ON one.scan_id = db.scan_id AND one.cluster_id = db.cluster_id GROUP BY ALL),
cd AS (SELECT one.*, greatest(x1 - x0, y1 - y0) * {_FT} AS spread_ft, point_count / (greatest(x1 - x0, 0.01) * greatest(y1 - y0, 0.01) * greatest(z1 - z0, 0.01)) AS density,
 CASE WHEN nl >= 2 AND nu >= 2 AND sl >= 0.01 THEN round(su / sl, 9) < 0.7 ELSE false END AS conical FROM one JOIN hv USING (scan_id, cluster_id)),
ca AS (SELECT *, CASE WHEN r IS NULL THEN 'unknown' WHEN r > 200 AND g > 200 AND b > 200 THEN 'white' WHEN greatest(r, g, b) - least(r, g, b) < 30 AND greatest(r, g, b) > 50 THEN 'gray'
 WHEN g > 80 AND g > r * 1.2::DOUBLE AND g > b * 1.2::DOUBLE THEN 'green' WHEN r > 80 AND r > g AND g > 40 AND b < g THEN 'brown' ELSE 'mixed' END AS dominant_color,
 CASE WHEN round(height_ft, 9) < 0.1 OR round(spread_ft, 9) < 0.1 THEN 'irregular' WHEN round(height_ft, 9) / round(spread_ft, 9) > 3 THEN 'columnar' WHEN round(height_ft, 9) / round(spread_ft, 9) < 0.5 THEN 'flat' WHEN conical THEN 'conical' ELSE 'spreading' END AS vertical_profile FROM cd)"""


def _cands(spark, d):
    c, p = _planes(spark, d)
    j = c.join(points.dbscan(c, EPS, MIN).drop("is_core"), ["scan_id", "idx"])
    return points.candidates(j, p), p


@query(f"""WITH RECURSIVE {bind.CLOUD}, {_PLANES}, {_DB}, {_CAND} SELECT scan_id, cluster_id, round(cx + 3e-10, 6) AS cx, round(cy + 3e-10, 6) AS cy, round(height_ft, 6) AS height_ft, round(spread_ft, 6) AS spread_ft, point_count, dominant_color, vertical_profile, round(density, 4) AS density FROM ca""")
def feature_candidates(spark: SparkSession, d: str) -> DataFrame:
    c, _ = _cands(spark, d)
    return c.select("scan_id", "cluster_id", *[F.round(F.col(x) + 3e-10, 6).alias(x) for x in ("cx", "cy")], *[F.round(x, 6).alias(x) for x in ("height_ft", "spread_ft")], "point_count", "dominant_color", "vertical_profile", F.round("density", 4).alias("density"))


_SCALED = "sc AS (SELECT scan_id, cluster_id, height_ft * 8 AS h, spread_ft * 3 AS s, dominant_color AS colour, vertical_profile AS prof FROM ca)"


@query(f"""WITH RECURSIVE {bind.CLOUD}, {_PLANES}, {_DB}, {_CAND}, {_SCALED}, f AS (SELECT *, round(h, 9) > 8 AND prof = 'columnar' AND round(s, 9) < 2 AND colour = 'gray' AS pole,
 round(h, 9) > 8 AND prof IN ('columnar', 'spreading') AND colour IN ('brown', 'green') AS tree, round(h, 9) < 3 AND prof = 'flat' AS hard, round(h, 9) > 15 AS vt, round(s, 9) > 5 AS wide FROM sc)
SELECT scan_id, cluster_id, CASE WHEN pole THEN 'Utility Pole' WHEN tree AND vt AND wide THEN 'London Plane Tree' WHEN tree AND vt THEN 'Street Tree Trunk' WHEN tree THEN 'Young Street Tree'
 WHEN hard AND colour = 'gray' THEN 'Concrete Curb' WHEN hard AND colour = 'brown' THEN 'Brick Pathway' WHEN hard THEN 'Hardscape Element' ELSE 'Urban Structure' END AS label,
 CASE WHEN pole THEN 'utility' WHEN tree THEN 'tree' WHEN hard THEN 'hardscape' ELSE 'structure' END AS category,
 CASE WHEN pole THEN NULL WHEN tree AND vt AND wide THEN 'Platanus × acerifolia' WHEN tree AND vt THEN 'Lophostemon confertus' END AS species,
 CASE WHEN pole THEN 0.75 WHEN tree AND vt AND wide THEN 0.85 WHEN tree AND vt THEN 0.72 WHEN tree THEN 0.60 WHEN hard THEN 0.65 ELSE 0.45 END::DOUBLE AS confidence FROM f""")
def classify_features(spark: SparkSession, d: str) -> DataFrame:
    c, _ = _cands(spark, d)
    c = c.withColumn("height_ft", F.col("height_ft") * 8).withColumn("spread_ft", F.col("spread_ft") * 3)
    return points.classify(c).select("scan_id", "cluster_id", "label", "category", "species", "confidence")


_GAPS = f"""g0 AS (SELECT a.scan_id, a.cluster_id AS feature_a, b.cluster_id AS feature_b, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) * {_FT} AS distance_ft,
 a.spread_ft / 4 AS sa, b.spread_ft / 4 AS sb, (a.cx + b.cx) / 2 AS mx, (a.cy + b.cy) / 2 AS my FROM ca a JOIN ca b ON a.scan_id = b.scan_id AND a.cluster_id < b.cluster_id),
ga AS (SELECT g0.*, distance_ft - (sa / 2 + sb / 2) AS w, least(sa, sb) AS l, (distance_ft - (sa / 2 + sb / 2)) * least(sa, sb) AS area, CASE WHEN abs(nz) < 1e-6 THEN 0 ELSE -((nx * mx + ny * my + d) / nz) * {_FT} END AS ground
 FROM g0 JOIN gp USING (scan_id) WHERE round(distance_ft, 9) <= {FAR} AND round(distance_ft - (sa / 2 + sb / 2), 9) > 0)"""


def _gaps(spark, d):
    c, p = _cands(spark, d)
    return points.gaps(c.withColumn("spread_ft", F.col("spread_ft") / 4), p, FAR)


@query(f"""WITH RECURSIVE {bind.CLOUD}, {_PLANES}, {_DB}, {_CAND}, {_GAPS} SELECT scan_id, feature_a, feature_b, round(distance_ft, 6) AS distance_ft, round(w, 6) AS clear_width_ft, round(l, 6) AS clear_length_ft, round(area, 6) AS area_sqft, round(ground, 5) AS ground_ft,
 row_number() OVER (PARTITION BY scan_id ORDER BY distance_ft, feature_a, feature_b)::INT AS rank FROM ga""")
def gaps(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy("distance_ft", "feature_a", "feature_b"))
    return _gaps(spark, d).withColumn("rank", rank).select("scan_id", "feature_a", "feature_b", *[F.round(x, 6).alias(x) for x in ("distance_ft", "clear_width_ft", "clear_length_ft", "area_sqft")], F.round("ground_ft", 5).alias("ground_ft"), "rank")


@query(f"""WITH RECURSIVE {bind.CLOUD}, {_PLANES}, {_DB}, {_CAND}, {_GAPS} SELECT scan_id, feature_a, feature_b, round(distance_ft, 6) AS distance_ft, round(w, 6) AS clear_width_ft, round(l, 6) AS clear_length_ft, round(area, 6) AS area_sqft, round(ground, 5) AS ground_ft FROM ga""")
def gaps_sql(spark: SparkSession, d: str) -> DataFrame:
    """The gaps of `gaps` by the table function, which sweeps each scan's features in order of cx."""
    tables.register(spark)
    c, p = _cands(spark, d)
    features = c.withColumn("spread_ft", F.col("spread_ft") / 4).select("scan_id", "cluster_id", "cx", "cy", "spread_ft").join(p.select("scan_id", "nx", "ny", "nz", "d"), "scan_id")
    return spark.sql(f"SELECT scan_id, feature_a, feature_b, round(distance_ft, 6) AS distance_ft, round(clear_width_ft, 6) AS clear_width_ft, round(clear_length_ft, 6) AS clear_length_ft, round(area_sqft, 6) AS area_sqft, round(ground_ft, 5) AS ground_ft FROM measure_gaps(TABLE({{features}}), {FAR})", features=features)


@query(f"""WITH RECURSIVE {bind.CLOUD}, {_PLANES}, {_DB}, {_CAND}, {_GAPS}, bg AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY round(area, 9) DESC, distance_ft DESC, feature_a DESC, feature_b DESC) AS rk FROM ga)
SELECT scan_id, feature_a, feature_b, round(area, 5) AS area_sqft, round(area, 5) AS rectangle_sqft FROM bg WHERE rk = 1""")
def best_gap(spark: SparkSession, d: str) -> DataFrame:
    """The largest gap of a scan, joined with its two candidates for the rectangle that fills it."""
    c, p = _cands(spark, d)
    c = shared_table(c.withColumn("spread_ft", F.col("spread_ft") / 4), "candidates")
    g = points.best_gap(points.gaps(c, p, FAR))
    at = lambda n: c.select("scan_id", F.col("cluster_id").alias(f"feature_{n}"), F.col("cx").alias(f"{n}x"), F.col("cy").alias(f"{n}y"))
    j = g.join(at("a"), ["scan_id", "feature_a"]).join(at("b"), ["scan_id", "feature_b"])
    ring = geo.gap_rectangle(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.col("clear_length_ft"), F.col("clear_width_ft"))
    return j.select("scan_id", "feature_a", "feature_b", F.round("area_sqft", 5).alias("area_sqft"), F.round(geo.ring_area(ring), 5).alias("rectangle_sqft"))


_EIGEN = f"""{_KNN}, cv AS (SELECT nn.scan_id, nn.idx, count(*) AS n, var_pop(c.x) AS xx, var_pop(c.y) AS yy, var_pop(c.z) AS zz, covar_pop(c.x, c.y) AS xy, covar_pop(c.x, c.z) AS xz, covar_pop(c.y, c.z) AS yz
 FROM nn JOIN c ON c.scan_id = nn.scan_id AND c.idx = other WHERE rank <= 8 GROUP BY ALL),
q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM cv), p AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q),
f AS (SELECT *, acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p)))) / 3 AS phi FROM p),
l AS (SELECT scan_id, idx, n, q + 2 * p * cos(phi) AS l1, greatest(q + 2 * p * cos(phi + 2.0943951023931953), 0) AS l3, 3 * q AS t FROM f), e AS (SELECT *, t - l1 - l3 AS l2 FROM l)"""


@query(f"""WITH {bind.CLOUD}, {_EIGEN} SELECT scan_id, idx, round((l2 - l3) / l1, 4) AS planarity, round((l1 - l2) / l1, 4) AS linearity, round(l3 / l1, 4) AS sphericity, round(l3 / (l1 + l2 + l3), 4) AS curvature FROM e WHERE n >= 3 AND l1 >= 1e-10""")
def eigen_features(spark: SparkSession, d: str) -> DataFrame:
    e = points.covariance_features(bind.cloud(spark, d), 8)
    return e.where("n >= 3 and l1 >= 1e-10").select("scan_id", "idx", *[F.round(c, 4).alias(c) for c in ("planarity", "linearity", "sphericity", "curvature")])

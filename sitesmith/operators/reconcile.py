"""Reconciliation of features seen by two sources, and the plug-in steps of a scan pipeline."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesmith.operators import hdbscan, points
from sitesmith.operators.joins import radius_join


def reconcile(scan: DataFrame, satellite: DataFrame, distance: float, height_ft: float) -> DataFrame:
    """(id, x, y, height_ft) of both -> scan_feature, satellite_feature, origin: both, scan or satellite.

    Two features are one if each is the other's nearest within the distance and height tolerance;
    of equally near ones the smaller id. A rule of our own where a language model was asked before.
    """
    p = radius_join(scan, satellite, distance, ["x", "y"]).where(F.abs(F.col("a.height_ft") - F.col("b.height_ft")) <= height_ft)
    p = p.select(F.col("a.id").alias("scan_feature"), F.col("b.id").alias("satellite_feature"), "d2")
    rank = lambda by, other: F.row_number().over(Window.partitionBy(by).orderBy("d2", other))
    p = p.withColumn("ra", rank("scan_feature", "satellite_feature")).withColumn("rb", rank("satellite_feature", "scan_feature")).where("ra = 1 and rb = 1")
    m = p.select("scan_feature", "satellite_feature")
    j = scan.select(F.col("id").alias("scan_feature")).join(m, "scan_feature", "left")
    only = satellite.select(F.col("id").alias("satellite_feature")).join(m, "satellite_feature", "left_anti").select(F.lit(None).cast("long").alias("scan_feature"), "satellite_feature")
    origin = F.when(F.col("scan_feature").isNull(), "satellite").when(F.col("satellite_feature").isNull(), "scan").otherwise("both")
    return j.unionByName(only).withColumn("origin", origin)


def reconcile_three(scan: DataFrame, satellite: DataFrame, plan: DataFrame, distance: float, height_ft: float) -> DataFrame:
    """Three sources -> scan_feature, satellite_feature, plan_feature, origin: the sources that saw it, joined by '+'.

    Scan and satellite meet first; the plan's features meet what came of that, at the scan's place where both have one.
    """
    two = reconcile(scan, satellite, distance, height_ft)
    at = lambda df, name: df.select(F.col("id").alias(name), F.struct("x", "y", "height_ft").alias(f"at_{name}"))
    merged = two.join(at(scan, "scan_feature"), "scan_feature", "left").join(at(satellite, "satellite_feature"), "satellite_feature", "left")
    merged = merged.withColumn("at", F.coalesce("at_scan_feature", "at_satellite_feature"))
    # an id that both sides of the first match can be told by: even for the scan's, odd for the satellite's own
    merged = merged.select("scan_feature", "satellite_feature", F.when(F.col("scan_feature").isNotNull(), F.col("scan_feature") * 2).otherwise(F.col("satellite_feature") * 2 + 1).alias("id"), "at.*")
    three = reconcile(merged.select("id", "x", "y", "height_ft"), plan, distance, height_ft).select(F.col("scan_feature").alias("id"), F.col("satellite_feature").alias("plan_feature"))
    out = three.join(merged.select("id", "scan_feature", "satellite_feature"), "id", "left")
    seen = F.concat_ws("+", *[F.when(F.col(f"{s}_feature").isNotNull(), F.lit(s)) for s in ("scan", "satellite", "plan")])
    return out.select("scan_feature", "satellite_feature", "plan_feature", seen.alias("origin"))


class Extractor(Protocol):
    def __call__(self, cloud: DataFrame) -> DataFrame: ...


class Clusterer(Protocol):
    def __call__(self, cloud: DataFrame, features: DataFrame) -> DataFrame: ...


class Classifier(Protocol):
    def __call__(self, candidates: DataFrame) -> DataFrame: ...


class EigenExtractor:
    """Shape features of each point's k nearest."""

    def __init__(self, k: int = 20):
        self.k = k

    def __call__(self, cloud: DataFrame) -> DataFrame:
        return points.covariance_features(cloud, self.k)


class DensityClusterer:
    def __init__(self, eps: float = 0.3, min_points: int = 50):
        self.eps, self.min_points = eps, min_points

    def __call__(self, cloud: DataFrame, features: DataFrame) -> DataFrame:
        return points.dbscan(cloud, self.eps, self.min_points).drop("is_core")


class HierarchyClusterer:
    def __init__(self, min_cluster_size: int = 200, min_samples: int = 10, weight: float = 1.0):
        self.sizes, self.weight = (min_cluster_size, min_samples), weight

    def __call__(self, cloud: DataFrame, features: DataFrame) -> DataFrame:
        return hdbscan.hdbscan(hdbscan.vectors(cloud, features, self.weight), *self.sizes)


class FailingClassifier:
    """Raises, to test what callers do then."""

    def __call__(self, candidates: DataFrame) -> DataFrame:
        raise RuntimeError("classification failed")


def run_pipeline(cloud: DataFrame, planes: DataFrame, extract: Extractor, cluster: Clusterer, classify: Classifier = points.classify) -> DataFrame:
    """Features, clusters, candidates, classes of a cloud."""
    clusters = cluster(cloud, extract(cloud))
    return classify(points.candidates(cloud.join(clusters, ["scan_id", "idx"]), planes))

"""Proposals as documents: the shuffles they take, and what a project row gives."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

import __spark_entry__ as E
from sitesmith.operators import quote

DIR = "/root/testdata/sf0.001"


def test_documents_meet_by_project_once(spark):
    """Where nothing is broadcast: both sides of three joins and the items by project are shuffled, no more."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = E.queries()["proposal_documents"](spark, DIR)._jdf.queryExecution().sparkPlan().toString()
        executed = E.queries()["proposal_documents"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert plan.count("lineitem.parquet") <= 2 and "rollup-" not in plan
    assert executed.count("Exchange hashpartitioning") <= 6


def test_a_document_for_each_row_of_a_project(spark):
    """Two rows of one project are two documents, each with its tiers and callouts once."""
    items = spark.createDataFrame(
        [(1, "good", "z1", "Bed", "m", "Fern", 2.0, 10.0), (1, "good", "z1", "Bed", "n", "Agave", 3.0, 10.0), (1, "best", "z2", "Path", "m", "Fern", 4.0, 20.0), (None, "good", "z3", "Bed", "m", "Fern", 1.0, 1.0)],
        "project_id long, tier string, zone_id string, label string, material_id string, material_name string, line_total double, area_sqft double",
    ).withColumn("line_total", F.col("line_total").cast("decimal(18,2)"))
    projects = spark.createDataFrame([(1, "Home", "1 Road", "Co"), (1, "House", "1 Road", "Co"), (2, "None", "2 Road", "Co")], "project_id long, name string, address string, company string")
    docs = [json.loads(r["document"]) for r in quote.proposal_documents(items, projects).orderBy("document").collect()]
    assert len(docs) == 2
    for doc, name in zip(docs, ("Home", "House")):
        assert [t["headline"] for t in doc["tier_narratives"]] == [f"Good Package for {name}", f"Best Package for {name}"]
        assert doc["tier_narratives"][0]["differentiators"][1] == "All-inclusive $5.00 pricing"
        assert [z["note"].split(" — ")[0] for z in doc["zone_callouts"]] == ["Bed zone (10.0 sq ft) featuring Agave, Fern"]

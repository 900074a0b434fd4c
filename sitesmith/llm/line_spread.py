"""Line dedup by distinct-site spread: HyperLogLog sketches per line, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesmith.llm.common import stored, table

#: Sites on which a line has to occur to be boilerplate.
SITES = 10
#: log2 of a sketch's registers; its standard error is 1.04 / sqrt(2 ** LG_K) at most.
LG_K = 11
#: Estimates within so many standard errors of the threshold are counted exactly.
ERRORS = 5


def line_key(line: Column) -> Column:
    """128 bits for a line without the white space around it; null for a blank one."""
    bare = F.trim(line)
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b")))


# explode_outer below: for a plain explode Spark adds a filter that makes the array a second time


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n", -1)


def spread_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(site, text, ...) -> keys (a, b) of lines that occur on at least `sites` sites, exactly.

    Each line's sites go into a HyperLogLog sketch where they are read and the sketches of a
    line merge by aggregation, so a line on every page is one row a task. Only lines with an
    estimate within ERRORS standard errors of the threshold have their distinct sites counted,
    from pairs dealt by line and site.
    """
    pairs = docs.select(F.coalesce(F.col("site"), F.lit("")).alias("site"), F.explode_outer(F.transform(lines_of("text"), line_key)).alias("k")).where("k is not null").select("k.a", "k.b", "site")
    known = pairs.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("est"))
    margin = ERRORS * 1.04 / (2 ** (LG_K / 2))
    known = stored(known.where(F.col("est") >= int(sites * (1 - margin))), "line-spread")
    sure = F.col("est") > int(sites * (1 + margin)) + 1
    near = known.where(~sure).select("a", "b")
    # counted by line and site first: no task holds all rows of a line
    near = pairs.join(near, ["a", "b"], "left_semi").distinct().groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= sites)
    return known.where(sure).select("a", "b").unionByName(near.select("a", "b"))


def without_spread_lines(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """(doc_id, text, site column) -> doc_id, n_lines, n_removed, text without lines that occur on at least `sites` sites.

    Lines end at \\n or \\r\\n and are compared without spaces around them; blank lines stay. The
    spread lines of each document are found by a join on the line, gathered per document, and
    taken out of its text; only documents that hold any are joined with their lists. A null
    site is a site of its own; a null text stays null, with one (blank) line. Equal doc_ids share the list, in
    which each is complete. Extra columns are ignored.
    """
    rows = docs.select("doc_id", F.col(site).cast("string").alias("site"), "text")
    spread = stored(spread_lines(rows, sites), "spread-lines")
    held = rows.select("doc_id", F.explode_outer(F.array_distinct(F.transform(lines_of("text"), line_key))).alias("k")).where("k is not null").select("doc_id", "k.a", "k.b")
    found = held.join(spread, ["a", "b"]).groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("gone")).withColumnRenamed("doc_id", "__id")
    lines = rows.select("doc_id", "text").join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", "text", "gone", lines_of("text").alias("lines"))
    kept = F.filter("lines", lambda x: ~F.coalesce(F.array_contains(F.col("gone"), line_key(x)), F.lit(False)))
    lines = lines.withColumn("kept", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept))
    return lines.select(
        "doc_id", F.size("lines").alias("n_lines"), (F.size("lines") - F.size("kept")).alias("n_removed"),
        F.when(F.size("lines") == F.size("kept"), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
    )


def op2_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_spread_lines(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH l AS (SELECT doc_id, source, text, unnest(regexp_split_to_array(text, '\\r?\\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1) AS n FROM documents),
s AS (SELECT trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT coalesce(source, '')) >= {SITES}),
m AS (SELECT l.*, s.line IS NOT NULL AS gone FROM l LEFT JOIN s ON trim(l.line, ' ') = s.line)
SELECT doc_id, count(*)::INT AS n_lines, count(*) FILTER (WHERE gone)::INT AS n_removed,
  CASE WHEN bool_or(gone) THEN coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') ELSE any_value(text) END AS text
FROM m GROUP BY doc_id
"""

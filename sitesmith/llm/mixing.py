"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitesmith.llm.common import WORD_RE, stored, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SEED = "mix-1"
#: Key ranges of a source whose sizes are summed before any prefix sum; no window holds more than one range of a source.
#: They are even steps of the mean of the key's distributions at the least and the greatest weight, so that whatever the
#: weights a range holds some few RANGES-ths of a source.
RANGES = 4096


def n_words(text: Column | str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def quality_weight(text: Column | str) -> Column:
    """Between 0.1 and 1: falls with the share of characters from #*$%&|<> in a text."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    odd = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.1), 1.0 - 10.0 * odd / F.greatest(F.length(text), F.lit(1)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source_key, source, source_size), a row a source -> with target.

    Weights repeat in order of the sources' code points, null last. With the sources in order of
    cap / weight, the first k stop at their caps, for the smallest k whose next source does not
    exceed its cap at the level that remains: (total - caps of the first k) / (weights of the
    others). That is where resharing the excess ends.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last(), "source_key")
    w = sizes.withColumn("rank", F.row_number().over(order) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size").cast("double") * repeats)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = (
        w.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - F.col("capped")) / F.col("weight_left"))
    )
    w = w.withColumn("final", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)["level"])
    return w.select("source_key", "source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, besides the columns named in keep.

    Each document draws the exponential key -ln(u) / w from a hash of its id and the seed, w
    its quality weight. A source is taken floor(target / size) times whole; then its documents
    in order of their keys, until the words taken are nearest to the target. Equal ids in a
    source are ordered by size. Prefix sums run over ranges of the key within a source (a
    partial sum per range first), so a source with a third of all rows is no one task's work.
    Reruns agree. Null text has size 0; a null source is a source of its own; documents of size
    0 take 0. Extra columns are ignored.
    """
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    rows = docs.select(
        "doc_id", n_words("text").alias("size"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("source_key"),
        (-F.log(u) / quality_weight("text")).alias("key"), *keep,
    ).withColumn("range", F.floor((1 - (F.exp(-F.col("key")) + F.exp(-0.1 * F.col("key"))) / 2) * RANGES).cast("int"))
    rows = stored(rows, "mix")
    ranges = rows.groupBy("source_key", "source", "range").agg(F.sum("size").alias("range_size"))
    goal = targets(ranges.groupBy("source_key", "source").agg(F.sum("range_size").alias("source_size")))
    ranges = ranges.withColumn(
        "before", F.coalesce(F.sum("range_size").over(Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    plan = ranges.drop("source").join(goal.drop("source"), "source_key").select("source_key", "range", "before", "source_size", "target")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    inside = Window.partitionBy("source_key", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("prior", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(plan, ["source_key", "range"])
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    more = (F.col("before") + F.col("prior") + F.col("size") / 2.0 <= rest).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + more)).alias("taken"), *keep)


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns kept; documents without words go."""
    names = docs.columns
    whole = docs.withColumn("__row", F.struct(*names))
    taken = mix(whole, seed, keep=("__row",))
    times = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0).cast("int")
    return taken.where("taken > 0").select("__row", F.explode(F.sequence(F.lit(1), times)).alias("__copy")).select("__row.*")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
      / greatest(0.1, 1.0 - 10.0 * ((length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::DOUBLE / greatest(length(coalesce(text, '')), 1))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM r),
c AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0::DOUBLE)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM c WHERE level * weight <= cap ORDER BY cap / weight, rank LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM f) * weight), cap) AS target FROM c),
p AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN prior + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""

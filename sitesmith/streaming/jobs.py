"""Scan jobs from two streams, uploads and completions, with late and repeated events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Rows without those that are delivered again; in a stream as far as the watermark's delay reaches."""
    if df.isStreaming:
        return df.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), at).alias("v")).select(*keys, "v.*")


def job_outcomes(uploads: DataFrame, completions: DataFrame, timeout: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(job_id, created_at) and (job_id, completed_at, status, error) -> a row a job: job_id, created_at, completed_at, status, error.

    A job whose completion does not come within the timeout is failed with the error `timed out`, in a stream as
    soon as the watermark has passed that time. Events may come twice and out of order, up to `late`
    behind the newest of their stream. Completions without an upload give no row.
    """
    up = first_of(uploads.select("job_id", "created_at"), ["job_id"], "created_at", late).alias("u")
    done = first_of(completions.select("job_id", "completed_at", "status", "error"), ["job_id"], "completed_at", late).alias("d")
    near = F.expr(f"u.job_id = d.job_id AND d.completed_at >= u.created_at AND d.completed_at <= u.created_at + INTERVAL {timeout}")
    failed = F.col("d.job_id").isNull()
    out = up.join(done, near, "left")
    return out.select("u.job_id", "u.created_at", "d.completed_at", F.when(failed, "failed").otherwise(F.col("d.status")).alias("status"), F.when(failed, "timed out").otherwise(F.col("d.error")).alias("error"))

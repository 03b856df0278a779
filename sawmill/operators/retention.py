"""Retention (#43–#48).

The reference deletes ``timestamp < cutoff`` in batches of the oldest
``batch_size`` rows until a short batch.  The batch operators are kept for
fidelity; the summary comes from one aggregate (``batches`` follows from the
count), and the physical delete on a partitioned table is a directory drop
plus one boundary-day rewrite (``LogStore.run_retention``).
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sawmill.functions.times import iso_text, minute_floor, to_utc_naive, ts_literal
from sawmill.schema import DEFAULT_RETENTION_BATCH, DEFAULT_RETENTION_DAYS

# A delete batch at most this many rows is broadcast to the anti join; a
# larger batch takes the shuffle join (AQE may still switch at run time).
BROADCAST_BATCH_ROWS = 1_000_000


def check_positive(name: str, value) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be an integer greater than or equal to 1")
    return value


def retention_cutoff(as_of, days: int = DEFAULT_RETENTION_DAYS) -> datetime:
    """``as_of − days × 24 h`` exactly, in UTC (#43)."""
    check_positive("days", days)
    return to_utc_naive(as_of) - timedelta(days=days)


def expired_logs(logs: DataFrame, cutoff) -> DataFrame:
    """``timestamp < cutoff`` (strict; a log exactly at the cutoff stays, #44)."""
    out = logs.where(F.col("timestamp") < ts_literal(cutoff))
    if "log_date" in logs.columns:
        out = out.where(F.col("log_date") <= F.to_date(ts_literal(cutoff)))
    return out


def retained_logs(logs: DataFrame, cutoff) -> DataFrame:
    """Complement of ``expired_logs`` (#44)."""
    out = logs.where(F.col("timestamp") >= ts_literal(cutoff))
    if "log_date" in logs.columns:
        out = out.where(F.col("log_date") >= F.to_date(ts_literal(cutoff)))
    return out


def oldest_expired(logs: DataFrame, cutoff, batch_size: int = DEFAULT_RETENTION_BATCH) -> DataFrame:
    """Next bounded delete batch: oldest first by (timestamp, id), ≤ batch_size rows (#45)."""
    check_positive("batch_size", batch_size)
    return expired_logs(logs, cutoff).orderBy("timestamp", "id").limit(batch_size)


def delete_batch(logs: DataFrame, batch: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Rows of ``logs`` not in ``batch`` — the ``ctid IN (…)`` semi join, negated (#46).

    ``batch_rows`` is the batch's proven row bound (its LIMIT); only then is
    the batch broadcast.
    """
    ids = batch.select("id")
    if batch_rows is not None and batch_rows <= BROADCAST_BATCH_ROWS:
        ids = F.broadcast(ids)
    return logs.join(ids, "id", "left_anti")


def retention_summary(logs: DataFrame, as_of, days: int = DEFAULT_RETENTION_DAYS,
                      batch_size: int = DEFAULT_RETENTION_BATCH) -> DataFrame:
    """One row ``(cutoff, deleted, batches)`` (#47) from one aggregate.

    The delete loop stops at the first short batch, so
    ``batches = floor(deleted / batch_size) + 1`` (at least 1).
    """
    check_positive("batch_size", batch_size)
    cutoff = retention_cutoff(as_of, days)
    deleted = F.count(F.lit(1))
    return expired_logs(logs, cutoff).agg(
        F.lit(iso_text(cutoff, millis=True)).alias("cutoff"),
        deleted.alias("deleted"),
        (F.floor(deleted / F.lit(batch_size)) + 1).cast("bigint").alias("batches"))


def retain_rollup(rollup: DataFrame, cutoff) -> DataFrame:
    """Opt-in rollup pruning (#48): keep minutes that may still hold live logs."""
    return rollup.where(F.col("bucket_start") >= minute_floor(ts_literal(cutoff)))

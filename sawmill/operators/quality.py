"""Consistency checks (#49, #50)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sawmill.operators.rollup import ROLLUP_KEY, minute_rollup


def rollup_mismatches(logs: DataFrame, rollup: DataFrame) -> DataFrame:
    """Keys whose stored count differs from a recount of the raw rows (#49).

    Both sides are aggregated on the key before the full outer join, so the
    join sees one row per key and side.  Empty when raw and rollup agree.
    """
    recount = minute_rollup(logs).withColumnRenamed("count", "recount")
    stored = rollup.groupBy(*ROLLUP_KEY).agg(F.sum("count").cast("bigint").alias("stored"))
    joined = recount.join(stored, list(ROLLUP_KEY), "full_outer")
    return joined.where(F.coalesce("recount", F.lit(0)) != F.coalesce("stored", F.lit(0))).select(
        *ROLLUP_KEY, F.coalesce("stored", F.lit(0)).cast("bigint").alias("stored"),
        F.coalesce("recount", F.lit(0)).cast("bigint").alias("recount"))


def visibility_report(commits: DataFrame, logs: DataFrame) -> DataFrame:
    """Accepted vs visible rows per committed batch (#50)."""
    visible = logs.groupBy("batch_id").agg(F.count(F.lit(1)).alias("visible"))
    return commits.select("batch_id", "accepted").join(visible, "batch_id", "left").select(
        "batch_id", "accepted", F.coalesce("visible", F.lit(0)).cast("bigint").alias("visible"))

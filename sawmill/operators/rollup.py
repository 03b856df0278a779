"""Minute rollup and its additive merge (#33, #34).

Both are hash aggregates with map-side partial aggregation: a hot service or
level only grows the partial counts of each task, never one reducer's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sawmill.functions.times import bucket_start

ROLLUP_KEY = ("bucket_start", "service", "level")


def minute_rollup(logs: DataFrame) -> DataFrame:
    """Count per (UTC minute, service, level) (#33)."""
    keyed = logs.select(bucket_start("timestamp", "1m").alias("bucket_start"), "service", "level")
    return keyed.groupBy(*ROLLUP_KEY).agg(F.count(F.lit(1)).alias("count"))


def merge_rollup(base: DataFrame, *deltas: DataFrame) -> DataFrame:
    """Additive upsert of delta counts into a base rollup on the 3-column key (#34)."""
    merged = base.select(*ROLLUP_KEY, "count")
    for delta in deltas:
        merged = merged.unionByName(delta.select(*ROLLUP_KEY, "count"))
    return merged.groupBy(*ROLLUP_KEY).agg(F.sum("count").cast("bigint").alias("count"))

"""Bucketed counts (#29–#32, #35–#37).

Raw counts are ``COUNT(*)`` per (bucket, group) after all filters; rollup counts
are ``SUM(count)`` of the minute rollup, whose time range is tested on
``bucket_start``.  Both are partial + final hash aggregates; only the small
aggregated result is range-sorted for output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.functions.times import bucket_start, iso_millis, minute_floor, resolve_bound, shift, ts_literal
from sawmill.operators.filters import filter_level, filter_service, filter_since, filter_until, search_logs
from sawmill.schema import BUCKET_WIDTHS, GROUP_BY_VALUES, MESSAGES


def _group(group_by: str | None) -> Column:
    if group_by is None:
        return F.lit(None).cast("string")
    if group_by not in GROUP_BY_VALUES:
        raise ValueError(MESSAGES["group_by"])
    return F.col(group_by).cast("string")


def _check_bucket(bucket: str) -> None:
    if bucket not in BUCKET_WIDTHS:
        raise ValueError(MESSAGES["bucket"])


def order_buckets(df: DataFrame) -> DataFrame:
    """``start ASC, group ASC NULLS FIRST`` (#35); only non-empty buckets."""
    return df.orderBy(F.asc("start"), F.asc_nulls_first("group"))


def aggregate_raw(logs: DataFrame, since, until, bucket: str, group_by: str | None = None,
                  service: str | None = None, level: str | None = None, q: str | None = None,
                  attributes: dict[str, str] | None = None) -> DataFrame:
    """COUNT(*) per (start, group) over raw rows after all filters (#30)."""
    _check_bucket(bucket)
    rows = search_logs(logs, service=service, level=level, since=since, until=until, q=q,
                       attributes=attributes)
    keyed = rows.select(bucket_start("timestamp", bucket).alias("start"), _group(group_by).alias("group"))
    return keyed.groupBy("start", "group").agg(F.count(F.lit(1)).alias("count"))


def _rollup_range(rollup: DataFrame, since, until) -> DataFrame:
    """Range on ``bucket_start`` (not on log time): the reference's rollup semantics."""
    return filter_until(filter_since(rollup, since, "bucket_start"), until, "bucket_start")


def aggregate_rollup(rollup: DataFrame, since, until, bucket: str, group_by: str | None = None,
                     service: str | None = None, level: str | None = None) -> DataFrame:
    """SUM(count) per (start, group) from the minute rollup (#31)."""
    _check_bucket(bucket)
    rows = _rollup_range(rollup, since, until)
    if service:
        rows = filter_service(rows, service)
    if level:
        rows = filter_level(rows, level)
    start = F.col("bucket_start") if bucket == "1m" else bucket_start("bucket_start", bucket)
    keyed = rows.select(start.alias("start"), _group(group_by).alias("group"), "count")
    return keyed.groupBy("start", "group").agg(F.sum("count").cast("bigint").alias("count"))


def aggregate_logs(logs: DataFrame, rollup: DataFrame, since, until, bucket: str,
                   group_by: str | None = None, service: str | None = None, level: str | None = None,
                   q: str | None = None, attributes: dict[str, str] | None = None) -> DataFrame:
    """The reference's router (#32): no q and no attribute filter → rollup, else raw."""
    if not q and not attributes:
        out = aggregate_rollup(rollup, since, until, bucket, group_by, service, level)
    else:
        out = aggregate_raw(logs, since, until, bucket, group_by, service, level, q, attributes)
    return order_buckets(out)


def aggregate_exact(logs: DataFrame, rollup: DataFrame, since, until, bucket: str,
                    group_by: str | None = None, service: str | None = None,
                    level: str | None = None) -> DataFrame:
    """Raw-exact counts at rollup cost (#37).

    Whole minutes inside [since, until) come from the rollup; the partial
    minutes at both edges from raw rows.  A range inside one minute is raw only
    (the inner range is then empty and the edge test covers everything).  Equal
    to ``aggregate_raw`` where the raw rows still exist.
    """
    _check_bucket(bucket)
    spark = logs.sparkSession
    lo, hi = ts_literal(resolve_bound(spark, since)), ts_literal(resolve_bound(spark, until))
    floor_lo = minute_floor(lo)
    inner_lo = F.when(floor_lo == lo, lo).otherwise(shift(floor_lo, minutes=1))
    inner_hi = minute_floor(hi)
    # raw edges [lo, b) and [c, hi); with no whole minute inside they meet at b == c
    b = F.least(inner_lo, hi)
    c = F.greatest(inner_hi, b)
    inner = _rollup_range(rollup, inner_lo, inner_hi)
    if service:
        inner = filter_service(inner, service)
    if level:
        inner = filter_level(inner, level)
    parts = inner.select(bucket_start("bucket_start", bucket).alias("start"),
                         _group(group_by).alias("group"), "count")
    for edge_lo, edge_hi in ((lo, b), (c, hi)):
        edge = search_logs(logs, service=service, level=level, since=edge_lo, until=edge_hi)
        parts = parts.unionByName(edge.select(
            bucket_start("timestamp", bucket).alias("start"), _group(group_by).alias("group"),
            F.lit(1).cast("bigint").alias("count")))
    return parts.groupBy("start", "group").agg(F.sum("count").cast("bigint").alias("count"))


def render_buckets(df: DataFrame) -> DataFrame:
    """Output projection (#36): start as ms ISO text, group text or NULL, count."""
    return df.select(iso_millis("start").alias("start"), F.col("group"), F.col("count"))

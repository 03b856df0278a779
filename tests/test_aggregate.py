from datetime import datetime

from pyspark.sql import functions as F

from sawmill.functions.times import bucket_start
from sawmill.operators.aggregate import (
    aggregate_exact, aggregate_logs, aggregate_raw, aggregate_rollup, render_buckets,
)
from sawmill.operators.quality import rollup_mismatches
from sawmill.operators.rollup import merge_rollup, minute_rollup


def _logs(spark, rows):
    df = spark.createDataFrame(rows, "id long, ts string, service string, level string")
    return df.select("id", F.col("ts").cast("timestamp_ntz").alias("timestamp"), "service", "level",
                     F.lit("m").alias("message"), F.lit("{}").alias("attributes"))


def test_minute_rollup_golden(spark):
    logs = _logs(spark, [(1, "2026-08-03 10:00:59", "checkout", "info"),
                         (2, "2026-08-03 10:01:01", "checkout", "info"),
                         (3, "2026-08-03 10:01:30", "checkout", "info"),
                         (4, "2026-08-03 10:01:45", "checkout", "error"),
                         (5, "2026-08-03 10:01:50", "billing", "info")])
    got = sorted((r["bucket_start"].minute, r["service"], r["level"], r["count"])
                 for r in minute_rollup(logs).collect())
    assert got == [(0, "checkout", "info", 1), (1, "billing", "info", 1),
                   (1, "checkout", "error", 1), (1, "checkout", "info", 2)]


def test_bucket_floor_before_1970(spark):
    df = spark.createDataFrame([("1969-12-31 23:59:30",)], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("t"))
    row = df.select(bucket_start("t", "1m").alias("m"), bucket_start("t", "1d").alias("d")).first()
    assert row["m"] == datetime(1969, 12, 31, 23, 59) and row["d"] == datetime(1969, 12, 31)


def test_raw_equals_rollup_on_aligned_range(small_logs):
    r = minute_rollup(small_logs)
    for bucket, group in (("5m", "service"), ("1h", "level"), ("1d", None)):
        raw = aggregate_raw(small_logs, "2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z", bucket, group)
        roll = aggregate_rollup(r, "2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z", bucket, group)
        assert sorted(raw.collect()) == sorted(roll.collect())


def test_unaligned_range_rollup_drops_first_minute_exact_does_not(small_logs):
    since = "2024-01-05T00:00:30Z"
    first = small_logs.where(F.col("timestamp") >= F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")) \
        .agg(F.min("timestamp")).scalar()
    r = minute_rollup(small_logs)
    raw = aggregate_raw(small_logs, first, "2024-01-08T00:00:00Z", "1d")
    roll = aggregate_rollup(r, first, "2024-01-08T00:00:00Z", "1d")
    exact = aggregate_exact(small_logs, r, first, "2024-01-08T00:00:00Z", "1d")
    total = lambda df: df.agg(F.sum("count")).first()[0]
    assert total(raw) - total(roll) >= 1
    assert sorted(exact.collect()) == sorted(raw.collect())
    # a range inside one minute is raw only
    inner = aggregate_exact(small_logs, r, since, "2024-01-05T00:00:50Z", "1m")
    assert sorted(inner.collect()) == sorted(
        aggregate_raw(small_logs, since, "2024-01-05T00:00:50Z", "1m").collect())


def test_router_and_rendering(small_logs):
    r = minute_rollup(small_logs)
    routed = aggregate_logs(small_logs, r, "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z", "1d", "level")
    rows = render_buckets(routed).collect()
    assert rows[0]["start"] == "2024-01-01T00:00:00.000Z"
    assert [(x["start"], x["group"]) for x in rows] == sorted((x["start"], x["group"]) for x in rows)
    assert sum(x["count"] for x in rows) == small_logs.count()
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert "message" not in plan  # rollup route never reads raw rows


def test_merge_rollup_replay_and_mismatches(small_logs):
    whole = minute_rollup(small_logs)
    a = minute_rollup(small_logs.where(F.col("id") % 3 == 0))
    b = minute_rollup(small_logs.where(F.col("id") % 3 != 0))
    merged = merge_rollup(a, b)
    assert rollup_mismatches(small_logs, merged).count() == 0
    replayed = merge_rollup(a, b, b)
    assert rollup_mismatches(small_logs, replayed).count() == b.count()
    assert sorted(merged.collect()) == sorted(whole.collect())


def test_exact_prunes_the_rollup_by_day(spark, small_logs, tmp_path):
    r = minute_rollup(small_logs).withColumn("bucket_date", F.to_date("bucket_start"))
    r.write.partitionBy("bucket_date").parquet(str(tmp_path / "rollup"))
    stored = spark.read.parquet(str(tmp_path / "rollup"))
    out = aggregate_exact(small_logs, stored, "2024-01-03T00:00:30Z", "2024-01-05T00:00:50Z", "1h")
    plan = out._jdf.queryExecution().executedPlan().toString()
    pruned = [x for x in plan.split("PartitionFilters: [")[1:] if x.split("]")[0].count("bucket_date") >= 2]
    assert pruned and "2024-01-03" in pruned[0].split("]")[0]
    want = aggregate_raw(small_logs, "2024-01-03T00:00:30Z", "2024-01-05T00:00:50Z", "1h")
    assert sorted(out.collect()) == sorted(want.collect())

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sawmill.operators.retention import (
    delete_batch, expired_logs, oldest_expired, retention_cutoff, retention_summary,
)
from sawmill.plans.args import ArgumentError, retention_settings
from sawmill.sources.fixtures import AS_OF


def test_cutoff_golden():
    assert retention_cutoff("2026-08-08T00:00:00Z", 30) == datetime(2026, 7, 9)
    assert retention_cutoff(AS_OF, 10) == datetime(2024, 1, 21)


def test_batches_formula(spark):
    df = spark.range(10074).select(F.col("id"), F.lit("2020-01-01").cast("timestamp_ntz").alias("timestamp"))
    (row,) = retention_summary(df, "2026-08-08T00:00:00Z", 30, 5000).collect()
    assert (row["deleted"], row["batches"]) == (10074, 3)
    (row,) = retention_summary(df.limit(0), "2026-08-08T00:00:00Z", 30, 5000).collect()
    assert (row["deleted"], row["batches"]) == (0, 1)
    (row,) = retention_summary(df.limit(5000), "2026-08-08T00:00:00Z", 30, 5000).collect()
    assert row["batches"] == 2


def test_expired_counts_and_batch_loop_agree(small_logs):
    cutoff = retention_cutoff(AS_OF, 10)
    assert expired_logs(small_logs, cutoff).count() == 698
    remaining, batches = small_logs, 0
    while True:
        batch = oldest_expired(remaining, cutoff, 500).cache()
        n = batch.count()
        remaining = delete_batch(remaining, batch, 500).cache()
        remaining.count()
        batches += 1
        if n < 500:
            break
    assert batches == 2 and expired_logs(remaining, cutoff).count() == 0
    assert remaining.count() == 1000 - 698


def test_log_exactly_at_cutoff_stays(spark):
    df = spark.createDataFrame([(1, "2024-01-21 00:00:00"), (2, "2024-01-20 23:59:59.999999")], "id long, t string") \
        .select("id", F.col("t").cast("timestamp_ntz").alias("timestamp"))
    assert [r["id"] for r in expired_logs(df, retention_cutoff(AS_OF, 10)).collect()] == [2]


def test_settings_contract():
    assert retention_settings({}) == (30, 5000)
    with pytest.raises(ArgumentError) as err:
        retention_settings({"LOG_RETENTION_DAYS": "0", "RETENTION_DELETE_BATCH_SIZE": "x"})
    assert len(err.value.errors) == 2

import pytest
from pyspark.sql import functions as F

from sawmill.functions.cursor import (
    decode_cursor, decode_cursor_value, encode_cursor, encode_cursor_value,
)
from sawmill.operators.paging import log_page, render_logs
from sawmill.sources.fixtures import logs_tied

from conftest import SF_SMALL


def test_page_golden(spark):
    rows = [(9, "2026-08-03 10:00:00", "info", "checkout", "created", "{}"),
            (8, "2026-08-03 09:59:00", "info", "checkout", "older", "{}")]
    df = spark.createDataFrame(rows, "id long, ts string, level string, service string, message string, attributes string") \
        .select("id", F.col("ts").cast("timestamp_ntz").alias("timestamp"), "level", "service", "message", "attributes")
    cursor = encode_cursor_value("2026-08-03T10:01:00.000Z", 10)
    (row,) = render_logs(log_page(df, 1, cursor)).collect()
    assert row["id"] == "9" and row["timestamp"] == "2026-08-03T10:00:00.000Z"
    assert row["next_cursor"] == encode_cursor_value("2026-08-03T10:00:00.000Z", 9)
    assert decode_cursor_value(row["next_cursor"]) == ("2026-08-03T10:00:00.000000Z", 9)


def test_cursor_round_trip_and_invalid(spark):
    token = encode_cursor_value("2026-08-03T10:00:00.000Z", 42)
    assert decode_cursor_value(token) == ("2026-08-03T10:00:00.000000Z", 42)
    for bad in ["not-a-cursor", token + "=", token + "==", "", token[:-1],
                encode_cursor_value("2026-08-03T10:00:00Z", 1).upper()]:
        assert decode_cursor_value(bad) is None
    df = spark.createDataFrame([(token,), ("not-a-cursor",), (token + "=",)], "t string")
    got = [tuple(r) for r in df.select(decode_cursor("t").alias("c")).select("c.*").collect()]
    assert got[0][1:] == (42, True) and got[1] == (None, None, False) and got[2] == (None, None, False)


def test_spark_and_python_tokens_agree(spark, small_logs):
    row = small_logs.select("timestamp", "id", encode_cursor("timestamp", "id").alias("t")).first()
    assert row["t"] == encode_cursor_value(row["timestamp"], row["id"])


def test_walking_pages_yields_every_row_once_in_order(spark):
    tied = logs_tied(spark, SF_SMALL)
    expected = [r["id"] for r in tied.orderBy(F.desc("timestamp"), F.desc("id")).select("id").collect()]
    seen, cursor = [], None
    for _ in range(20):
        page = log_page(tied, 97, cursor).collect()
        seen.extend(r["id"] for r in page)
        cursor = page[-1]["next_cursor"] if page else None
        if cursor is None:
            break
    assert seen == expected


def test_limit_is_checked_not_clamped(small_logs):
    for bad in (0, 1001, "5", True):
        with pytest.raises(ValueError):
            log_page(small_logs, bad)


def test_invalid_cursor_rejected_before_scan(small_logs):
    with pytest.raises(ValueError, match="cursor"):
        log_page(small_logs, 10, "not-a-cursor")

"""Test inputs derived from the driver's ``events`` table (FIXTURES.md §2, §3).

``logs``       — the ``logs`` table shape, one log per event.
``logs_tied``  — the same with timestamps floored to the hour (paging ties).
``ingest_bodies`` — one JSON ingest body per 50 events with the fault rules
                 of FIXTURES.md §3, as envelope records ``(body_id, value)``.

All of it is plain DataFrame work over the whole table.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.functions.times import bucket_start, iso_micros, iso_text, to_utc_naive
from sawmill.sources.tables import read_table

# Fixed parameters of the test scenario (FIXTURES.md §2).
AS_OF = "2024-01-31T00:00:00Z"
RETENTION_DAYS = 10
RETENTION_BATCH = 500
ALIGNED_SINCE = "2024-01-05T00:00:00Z"
ALIGNED_UNTIL = "2024-01-08T00:00:00Z"
BODY_SIZE = 50
ENVELOPES = ("array", "entries", "logs", "data", "items")
BLANK_MESSAGE = " \u00a0\t "


def level_of(event_type: Column) -> Column:
    return (F.when(event_type == "error", "error").when(event_type == "purchase", "warn")
            .when(event_type == "view", "debug").otherwise("info"))


def logs_from_events(events: DataFrame) -> DataFrame:
    """``events`` → ``logs(id, timestamp, level, service, message, attributes)``."""
    eid, uid = F.col("event_id"), F.col("user_id")
    message = F.concat(
        F.col("event_type"), F.lit(" by user "), uid.cast("string"), F.lit(" amount "),
        F.round(F.col("value") * 100).cast("bigint").cast("string"),
        F.when(eid % 10 == 0, F.lit(" 50%_OFF")).otherwise(F.lit("")))
    attributes = F.when(eid % 11 == 0, F.lit("{}")).otherwise(F.to_json(F.struct(
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        uid.alias("user"), F.col("event_type").alias("type"))))
    return events.select(
        eid.alias("id"),
        F.col("ts").alias("timestamp"),
        level_of(F.col("event_type")).alias("level"),
        F.concat(F.lit("svc-"), (uid % 8).cast("string")).alias("service"),
        message.alias("message"),
        attributes.alias("attributes"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_from_events(read_table(spark, sf_dir, "events"))


def logs_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``logs`` with hour-floored timestamps: many rows share one timestamp."""
    base = logs(spark, sf_dir)
    return base.withColumn("timestamp", bucket_start("timestamp", "1h"))


def _json_string(text: Column) -> Column:
    """JSON string literal of a text column (escaping done by ``to_json``)."""
    return F.regexp_extract(F.to_json(F.array(text)), r"^\[(.*)\]$", 1)


def entry_json(events: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """One ingest entry (JSON text) per event, faults per FIXTURES.md §3."""
    eid = F.col("event_id")
    log = logs_from_events(events).withColumnRenamed("id", "event_id")
    future = iso_text(to_utc_naive(as_of) + timedelta(minutes=10))
    ts_piece = (F.when(eid % 29 == 1, F.lit(None))
                .when(eid % 31 == 1, F.lit('"timestamp":"not-a-date"'))
                .when(eid % 37 == 1, F.lit(f'"timestamp":"{future}"'))
                .otherwise(F.concat(F.lit('"timestamp":"'), iso_micros("timestamp"), F.lit('"'))))
    level_piece = F.concat(F.lit('"level":'), _json_string(
        F.when(eid % 17 == 1, F.lit("verbose")).otherwise(F.col("level"))))
    service_piece = F.concat(F.lit('"service":'), F.when(
        eid % 23 == 1, F.regexp_extract(F.col("service"), r"(\d+)$", 1))
        .otherwise(_json_string(F.col("service"))))
    message_piece = F.concat(F.lit('"message":'), _json_string(
        F.when(eid % 19 == 1, F.lit(BLANK_MESSAGE)).otherwise(F.col("message"))))
    attr_piece = (F.when(eid % 13 == 1, F.lit('"attributes":{"n":{"x":1}}'))
                  .when(eid % 13 == 2, F.lit('"attributes":null'))
                  .when(eid % 13 == 3, F.lit(None))
                  .otherwise(F.concat(F.lit('"attributes":'), F.col("attributes"))))
    entry = F.concat(F.lit("{"), F.concat_ws(",", ts_piece, level_piece, service_piece,
                                              message_piece, attr_piece), F.lit("}"))
    return log.select("event_id", entry.alias("entry"))


def bodies_from_events(events: DataFrame, as_of: str = AS_OF, ranges: int | None = None) -> DataFrame:
    """Envelope records ``(body_id, value)``: one body per ``event_id div 50``.

    Each group holds at most 50 entries, so ``collect_list`` is bounded.  Events are dealt by body
    before their JSON is built: the grouping needs no second shuffle, and columns travel, not text.
    With ``ranges`` they are dealt into that many ranges of bodies, whose bounds come from a sample of the events.
    """
    body_id = F.floor(F.col("event_id") / BODY_SIZE)
    dealt = events.repartitionByRange(ranges, body_id) if ranges else events.repartition(body_id)
    entries = entry_json(dealt, as_of).withColumn("body_id", body_id)
    grouped = entries.groupBy("body_id").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "entry"))).alias("items"))
    listed = F.array_join(F.transform("items", lambda x: x["entry"]), ",")
    kind = F.col("body_id") % len(ENVELOPES)
    value = F.when(kind == 0, F.concat(F.lit("["), listed, F.lit("]")))
    for i, key in enumerate(ENVELOPES[1:], start=1):
        value = value.when(kind == i, F.concat(F.lit(f'{{"{key}":['), listed, F.lit("]}")))
    return grouped.select(F.col("body_id").cast("bigint").alias("body_id"), value.alias("value"))


def ingest_bodies(spark: SparkSession, sf_dir: str, as_of: str = AS_OF, ranges: int | None = None) -> DataFrame:
    return bodies_from_events(read_table(spark, sf_dir, "events"), as_of, ranges)


# Fixed edge-case bodies (FIXTURES.md §3), appended with negative body ids.
EXTRA_ENTRY = ('{"timestamp":"2024-01-15T12:00:00Z","level":"info","service":"svc-x",'
               '"message":"extra body"}')
EXTRA_BODIES = (
    (-1, "[]"),
    (-2, '{"entries":[]}'),
    (-3, '{"entries":5,"logs":[{}]}'),
    (-4, '{"entries":null,"logs":[' + EXTRA_ENTRY + "]}"),
    (-5, '{"x":1}'),
    (-6, '[5,null,"a"]'),
    (-7, '{"entries":[{"level":"info"'),
    (-8, '{"entries":[{"timestamp":"2024-01-15T12:00:00Z","level":"verbose","level":"info",'
         '"service":"svc-x","message":"duplicate keys, the last one wins"}]}'),
    (-9, '"just text"'),
    (-10, ""),
)


def ingest_bodies_with_extras(spark: SparkSession, sf_dir: str, as_of: str = AS_OF, ranges: int | None = None) -> DataFrame:
    """``ingest_bodies`` plus the fixed edge-case bodies, in a partition of their own."""
    from sawmill.schema import BODIES
    extras = spark.createDataFrame(list(EXTRA_BODIES), BODIES).coalesce(1)
    return ingest_bodies(spark, sf_dir, as_of, ranges).unionByName(extras)

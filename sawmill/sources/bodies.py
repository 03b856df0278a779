"""Envelope-record sources: one ingest body per record, ``(body_id, value)``.

``parquet`` / ``json`` files carry both columns, like a Kafka (key, value)
record.  ``text`` files carry one JSON body per line, ``wholetext`` files one
JSON body per file (line breaks inside it included); ``body_id`` is then the
position-derived ``monotonically_increasing_id`` — unique within one read (one
micro-batch), which together with the batch id identifies a body.  A stream of
text has no ``body_id`` column; ``LogStore.ingest_batch`` numbers each
micro-batch (Spark allows that id only on static frames).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.schema import BODIES
from sawmill.session import configure

FORMATS = ("parquet", "json", "text", "wholetext")
_TEXT = ("text", "wholetext")
_OFFSET_BITS = 40  # Kafka offsets below 2^40 per partition; partitions below 2^23


def from_kafka_records(records: DataFrame) -> DataFrame:
    """Kafka records (``partition``, ``offset``, binary ``value``) → ``(body_id, value)``.

    ``body_id`` is ``partition · 2^40 + offset``: unique per topic and stable
    when a micro-batch is replayed from the same offsets.
    """
    body_id = F.shiftleft(F.col("partition").cast("bigint"), _OFFSET_BITS) + F.col("offset")
    return records.select(body_id.alias("body_id"), F.col("value").cast("string").alias("value"))


def read_kafka_body_stream(spark: SparkSession, servers: str, topic: str, options: dict | None = None,
                           max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Streaming envelope records from a Kafka topic (needs the Spark Kafka connector)."""
    reader = (configure(spark).readStream.format("kafka")
              .option("kafka.bootstrap.servers", servers).option("subscribe", topic))
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    return from_kafka_records(reader.load())


def with_body_ids(df: DataFrame) -> DataFrame:
    """Adds position-derived ``body_id`` to a static frame of bodies without one."""
    if "body_id" in df.columns:
        return df
    return df.select(F.monotonically_increasing_id().alias("body_id"), F.col("value"))


def _shape(df: DataFrame, source_format: str) -> DataFrame:
    if source_format in _TEXT:
        return df.select("value") if df.isStreaming else with_body_ids(df)
    return df.select(F.col("body_id").cast("bigint"), F.col("value").cast("string"))


def _reader(reader, source_format: str):
    if source_format in _TEXT:
        return reader.format("text").option("wholetext", source_format == "wholetext")
    return reader.format(source_format).schema(BODIES)


def read_bodies(spark: SparkSession, path: str, source_format: str = "parquet") -> DataFrame:
    """Batch read of envelope records."""
    if source_format not in FORMATS:
        raise ValueError(f"source_format must be one of: {', '.join(FORMATS)}")
    return _shape(_reader(configure(spark).read, source_format).load(path), source_format)


def read_body_stream(spark: SparkSession, path: str, source_format: str = "parquet",
                     max_files_per_trigger: int | None = None, max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of envelope records from a folder of files; a limit on files goes before one on bytes."""
    if source_format not in FORMATS:
        raise ValueError(f"source_format must be one of: {', '.join(FORMATS)}")
    reader = _reader(configure(spark).readStream, source_format)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    elif max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    return _shape(reader.load(path), source_format)

"""Continuous ingest with Structured Streaming (#13).

Envelope records ``(body_id, value)`` arrive as files — Parquet (default), JSON
lines, text lines or whole text files — or from Kafka (``sources.bodies.read_kafka_body_stream``);
``ingest_stream`` takes any streaming frame of that shape.  Each micro-batch goes through
``LogStore.ingest_batch`` inside ``foreachBatch``: raw rows, rollup deltas,
rejected entries and body outcomes are written under the batch's own id and the commit row last,
so a batch becomes visible all at once and a replay after failure rewrites the
same directories.  No watermark: the reference accepts logs of any age and adds
them to their old minute, which a watermarked append aggregation would drop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sawmill.plans.store import LogStore
from sawmill.sources.bodies import read_body_stream

MAX_BYTES = 1 << 30  # of source files in a micro-batch


def ingest_stream(bodies: DataFrame, store_root: str, checkpoint: str, as_of=None,
                  available_now: bool = True, processing_time: str | None = None,
                  strict_storage: bool = False, store_class: type[LogStore] = LogStore) -> StreamingQuery:
    """Runs any streaming frame of envelope records ``(body_id, value)`` into a store of ``store_class``."""
    store = store_class(bodies.sparkSession, store_root)

    def process(batch: DataFrame, batch_id: int) -> None:
        store.ingest_batch(batch, batch_id, as_of, strict_storage, owner=checkpoint)

    writer = bodies.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def stream_ingest_logs(spark: SparkSession, source: str, store_root: str, checkpoint: str,
                       as_of=None, max_files_per_trigger: int | None = None,
                       available_now: bool = True, processing_time: str | None = None,
                       source_format: str = "parquet", strict_storage: bool = False,
                       store_class: type[LogStore] = LogStore, max_bytes_per_trigger: int = MAX_BYTES) -> StreamingQuery:
    """Start the ingest stream; returns the running query.

    A micro-batch takes at most ``max_files_per_trigger`` files if given, else files of at most ``max_bytes_per_trigger``
    (one file at least), so no option reads a whole backlog at once.

    ``as_of`` pins the clock of the 5-minute future rule (tests); by default
    each batch reads the clock once and records it in its commit row.
    """
    bodies = read_body_stream(spark, source, source_format, max_files_per_trigger, max_bytes_per_trigger)
    return ingest_stream(bodies, store_root, checkpoint, as_of, available_now, processing_time,
                         strict_storage, store_class)

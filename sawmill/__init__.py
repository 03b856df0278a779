"""sawmill — log ingest, search, bucketed counts and retention as Spark jobs.

Every operator takes and returns DataFrames; the heavy lifting is Catalyst /
Tungsten work (pushed-down Parquet scans, hash aggregates, top-k), never a
driver-side loop.  Typical use::

    from sawmill import build_session, LogStore, ingest_stream, search, aggregate
    spark = build_session()
    store = LogStore(spark, "/shared/logs")
    page = search(store.logs(), {"service": "checkout", "level": "error", "limit": "100"})
    buckets = aggregate(store.logs(), store.rollup(), {"since": "…", "until": "…", "bucket": "1h"})
"""

from sawmill.functions.attrs import attrs_kv, attrs_text, explode_attrs
from sawmill.functions.cursor import decode_cursor, encode_cursor
from sawmill.functions.sql import register_sql_functions
from sawmill.functions.times import bucket_start, iso_millis, iso_micros, parse_log_time
from sawmill.operators.aggregate import (
    aggregate_exact, aggregate_logs, aggregate_raw, aggregate_rollup, order_buckets, render_buckets,
)
from sawmill.operators.filters import filter_attrs, filter_message, filter_message_literal, search_logs
from sawmill.operators.ids import assign_arrival_ids, assign_log_ids
from sawmill.operators.paging import after_cursor, latest_logs, log_page, newest_first, render_logs
from sawmill.operators.quality import rollup_mismatches, visibility_report
from sawmill.operators.retention import (
    delete_batch, expired_logs, oldest_expired, retain_rollup, retained_logs, retention_cutoff,
    retention_summary,
)
from sawmill.operators.rollup import merge_rollup, minute_rollup
from sawmill.operators.validate import (
    accepted_logs, ingest_summary, parse_ingest_bodies, rejected_entries, validate_entries,
)
from sawmill.plans.api import aggregate, search
from sawmill.plans.args import ArgumentError, parse_aggregate, parse_search, retention_settings
from sawmill.plans.store import LogStore
from sawmill.session import build_session, configure, work_dir
from sawmill.sources.bodies import read_bodies, read_body_stream, read_kafka_body_stream
from sawmill.streaming.ingest import ingest_stream, stream_ingest_logs

__all__ = [
    "ArgumentError", "LogStore", "accepted_logs", "after_cursor", "aggregate", "aggregate_exact",
    "aggregate_logs", "aggregate_raw", "aggregate_rollup", "assign_arrival_ids", "assign_log_ids",
    "attrs_kv", "attrs_text", "bucket_start", "build_session", "configure", "decode_cursor",
    "delete_batch", "encode_cursor", "expired_logs", "explode_attrs", "filter_attrs", "filter_message",
    "filter_message_literal", "ingest_stream", "ingest_summary", "iso_micros", "iso_millis",
    "latest_logs", "log_page", "merge_rollup", "minute_rollup", "newest_first", "oldest_expired",
    "order_buckets", "parse_aggregate", "parse_ingest_bodies", "parse_log_time", "parse_search",
    "read_bodies", "read_body_stream", "read_kafka_body_stream", "register_sql_functions",
    "rejected_entries", "render_buckets", "render_logs", "retain_rollup", "retained_logs",
    "retention_cutoff", "retention_settings", "retention_summary", "rollup_mismatches", "search",
    "search_logs", "stream_ingest_logs", "validate_entries", "visibility_report", "work_dir",
]

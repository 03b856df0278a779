"""Tables, fixed vocabulary and limits of the log store."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the reference's for identical results:
# level names, rejection reasons, bucket widths, limits and retention defaults.
LEVELS = ("debug", "info", "warn", "error")
REASON_TIMESTAMP = "timestamp must be a valid ISO 8601 date"
REASON_FUTURE = "timestamp cannot be more than 5 minutes in the future"
REASON_LEVEL = "level must be one of: debug, info, warn, error"
REASON_MESSAGE = "message must be a non-empty string"
REASON_SERVICE = "service must be a non-empty string"
REASON_ATTRIBUTES = "attributes must be a flat object with primitive values only"
REASON_SEPARATOR = "; "
ENVELOPE_KEYS = ("entries", "logs", "data", "items")
FUTURE_TOLERANCE_MINUTES = 5
BUCKET_WIDTHS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}
GROUP_BY_VALUES = ("service", "level")
MIN_LIMIT, DEFAULT_LIMIT, MAX_LIMIT = 1, 100, 1000
DEFAULT_RETENTION_DAYS = 30
DEFAULT_RETENTION_BATCH = 5000
# Fixed values as well: argument errors, words that mean "not given", names of settings.
ATTR_PREFIX = "attr."
ABSENT_WORDS = ("", "null", "undefined")
SETTING_DAYS = "LOG_RETENTION_DAYS"
SETTING_BATCH = "RETENTION_DELETE_BATCH_SIZE"
MESSAGES = {
    "service": "service must be a string",
    "service_blank": "service must be a non-empty string",
    "level": "level must be one of: debug, info, warn, error",
    "since": "since must be a valid ISO 8601 date",
    "until": "until must be a valid ISO 8601 date",
    "range": "until must be greater than since",
    "q": "q must be a string",
    "limit": "limit must be an integer between 1 and 1000",
    "cursor": "cursor must be a valid base64url-encoded log cursor",
    "no_bucket": "bucket is required",
    "bucket": "bucket must be one of: 1m, 5m, 1h, 1d",
    "group_by": "group_by must be one of: service, level",
    "attribute": "attribute filter {key} must be a string",
    "setting": "{name} must be an integer",
    "setting_low": "{name} must be an integer greater than or equal to 1",
}

# Extra reasons of the opt-in strict_storage check (ours, not the reference's): entries
# a relational store would refuse at insert time are quarantined instead.
SERVICE_MAX_CHARS = 255
REASON_SERVICE_LENGTH = "service must be at most 255 characters"
REASON_NUL = "text must not contain NUL characters"

# Body outcomes of parse_ingest_bodies / ingest_summary.
STATUS_OK = "ok"
STATUS_MALFORMED = "malformed_json"
STATUS_INVALID = "invalid_body"
OUTCOME_ALL_REJECTED = "all_rejected"

LOGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("level", T.StringType(), False),
    T.StructField("service", T.StringType(), False),
    T.StructField("message", T.StringType(), False),
    T.StructField("attributes", T.StringType(), False),
])

ROLLUP = T.StructType([
    T.StructField("bucket_start", T.TimestampNTZType(), False),
    T.StructField("service", T.StringType(), False),
    T.StructField("level", T.StringType(), False),
    T.StructField("count", T.LongType(), False),
])

REJECTED = T.StructType([
    T.StructField("body_id", T.LongType(), False),
    T.StructField("index", T.IntegerType(), False),
    T.StructField("reason", T.StringType(), False),
    T.StructField("entry", T.StringType(), True),
])

COMMITS = T.StructType([
    T.StructField("batch_id", T.LongType(), False),
    T.StructField("as_of", T.TimestampNTZType(), False),
    T.StructField("accepted", T.LongType(), False),
    T.StructField("rejected", T.LongType(), False),
    T.StructField("max_id", T.LongType(), False),
])

# Envelope records: one ingest body per record, like a Kafka (key, value).
BODIES = T.StructType([
    T.StructField("body_id", T.LongType(), False),
    T.StructField("value", T.StringType(), True),
])

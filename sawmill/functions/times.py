"""Time scalars: literals, bucket floors, ISO text, parsing (#29, #41, #42).

Stored timestamps are UTC wall-clock ``TIMESTAMP_NTZ`` (the session zone is
pinned to UTC by ``sawmill.configure``), so no expression below shifts zones.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


# One grammar for every time given as text: a full ISO date, then optionally a time of day with
# minutes, and a zone as Z or an offset.  24:00 is the end of its day.
TIME_TEXT = (r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}([Tt ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,9})?)?"
             r"\s*([Zz]|[+-][0-9]{2}(:?[0-9]{2})?)?)?\s*$")
_DAY_END = r"([Tt ])24:00(:00([.,]0+)?)?"


def to_utc_naive(value, partial: bool = True) -> datetime:
    """Python-side: ISO text or datetime → naive UTC datetime.

    Text without an offset is read as UTC.  With ``partial`` a year or a year and
    month stand for their first day.  Raises ``ValueError`` on junk.
    """
    if isinstance(value, datetime):
        dt = value
    elif isinstance(value, str):
        text = value.strip()
        if partial and re.fullmatch(r"[0-9]{4}(-[0-9]{2})?", text):
            text += "-01-01"[len(text) - 4:]
        if not re.match(TIME_TEXT, text):
            raise ValueError(f"not a timestamp: {value!r}")
        ended = re.search(_DAY_END, text)
        if ended:
            text = re.sub(_DAY_END, r"\g<1>00:00:00", text)
        if text.endswith(("Z", "z")):
            text = text[:-1] + "+00:00"
        dt = datetime.fromisoformat(text) + timedelta(days=1 if ended else 0)
    else:
        raise ValueError(f"not a timestamp: {value!r}")
    if dt.tzinfo is not None:
        dt = dt.astimezone(timezone.utc).replace(tzinfo=None)
    return dt


def iso_text(dt: datetime, millis: bool = False) -> str:
    """Python-side ISO text in UTC with µs (cursor form) or ms (output form)."""
    dt = to_utc_naive(dt)
    text = dt.strftime("%Y-%m-%dT%H:%M:%S.%f")
    return (text[:-3] if millis else text) + "Z"


def ts_literal(value) -> Column:
    """A constant ``TIMESTAMP_NTZ`` (folded by Catalyst, so it pushes down).

    A Column (e.g. a scalar subquery) is passed through unchanged.
    """
    if isinstance(value, Column):
        return value
    dt = to_utc_naive(value)
    return F.lit(dt.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def resolve_bound(spark, value):
    """A Column bound (e.g. a scalar subquery) evaluated once to a Python value.

    Used where one bound feeds many expressions: as a literal it is computed
    once instead of once per use, and it reaches the Parquet scan as a pushed
    filter and as a static partition filter.  Other values pass through.
    """
    if isinstance(value, Column):
        return spark.range(1).select(value.alias("b")).first()["b"]
    return value


def shift(value, **delta) -> Column:
    """``value + timedelta(**delta)`` as an NTZ column (literal or Column)."""
    if isinstance(value, Column):
        seconds = int(timedelta(**delta).total_seconds())
        return value + F.make_dt_interval(secs=F.lit(seconds))
    return ts_literal(to_utc_naive(value) + timedelta(**delta))


BUCKET_MICROS = {"1m": 60_000_000, "5m": 300_000_000, "1h": 3_600_000_000, "1d": 86_400_000_000}


def _as_col(ts) -> Column:
    if isinstance(ts, Column):
        return ts
    if isinstance(ts, str):
        return F.col(ts)
    return ts_literal(ts)


def _micros_of_day(col: Column) -> Column:
    """Microseconds since midnight, from field extraction (zone-free on NTZ)."""
    return (F.hour(col).cast("bigint") * 3_600_000_000 + F.minute(col).cast("bigint") * 60_000_000
            + (F.date_part(F.lit("SECOND"), col) * 1_000_000).cast("bigint"))


def bucket_start(ts, width: str) -> Column:
    """Epoch-aligned UTC floor to 1m/5m/1h/1d (#29); floors pre-1970 too.

    Every width divides a day, so the offset into the bucket is the time of
    day modulo the width.  Plain long arithmetic inside whole-stage codegen;
    it keeps the NTZ type, does not depend on the session zone and, unlike
    ``window()``, may appear several times in one projection.
    """
    if width not in BUCKET_MICROS:
        raise ValueError(f"bucket must be one of: {', '.join(BUCKET_MICROS)}")
    col = _as_col(ts)
    return F.timestamp_add("MICROSECOND", -F.pmod(_micros_of_day(col), F.lit(BUCKET_MICROS[width])), col)


def minute_floor(ts) -> Column:
    """Start of the UTC minute of an NTZ column, name or constant."""
    return bucket_start(ts, "1m")


def iso_micros(ts) -> Column:
    """``…SS.ffffffZ`` text of an NTZ timestamp (#41)."""
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, ISO_MICROS)


def iso_millis(ts) -> Column:
    """``…SS.fffZ`` text of an NTZ timestamp (#41); truncates µs."""
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, ISO_MILLIS)


# ISO 8601 allows a time of day without seconds ("…T10:30Z"); Spark's parser
# wants them, so ":00" is inserted before the zone or the end of the text.
_NO_SECONDS = r"^(\s*[+-]?\d{4,6}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?=\s*(?:$|Z|[+-]\d))"


# Most texts have this form, which Spark's parser reads as it is.
_COMMON = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]([01][0-9]|2[0-3]):[0-9]{2}:[0-9]{2}([.][0-9]{1,9})?"
           r"(Z|[+-][0-9]{2}:[0-9]{2})?$")


def parse_log_time(text) -> Column:
    """ISO 8601 text (with or without zone) → UTC ``TIMESTAMP_NTZ``; junk → NULL (#42).

    Text without a zone is read in the session zone (UTC).
    """
    col = F.col(text) if isinstance(text, str) else text
    ended = col.rlike(_DAY_END)
    start = F.concat(F.regexp_replace(col, r"[Tt ]24:00.*$", "T00:00:00"),
                     F.regexp_extract(col, r"([Zz]|[+-][0-9]{2}(:?[0-9]{2})?)\s*$", 1))
    read = lambda c: F.try_to_timestamp(c).cast("timestamp_ntz")
    return (F.when(col.rlike(_COMMON), read(col))
            .when(~col.rlike(TIME_TEXT), F.lit(None))
            .when(ended, read(start) + F.expr("INTERVAL 1 DAY"))
            .otherwise(read(F.regexp_replace(col, _NO_SECONDS, "$1:00"))))

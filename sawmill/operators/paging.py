"""Order, top-k and keyset pages (#22–#25, #28).

A page is ``limit + 1`` rows taken newest first: Catalyst plans that as
``TakeOrderedAndProject`` — a per-partition top-k and a merge of at most
``limit + 1`` rows per partition — never a full sort of the table.  The top-k
is late-materialized (keys first, then full rows above the boundary key) and,
on a day-partitioned store, restricted to the newest days that can hold the
page.  Everything after it (the page cut and ``next_cursor``) works on that
bounded set only (≤ 1001 rows, already in one partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sawmill.functions.attrs import attributes_json
from sawmill.functions.cursor import decode_cursor_value, encode_cursor
from sawmill.functions.times import iso_millis, ts_literal
from sawmill.schema import DEFAULT_LIMIT, MAX_LIMIT, MIN_LIMIT


def _newest_first_keys():
    return F.desc_nulls_last("timestamp"), F.desc_nulls_last("id")


def check_limit(limit) -> int:
    """Integer in 1..1000; out of range is an error, not clamped."""
    if isinstance(limit, bool) or not isinstance(limit, int) or not MIN_LIMIT <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be an integer between {MIN_LIMIT} and {MAX_LIMIT}")
    return limit


def newest_first(df: DataFrame) -> DataFrame:
    """``timestamp DESC NULLS LAST, id DESC NULLS LAST`` (#22)."""
    return df.orderBy(*_newest_first_keys())


def newest_rows(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest rows, late-materialized.

    Phase 1 is a top-k over ``(timestamp, id)`` alone — two narrow columns —
    and yields the n-th key (one row to the driver).  Phase 2 reads full rows
    only at or above that key: the ``timestamp`` bound is pushed into the
    Parquet scan, so row groups that are entirely older are skipped and the
    wide ``message`` / ``attributes`` columns are read for a handful of row
    groups instead of the whole input.  Keys are unique, so phase 2 holds
    exactly the n rows.
    """
    keys = newest_first(df.select("timestamp", "id")).limit(n)
    edge = keys.orderBy("timestamp", "id").select("timestamp", "id").first()
    if edge is None:
        return newest_first(df).limit(n)
    tb, ib = ts_literal(edge["timestamp"]), F.lit(edge["id"])
    t = F.col("timestamp")
    return newest_first(df.where((t >= tb) & ((t > tb) | (F.col("id") >= ib)))).limit(n)


def latest_logs(df: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Top-k newest logs (#23)."""
    return newest_rows(newest_days(df, check_limit(limit)), limit)


def after_cursor(df: DataFrame, ts, id_value) -> DataFrame:
    """Keyset ``(timestamp, id) < (ts, id)`` (#24).

    Written as ``ts <= c AND (ts < c OR id < i)`` so the ``timestamp`` bound
    reaches the Parquet scan (a struct comparison would not push down).
    """
    c = ts_literal(ts)
    i = id_value if isinstance(id_value, Column) else F.lit(int(id_value))
    t = F.col("timestamp")
    out = df.where((t <= c) & ((t < c) | ((t == c) & (F.col("id") < i))))
    if "log_date" in df.columns:
        out = out.where(F.col("log_date") <= F.to_date(c))
    return out


def newest_days(df: DataFrame, rows: int) -> DataFrame:
    """Restricts a day-partitioned input to the newest days that hold ``rows`` rows.

    Every row of an older day is older than every row of a newer one, so the
    top ``rows`` rows lie in those days.  One aggregate counts the matching
    rows per day — it reads only the filter columns (row counts from Parquet
    footers when there is no filter) and returns one row per day — and the
    top-k that follows prunes every older day directory.
    """
    if "log_date" not in df.columns:
        return df
    per_day = df.groupBy("log_date").agg(F.count(F.lit(1)).alias("n")).collect()
    total, start = 0, None
    for row in sorted(per_day, key=lambda r: r["log_date"], reverse=True):
        total += row["n"]
        start = row["log_date"]
        if total >= rows:
            break
    if start is None:
        return df
    return df.where(F.col("log_date") >= F.lit(start))


def log_page(df: DataFrame, limit: int = DEFAULT_LIMIT, cursor: str | None = None, *, newest: bool = True) -> DataFrame:
    """One page newest first plus ``next_cursor`` (#25).

    ``next_cursor`` is the token of the last shown row when a further row
    exists, else NULL.  An invalid cursor is an error before any scan.
    ``newest=False`` tells that ``df`` already holds only days that the page needs.
    """
    check_limit(limit)
    if cursor:
        decoded = decode_cursor_value(cursor)
        if decoded is None:
            raise ValueError("cursor must be a valid base64url-encoded log cursor")
        df = after_cursor(df, *decoded)
    fetched = newest_rows(newest_days(df, limit + 1) if newest else df, limit + 1)
    # The window runs over the fetched ≤ limit+1 rows, which the top-k already
    # gathered into a single partition: no exchange, no unbounded group.
    order = Window.orderBy(*_newest_first_keys())
    whole = Window.partitionBy()
    ranked = fetched.select("*", F.row_number().over(order).alias("_rank"),
                            F.count(F.lit(1)).over(whole).alias("_rows"))
    token = F.max(F.when(F.col("_rank") == limit, encode_cursor("timestamp", "id"))).over(whole)
    page = ranked.select(*df.columns, "_rank",
                         F.when(F.col("_rows") > limit, token).alias("next_cursor"))
    return page.where(F.col("_rank") <= limit).drop("_rank")


def render_logs(df: DataFrame) -> DataFrame:
    """Output projection (#28): id as text, ms ISO time, attributes never NULL."""
    extra = [c for c in ("next_cursor",) if c in df.columns]
    return df.select(
        F.col("id").cast("string").alias("id"),
        iso_millis("timestamp").alias("timestamp"),
        "level", "service", "message",
        attributes_json(df).alias("attributes"),
        *extra)

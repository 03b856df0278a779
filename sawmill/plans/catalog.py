"""

Every query reads the driver's tables (``events`` → ``logs``, ingest bodies)
over the whole table.  Parameters are the fixed ones of FIXTURES.md §2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.functions.attrs import attributes_json, attrs_kv, attrs_text, explode_attrs
from sawmill.functions.cursor import decode_cursor, encode_cursor, encode_cursor_value
from sawmill.functions.times import iso_micros, parse_log_time, ts_literal
from sawmill.operators.aggregate import (
    aggregate_exact, aggregate_logs, aggregate_raw, aggregate_rollup, order_buckets, render_buckets,
)
from sawmill.operators.attr_stats import attr_estimates, attr_sketches, attr_statistics, merge_attr_sketches
from sawmill.operators.filters import (
    filter_attrs, filter_level, filter_message, filter_message_literal, filter_service,
    filter_since, filter_until, search_logs,
)
from sawmill.operators.ids import assign_log_ids, in_ranges
from sawmill.operators.paging import after_cursor, latest_logs, log_page, render_logs
from sawmill.operators.quality import rollup_mismatches, visibility_report
from sawmill.operators.retention import (
    delete_batch, expired_logs, oldest_expired, retain_rollup, retained_logs, retention_cutoff,
    retention_summary,
)
from sawmill.operators.rollup import merge_rollup, minute_rollup
from sawmill.operators.validate import (
    accepted_logs, ingest_summary, parse_ingest_bodies, rejected_entries, validate_entries,
)
from sawmill.plans import oracle as O
from sawmill.sources import fixtures as FX

LOG_COLUMNS = ("id", "timestamp", "level", "service", "message", "attributes")
WHOLE_SINCE, WHOLE_UNTIL = "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z"
CUTOFF = retention_cutoff(FX.AS_OF, FX.RETENTION_DAYS)
PAGE = 100


def _logs(spark, d):
    return FX.logs(spark, d)


def _validated(spark, d):
    return validate_entries(parse_ingest_bodies(FX.ingest_bodies(spark, d)), FX.AS_OF)


def _ingest_ids(spark, d):
    """The bodies are put in order before they are parsed; entries keep their body's place."""
    placed = in_ranges(FX.ingest_bodies(spark, d), "body_id")
    accepted = accepted_logs(validate_entries(parse_ingest_bodies(placed), FX.AS_OF))
    return assign_log_ids(accepted, placed=True).select("id", "body_id", "index")


def _validated_extras(spark, d):
    return validate_entries(parse_ingest_bodies(FX.ingest_bodies_with_extras(spark, d)), FX.AS_OF)


def _first_unaligned(logs: DataFrame):
    """Scalar subquery: the first log at or after the aligned start."""
    return logs.where(F.col("timestamp") >= ts_literal(FX.ALIGNED_SINCE)).agg(
        F.min("timestamp")).scalar()


def _next_page(logs: DataFrame) -> DataFrame:
    first = log_page(logs, PAGE)
    token = first.select("next_cursor").first()["next_cursor"]
    return log_page(logs, PAGE, token)


def _last_page(logs: DataFrame) -> DataFrame:
    """Cursor on the 51st-oldest row, so the page holds the 50 oldest rows."""
    row = (logs.orderBy("timestamp", "id").limit(51)
           .orderBy(F.desc("timestamp"), F.desc("id")).select("timestamp", "id").first())
    return log_page(logs, PAGE, encode_cursor_value(row["timestamp"], row["id"]))


def _cursor_decode(spark, d):
    tokens = _logs(spark, d).select("id", encode_cursor("timestamp", "id").alias("token"))
    both = tokens.select("id", F.lit("plain").alias("kind"), "token").unionByName(
        tokens.select("id", F.lit("padded").alias("kind"), F.concat("token", F.lit("=")).alias("token")))
    dec = both.select("id", "kind", decode_cursor("token").alias("c"))
    return dec.select("id", "kind", F.col("c.timestamp").alias("timestamp"),
                      F.col("c.id").alias("cursor_id"), F.col("c.valid").alias("valid"))


def _attrs_text(spark, d):
    m = attrs_text("attributes")
    return _logs(spark, d).select(
        "id", *[F.try_element_at(m, F.lit(k)).alias(k) for k in ("k", "user", "type")])


def _attr_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each service's attributes, merged: exact counts, and whether the estimate is within 4 % of the exact number."""
    logs = _logs(spark, sf_dir)
    merged = attr_estimates(merge_attr_sketches(attr_sketches(logs, "service"))).select("key", "n_logs", F.col("n_values").alias("estimate"))
    exact = attr_statistics(logs).select("key", "n_values")
    return merged.join(exact, "key").select(
        "key", "n_logs", (F.abs(F.col("estimate") - F.col("n_values")) <= 0.04 * F.col("n_values")).alias("estimate_close"))


def _parse_log_time(spark, d):
    ts = F.col("timestamp")
    return _logs(spark, d).select(
        "id",
        parse_log_time(iso_micros(ts)).alias("parsed_utc"),
        parse_log_time(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00")))
        .alias("parsed_offset"),
        parse_log_time(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).alias("parsed_plain"))


def _stream_ingest(spark, d):
    return _select_stored(_store(spark, d).logs())


def _visibility(spark, d):
    store = _store(spark, d)
    report = visibility_report(store.commits(), store.logs())
    return report.agg(F.sum("accepted").cast("bigint").alias("accepted"),
                      F.sum("visible").cast("bigint").alias("visible"),
                      F.count_if(F.col("accepted") != F.col("visible")).alias("mismatched_batches"))


STORED = ("timestamp", "level", "service", "message")


def _stored(df: DataFrame) -> list:
    """Stored-log columns for output: the VARIANT attributes as JSON text."""
    return [*STORED, attributes_json(df).alias("attributes")]


def _select_stored(df: DataFrame) -> DataFrame:
    return df.select(*_stored(df))


def _store(spark, d, tag="shared"):
    from sawmill.plans.runs import streamed_store
    return streamed_store(spark, d, tag)


def _store_page(spark, d):
    page = log_page(_store(spark, d).logs(), PAGE)
    return page.select(*_stored(page), F.col("next_cursor").isNotNull().alias("has_next"))


def _store_exact(spark, d):
    store = _store(spark, d)
    logs = store.logs()
    return aggregate_exact(logs, store.rollup(), _first_unaligned(logs), FX.ALIGNED_UNTIL, "1h", "level")


def _store_compacted(spark, d):
    from sawmill.plans.runs import run_stream
    store = run_stream(spark, d)  # its own: compaction changes what the others read
    store.compact_rollup()
    return store.rollup().drop("bucket_date")


def _store_bodies(spark, d):
    """Stored outcomes of a stream that also holds malformed, invalid and empty bodies."""
    from sawmill.plans.runs import run_stream
    store = run_stream(spark, d, bodies=FX.ingest_bodies_with_extras)
    return store.bodies().select("body_id", "accepted", "rejected", "outcome")


def _store_retention(spark, d):
    """Retention on a store streamed for it."""
    from sawmill.plans.runs import run_stream
    store = run_stream(spark, d)
    result = store.run_retention(FX.AS_OF, FX.RETENTION_DAYS, FX.RETENTION_BATCH)
    return spark.createDataFrame([(result["cutoff"], result["deleted"], result["batches"], store.logs().count())],
                                 "cutoff string, deleted long, batches long, remaining long")


def _manifest_store(spark, d, tag="shared"):
    from sawmill.plans.manifest import ManifestStore
    from sawmill.plans.runs import streamed_store
    return streamed_store(spark, d, f"manifest-{tag}", ManifestStore)


def _manifest_packed(spark, d):
    """All logs after the days' small files were packed and the rollup folded, on a store streamed for it."""
    from sawmill.plans.manifest import ManifestStore
    from sawmill.plans.runs import run_stream
    store = run_stream(spark, d, store_class=ManifestStore)  # its own: a shared one may be packed or folded already
    store.compact_logs(min_files=2)
    store.compact_rollup()
    return _select_stored(store.logs())


def _manifest_page(spark, d):
    page = _manifest_store(spark, d).page(PAGE)
    return page.select(*_stored(page), F.col("next_cursor").isNotNull().alias("has_next"))


def _manifest_search_day(spark, d):
    day = ("2024-01-05T00:00:00Z", "2024-01-06T00:00:00Z")
    return _select_stored(search_logs(_manifest_store(spark, d).logs(*day), level="warn", since=day[0], until=day[1]))


def _manifest_rollup(spark, d):
    store = _manifest_store(spark, d, "folded")
    store.compact_rollup()
    return store.rollup().drop("bucket_date")


def _manifest_retention(spark, d):
    """Retention as one version of a store streamed for it."""
    from sawmill.plans.manifest import ManifestStore
    from sawmill.plans.runs import run_stream
    store = run_stream(spark, d, store_class=ManifestStore)
    result = store.run_retention(FX.AS_OF, FX.RETENTION_DAYS, FX.RETENTION_BATCH)
    return spark.createDataFrame([(result["cutoff"], result["deleted"], result["batches"], store.logs().count())],
                                 "cutoff string, deleted long, batches long, remaining long")


SEARCH_PARAMS = {"service": "svc-2", "level": "null", "since": "2024-01-03T00:00:00Z", "q": "PURCHASE",
                 "limit": "50", "attr.user": "", "cursor": ""}
AGGREGATE_PARAMS = {"since": "2024-01-02T00:00:00Z", "until": "2024-01-09T00:00:00Z", "bucket": "1h",
                    "group_by": "service", "level": "warn", "service": "null"}


def _api_search(spark, d):
    from sawmill.plans.api import search
    return search(_logs(spark, d), SEARCH_PARAMS)


def _api_aggregate(spark, d):
    from sawmill.plans.api import aggregate
    logs = _logs(spark, d)
    return aggregate(logs, minute_rollup(logs), AGGREGATE_PARAMS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    A, S, U = FX.ALIGNED_SINCE, WHOLE_SINCE, WHOLE_UNTIL
    cols = list(LOG_COLUMNS)
    return {
        # ingest (#1–#11)
        "ingest_entries": lambda s, d: parse_ingest_bodies(FX.ingest_bodies_with_extras(s, d)).select(
            "body_id", "status", "index"),
        "ingest_validated": lambda s, d: _validated_extras(s, d).select("body_id", "index", "reason"),
        "ingest_accepted": lambda s, d: accepted_logs(_validated(s, d)),
        "ingest_rejected": lambda s, d: rejected_entries(_validated_extras(s, d)).select(
            "body_id", "index", "reason"),
        "ingest_summary": lambda s, d: ingest_summary(_validated_extras(s, d)),
        "ingest_ids": _ingest_ids,
        # filters (#14–#21)
        "filter_service": lambda s, d: filter_service(_logs(s, d), "svc-3").select(*cols),
        "filter_level": lambda s, d: filter_level(_logs(s, d), "error").select(*cols),
        "filter_since": lambda s, d: filter_since(_logs(s, d), FX.ALIGNED_SINCE).select(*cols),
        "filter_until": lambda s, d: filter_until(_logs(s, d), FX.ALIGNED_UNTIL).select(*cols),
        "filter_message": lambda s, d: filter_message(_logs(s, d), "Purchase by USER 1").select(*cols),
        "filter_message_wildcard": lambda s, d: filter_message(_logs(s, d), "by user 1_ amount").select(*cols),
        "filter_message_literal": lambda s, d: filter_message_literal(_logs(s, d), "50%_off").select(*cols),
        "filter_message_escaped": lambda s, d: filter_message(_logs(s, d), r"50\%\_off").select(*cols),
        "filter_message_backslash": lambda s, d: filter_message(_logs(s, d), r"b\y user 1\2").select(*cols),
        "filter_attrs": lambda s, d: filter_attrs(_logs(s, d), {"type": "purchase", "user": "12"}).select(*cols),
        "search_combined": lambda s, d: search_logs(
            _logs(s, d), service="svc-2", level="warn", since=FX.ALIGNED_SINCE, until=FX.ALIGNED_UNTIL,
            q="USER", attributes={"type": "purchase"}).select(*cols),
        # order / top-k / pages (#22–#28)
        "latest_logs": lambda s, d: latest_logs(_logs(s, d), PAGE).select(*cols),
        "after_cursor": lambda s, d: after_cursor(FX.logs_tied(s, d), "2024-01-15T00:00:00Z", 5000).select(*cols),
        "log_page_first": lambda s, d: log_page(_logs(s, d), PAGE),
        "log_page_next": lambda s, d: _next_page(_logs(s, d)),
        "log_page_last": lambda s, d: _last_page(_logs(s, d)),
        "log_page_tied": lambda s, d: _next_page(FX.logs_tied(s, d)),
        "cursor_encode": lambda s, d: _logs(s, d).select("id", encode_cursor("timestamp", "id").alias("cursor")),
        "cursor_decode": _cursor_decode,
        "render_logs": lambda s, d: render_logs(_logs(s, d)),
        "api_search": _api_search,
        # aggregates (#29–#37)
        "agg_1m": lambda s, d: aggregate_raw(_logs(s, d), A, FX.ALIGNED_UNTIL, "1m"),
        "agg_5m_service": lambda s, d: aggregate_raw(_logs(s, d), S, U, "5m", "service"),
        "agg_1h_level": lambda s, d: aggregate_raw(_logs(s, d), S, U, "1h", "level"),
        "agg_1d": lambda s, d: aggregate_raw(_logs(s, d), S, U, "1d"),
        "agg_raw_message": lambda s, d: aggregate_logs(
            _logs(s, d), minute_rollup(_logs(s, d)), S, U, "1h", "service", q="purchase"),
        "agg_raw_attrs": lambda s, d: aggregate_logs(
            _logs(s, d), minute_rollup(_logs(s, d)), S, U, "1d", "service", attributes={"type": "error"}),
        "agg_rollup_1h_service": lambda s, d: aggregate_rollup(minute_rollup(_logs(s, d)), S, U, "1h", "service"),
        "agg_rollup_unaligned": lambda s, d: aggregate_rollup(
            minute_rollup(_logs(s, d)), _first_unaligned(_logs(s, d)), FX.ALIGNED_UNTIL, "1h", "level"),
        "agg_routed": lambda s, d: aggregate_logs(
            _logs(s, d), minute_rollup(_logs(s, d)), A, FX.ALIGNED_UNTIL, "5m", service="svc-1"),
        "agg_exact_unaligned": lambda s, d: aggregate_exact(
            _logs(s, d), minute_rollup(_logs(s, d)), _first_unaligned(_logs(s, d)), FX.ALIGNED_UNTIL,
            "1h", "level"),
        "render_buckets": lambda s, d: render_buckets(order_buckets(aggregate_raw(_logs(s, d), S, U, "1d", "level"))),
        "api_aggregate": _api_aggregate,
        # rollup and checks (#33, #34, #49, #50)
        "minute_rollup": lambda s, d: minute_rollup(_logs(s, d)),
        "merge_rollup": lambda s, d: merge_rollup(
            minute_rollup(_logs(s, d).where(F.second("timestamp") < 30)),
            minute_rollup(_logs(s, d).where(F.second("timestamp") >= 30))),
        "rollup_mismatches": lambda s, d: rollup_mismatches(
            retained_logs(_logs(s, d), CUTOFF), minute_rollup(_logs(s, d))),
        "visibility_report": _visibility,
        # attributes and time scalars (#38–#42)
        "attrs_text": _attrs_text,
        "attrs_kv": lambda s, d: _logs(s, d).select(
            "id", F.array_join(attrs_kv(attrs_text("attributes")), "|").alias("kv")),
        "explode_attrs": lambda s, d: explode_attrs(_logs(s, d)),
        "attr_statistics": lambda s, d: attr_statistics(_logs(s, d)),
        "attr_sketches": _attr_sketches,
        "parse_log_time": _parse_log_time,
        # retention (#43–#48)
        "retention_expired": lambda s, d: expired_logs(_logs(s, d), CUTOFF).select(*cols),
        "retention_retained": lambda s, d: retained_logs(_logs(s, d), CUTOFF).select(*cols),
        "retention_oldest_batch": lambda s, d: oldest_expired(_logs(s, d), CUTOFF, FX.RETENTION_BATCH).select(*cols),
        "retention_after_batch": lambda s, d: delete_batch(
            _logs(s, d), oldest_expired(_logs(s, d), CUTOFF, FX.RETENTION_BATCH), FX.RETENTION_BATCH).select(*cols),
        "retention_summary": lambda s, d: retention_summary(
            _logs(s, d), FX.AS_OF, FX.RETENTION_DAYS, FX.RETENTION_BATCH),
        "retention_rollup": lambda s, d: retain_rollup(minute_rollup(_logs(s, d)), CUTOFF),
        # streaming (#12, #13) and the store built by it
        "stream_ingest": _stream_ingest,
        "store_page_first": _store_page,
        "store_bodies": _store_bodies,
        "store_search_day": lambda s, d: _select_stored(search_logs(
            _store(s, d).logs(), level="warn", since="2024-01-05T00:00:00Z", until="2024-01-06T00:00:00Z")),
        "store_search_attrs": lambda s, d: _select_stored(search_logs(
            _store(s, d).logs(), service="svc-3", attributes={"type": "error", "user": "11"})),
        "store_rollup": lambda s, d: _store(s, d).rollup().drop("bucket_date"),
        "store_rollup_compacted": _store_compacted,
        "store_agg_exact": _store_exact,
        "store_retention": _store_retention,
        # the same over a manifest: files opened by list
        "manifest_logs_packed": _manifest_packed,
        "manifest_page_first": _manifest_page,
        "manifest_search_day": _manifest_search_day,
        "manifest_rollup_compacted": _manifest_rollup,
        "manifest_retention": _manifest_retention,
    }


def _ts(text: str) -> str:
    return "TIMESTAMP '" + text.replace("T", " ").rstrip("Z") + "'"


def oracle_sql() -> dict[str, str]:
    W = O.with_ctes
    cols = 'id, "timestamp", level, service, message, attributes'
    since, until = _ts(FX.ALIGNED_SINCE), _ts(FX.ALIGNED_UNTIL)
    ws, wu = _ts(WHOLE_SINCE), _ts(WHOLE_UNTIL)
    cutoff = "TIMESTAMP '" + CUTOFF.strftime("%Y-%m-%d %H:%M:%S") + "'"
    first_unaligned = f'(SELECT min("timestamp") FROM logs WHERE "timestamp" >= {since})'

    def bucket(width: str, col: str = '"timestamp"') -> str:
        return f"time_bucket(INTERVAL '{width}', {col}, TIMESTAMP '1970-01-01')"

    def raw_agg(width, group, where):
        g = "CAST(NULL AS VARCHAR)" if group is None else group
        return W(f'SELECT {bucket(width)} AS start, {g} AS "group", count(*) AS "count" '
                 f"FROM logs WHERE {where} GROUP BY ALL")

    def rollup_agg(width, group, where):
        g = "CAST(NULL AS VARCHAR)" if group is None else group
        b = "bucket_start" if width == "1 minute" else bucket(width, "bucket_start")
        return W(f'SELECT {b} AS start, {g} AS "group", CAST(sum("count") AS BIGINT) AS "count" '
                 f"FROM rollup WHERE {where} GROUP BY ALL", O.ROLLUP_CTE)

    def page(source: str, cursor_row: str | None) -> str:
        ctes = [O.TIED_CTE] if source == "tied" else []
        where = ""
        if cursor_row:
            ctes.append(f"c AS ({cursor_row})")
            where = 'WHERE ("timestamp", id) < (SELECT ("timestamp", id) FROM c)'
        ctes.append(f'f AS (SELECT {cols} FROM {source} {where} ORDER BY "timestamp" DESC, id DESC LIMIT {PAGE + 1})')
        ctes.append('r AS (SELECT *, row_number() OVER (ORDER BY "timestamp" DESC, id DESC) AS rk, '
                    "count(*) OVER () AS n FROM f)")
        return W(f"SELECT {cols}, CASE WHEN n > {PAGE} THEN max(CASE WHEN rk = {PAGE} THEN "
                 f"{O.cursor_sql()} END) OVER () END AS next_cursor FROM r WHERE rk <= {PAGE}", *ctes)

    nth_newest = lambda src: f'SELECT "timestamp", id FROM {src} ORDER BY "timestamp" DESC, id DESC LIMIT 1 OFFSET {PAGE - 1}'
    exploded = ("SELECT id, 'k' AS key, CAST(k AS VARCHAR) AS value FROM logs WHERE attributes <> '{}' "
                "UNION ALL SELECT id, 'user', CAST(user_id AS VARCHAR) FROM logs WHERE attributes <> '{}' "
                "UNION ALL SELECT id, 'type', event_type FROM logs WHERE attributes <> '{}'")
    oldest_batch = f'SELECT id FROM logs WHERE "timestamp" < {cutoff} ORDER BY "timestamp", id LIMIT {FX.RETENTION_BATCH}'
    summary = W(
        "SELECT body_id, CAST(count_if(reason = '') AS BIGINT) AS accepted, "
        "CAST(count_if(reason <> '') AS BIGINT) AS rejected, "
        "CASE WHEN count_if(reason = '') > 0 THEN 'ok' ELSE 'all_rejected' END AS outcome "
        f"FROM entries GROUP BY body_id UNION ALL SELECT * FROM ({O.EXTRA_SUMMARY})", O.ENTRIES_CTE)
    accepted = "FROM entries WHERE reason = ''"
    out = {
        "ingest_entries": W("SELECT body_id, 'ok' AS status, \"index\" FROM entries "
                            f"UNION ALL SELECT * FROM ({O.EXTRA_ENTRIES})", O.ENTRIES_CTE),
        "ingest_validated": W('SELECT body_id, "index", reason FROM entries '
                              f"UNION ALL SELECT * FROM ({O.EXTRA_VALIDATED})", O.ENTRIES_CTE),
        "ingest_accepted": W('SELECT body_id, "index", "timestamp", level, service, message, '
                             f"stored_attributes AS attributes {accepted}", O.ENTRIES_CTE),
        "ingest_rejected": W("SELECT body_id, \"index\", reason FROM entries WHERE reason <> '' "
                             f"UNION ALL SELECT * FROM ({O.EXTRA_VALIDATED}) WHERE reason <> ''", O.ENTRIES_CTE),
        "ingest_summary": summary,
        "store_bodies": summary,
        "ingest_ids": W('SELECT CAST(row_number() OVER (ORDER BY body_id, "index") AS BIGINT) AS id, '
                        f'body_id, "index" {accepted}', O.ENTRIES_CTE),
        "filter_service": W(f"SELECT {cols} FROM logs WHERE service = 'svc-3'"),
        "filter_level": W(f"SELECT {cols} FROM logs WHERE level = 'error'"),
        "filter_since": W(f'SELECT {cols} FROM logs WHERE "timestamp" >= {since}'),
        "filter_until": W(f'SELECT {cols} FROM logs WHERE "timestamp" < {until}'),
        "filter_message": W(f"SELECT {cols} FROM logs WHERE message ILIKE '%Purchase by USER 1%' ESCAPE '\\'"),
        "filter_message_wildcard": W(f"SELECT {cols} FROM logs WHERE message ILIKE '%by user 1_ amount%' ESCAPE '\\'"),
        "filter_message_literal": W(f"SELECT {cols} FROM logs WHERE contains(lower(message), lower('50%_off'))"),
        "filter_message_escaped": W(f"SELECT {cols} FROM logs WHERE message ILIKE '%50\\%\\_off%' ESCAPE '\\'"),
        "filter_message_backslash": W(f"SELECT {cols} FROM logs WHERE message ILIKE '%b\\y user 1\\2%' ESCAPE '\\'"),
        "filter_attrs": W(f"SELECT {cols} FROM logs WHERE json_extract_string(attributes, '$.type') = 'purchase' "
                          "AND json_extract_string(attributes, '$.user') = '12'"),
        "search_combined": W(
            f"SELECT {cols} FROM logs WHERE service = 'svc-2' AND level = 'warn' AND \"timestamp\" >= {since} "
            f"AND \"timestamp\" < {until} AND message ILIKE '%USER%' ESCAPE '\\' "
            "AND json_extract_string(attributes, '$.type') = 'purchase'"),
        "latest_logs": W(f'SELECT {cols} FROM logs ORDER BY "timestamp" DESC, id DESC LIMIT {PAGE}'),
        "after_cursor": W(f"SELECT {cols} FROM tied WHERE (\"timestamp\", id) < (TIMESTAMP '2024-01-15 00:00:00', 5000)",
                          O.TIED_CTE),
        "log_page_first": page("logs", None),
        "log_page_next": page("logs", nth_newest("logs")),
        "log_page_last": page("logs", 'SELECT "timestamp", id FROM logs ORDER BY "timestamp", id LIMIT 1 OFFSET 50'),
        "log_page_tied": page("tied", nth_newest("tied")),
        "cursor_encode": W(f"SELECT id, {O.cursor_sql()} AS cursor FROM logs"),
        "cursor_decode": W("SELECT id, 'plain' AS kind, \"timestamp\", id AS cursor_id, true AS valid FROM logs "
                           "UNION ALL SELECT id, 'padded' AS kind, CAST(NULL AS TIMESTAMP) AS \"timestamp\", "
                           "CAST(NULL AS BIGINT) AS cursor_id, false AS valid FROM logs"),
        "render_logs": W("SELECT CAST(id AS VARCHAR) AS id, strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S.%g') || 'Z' "
                         "AS \"timestamp\", level, service, message, attributes FROM logs"),
        "api_search": W(
            "SELECT CAST(id AS VARCHAR) AS id, strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS \"timestamp\", "
            "level, service, message, attributes, "
            f"CASE WHEN n > 50 THEN max(CASE WHEN rk = 50 THEN {O.cursor_sql()} END) OVER () END AS next_cursor "
            "FROM r WHERE rk <= 50",
            f"f AS (SELECT {cols} FROM logs WHERE service = 'svc-2' AND \"timestamp\" >= TIMESTAMP '2024-01-03 00:00:00' "
            "AND message ILIKE '%PURCHASE%' ESCAPE '\\' ORDER BY \"timestamp\" DESC, id DESC LIMIT 51)",
            'r AS (SELECT *, row_number() OVER (ORDER BY "timestamp" DESC, id DESC) AS rk, count(*) OVER () AS n FROM f)'),
        "api_aggregate": W(
            f"SELECT strftime({bucket('1 hour', 'bucket_start')}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS start, "
            'service AS "group", CAST(sum("count") AS BIGINT) AS "count" FROM rollup '
            "WHERE bucket_start >= TIMESTAMP '2024-01-02 00:00:00' AND bucket_start < TIMESTAMP '2024-01-09 00:00:00' "
            "AND level = 'warn' GROUP BY ALL", O.ROLLUP_CTE),
        "agg_1m": raw_agg("1 minute", None, f'"timestamp" >= {since} AND "timestamp" < {until}'),
        "agg_5m_service": raw_agg("5 minutes", "service", f'"timestamp" >= {ws} AND "timestamp" < {wu}'),
        "agg_1h_level": raw_agg("1 hour", "level", f'"timestamp" >= {ws} AND "timestamp" < {wu}'),
        "agg_1d": raw_agg("1 day", None, f'"timestamp" >= {ws} AND "timestamp" < {wu}'),
        "agg_raw_message": raw_agg("1 hour", "service", f'"timestamp" >= {ws} AND "timestamp" < {wu} '
                                                         "AND message ILIKE '%purchase%' ESCAPE '\\'"),
        "agg_raw_attrs": raw_agg("1 day", "service", f'"timestamp" >= {ws} AND "timestamp" < {wu} '
                                                      "AND json_extract_string(attributes, '$.type') = 'error'"),
        "agg_rollup_1h_service": rollup_agg("1 hour", "service", f"bucket_start >= {ws} AND bucket_start < {wu}"),
        "agg_rollup_unaligned": rollup_agg("1 hour", "level",
                                           f"bucket_start >= {first_unaligned} AND bucket_start < {until}"),
        "agg_routed": rollup_agg("5 minutes", None,
                                 f"bucket_start >= {since} AND bucket_start < {until} AND service = 'svc-1'"),
        "agg_exact_unaligned": raw_agg("1 hour", "level",
                                       f'"timestamp" >= {first_unaligned} AND "timestamp" < {until}'),
        "render_buckets": W(
            f"SELECT strftime({bucket('1 day')}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS start, level AS \"group\", "
            f'count(*) AS "count" FROM logs WHERE "timestamp" >= {ws} AND "timestamp" < {wu} GROUP BY ALL'),
        "minute_rollup": W('SELECT bucket_start, service, level, "count" FROM rollup', O.ROLLUP_CTE),
        "merge_rollup": W('SELECT bucket_start, service, level, "count" FROM rollup', O.ROLLUP_CTE),
        "rollup_mismatches": W('SELECT bucket_start, service, level, "count" AS stored, CAST(0 AS BIGINT) AS recount '
                               f"FROM rollup WHERE bucket_start < {cutoff}", O.ROLLUP_CTE),
        "visibility_report": W(f"SELECT count(*) AS accepted, count(*) AS visible, CAST(0 AS BIGINT) AS mismatched_batches "
                               f"{accepted}", O.ENTRIES_CTE),
        "attrs_text": W("SELECT id, json_extract_string(attributes, '$.k') AS k, "
                        "json_extract_string(attributes, '$.user') AS \"user\", "
                        "json_extract_string(attributes, '$.type') AS type FROM logs"),
        "attrs_kv": W("SELECT id, CASE WHEN attributes = '{}' THEN NULL ELSE "
                      "concat('1:k=', k, '|4:type=', event_type, '|4:user=', user_id) END AS kv FROM logs"),
        "explode_attrs": W(exploded),
        "attr_statistics": W(f"SELECT key, count(*) AS n_logs, count(DISTINCT value) AS n_values FROM ({exploded}) GROUP BY key"),
        "attr_sketches": W(f"SELECT key, count(*) AS n_logs, true AS estimate_close FROM ({exploded}) GROUP BY key"),
        "parse_log_time": W("SELECT id, \"timestamp\" AS parsed_utc, \"timestamp\" - INTERVAL 2 HOUR AS parsed_offset, "
                            "date_trunc('second', \"timestamp\") AS parsed_plain FROM logs"),
        "retention_expired": W(f'SELECT {cols} FROM logs WHERE "timestamp" < {cutoff}'),
        "retention_retained": W(f'SELECT {cols} FROM logs WHERE "timestamp" >= {cutoff}'),
        "retention_oldest_batch": W(f'SELECT {cols} FROM logs WHERE "timestamp" < {cutoff} '
                                    f'ORDER BY "timestamp", id LIMIT {FX.RETENTION_BATCH}'),
        "retention_after_batch": W(f"SELECT {cols} FROM logs WHERE id NOT IN ({oldest_batch})"),
        "retention_summary": W(f"SELECT '{CUTOFF.strftime('%Y-%m-%dT%H:%M:%S')}.000Z' AS cutoff, count(*) AS deleted, "
                               f"CAST(count(*) // {FX.RETENTION_BATCH} + 1 AS BIGINT) AS batches "
                               f'FROM logs WHERE "timestamp" < {cutoff}'),
        "retention_rollup": W(f'SELECT bucket_start, service, level, "count" FROM rollup WHERE bucket_start >= {cutoff}',
                              O.ROLLUP_CTE),
        "stream_ingest": W(f'SELECT "timestamp", level, service, message, stored_attributes AS attributes {accepted}',
                           O.ENTRIES_CTE),
        "store_page_first": W(f'SELECT "timestamp", level, service, message, stored_attributes AS attributes, '
                              f'true AS has_next {accepted} ORDER BY "timestamp" DESC LIMIT {PAGE}', O.ENTRIES_CTE),
        "store_search_day": W('SELECT "timestamp", level, service, message, stored_attributes AS attributes '
                              f"{accepted} AND level = 'warn' AND \"timestamp\" >= {since} "
                              "AND \"timestamp\" < TIMESTAMP '2024-01-06 00:00:00'", O.ENTRIES_CTE),
        "store_search_attrs": W('SELECT "timestamp", level, service, message, stored_attributes AS attributes '
                                f"{accepted} AND service = 'svc-3' "
                                "AND json_extract_string(stored_attributes, '$.type') = 'error' "
                                "AND json_extract_string(stored_attributes, '$.user') = '11'", O.ENTRIES_CTE),
        "store_rollup": W(f"SELECT {bucket('1 minute')} AS bucket_start, service, level, count(*) AS \"count\" "
                          f"{accepted} GROUP BY ALL", O.ENTRIES_CTE),
        "store_rollup_compacted": W(f"SELECT {bucket('1 minute')} AS bucket_start, service, level, "
                                    f"count(*) AS \"count\" {accepted} GROUP BY ALL", O.ENTRIES_CTE),
        "store_agg_exact": W(f"SELECT {bucket('1 hour')} AS start, level AS \"group\", count(*) AS \"count\" "
                             f"{accepted} AND \"timestamp\" >= (SELECT min(\"timestamp\") {accepted} "
                             f"AND \"timestamp\" >= {since}) AND \"timestamp\" < {until} GROUP BY ALL", O.ENTRIES_CTE),
        "store_retention": W(f"SELECT '{CUTOFF.strftime('%Y-%m-%dT%H:%M:%S')}.000Z' AS cutoff, "
                             f"count_if(\"timestamp\" < {cutoff}) AS deleted, "
                             f"CAST(count_if(\"timestamp\" < {cutoff}) // {FX.RETENTION_BATCH} + 1 AS BIGINT) AS batches, "
                             f"count_if(\"timestamp\" >= {cutoff}) AS remaining {accepted}", O.ENTRIES_CTE),
    }
    same = {"manifest_logs_packed": "stream_ingest", "manifest_page_first": "store_page_first", "manifest_search_day": "store_search_day",
            "manifest_rollup_compacted": "store_rollup_compacted", "manifest_retention": "store_retention"}
    return out | {name: out[of] for name, of in same.items()}

"""DuckDB SQL equal to each registered query (the correctness oracle).

Every statement starts from the driver's ``events`` view and builds the same
``logs`` rows as ``sawmill.sources.fixtures`` with the FIXTURES.md §2
expressions.  Aggregates cast to BIGINT (DuckDB sums to HUGEINT).
"""

from __future__ import annotations

LOGS_CTE = """logs AS (
  SELECT event_id AS id, ts AS "timestamp",
         CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn'
                         WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
         concat('svc-', user_id % 8) AS service,
         concat(event_type, ' by user ', user_id, ' amount ', CAST(round(value * 100) AS BIGINT),
                CASE WHEN event_id % 10 = 0 THEN ' 50%_OFF' ELSE '' END) AS message,
         CASE WHEN event_id % 11 = 0 THEN '{}'
              ELSE json_object('k', CAST(json_extract(props, '$.k') AS BIGINT), 'user', user_id,
                               'type', event_type)::VARCHAR END AS attributes,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id, event_type
  FROM events)"""

TIED_CTE = """tied AS (
  SELECT id, date_trunc('hour', "timestamp") AS "timestamp", level, service, message, attributes
  FROM logs)"""

ROLLUP_CTE = """rollup AS (
  SELECT time_bucket(INTERVAL '1 minute', "timestamp", TIMESTAMP '1970-01-01') AS bucket_start,
         service, level, count(*) AS "count"
  FROM logs GROUP BY ALL)"""

# Accepted / rejected entries of the generated ingest bodies (FIXTURES.md §3).
ENTRIES_CTE = """entries AS (
  SELECT l.*, CAST(id // 50 AS BIGINT) AS body_id,
         CAST(row_number() OVER (PARTITION BY id // 50 ORDER BY id) - 1 AS INTEGER) AS "index",
         concat_ws('; ',
           CASE WHEN id % 29 = 1 OR id % 31 = 1 THEN 'timestamp must be a valid ISO 8601 date'
                WHEN id % 37 = 1 THEN 'timestamp cannot be more than 5 minutes in the future' END,
           CASE WHEN id % 17 = 1 THEN 'level must be one of: debug, info, warn, error' END,
           CASE WHEN id % 19 = 1 THEN 'message must be a non-empty string' END,
           CASE WHEN id % 23 = 1 THEN 'service must be a non-empty string' END,
           CASE WHEN id % 13 IN (1, 2) THEN 'attributes must be a flat object with primitive values only' END
         ) AS reason,
         CASE WHEN id % 11 = 0 OR id % 13 = 3 THEN '{}'
              ELSE json_object('k', k, 'type', event_type, 'user', user_id)::VARCHAR END AS stored_attributes
  FROM logs l)"""

# Expected outcomes of the fixed edge-case bodies (sawmill.sources.fixtures.EXTRA_BODIES).
_NON_OBJECT_REASON = ("timestamp must be a valid ISO 8601 date; level must be one of: debug, info, warn, "
                      "error; message must be a non-empty string; service must be a non-empty string")
EXTRA_ENTRIES = """SELECT * FROM (VALUES
  (-1::BIGINT, 'ok', NULL::INTEGER), (-2, 'ok', NULL), (-3, 'invalid_body', NULL), (-4, 'ok', 0),
  (-5, 'invalid_body', NULL), (-6, 'ok', 0), (-6, 'ok', 1), (-6, 'ok', 2), (-7, 'malformed_json', NULL),
  (-8, 'ok', 0), (-9, 'malformed_json', NULL), (-10, 'invalid_body', NULL)) AS t(body_id, status, "index")"""
EXTRA_VALIDATED = f"""SELECT * FROM (VALUES
  (-1::BIGINT, NULL::INTEGER, NULL::VARCHAR), (-2, NULL, NULL), (-3, NULL, NULL), (-4, 0, ''),
  (-5, NULL, NULL), (-6, 0, '{_NON_OBJECT_REASON}'), (-6, 1, '{_NON_OBJECT_REASON}'),
  (-6, 2, '{_NON_OBJECT_REASON}'), (-7, NULL, NULL), (-8, 0, ''), (-9, NULL, NULL), (-10, NULL, NULL)
  ) AS t(body_id, "index", reason)"""
EXTRA_SUMMARY = """SELECT * FROM (VALUES
  (-1::BIGINT, 0::BIGINT, 0::BIGINT, 'all_rejected'), (-2, 0, 0, 'all_rejected'), (-3, 0, 0, 'invalid_body'),
  (-4, 1, 0, 'ok'), (-5, 0, 0, 'invalid_body'), (-6, 0, 3, 'all_rejected'), (-7, 0, 0, 'malformed_json'),
  (-8, 1, 0, 'ok'), (-9, 0, 0, 'malformed_json'), (-10, 0, 0, 'invalid_body')
  ) AS t(body_id, accepted, rejected, outcome)"""

CURSOR_SQL = """rtrim(replace(replace(to_base64(encode(
  '{"timestamp":"' || strftime({ts}, '%Y-%m-%dT%H:%M:%S.%fZ') || '","id":' || CAST({id} AS VARCHAR) || '}')),
  '+', '-'), '/', '_'), '=')"""


def with_ctes(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((LOGS_CTE, *ctes)) + "\n" + body


def cursor_sql(ts: str = '"timestamp"', id_: str = "id") -> str:
    return CURSOR_SQL.replace("{ts}", ts).replace("{id}", id_)

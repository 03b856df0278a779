"""SQL functions for ``spark.sql`` users (#39 as a SQL function).

``logs_attributes_kv(attributes)`` is the reference's one SQL function: the
sorted ``len:key=value`` strings of a JSON attribute object, values as text.
It is a SQL-bodied temporary function made of built-in expressions — no Python
runs per row — and equals ``attrs_kv(attrs_text(attributes))`` (tested).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOUBLE = "try_variant_get(v, '$', 'double')"


def _shortest(text: str, digits: int) -> str:
    shorter = f"format_string('%.{digits}e', {_DOUBLE})"
    return f"CASE WHEN try_cast({shorter} AS DOUBLE) = {_DOUBLE} THEN {shorter} ELSE {text} END"


_TEXT = f"({_shortest(_shortest(_shortest(f"format_string('%.16e', {_DOUBLE})", 15), 14), 0)})"


def _part(k: int) -> str:
    return f"regexp_extract({_TEXT}, '^(-?)([0-9]+)[.]?([0-9]*)e[+]?(-?[0-9]+)$', {k})"


_DIGITS = f"concat({_part(2)}, regexp_replace({_part(3)}, '0+$', ''))"
_AT = f"(length({_part(2)}) + coalesce(try_cast({_part(4)} AS INT), 0))"
_NUMBER_TEXT = (
    f"CASE WHEN {_DOUBLE} = floor({_DOUBLE}) AND abs({_DOUBLE}) < 9007199254740992 "
    f"THEN CAST(CAST({_DOUBLE} AS BIGINT) AS STRING) "
    f"WHEN NOT rlike({_TEXT}, '[0-9]e[+-]') THEN CAST({_DOUBLE} AS STRING) "
    f"ELSE concat({_part(1)}, CASE WHEN {_AT} <= 0 THEN concat('0.', repeat('0', -{_AT}), {_DIGITS}) "
    f"WHEN {_AT} >= length({_DIGITS}) THEN concat({_DIGITS}, repeat('0', {_AT} - length({_DIGITS}))) "
    f"ELSE concat(substring({_DIGITS}, 1, {_AT}), '.', substring({_DIGITS}, {_AT} + 1)) END) END")

_VALUE_TEXT = (
    "CASE WHEN schema_of_variant(v) = 'VOID' THEN CAST(NULL AS STRING) "
    "WHEN schema_of_variant(v) IN ('STRING', 'BOOLEAN') THEN try_variant_get(v, '$', 'string') "
    "WHEN schema_of_variant(v) IN ('TINYINT', 'SMALLINT', 'INT', 'BIGINT', 'FLOAT', 'DOUBLE') "
    f"OR startswith(schema_of_variant(v), 'DECIMAL') THEN {_NUMBER_TEXT} "
    "ELSE to_json(v) END")

LOGS_ATTRIBUTES_KV = f"""CREATE OR REPLACE TEMPORARY FUNCTION logs_attributes_kv(attributes STRING)
RETURNS ARRAY<STRING>
RETURN nullif(
  transform(
    array_sort(map_entries(transform_values(
      try_variant_get(try_parse_json(attributes), '$', 'map<string,variant>'), (k, v) -> {_VALUE_TEXT}))),
    e -> concat(CAST(char_length(e.key) AS STRING), ':', e.key, '=', e.value)),
  CAST(array() AS ARRAY<STRING>))"""


def register_sql_functions(spark: SparkSession) -> None:
    """Registers ``logs_attributes_kv`` for the session's SQL."""
    spark.sql(LOGS_ATTRIBUTES_KV)

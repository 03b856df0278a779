"""Attribute scalars (#38–#40).

``attributes`` is JSON text in the driver-derived logs and a VARIANT in the
store (parsed once at ingest, never again per query); ``attributes_doc`` and
``attributes_json`` hide the difference.  ``attrs_text`` gives the reference's
``jsonb_each_text`` view of it — every value as text, JSON null as NULL, numbers
in the canonical decimal text a JavaScript number prints through PostgreSQL
``numeric`` — all with built-in VARIANT functions, no Python UDF.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = re.compile(r"-?([0-9]+(\.[0-9]+)?|Infinity)")  # texts that a number can have
_NUMERIC_SCHEMAS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, wherever ``body`` uses it: a one-element lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _plain_decimal(text: Column) -> Column:
    """``1.25e-07`` → ``0.000000125``: the exponent only moves the decimal point."""
    def moved(parts: Column) -> Column:  # sign, digits before the point, digits after it, exponent
        digits, at = F.concat(parts[1], parts[2]), F.length(parts[1]) + parts[3].cast("int")
        plain = (F.when(at <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), digits))
                 .when(at >= F.length(digits), F.concat(digits, F.repeat(F.lit("0"), at - F.length(digits))))
                 .otherwise(F.concat(F.substring(digits, F.lit(1), at), F.lit("."), F.substring(digits, at + 1, F.length(digits)))))
        return F.concat(parts[0], plain)

    cut = F.regexp_replace(text, r"^(-?)([0-9]+)\.?([0-9]*?)0*e[+]?(-?[0-9]+)$", "$1,$2,$3,$4")
    return bind(F.split(cut, ","), moved)


def _double_text(d: Column) -> Column:
    def decimal(text: Column) -> Column:
        return F.when(text.rlike("[0-9]e[+-]"), _plain_decimal(text)).otherwise(d.cast("string"))

    def shorter_or(text: Column, digits: int) -> Column:
        return bind(F.format_string(f"%.{digits}e", d), lambda x: F.when(x.try_cast("double") == d, x).otherwise(text))

    text = F.format_string("%.16e", d)  # the cast's own text isn't always the shortest
    for digits in (15, 14, 0):
        text = shorter_or(text, digits)
    return (F.when((d == F.floor(d)) & (F.abs(d) < F.lit(2.0 ** 53)), d.cast("bigint").cast("string"))  # fast path; -0 → "0"
            .otherwise(bind(text, decimal)))


def number_text(v: Column) -> Column:
    """Canonical decimal text of a JSON number held in a VARIANT.

    The value first becomes a double, as JavaScript reads it (so ``1.0`` → ``1``
    and integers past 2^53 lose digits), then its shortest text prints as a plain
    decimal: an exponent only moves the decimal point.
    """
    return bind(F.try_variant_get(v, "$", "double"), _double_text)


def _is_number(kind: Column) -> Column:
    return kind.isin(*_NUMERIC_SCHEMAS) | kind.startswith("DECIMAL")


def variant_text(v: Column) -> Column:
    """Text of one flat JSON value: string as is, boolean/number as text, null → NULL."""
    return bind(F.schema_of_variant(v), lambda kind: (
        F.when(kind.isin("STRING", "BOOLEAN"), F.try_variant_get(v, "$", "string"))
        .when(_is_number(kind), number_text(v))
        .when(kind != "VOID", F.to_json(v))))


def variant_text_is(v: Column, want: str) -> Column:
    """``variant_text(v) = want``, with a number's text made only where the number is the wanted one."""
    other = F.try_variant_get(v, "$", "string")
    number = F.lit(False)
    if _NUMBER.fullmatch(want):
        number = bind(F.try_variant_get(v, "$", "double"),
                      lambda d: F.when(d == F.lit(float(want)), _double_text(d) == F.lit(want)).otherwise(F.lit(False)))
    return F.coalesce(bind(F.schema_of_variant(v), lambda kind: (
        F.when(kind.isin("STRING", "BOOLEAN"), other == F.lit(want))
        .when(_is_number(kind), number)
        .when(kind != "VOID", F.to_json(v) == F.lit(want)))), F.lit(False))


def _is_variant(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.VariantType)


def attributes_doc(df: DataFrame, name: str = "attributes") -> Column:
    """The attributes as a VARIANT: a stored VARIANT as is, JSON text parsed."""
    return F.col(name) if _is_variant(df, name) else F.try_parse_json(F.col(name))


def attributes_json(df: DataFrame, name: str = "attributes") -> Column:
    """The attributes as JSON text for output; never NULL (``{}``)."""
    col = F.to_json(F.col(name)) if _is_variant(df, name) else F.col(name)
    return F.coalesce(col, F.lit("{}"))


def attrs_map(doc: Column) -> Column:
    """VARIANT object → ``MAP<STRING,STRING>`` of value texts; non-objects → NULL."""
    as_map = F.try_variant_get(doc, "$", "map<string,variant>")
    return F.transform_values(as_map, lambda _k, v: variant_text(v))


def attrs_text(attributes) -> Column:
    """JSON object text → ``MAP<STRING,STRING>`` (#38); non-objects → NULL."""
    return attrs_map(F.try_parse_json(_col(attributes)))


def attrs_kv(attrs) -> Column:
    """Sorted ``len:key=value`` strings of a text map (#39); ``{}`` → NULL.

    A JSON null value gives a NULL element, as string concatenation with NULL
    does in SQL.  ``len`` counts characters.
    """
    m = _col(attrs)
    entries = F.array_sort(F.map_entries(m))
    tokens = F.transform(entries, lambda e: F.concat(
        F.char_length(e["key"]).cast("string"), F.lit(":"), e["key"], F.lit("="), e["value"]))
    return F.when(F.size(m) > 0, tokens)


def explode_attrs(logs: DataFrame, attrs_col: str = "attributes") -> DataFrame:
    """One row per (id, key, value) of every log's attributes (#40)."""
    return logs.select("id", F.explode(attrs_map(attributes_doc(logs, attrs_col))).alias("key", "value"))


def utf16_length(text: str) -> int:
    """Length in UTF-16 code units, as JavaScript's ``String.length`` counts."""
    return len(text.encode("utf-16-le")) // 2


def kv_token(key: str, value: str) -> str:
    """Python-side ``len:key=value`` of a search filter (UTF-16 length)."""
    return f"{utf16_length(key)}:{key}={value}"

"""Search filters, all AND-combined (#14–#21).

Each filter is a plain ``where`` Catalyst pushes into the Parquet scan.  When
the input carries a day partition column (``log_date`` for logs,
``bucket_date`` for the compacted rollup), time bounds also bound it so whole
day directories are pruned (Catalyst does not derive that on its own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.functions.attrs import attributes_doc, utf16_length, variant_text_is
from sawmill.functions.patterns import like_pattern
from sawmill.functions.times import ts_literal
from sawmill.schema import LEVELS


# Day partition column that goes with each time column (stored logs, compacted rollup).
_DAY_OF = {"timestamp": "log_date", "bucket_start": "bucket_date"}


def _day_column(df: DataFrame, column: str) -> str | None:
    day = _DAY_OF.get(column)
    return day if day in df.columns else None


def filter_service(df: DataFrame, service: str) -> DataFrame:
    """Exact, case-sensitive match (#14)."""
    return df.where(F.col("service") == F.lit(service))


def filter_level(df: DataFrame, level: str) -> DataFrame:
    """Exact match on one of the four levels (#15)."""
    if level not in LEVELS:
        raise ValueError("level must be one of: debug, info, warn, error")
    return df.where(F.col("level") == F.lit(level))


def filter_since(df: DataFrame, since, column: str = "timestamp") -> DataFrame:
    """``timestamp >= since`` (inclusive, #16)."""
    bound = ts_literal(since)
    out = df.where(F.col(column) >= bound)
    day = _day_column(df, column)
    if day:
        out = out.where(F.col(day) >= F.to_date(bound))
    return out


def filter_until(df: DataFrame, until, column: str = "timestamp") -> DataFrame:
    """``timestamp < until`` (exclusive, #17)."""
    bound = ts_literal(until)
    out = df.where(F.col(column) < bound)
    day = _day_column(df, column)
    if day:
        out = out.where(F.col(day) <= F.to_date(bound))
    return out


def filter_message(df: DataFrame, q: str) -> DataFrame:
    """``message ILIKE '%q%'`` with q unescaped, as the reference runs it (#18)."""
    return df.where(F.col("message").ilike(like_pattern(q)))


def filter_message_literal(df: DataFrame, q: str) -> DataFrame:
    """The documented behavior: case-insensitive plain substring (#19)."""
    return df.where(F.contains(F.lower(F.col("message")), F.lower(F.lit(q))))


def _key_path(key: str) -> str | None:
    """VARIANT path of one object key, or None when the key holds both quote kinds."""
    if "'" not in key:
        return f"$['{key}']"
    if '"' not in key:
        return f'$["{key}"]'
    return None


def _text_is(want: str):
    return lambda v: variant_text_is(v, want)


def attribute_match(filters: dict[str, str], doc: Column | None = None) -> Column:
    """All ``attr.key=value`` pairs as one test on the parsed ``attributes``.

    Each key is looked up by path in the VARIANT (no map is built), its value
    turned into text as PostgreSQL's ``jsonb_each_text`` does, and compared;
    a missing key or JSON null never matches.  Equal to containment of every
    ``len:key=value`` token; the reference measures the filter key in UTF-16
    units but the stored key in characters, so a key outside the BMP can never
    match — that is kept.  ``doc`` is the attributes VARIANT (default: parsed
    from the JSON text column).
    """
    if any(utf16_length(k) != len(k) for k in filters):
        return F.lit(False)

    def bind(value: Column, body) -> Column:
        # Filters get no common-subexpression elimination; a one-element
        # lambda evaluates ``value`` once and lets ``body`` reuse it.
        return F.exists(F.array(value), body)

    def all_pairs(doc: Column) -> Column:
        cond = None
        for key in sorted(filters):
            path = _key_path(key)
            value = (F.try_variant_get(doc, path, "variant") if path is not None else
                     F.try_element_at(F.try_variant_get(doc, "$", "map<string,variant>"), F.lit(key)))
            test = bind(value, _text_is(filters[key]))
            cond = test if cond is None else cond & test
        return cond

    return bind(doc if doc is not None else F.try_parse_json(F.col("attributes")), all_pairs)


def filter_attrs(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Every pair must match as text; missing key, JSON null or ``{}`` never match (#20)."""
    if not filters:
        return df
    return df.where(attribute_match(filters, attributes_doc(df)))


def search_logs(df: DataFrame, service: str | None = None, level: str | None = None,
                since=None, until=None, q: str | None = None,
                attributes: dict[str, str] | None = None) -> DataFrame:
    """All filters in one call (#21); any subset, AND-combined."""
    if service:
        df = filter_service(df, service)
    if level:
        df = filter_level(df, level)
    if since is not None:
        df = filter_since(df, since)
    if until is not None:
        df = filter_until(df, until)
    if q:
        df = filter_message(df, q)
    if attributes:
        df = filter_attrs(df, attributes)
    return df

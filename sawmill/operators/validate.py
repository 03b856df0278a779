"""Ingest: body normalization and per-entry validation (#1–#10).

Bodies arrive as text.  ``try_parse_json`` turns each into a VARIANT, which
keeps what JSON tells apart and a typed struct would lose: a missing key vs an
explicit ``null``, a number vs a string, nested vs flat values.  Entries are
validated independently and each rule adds its own reason, in the fixed order
timestamp, level, message, service, attributes.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.functions.times import parse_log_time, shift
from sawmill.schema import (
    ENVELOPE_KEYS, FUTURE_TOLERANCE_MINUTES, LEVELS, OUTCOME_ALL_REJECTED, REASON_ATTRIBUTES,
    REASON_FUTURE, REASON_LEVEL, REASON_MESSAGE, REASON_NUL, REASON_SEPARATOR, REASON_SERVICE,
    REASON_SERVICE_LENGTH, REASON_TIMESTAMP, SERVICE_MAX_CHARS, STATUS_INVALID, STATUS_MALFORMED,
    STATUS_OK,
)

# JavaScript's String.prototype.trim removes these (ECMAScript WhiteSpace and
# LineTerminator): tab, LF, VT, FF, CR, every Unicode space separator, U+2028,
# U+2029 and U+FEFF.  Spark's trim only removes U+0020.
_BLANK = r"^[\t\n\x{0B}\f\r\p{Z}\x{FEFF}]*$"


def _is(kind: Column, name: str) -> Column:
    return F.coalesce(kind == name, F.lit(False))


def _starts(kind: Column, prefix: str) -> Column:
    return F.coalesce(kind.startswith(prefix), F.lit(False))


def parse_ingest_bodies(bodies: DataFrame, keep_bad: bool = False) -> DataFrame:
    """``(body_id, value)`` → ``(body_id, status, index, entry VARIANT)`` (#1).

    A root array is the entry list; otherwise the first non-null of
    entries/logs/data/items must be an array.  Bodies that are not ``ok`` and
    empty lists keep one row with NULL index, so every body is accounted for.
    The body is parsed once (its own projection) and inspected from there.

    As a strict JSON body parser does, a body must start (after JSON blanks)
    with ``{`` or ``[``: a bare string, number or ``null`` is malformed.  An
    empty body reads as ``{}`` and is therefore an invalid body.

    ``keep_bad`` adds ``body``, the text of bodies that are not ``ok`` (NULL for the others).
    """
    value = F.col("value")
    empty = value.isNull() | (value == "")
    strict = F.coalesce(value.rlike(r"^[ \t\n\r]*[\[{]"), F.lit(False))
    parsed = bodies.select("body_id", empty.alias("_empty"),
                           F.when(strict, F.try_parse_json(value)).alias("_doc"), *([value] if keep_bad else []))
    doc = F.col("_doc")
    members = [F.try_variant_get(doc, f"$.{k}", "variant") for k in ENVELOPE_KEYS]
    picked = F.coalesce(*[F.when(~F.is_variant_null(m), m) for m in members])
    root_is_list = F.try_variant_get(doc, "$", "array<variant>")
    listed = F.coalesce(root_is_list, F.try_variant_get(picked, "$", "array<variant>"))
    staged = parsed.select(
        "body_id",
        F.when(F.col("_empty"), F.lit(STATUS_INVALID)).when(doc.isNull(), F.lit(STATUS_MALFORMED))
        .when(listed.isNotNull(), F.lit(STATUS_OK)).otherwise(F.lit(STATUS_INVALID)).alias("status"),
        listed.alias("_entries"), *([value] if keep_bad else []))
    bad = [F.when(F.col("status") != STATUS_OK, value).alias("body")] if keep_bad else []
    return staged.select(
        "body_id", "status", *bad, F.posexplode_outer("_entries").alias("index", "entry"))


def validate_entries(entries: DataFrame, as_of=None, strict_storage: bool = False) -> DataFrame:
    """Adds ``errors ARRAY<STRING>`` and ``reason`` to parsed entries (#2–#7).

    ``as_of`` is the instant the 5-minute future rule is measured from; it is
    fixed once per batch (default: now).  Rows with NULL index (empty or bad
    bodies) pass through with NULL errors.

    ``strict_storage`` adds two checks after the standard ones: a service over
    255 characters, and a NUL character in service, message or attributes —
    entries that pass validation but that a relational store would refuse on
    insert (failing every entry written with them).

    Three projections: the five fields are pulled out of the VARIANT once,
    then typed once, then judged — so no VARIANT is inspected twice per row.
    """
    if as_of is None:
        as_of = datetime.now(timezone.utc)
    names = ("timestamp", "level", "message", "service", "attributes")
    # a non-object entry (array, scalar, null) is judged as {}
    objects = entries.select("*", F.when(_starts(F.schema_of_variant("entry"), "OBJECT"),
                                         F.col("entry")).alias("_obj"))
    fields = objects.select(
        *entries.columns,
        *[F.try_variant_get("_obj", f"$.{n}", "variant").alias(f"_v_{n}") for n in names])

    def text(n: str) -> Column:
        v = F.col(f"_v_{n}")
        return F.when(_is(F.schema_of_variant(v), "STRING"), F.try_variant_get(v, "$", "string"))

    attr_map = F.try_variant_get("_v_attributes", "$", "map<string,variant>")
    nested = F.exists(F.map_values(attr_map),
                      lambda v: F.coalesce(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.lit(False)))
    typed = fields.select(
        *entries.columns,
        parse_log_time(text("timestamp")).alias("_timestamp"),
        text("level").alias("_level"), text("message").alias("_message"),
        text("service").alias("_service"),
        F.col("_v_attributes").alias("_attrs"),
        (F.col("_v_attributes").isNotNull()
         & (attr_map.isNull() | F.coalesce(nested, F.lit(False)))).alias("_bad_attrs"))

    limit = shift(as_of, minutes=FUTURE_TOLERANCE_MINUTES)
    ts = F.col("_timestamp")
    errors = F.filter(F.array(
        F.when(ts.isNull(), F.lit(REASON_TIMESTAMP)).when(ts > limit, F.lit(REASON_FUTURE)),
        F.when(~F.coalesce(F.col("_level").isin(*LEVELS), F.lit(False)), F.lit(REASON_LEVEL)),
        F.when(F.coalesce(F.col("_message").rlike(_BLANK), F.lit(True)), F.lit(REASON_MESSAGE)),
        F.when(F.coalesce(F.col("_service").rlike(_BLANK), F.lit(True)), F.lit(REASON_SERVICE)),
        F.when(F.col("_bad_attrs"), F.lit(REASON_ATTRIBUTES)),
        *_storage_checks(strict_storage),
    ), lambda x: x.isNotNull())
    judged = typed.select("*", F.when(F.col("index").isNotNull(), errors).alias("errors"))
    judged = judged.select("*", F.array_join("errors", REASON_SEPARATOR).alias("reason"))
    # Optimization fence: a one-row Generate.  Later filters on ``errors``
    # (accepted / rejected) stay above it instead of being pushed down and
    # re-deriving every VARIANT extraction inside the filter.
    return judged.select(F.inline(F.array(F.struct(*judged.columns))))


def _storage_checks(strict: bool) -> list[Column]:
    if not strict:
        return []
    nul = "\u0000"
    has_nul = (F.coalesce(F.col("_service").contains(nul), F.lit(False))
               | F.coalesce(F.col("_message").contains(nul), F.lit(False))
               | F.coalesce(F.to_json("_attrs").contains("\\u0000"), F.lit(False)))
    return [F.when(F.char_length("_service") > SERVICE_MAX_CHARS, F.lit(REASON_SERVICE_LENGTH)),
            F.when(has_nul, F.lit(REASON_NUL))]


def accepted_logs(validated: DataFrame, attributes_as: str = "json") -> DataFrame:
    """Valid entries as typed log rows, without ids (#8); missing attributes → ``{}``.

    ``attributes_as="variant"`` keeps the parsed VARIANT (what the store writes)
    instead of rendering JSON text.
    """
    if attributes_as == "variant":
        attrs = F.coalesce(F.col("_attrs"), F.parse_json(F.lit("{}")))
    else:
        attrs = F.coalesce(F.to_json("_attrs"), F.lit("{}"))
    return validated.where(F.size("errors") == 0).select(
        "body_id", "index",
        F.col("_timestamp").alias("timestamp"), F.col("_level").alias("level"),
        F.col("_service").alias("service"), F.col("_message").alias("message"),
        attrs.alias("attributes"))


def kept_fields(validated: DataFrame) -> DataFrame:
    """``validated`` with what its outputs take of a row: of an accepted entry the typed fields, of a rejected one its text and
    reason.  About half of what a cached batch holds otherwise."""
    good, bad = F.size("errors") == 0, F.size("errors") > 0
    return validated.select(
        *[c for c in ("body_id", "status", "body", "index", "errors") if c in validated.columns],
        *[F.when(bad, F.col(c)).alias(c) for c in ("entry", "reason")],
        *[F.when(good, F.col(c)).alias(c) for c in ("_timestamp", "_level", "_message", "_service", "_attrs")])


def rejected_entries(validated: DataFrame) -> DataFrame:
    """``(body_id, index, reason, entry)`` of invalid entries (#9)."""
    return validated.where(F.size("errors") > 0).select(
        "body_id", F.col("index").cast("int").alias("index"), "reason",
        F.to_json("entry").alias("entry"))


def ingest_summary(validated: DataFrame) -> DataFrame:
    """Per body: accepted, rejected, outcome (#10).

    ``ok`` if anything was accepted; a body whose entries were all rejected —
    or that had none — is ``all_rejected``; bad bodies keep their status.
    """
    valid = F.size("errors") == 0
    summary = validated.groupBy("body_id", "status").agg(
        F.count_if(F.col("index").isNotNull() & valid).alias("accepted"),
        F.count_if(F.col("index").isNotNull() & ~valid).alias("rejected"))
    outcome = (F.when(F.col("status") != STATUS_OK, F.col("status"))
               .when(F.col("accepted") > 0, F.lit(STATUS_OK))
               .otherwise(F.lit(OUTCOME_ALL_REJECTED)))
    return summary.select("body_id", "accepted", "rejected", outcome.alias("outcome"))


def body_outcomes(validated: DataFrame) -> DataFrame:
    """``ingest_summary`` plus ``body``, the text of every malformed or invalid body.

    Takes entries parsed with ``keep_bad``.  A bad body is one row already; only good ones are grouped.
    """
    good = ingest_summary(validated.where(F.col("status") == STATUS_OK))
    none = F.lit(0).cast("bigint")
    bad = validated.where(F.col("status") != STATUS_OK).select(
        "body_id", none.alias("accepted"), none.alias("rejected"), F.col("status").alias("outcome"), "body")
    return good.withColumn("body", F.lit(None).cast("string")).unionByName(bad)

"""Keyset cursor tokens (#26, #27).

A token is the unpadded base64url form of ``{"timestamp":"<µs ISO>","id":n}``.
A token is valid only when it re-encodes byte for byte, decodes to UTF-8 JSON
with a string timestamp that parses and a non-negative integer id — so padded
tokens, junk and tokens with extra whitespace are refused.
"""

from __future__ import annotations

import base64
import binascii
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sawmill.functions.attrs import bind
from sawmill.functions.times import ISO_MICROS, iso_text, parse_log_time, to_utc_naive

_INTEGRAL = ("TINYINT", "SMALLINT", "INT", "BIGINT")


def _b64url(binary: Column) -> Column:
    # base64() wraps lines at 76 characters with CRLF; translate drops those
    # (characters without a counterpart are deleted) while mapping +/ to -_.
    return F.rtrim(F.translate(F.base64(binary), "+/\r\n", "-_"), F.lit("="))


def encode_cursor(ts, id_col) -> Column:
    """Token column for (timestamp, id) columns (#26)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    doc = F.concat(F.lit('{"timestamp":"'), F.date_format(ts, ISO_MICROS),
                   F.lit('","id":'), id_col.cast("string"), F.lit("}"))
    return _b64url(F.encode(doc, "UTF-8"))


def decode_cursor(token) -> Column:
    """Token column → ``STRUCT<timestamp NTZ, id BIGINT, valid BOOLEAN>`` (#27).

    The steps are bound one after the other, so each is evaluated once a row and the plan holds each once.
    """
    tok = F.col(token) if isinstance(token, str) else token

    def text(binary: Column) -> Column:
        return F.when((_b64url(binary) == tok) & F.is_valid_utf8(binary), F.decode(binary, "UTF-8"))

    def members(doc: Column) -> Column:
        return F.struct(F.try_variant_get(doc, "$.timestamp", "variant").alias("ts"),
                        F.try_variant_get(doc, "$.id", "variant").alias("id"))

    def typed(m: Column) -> Column:
        kind = F.schema_of_variant(m["id"])
        numeric = kind.isin(*_INTEGRAL, "FLOAT", "DOUBLE") | kind.startswith("DECIMAL")
        ts = F.when(F.schema_of_variant(m["ts"]) == "STRING", F.try_variant_get(m["ts"], "$", "string"))
        return F.struct(bind(ts, parse_log_time).alias("ts"),
                        F.when(numeric, F.try_variant_get(m["id"], "$", "double")).alias("id"))

    def judged(m: Column) -> Column:
        whole = m["id"].try_cast("bigint")
        valid = F.coalesce(m["ts"].isNotNull() & (m["id"] >= 0) & (m["id"] == F.floor(m["id"])) & whole.isNotNull(), F.lit(False))
        return F.struct(F.when(valid, m["ts"]).alias("timestamp"), F.when(valid, whole).alias("id"), valid.alias("valid"))

    binary = F.try_to_binary(F.translate(tok, "-_", "+/"), F.lit("base64"))
    doc = bind(binary, lambda b: F.try_parse_json(text(b)))
    return bind(bind(bind(doc, members), typed), judged)


def encode_cursor_value(ts, id_value: int) -> str:
    """Python-side token for one (timestamp, id) — same bytes as ``encode_cursor``."""
    doc = json.dumps({"timestamp": iso_text(ts), "id": int(id_value)}, separators=(",", ":"))
    return base64.urlsafe_b64encode(doc.encode("utf-8")).decode("ascii").rstrip("=")


def decode_cursor_value(token: str):
    """Python-side decode of a search argument → (timestamp text, id) or None."""
    if not isinstance(token, str) or not token:
        return None
    try:
        raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
    except (binascii.Error, ValueError):
        return None
    if base64.urlsafe_b64encode(raw).decode("ascii").rstrip("=") != token:
        return None
    try:
        doc = json.loads(raw.decode("utf-8"))
    except (UnicodeDecodeError, ValueError):
        return None
    if not isinstance(doc, dict):
        return None
    ts, id_value = doc.get("timestamp"), doc.get("id")
    if not isinstance(ts, str) or isinstance(id_value, bool) or not isinstance(id_value, (int, float)):
        return None
    if isinstance(id_value, float) and (not math.isfinite(id_value) or not id_value.is_integer()):
        return None
    if id_value < 0:
        return None
    try:
        to_utc_naive(ts, partial=False)
    except ValueError:
        return None
    return ts, int(id_value)

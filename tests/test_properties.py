"""Property tests; each hypothesis example is evaluated as one Spark batch."""

import base64
import re
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sawmill.functions.attrs import attrs_text
from sawmill.functions.cursor import decode_cursor, decode_cursor_value, encode_cursor, encode_cursor_value
from sawmill.functions.patterns import like_pattern
from sawmill.functions.times import BUCKET_MICROS, bucket_start

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def pg_ilike(message: str, pattern: str) -> bool:
    """PostgreSQL ``ILIKE`` with escape ``\\``: ``\\c`` is a literal c."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
            continue
        out.append(".*" if ch == "%" else "." if ch == "_" else re.escape(ch))
        i += 1
    return re.fullmatch("".join(out).lower(), message.lower(), flags=re.S) is not None


texts = st.text(alphabet="aAbB%_\\ x", max_size=8)


@SETTINGS
@given(st.lists(st.tuples(texts, texts), min_size=20, max_size=60))
def test_like_pattern_matches_postgres(spark, pairs):
    rows = [(m, like_pattern(q), "%" + q + "%") for m, q in pairs]
    df = spark.createDataFrame(rows, "m string, p string, raw string")
    got = [r["hit"] for r in df.select(F.expr("m ILIKE p").alias("hit")).collect()]
    assert got == [pg_ilike(m, raw) for m, _, raw in rows]


moments = st.datetimes(min_value=datetime(1900, 1, 1), max_value=datetime(2200, 1, 1))


@SETTINGS
@given(st.lists(st.tuples(moments, st.integers(0, 2**53)), min_size=20, max_size=60))
def test_cursor_round_trip(spark, items):
    df = spark.createDataFrame([(t.strftime("%Y-%m-%d %H:%M:%S.%f"), i) for t, i in items], "t string, i long") \
        .select(F.col("t").cast("timestamp_ntz").alias("timestamp"), F.col("i").alias("id"))
    out = df.select("timestamp", "id", encode_cursor("timestamp", "id").alias("tok")) \
        .select("*", decode_cursor("tok").alias("c")).collect()
    for r in out:
        assert r["tok"] == encode_cursor_value(r["timestamp"], r["id"])
        assert (r["c"]["timestamp"], r["c"]["id"], r["c"]["valid"]) == (r["timestamp"], r["id"], True)
        ts_text, id_value = decode_cursor_value(r["tok"])
        assert id_value == r["id"]


@SETTINGS
@given(st.lists(moments, min_size=20, max_size=60), st.sampled_from(sorted(BUCKET_MICROS)))
def test_bucket_floor(spark, stamps, width):
    df = spark.createDataFrame([(t.strftime("%Y-%m-%d %H:%M:%S.%f"),) for t in stamps], "t string") \
        .select(F.col("t").cast("timestamp_ntz").alias("t"))
    got = [r["b"] for r in df.select(bucket_start("t", width).alias("b")).collect()]
    epoch, step = datetime(1970, 1, 1), BUCKET_MICROS[width]
    want = []
    for t in stamps:
        us = (t - epoch) // timedelta(microseconds=1)
        want.append(epoch + timedelta(microseconds=us - us % step))
    assert got == want


@SETTINGS
@given(st.lists(st.integers(-(2**53), 2**53), min_size=10, max_size=40))
def test_integer_attribute_text(spark, values):
    docs = [(f'{{"v": {v}}}',) for v in values]
    got = [r["m"]["v"] for r in spark.createDataFrame(docs, "a string").select(attrs_text("a").alias("m")).collect()]
    assert got == [str(v) for v in values]


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 19), min_size=1, max_size=2, unique=True))
def test_any_batch_split_keeps_store_consistent(spark, cuts):
    from conftest import SF_SMALL
    from sawmill.operators.quality import rollup_mismatches
    from sawmill.plans.store import LogStore
    from sawmill.session import work_dir
    from sawmill.sources.fixtures import AS_OF, ingest_bodies
    bodies = ingest_bodies(spark, SF_SMALL).cache()
    store = LogStore(spark, work_dir(spark, "split-store"))
    edges = [0, *sorted(cuts), 10**9]
    for batch_id, (lo, hi) in enumerate(zip(edges, edges[1:])):
        store.ingest_batch(bodies.where((F.col("body_id") >= lo) & (F.col("body_id") < hi)), batch_id, AS_OF)
    logs = store.logs()
    n = logs.count()
    assert n == 652  # accepted entries of the whole input, however it was split
    assert sorted(r["id"] for r in logs.select("id").collect()) == list(range(1, n + 1))
    assert rollup_mismatches(logs, store.rollup()).count() == 0


B64URL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"


def _token(moment, id_value: int) -> str:
    """A valid token, or (negative id) a well-formed token the decoders must refuse."""
    if id_value >= 0:
        return encode_cursor_value(moment, id_value)
    doc = '{"timestamp":"2024-01-01T00:00:00Z","id":%d}' % id_value
    return base64.urlsafe_b64encode(doc.encode()).decode().rstrip("=")


def _mutations(token: str):
    yield token
    yield token + "="
    yield token[:-1]
    yield token[1:]
    yield token.replace("e", "f", 1)
    yield token.upper()


@SETTINGS
@given(st.lists(st.one_of(
    st.text(alphabet=B64URL + "+/= ", max_size=80),
    st.tuples(moments, st.integers(-5, 2**40)).map(lambda t: _token(*t))),
    min_size=10, max_size=30))
def test_python_and_spark_cursor_decoders_agree(spark, tokens):
    tokens = [m for t in tokens for m in _mutations(t)]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    got = [r["v"] for r in df.select(decode_cursor("t")["valid"].alias("v")).collect()]
    want = [decode_cursor_value(t) is not None for t in tokens]
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.integers(-5, 1500).map(str), st.text(alphabet="0123456789 +-.e", max_size=6)))
def test_limit_contract(raw):
    import pytest as _pytest
    from sawmill.plans.args import ArgumentError, parse_search
    from sawmill.schema import ABSENT_WORDS
    text = raw.strip()
    ok = text.isdigit() and text.isascii() and 1 <= int(text) <= 1000
    if ok:
        assert parse_search({"limit": raw}).limit == int(text)
    elif text.lower() in ABSENT_WORDS:
        assert parse_search({"limit": raw}).limit == 100
    else:
        with _pytest.raises(ArgumentError):
            parse_search({"limit": raw})

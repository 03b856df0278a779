import json

from conftest import bodies

from sawmill.operators.validate import (
    accepted_logs, ingest_summary, parse_ingest_bodies, rejected_entries, validate_entries,
)
from sawmill.schema import (
    REASON_ATTRIBUTES, REASON_FUTURE, REASON_LEVEL, REASON_MESSAGE, REASON_SERVICE, REASON_TIMESTAMP,
)

AS_OF = "2026-08-03T10:00:00Z"
GOOD = {"timestamp": "2026-08-03T09:59:00.000Z", "level": "info", "service": "checkout",
        "message": "created", "attributes": {"region": "eu-west", "n": 1, "ok": True, "x": None}}


def run(spark, *texts):
    df = bodies(spark, [(i, t) for i, t in enumerate(texts)])
    return validate_entries(parse_ingest_bodies(df), AS_OF)


def test_partial_acceptance(spark):
    bad = {"timestamp": "2026-08-03T10:30:00Z", "level": "error", "service": "checkout",
           "message": "", "attributes": {"nested": {"x": 1}}}
    v = run(spark, json.dumps([GOOD, bad]))
    assert accepted_logs(v).count() == 1
    (rej,) = rejected_entries(v).collect()
    assert rej["index"] == 1
    assert rej["reason"] == "; ".join([REASON_FUTURE, REASON_MESSAGE, REASON_ATTRIBUTES])
    (summary,) = ingest_summary(v).collect()
    assert (summary["accepted"], summary["rejected"], summary["outcome"]) == (1, 1, "ok")


def test_bad_time_and_level(spark):
    e = dict(GOOD, timestamp="not-a-date", level="verbose")
    (rej,) = rejected_entries(run(spark, json.dumps({"entries": [e]}))).collect()
    assert rej["reason"] == f"{REASON_TIMESTAMP}; {REASON_LEVEL}"


def test_blank_service_and_array_attributes(spark):
    e = dict(GOOD, service=" \u00a0\ufeff\u2028", attributes=["a"])
    (rej,) = rejected_entries(run(spark, json.dumps({"logs": [e]}))).collect()
    assert rej["reason"] == f"{REASON_SERVICE}; {REASON_ATTRIBUTES}"


def test_types_are_checked_not_coerced(spark):
    e = dict(GOOD, timestamp=1700000000, service=5, message=["m"], level="INFO", attributes=None)
    (rej,) = rejected_entries(run(spark, json.dumps([e]))).collect()
    assert rej["reason"] == "; ".join(
        [REASON_TIMESTAMP, REASON_LEVEL, REASON_MESSAGE, REASON_SERVICE, REASON_ATTRIBUTES])


def test_non_object_entry_counts_as_empty(spark):
    v = run(spark, '[5, null, "a"]')
    reasons = [r["reason"] for r in rejected_entries(v).orderBy("index").collect()]
    assert reasons == ["; ".join([REASON_TIMESTAMP, REASON_LEVEL, REASON_MESSAGE, REASON_SERVICE])] * 3


def test_future_boundary_is_strict(spark):
    at = dict(GOOD, timestamp="2026-08-03T10:05:00Z")
    past = dict(GOOD, timestamp="2026-08-03T10:05:00.000001Z")
    v = run(spark, json.dumps([at, past]))
    assert [r["index"] for r in accepted_logs(v).collect()] == [0]


def test_missing_attributes_become_empty_object(spark):
    e = {k: v for k, v in GOOD.items() if k != "attributes"}
    (row,) = accepted_logs(run(spark, json.dumps([e]))).collect()
    assert row["attributes"] == "{}"


def test_envelopes_and_bad_bodies(spark):
    texts = ["[]", '{"entries":[]}', '{"entries":5,"logs":[{}]}',
             '{"entries":null,"logs":[' + json.dumps(GOOD) + "]}", '{"x":1}', "{broken",
             '{"data":[' + json.dumps(GOOD) + '],"items":5}', '{"items":[' + json.dumps(GOOD) + "]}",
             '"just text"', '{"entries":[{"level":"warn","level":"info","timestamp":"2026-08-03T09:00:00Z",'
             '"service":"a","message":"dup keys, last wins"}]}', "", " null", "5", ' \n [{"a":1}]']
    out = {r["body_id"]: (r["accepted"], r["rejected"], r["outcome"])
           for r in ingest_summary(run(spark, *texts)).collect()}
    assert out == {
        0: (0, 0, "all_rejected"), 1: (0, 0, "all_rejected"), 2: (0, 0, "invalid_body"),
        3: (1, 0, "ok"), 4: (0, 0, "invalid_body"), 5: (0, 0, "malformed_json"),
        6: (1, 0, "ok"), 7: (1, 0, "ok"), 8: (0, 0, "malformed_json"), 9: (1, 0, "ok"),
        10: (0, 0, "invalid_body"), 11: (0, 0, "malformed_json"), 12: (0, 0, "malformed_json"),
        13: (0, 1, "all_rejected")}


def test_accepted_plus_rejected_equals_entries(spark):
    from conftest import SF_SMALL
    from sawmill.sources.fixtures import AS_OF as FX_AS_OF, ingest_bodies
    v = validate_entries(parse_ingest_bodies(ingest_bodies(spark, SF_SMALL)), FX_AS_OF)
    total = v.where("index IS NOT NULL").count()
    assert accepted_logs(v).count() + rejected_entries(v).count() == total == 1000


def test_rejected_entry_keeps_original(spark):
    e = dict(GOOD, level="verbose")
    (rej,) = rejected_entries(run(spark, json.dumps([e]))).collect()
    assert json.loads(rej["entry"]) == e


def test_strict_storage_quarantines_unstorable_entries(spark):
    from sawmill.schema import REASON_NUL, REASON_SERVICE_LENGTH
    long_service = dict(GOOD, service="s" * 256)
    nul_message = dict(GOOD, message="a\u0000b")
    nul_attr = dict(GOOD, attributes={"k": "x\u0000"})
    ok = dict(GOOD, service="s" * 255)
    body = json.dumps([long_service, nul_message, nul_attr, ok])
    lenient = run(spark, body)
    assert accepted_logs(lenient).count() == 4
    df = bodies(spark, [(0, body)])
    strict = validate_entries(parse_ingest_bodies(df), AS_OF, strict_storage=True)
    reasons = {r["index"]: r["reason"] for r in rejected_entries(strict).collect()}
    assert reasons == {0: REASON_SERVICE_LENGTH, 1: REASON_NUL, 2: REASON_NUL}


def test_iso_time_without_seconds_is_valid(spark):
    e = dict(GOOD, timestamp="2026-08-03T09:30Z")
    (row,) = accepted_logs(run(spark, json.dumps([e]))).collect()
    assert row["timestamp"].isoformat() == "2026-08-03T09:30:00"

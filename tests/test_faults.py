"""Faults that lost or changed data once: retention at a mid-day cutoff, replays, number text, time text."""

import json

import pytest
from pyspark.sql import functions as F

from sawmill.functions.attrs import attrs_text
from sawmill.functions.cursor import decode_cursor_value
from sawmill.functions.times import parse_log_time, to_utc_naive
from sawmill.operators.quality import rollup_mismatches
from sawmill.plans.store import LogStore

AS_OF = "2024-03-10T12:00:00Z"


def body(spark, i, times):
    from sawmill.schema import BODIES
    entries = [{"timestamp": t, "level": "info", "service": "s", "message": f"{i}-{k}"} for k, t in enumerate(times)]
    return spark.createDataFrame([(i, json.dumps(entries))], BODIES)


@pytest.fixture()
def store(spark, tmp_path):
    got = LogStore(spark, str(tmp_path / "store"))
    got.ingest_batch(body(spark, 1, ["2024-03-08T09:00:00Z", "2024-03-09T11:00:00Z"]), 0, AS_OF)  # no survivor that day
    got.ingest_batch(body(spark, 2, ["2024-03-09T11:30:00Z", "2024-03-09T13:00:00Z", "2024-03-10T01:00:00Z"]), 1, AS_OF)
    return got


def messages(store):
    return sorted(r["message"] for r in store.logs().select("message").collect())


def test_retention_deletes_what_it_reports(store):
    assert store.run_retention(AS_OF, 1)["deleted"] == 3
    assert messages(store) == ["2-1", "2-2"]
    assert store.run_retention(AS_OF, 1)["deleted"] == 0
    assert messages(store) == ["2-1", "2-2"]


def test_a_failed_move_keeps_live_rows_and_the_next_run_ends_it(store, monkeypatch):
    move = LogStore._rename

    def fails(self, src, dst):
        if "/staged/" in src:
            raise IOError("no")
        move(self, src, dst)
    monkeypatch.setattr(LogStore, "_rename", fails)
    with pytest.raises(IOError):
        store.run_retention(AS_OF, 1)
    assert {"2-1", "2-2"} <= set(messages(store))
    monkeypatch.setattr(LogStore, "_rename", move)
    store.run_retention(AS_OF, 1)
    assert messages(store) == ["2-1", "2-2"]


def test_a_committed_batch_is_not_written_again(spark, store):
    before = sorted(map(tuple, store.logs().select("id", "message").collect()))
    again = store.ingest_batch(body(spark, 9, ["2024-03-10T02:00:00Z"]), 0, AS_OF)
    assert (again.batch_id, again.accepted, again.max_id) == (0, 2, 2)
    assert sorted(map(tuple, store.logs().select("id", "message").collect())) == before
    with pytest.raises(ValueError):
        store.ingest_batch(body(spark, 9, ["2024-03-10T02:00:00Z"]), 0, AS_OF, owner="another")
    store.compact_rollup()
    assert rollup_mismatches(store.logs(), store.rollup().drop("bucket_date")).count() == 0


NUMBERS = {"0.30000000000000004": "0.30000000000000004", "0.12345678901234568": "0.12345678901234568", "1e-16": "0." + "0" * 15 + "1",
           "5e-324": "0." + "0" * 323 + "5", "1e23": "1" + "0" * 23, "1.5e300": "15" + "0" * 299, "-2.50": "-2.5", "-0": "0", "1.0": "1", "12e-3": "0.012"}


def test_attribute_numbers_keep_their_digits(spark):
    from sawmill.functions.sql import register_sql_functions
    register_sql_functions(spark)
    df = spark.createDataFrame([(f'{{"k":{n}}}', want) for n, want in NUMBERS.items()], "attributes string, want string")
    for r in df.select("want", attrs_text("attributes")["k"].alias("got"), F.expr("logs_attributes_kv(attributes)[0]").alias("kv")).collect():
        assert r["got"] == r["want"]
        assert r["kv"] == f"1:k={r['got']}"


GOOD = {"2024-01-01": "2024-01-01 00:00:00", "2024-01-01T10:30Z": "2024-01-01 10:30:00", "2024-01-01 10:30:05.25+02:00": "2024-01-01 08:30:05.250000",
        "2024-01-31T24:00:00Z": "2024-02-01 00:00:00", "2024-02-28T24:00": "2024-02-29 00:00:00"}
BAD = ["12:30:45", "T12:30:45", "2024-01-01 00:00:00 Europe/Paris", "20240101", "2024-W01-1", "junk", "2024-13-01", "2024-01-01T25:00:00Z", ""]


def test_one_grammar_of_times(spark):
    df = spark.createDataFrame([(t,) for t in [*GOOD, *BAD]], "t string").select("t", parse_log_time("t").cast("string").alias("got"))
    got = {r["t"]: r["got"] for r in df.collect()}
    for t, want in GOOD.items():
        assert to_utc_naive(t).isoformat(" ")[:19] == want[:19] == got[t][:19]
    for t in BAD:
        assert got[t] is None
        with pytest.raises(ValueError):
            to_utc_naive(t)
    assert to_utc_naive("2024").isoformat() == "2024-01-01T00:00:00" and to_utc_naive("2024-03").month == 3
    assert decode_cursor_value("") is None


def test_retention_refuses_a_wrong_number(tmp_path):
    from sawmill.__main__ import main
    with pytest.raises(SystemExit):
        main(["retention", "--store", str(tmp_path), "--days", "0"])

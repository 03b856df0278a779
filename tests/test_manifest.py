"""The store over a manifest: listings, pruning, pages, compaction, retention, concurrent writers."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, bodies
from sawmill.operators.filters import search_logs
from sawmill.operators.paging import log_page
from sawmill.operators.quality import rollup_mismatches, visibility_report
from sawmill.plans import manifest
from sawmill.plans.manifest import Conflict, ManifestStore
from sawmill.session import work_dir
from sawmill.sources.fixtures import AS_OF, ingest_bodies

AT = "2024-03-10T12:00:00Z"


def body(spark, i, times):
    return bodies(spark, [(i, json.dumps([{"timestamp": t, "level": "info", "service": "s", "message": f"{i}-{k}"} for k, t in enumerate(times)]))])


def messages(df):
    return sorted(r["message"] for r in df.select("message").collect())


@pytest.fixture()
def store(spark):
    got = ManifestStore(spark, work_dir(spark, "manifest-test"))
    got.ingest_batch(body(spark, 1, ["2024-03-08T09:00:00Z", "2024-03-09T11:00:00Z"]), 0, AT)
    got.ingest_batch(body(spark, 2, ["2024-03-09T11:30:00Z", "2024-03-09T13:00:00Z", "2024-03-10T01:00:00Z"]), 1, AT)
    return got


def opened(df):
    return sorted(f.rsplit("log_date=", 1)[1][:10] for f in df.inputFiles())


def test_batches_replays_and_reports(spark):
    store = ManifestStore(spark, work_dir(spark, "manifest-test"))
    assert store.logs().count() == store.rollup().count() == 0 and store.compact_logs() is None and store.compact_rollup() is None
    all_ = ingest_bodies(spark, SF_SMALL).cache()
    store.ingest_batch(all_.where("body_id < 10"), 0, AS_OF)
    second = store.ingest_batch(all_.where("body_id >= 10"), 1, AS_OF)
    assert store.ingest_batch(all_.where("body_id >= 10"), 1, AS_OF) == second  # a committed batch is not written again
    assert sorted(r["id"] for r in store.logs().select("id").collect()) == list(range(1, second.max_id + 1))
    assert rollup_mismatches(store.logs(), store.rollup()).count() == 0
    report = visibility_report(store.commits(), store.logs()).collect()
    assert len(report) == 2 and all(r["accepted"] == r["visible"] for r in report)
    assert store.rejected().count() == 1000 - second.max_id


def test_a_batch_without_its_version_is_invisible_and_replayed(spark, store, monkeypatch):
    before = messages(store.logs())
    monkeypatch.setattr(ManifestStore, "_append", lambda self, *a, **b: (_ for _ in ()).throw(RuntimeError("driver lost")))
    with pytest.raises(RuntimeError):
        store.ingest_batch(body(spark, 3, ["2024-03-10T02:00:00Z"]), 2, AT)
    monkeypatch.undo()
    again = ManifestStore(spark, store.root)
    assert messages(again.logs()) == before and again.commits().count() == 2
    assert again.ingest_batch(body(spark, 3, ["2024-03-10T02:00:00Z"]), 2, AT).max_id == 6
    assert messages(again.logs()) == sorted([*before, "3-0"])


def test_readers_list_no_folder_and_open_only_the_days_asked_for(spark, store, monkeypatch):
    listed = []
    monkeypatch.setattr(ManifestStore, "_children", lambda self, path: listed.append(path) or [])
    day = store.logs("2024-03-10T00:00:00Z", "2024-03-11T00:00:00Z")
    assert opened(day) == ["2024-03-10"] and messages(day) == ["2-2"]
    assert opened(store.logs(until="2024-03-09T00:00:00Z")) == ["2024-03-08"]
    plan = store.logs("2024-03-10T00:00:00Z")._jdf.queryExecution().executedPlan().toString()
    assert "(1 paths)" in plan
    page = store.page(1)
    assert messages(page) == ["2-2"] and opened(page) == ["2024-03-09", "2024-03-09", "2024-03-10"]  # a second row: next_cursor
    assert not listed


def test_pages_walk_down_the_days(spark, store, monkeypatch):
    seen, cursor = [], None
    while True:
        rows = store.page(2, cursor).collect()
        seen += [r["message"] for r in rows]
        cursor = rows[0]["next_cursor"]
        if cursor is None:
            break
    assert seen == ["2-2", "2-1", "2-0", "1-1", "1-0"]
    some = lambda df: search_logs(df, q="2-")
    shown = ("id", "timestamp", "message", "next_cursor")
    assert store.page(2, None, some).select(*shown).collect() == log_page(some(store.logs()), 2).select(*shown).collect()
    none = store.page(5, None, lambda df: search_logs(df, q="nothing"))
    assert none.count() == 0
    # a filter whose page is full on the newest day opens no other
    assert opened(store.page(1, None, lambda df: df.where("message != '2-1'")))[-1] == "2024-03-10"
    with pytest.raises(ValueError):
        store.page(1, "junk")


def test_compaction_bounds_the_files_of_a_day(spark):
    store = ManifestStore(spark, work_dir(spark, "manifest-test"))
    for i in range(6):
        store.ingest_batch(body(spark, i, ["2024-03-09T00:30:00Z", f"2024-03-09T{10 + i}:00:00Z", "2024-03-10T01:00:00Z"]), i, AT)
    before, reader = sorted(store.logs().select("id", "message", "batch_id").collect()), store.logs()
    assert store.snapshot().of("logs").count() >= 12
    assert store.compact_logs(target_rows=6) is not None
    files = {r["day"].isoformat(): r["n"] for r in store.snapshot().of("logs").groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert files["2024-03-09"] <= 3 and files["2024-03-10"] <= 2
    assert sorted(store.logs().select("id", "message", "batch_id").collect()) == before
    assert sorted(reader.select("id", "message", "batch_id").collect()) == before  # planned before the compaction
    assert store.compact_logs(target_rows=6) is None
    store.ingest_batch(body(spark, 9, ["2024-03-09T05:00:00Z"]), 6, AT)
    assert store.logs().count() == len(before) + 1
    assert store.vacuum(keep=1) > 0 and sorted(store.logs().where("batch_id < 6").select("id", "message", "batch_id").collect()) == before


def test_rollup_compaction_rewrites_touched_days_only(spark, store):
    store.compact_rollup()
    first = {r["path"] for r in store.snapshot().of("rollup").collect()}
    assert store.snapshot().of("deltas").count() == 0 and len(first) == 3
    store.ingest_batch(body(spark, 3, ["2024-03-10T01:00:30Z"]), 2, AT)
    store.compact_rollup()
    second = {r["path"] for r in store.snapshot().of("rollup").collect()}
    assert len(first & second) == 2 and len(second) == 3
    assert rollup_mismatches(store.logs(), store.rollup().drop("bucket_date")).count() == 0
    store.vacuum(keep=1)
    assert rollup_mismatches(store.logs(), store.rollup().drop("bucket_date")).count() == 0


def test_the_packed_query_packs_and_folds_whenever_it_is_called(spark, tmp_path, monkeypatch):
    from sawmill.plans import catalog
    # batches are ranges of ids and each holds all three days: every day has small files to pack
    rows = [(i, f"2024-01-0{3 + i % 3}T{i % 24:02d}:30:00", i % 7, "view", 1.5, '{"k": 1}') for i in range(400)]
    (spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string")
     .select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")
     .write.parquet(f"{tmp_path}/events.parquet"))
    changes, append = [], ManifestStore._append

    def noted(self, kind, *a, **b):
        changes.append((self.root, kind))
        return append(self, kind, *a, **b)
    monkeypatch.setattr(ManifestStore, "_append", noted)
    stores = set()
    for _ in range(2):
        changes.clear()
        logs = catalog.queries()["manifest_logs_packed"](spark, str(tmp_path))
        kinds = [kind for _, kind in changes]
        assert kinds[-2:] == ["compact", "rollup"] and set(kinds[:-2]) == {"ingest"} and len(kinds) > 3
        packed = ManifestStore(spark, changes[-1][0])
        stores.add(packed.root)
        files = packed.snapshot()
        assert files.of("logs").count() == 3 and files.of("deltas").count() == 0 and files.of("rollup").count() == 3
        assert logs.count() == packed.commits().agg(F.sum("accepted")).first()[0] > 0
        assert rollup_mismatches(packed.logs(), packed.rollup().drop("bucket_date")).count() == 0
    # the other query that folds still has deltas of its own to fold
    changes.clear()
    catalog.queries()["manifest_rollup_compacted"](spark, str(tmp_path))
    assert changes[-1][1] == "rollup" and changes[-1][0] not in stores


def test_retention_is_one_version(spark, store):
    reader = store.logs()
    before = store.snapshot().version
    assert store.run_retention(AT, 1) == {"cutoff": "2024-03-09T12:00:00.000Z", "deleted": 3, "batches": 1}
    assert store.snapshot().version == before + 1
    assert messages(store.logs()) == ["2-1", "2-2"] and len(messages(reader)) == 5
    assert store.run_retention(AT, 1)["deleted"] == 0 and store.snapshot().version == before + 1
    store.run_retention(AT, 1, prune_rollup=True)
    assert rollup_mismatches(store.logs(), store.rollup().drop("bucket_date")).count() == 0
    for wrong in (0, True, "5"):
        with pytest.raises(ValueError):
            store.run_retention(AT, 1, wrong)


def test_bounded_deletes_end_where_retention_ends(spark, store):
    assert [store.delete_oldest(AT, 1, 2) for _ in range(3)] == [2, 1, 0]
    assert messages(store.logs()) == ["2-1", "2-2"]


def test_of_two_writers_that_replace_the_same_files_one_gives_up(spark, store, monkeypatch):
    gone = store.snapshot().of("logs")
    gone = spark.createDataFrame(gone.collect(), gone.schema)
    store.run_retention(AT, 1)
    with pytest.raises(Conflict):
        store._append("compact", None, gone)
    # a version number that is taken meanwhile: the next one is tried
    create, lost = ManifestStore._create, []

    def late(self, path, text):
        if not lost and path.endswith(".json"):
            lost.append(path)
            assert create(self, path, text.replace('"ingest"', '"other"'))
        return create(self, path, text)
    version = store.snapshot().version
    monkeypatch.setattr(ManifestStore, "_create", late)
    store.ingest_batch(body(spark, 3, ["2024-03-10T02:00:00Z"]), 2, AT)
    assert lost and store.snapshot().version == version + 2


def test_whole_lists_shorten_the_chain(spark, store, monkeypatch):
    monkeypatch.setattr(manifest, "CHECKPOINT", 3)
    for i in range(4):
        store.ingest_batch(body(spark, 10 + i, ["2024-03-10T02:00:00Z"]), 2 + i, AT)
    assert len(store.snapshot().chain) <= 3 and store.logs().count() == 9
    store.run_retention(AT, 1)
    store.vacuum(keep=2)
    assert len(store._numbers()) <= 5 and messages(store.logs())[-2:] == ["2-1", "2-2"]


def test_default_micro_batches_are_bounded(spark):
    import os
    from sawmill.streaming.ingest import stream_ingest_logs
    source = work_dir(spark, "bounded-source")
    for i in range(3):
        body(spark, i, ["2024-03-10T02:00:00Z"]).coalesce(1).write.mode("append").parquet(source)
    size = max(os.path.getsize(os.path.join(source, f)) for f in os.listdir(source) if f.endswith(".parquet"))
    root = work_dir(spark, "bounded-store")
    query = stream_ingest_logs(spark, source, root, f"{root}/_ck", as_of=AT, store_class=ManifestStore, max_bytes_per_trigger=size)
    query.awaitTermination(300)
    assert query.exception() is None
    store = ManifestStore(spark, root)
    assert store.commits().count() == 3 and store.logs().count() == 3

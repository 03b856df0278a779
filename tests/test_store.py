import json

import pytest

from pyspark.sql import functions as F

from conftest import SF_SMALL, bodies
from sawmill.operators.quality import rollup_mismatches, visibility_report
from sawmill.plans.runs import run_stream
from sawmill.plans.store import LogStore
from sawmill.session import work_dir
from sawmill.sources.fixtures import AS_OF, ingest_bodies

ENTRY = {"timestamp": "2024-01-20T12:00:00Z", "level": "info", "service": "a", "message": "m"}


def test_batches_commit_ids_and_replay(spark):
    store = LogStore(spark, work_dir(spark, "store-test"))
    all_bodies = ingest_bodies(spark, SF_SMALL).cache()
    first = store.ingest_batch(all_bodies.where("body_id < 10"), 0, AS_OF)
    second = store.ingest_batch(all_bodies.where("body_id >= 10"), 1, AS_OF)
    logs = store.logs()
    ids = sorted(r["id"] for r in logs.select("id").collect())
    assert ids == list(range(1, second.max_id + 1)) and first.max_id < second.max_id
    # replay of batch 1 rewrites its own directories: same rows, same ids
    store.ingest_batch(all_bodies.where("body_id >= 10"), 1, AS_OF)
    assert sorted(r["id"] for r in store.logs().select("id").collect()) == ids
    assert rollup_mismatches(store.logs(), store.rollup()).count() == 0
    report = visibility_report(store.commits(), store.logs()).collect()
    assert all(r["accepted"] == r["visible"] for r in report) and len(report) == 2
    assert store.rejected().count() == 1000 - len(ids)


def test_uncommitted_batch_is_invisible(spark):
    store = LogStore(spark, work_dir(spark, "store-test"))
    store.ingest_batch(bodies(spark, [(0, json.dumps([ENTRY]))]), 0, AS_OF)
    # batch 1 writes its data but "crashes" before the commit row
    spark.createDataFrame([(99, ENTRY["timestamp"])], "id long, t string").select(
        "id", F.col("t").cast("timestamp_ntz").alias("timestamp"), F.lit("info").alias("level"),
        F.lit("a").alias("service"), F.lit("m").alias("message"), F.parse_json(F.lit("{}")).alias("attributes"),
        F.lit("2024-01-20").cast("date").alias("log_date"),
    ).write.partitionBy("log_date").parquet(store.path("logs", 1))
    assert [r["id"] for r in store.logs().collect()] == [1]


def test_store_retention_drops_days_and_rewrites_boundary(spark):
    store = LogStore(spark, work_dir(spark, "store-test"))
    store.ingest_batch(ingest_bodies(spark, SF_SMALL), 0, AS_OF)
    before = store.logs().count()
    cutoff_rows = store.logs().where(F.col("timestamp") < F.lit("2024-01-21 12:00:00").cast("timestamp_ntz")).count()
    result = store.run_retention("2024-01-31T12:00:00Z", 10, 500)
    assert result["deleted"] == cutoff_rows and result["batches"] == cutoff_rows // 500 + 1
    after = store.logs()
    assert after.where(F.col("timestamp") < F.lit("2024-01-21 12:00:00").cast("timestamp_ntz")).count() == 0
    assert after.count() == before - cutoff_rows


def test_stream_ingest_matches_batch_validation(spark):
    store = run_stream(spark, SF_SMALL, files=3)
    commits = store.commits().collect()
    assert len(commits) == 3
    logs = store.logs()
    assert logs.count() == sum(c["accepted"] for c in commits)
    assert sorted(r["id"] for r in logs.select("id").collect()) == list(range(1, logs.count() + 1))
    assert rollup_mismatches(logs, store.rollup()).count() == 0


def test_rollup_compaction_generations(spark):
    store = LogStore(spark, work_dir(spark, "store-test"))
    all_bodies = ingest_bodies(spark, SF_SMALL).cache()
    store.ingest_batch(all_bodies.where("body_id < 8"), 0, AS_OF)
    store.ingest_batch(all_bodies.where("body_id >= 8 AND body_id < 15"), 1, AS_OF)
    before = sorted(store.rollup().collect())
    assert store.compact_rollup() == 1
    assert sorted(store.rollup().collect()) == before
    store.ingest_batch(all_bodies.where("body_id >= 15"), 2, AS_OF)
    assert rollup_mismatches(store.logs(), store.rollup()).count() == 0
    assert store.compact_rollup() == 2
    assert rollup_mismatches(store.logs(), store.rollup()).count() == 0


def test_text_body_stream(spark):
    import os
    from sawmill.streaming.ingest import stream_ingest_logs
    src = work_dir(spark, "text-src")
    with open(os.path.join(src, "part-0.txt"), "w") as fh:
        fh.write(json.dumps([ENTRY, dict(ENTRY, level="verbose")]) + "\n")
        fh.write('{"logs":[' + json.dumps(ENTRY) + "]}\n")
        fh.write("{broken\n")
    root = work_dir(spark, "text-store")
    q = stream_ingest_logs(spark, src, root, root + "/_ck", as_of=AS_OF, source_format="text")
    q.awaitTermination(300)
    store = LogStore(spark, root)
    (commit,) = store.commits().collect()
    assert (commit["accepted"], commit["rejected"]) == (2, 1)
    assert store.logs().count() == 2


def test_retention_rolls_forward_an_unfinished_swap(spark):
    store = LogStore(spark, work_dir(spark, "store-test"))
    store.ingest_batch(ingest_bodies(spark, SF_SMALL), 0, AS_OF)
    total = store.logs().count()
    # simulate a driver lost after staging and writing the intent, before any swap
    day_dir = store.path("logs", 0) + "/log_date=2024-01-21"
    staged = work_dir(spark, "stage-sim") + "/batch_id=0/log_date=2024-01-21"
    keep = store.logs().where("log_date = DATE'2024-01-21' AND timestamp >= TIMESTAMP_NTZ'2024-01-21 12:00:00'")
    kept = keep.count()
    dropped = store.logs().where("log_date = DATE'2024-01-21'").count() - kept
    keep.drop("batch_id", "log_date").write.parquet(staged)
    store._write_intent([(staged, day_dir)])
    store._finish_swaps()
    assert store.logs().count() == total - dropped
    assert not store._exists(store._intent_path())


def test_stream_replays_a_failed_batch_exactly_once(spark, monkeypatch):
    from sawmill.plans.runs import write_body_files
    from sawmill.streaming.ingest import stream_ingest_logs
    source = write_body_files(spark, SF_SMALL, files=3)
    root = work_dir(spark, "replay-store")
    real_commit = LogStore._commit
    failed = []

    def flaky_commit(self, result, as_of):
        if result.batch_id == 1 and not failed:
            failed.append(1)
            raise RuntimeError("driver lost before the commit row")
        real_commit(self, result, as_of)

    monkeypatch.setattr(LogStore, "_commit", flaky_commit)
    q = stream_ingest_logs(spark, source, root, root + "/_ck", as_of=AS_OF, max_files_per_trigger=1)
    with pytest.raises(Exception, match="driver lost before the commit row"):
        q.awaitTermination(300)
    assert failed
    store = LogStore(spark, root)
    assert [c["batch_id"] for c in store.commits().collect()] == [0]   # batch 1 wrote data, no commit
    visible_before = store.logs().count()
    # restart from the same checkpoint: batch 1 is replayed, then batch 2 runs
    q = stream_ingest_logs(spark, source, root, root + "/_ck", as_of=AS_OF, max_files_per_trigger=1)
    q.awaitTermination(300)
    assert q.exception() is None
    commits = store.commits().collect()
    assert sorted(c["batch_id"] for c in commits) == [0, 1, 2]
    logs = store.logs()
    n = logs.count()
    assert n > visible_before and n == sum(c["accepted"] for c in commits) == 652
    assert sorted(r["id"] for r in logs.select("id").collect()) == list(range(1, n + 1))
    assert rollup_mismatches(logs, store.rollup()).count() == 0


def test_kafka_record_shape(spark):
    from sawmill.sources.bodies import from_kafka_records
    rows = [(None, json.dumps([ENTRY]).encode(), "logs", 3, 17, None, 0)]
    records = spark.createDataFrame(
        rows, "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, "
              "timestampType int")
    (row,) = from_kafka_records(records).collect()
    assert row["body_id"] == (3 << 40) + 17 and json.loads(row["value"]) == [ENTRY]


def test_commit_in_progress_is_not_visible(spark):
    import os
    store = LogStore(spark, work_dir(spark, "store-test"))
    store.ingest_batch(bodies(spark, [(0, json.dumps([ENTRY]))]), 0, AS_OF)
    store.ingest_batch(bodies(spark, [(1, json.dumps([ENTRY, ENTRY]))]), 1, AS_OF)
    # a third batch whose commit write has only task output under _temporary so far
    pending = store.path("commits", 2).replace("file:", "") + "/_temporary/0"
    os.makedirs(pending)
    open(os.path.join(pending, "part-00000.parquet"), "w").close()
    assert store._committed_upto() == 1
    assert store.logs().count() == 3


def test_retention_is_idempotent_and_rollup_pruning_is_opt_in(spark):
    from pyspark.sql import functions as F
    store = LogStore(spark, work_dir(spark, "store-test"))
    store.ingest_batch(ingest_bodies(spark, SF_SMALL), 0, AS_OF)
    total = store.rollup().agg(F.sum("count")).first()[0]
    expired = store.logs().where(F.col("timestamp") < F.lit("2024-01-21 00:00:00").cast("timestamp_ntz")).count()
    first = store.run_retention(AS_OF, 10, 500)
    assert first["deleted"] == expired > 0
    # the rollup still counts the deleted logs (reference behavior)
    assert store.rollup().agg(F.sum("count")).first()[0] == total
    again = store.run_retention(AS_OF, 10, 500)
    assert (again["deleted"], again["batches"]) == (0, 1)
    store.run_retention(AS_OF, 10, 500, prune_rollup=True)
    kept = store.rollup()
    assert kept.where(F.col("bucket_start") < F.lit("2024-01-21 00:00:00").cast("timestamp_ntz")).count() == 0
    assert kept.agg(F.sum("count")).first()[0] == store.logs().count()


def test_batch_body_readers_feed_ingest(spark):
    import os
    from sawmill.sources.bodies import read_bodies
    folder = work_dir(spark, "batch-src")
    bodies(spark, [(7, json.dumps([ENTRY])), (8, '{"logs":[' + json.dumps(ENTRY) + "]}")]) \
        .write.parquet(folder + "/parquet")
    os.makedirs(folder.replace("file:", "") + "/text")
    with open(folder.replace("file:", "") + "/text/part-0.txt", "w") as fh:
        fh.write(json.dumps([ENTRY, ENTRY]) + "\n" + "{broken\n")
    store = LogStore(spark, work_dir(spark, "batch-store"))
    first = store.ingest_batch(read_bodies(spark, folder + "/parquet"), 0, AS_OF)
    second = store.ingest_batch(read_bodies(spark, folder + "/text", "text"), 1, AS_OF)
    assert (first.accepted, second.accepted, second.max_id) == (2, 2, 4)
    assert sorted(r["body_id"] for r in read_bodies(spark, folder + "/parquet").collect()) == [7, 8]


def test_retention_never_touches_an_in_flight_batch(spark):
    import os
    from pyspark.sql import functions as F
    store = LogStore(spark, work_dir(spark, "store-test"))
    old = dict(ENTRY, timestamp="2024-01-02T12:00:00Z")
    recent = dict(ENTRY, timestamp="2024-01-25T12:00:00Z")
    store.ingest_batch(bodies(spark, [(0, json.dumps([old, recent]))]), 0, AS_OF)
    # batch 1 is still writing (no commit row yet) and holds an expired row too
    spark.createDataFrame([(9, "2024-01-02 13:00:00")], "id long, t string").select(
        "id", F.col("t").cast("timestamp_ntz").alias("timestamp"), F.lit("info").alias("level"),
        F.lit("a").alias("service"), F.lit("m").alias("message"), F.parse_json(F.lit("{}")).alias("attributes"),
        F.lit("2024-01-02").cast("date").alias("log_date"),
    ).write.partitionBy("log_date").parquet(store.path("logs", 1))
    result = store.run_retention(AS_OF, 10, 500)
    assert result["deleted"] == 1                      # only the committed expired row
    in_flight = store.path("logs", 1).replace("file:", "") + "/log_date=2024-01-02"
    assert os.path.isdir(in_flight) and any(f.endswith(".parquet") for f in os.listdir(in_flight))
    assert [r["timestamp"].isoformat() for r in store.logs().collect()] == ["2024-01-25T12:00:00"]


def test_body_files_grow_in_number_with_the_events(spark, monkeypatch):
    from sawmill.plans import runs
    monkeypatch.setattr(runs, "EVENTS_PER_FILE", 200)
    bodies = spark.read.parquet(runs.write_body_files(spark, SF_SMALL, files=3))
    sizes = [r["count"] for r in bodies.groupBy("_metadata.file_path").count().collect()]
    assert len(sizes) > 3 and max(sizes) * 50 <= 2 * 200
    assert sorted(bodies.collect()) == sorted(ingest_bodies(spark, SF_SMALL).collect())
    store = run_stream(spark, SF_SMALL, files=3)
    assert store.commits().count() == 3
    assert rollup_mismatches(store.logs(), store.rollup()).count() == 0
    monkeypatch.setattr(runs, "FILES_PER_BATCH", 1)
    assert run_stream(spark, SF_SMALL, files=3).commits().count() == len(sizes)


def test_a_cached_batch_keeps_only_what_its_outputs_take(spark):
    from sawmill.operators import validate as V
    rows = [(0, json.dumps([ENTRY, dict(ENTRY, level="verbose"), dict(ENTRY, attributes={"a": 1}), 5])), (1, "{broken"), (2, "[]"), (3, None)]
    whole = V.validate_entries(V.parse_ingest_bodies(bodies(spark, rows), keep_bad=True), AS_OF)
    kept = V.kept_fields(whole)
    for output in (V.accepted_logs, V.rejected_entries, V.body_outcomes):
        assert sorted(map(str, output(kept).collect())) == sorted(map(str, output(whole).collect()))
    assert kept.where("size(errors) = 0").count() == 2
    assert kept.where("size(errors) = 0 AND (entry IS NOT NULL OR reason IS NOT NULL)").count() == 0
    assert kept.where("size(errors) > 0 AND (_message IS NOT NULL OR _attrs IS NOT NULL)").count() == 0

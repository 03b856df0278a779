import json

from conftest import bodies
from sawmill.plans.store import LogStore
from sawmill.session import work_dir
from sawmill.sources.bodies import read_bodies
from sawmill.sources.fixtures import AS_OF
from sawmill.streaming.ingest import stream_ingest_logs

ROW = {"timestamp": "2024-01-20T08:15:00Z", "level": "warn", "service": "billing", "message": "slow reply"}


def _outcomes(store):
    return {r["body_id"]: (r["accepted"], r["rejected"], r["outcome"], r["body"]) for r in store.bodies().collect()}


def test_every_body_keeps_an_outcome_and_bad_ones_their_text(spark):
    store = LogStore(spark, work_dir(spark, "bodies-test"))
    given = [(1, json.dumps([ROW, {}])), (2, "[{"), (3, '{"rows": 1}'), (4, None), (5, "[]"), (6, json.dumps([{}]))]
    store.ingest_batch(bodies(spark, given), 0, AS_OF)
    assert _outcomes(store) == {
        1: (1, 1, "ok", None), 2: (0, 0, "malformed_json", "[{"), 3: (0, 0, "invalid_body", '{"rows": 1}'),
        4: (0, 0, "invalid_body", None), 5: (0, 0, "all_rejected", None), 6: (0, 1, "all_rejected", None)}
    assert store.logs().count() == 1 and store.rejected().count() == 2


def test_whole_file_bodies(spark, tmp_path):
    for name, text in (("a", json.dumps([ROW, ROW], indent=2)), ("b", "[\n")):
        (tmp_path / name).write_text(text)
    assert read_bodies(spark, str(tmp_path), "wholetext").count() == 2
    root = work_dir(spark, "bodies-test")
    query = stream_ingest_logs(spark, str(tmp_path), root, f"{root}/_checkpoint", as_of=AS_OF, source_format="wholetext")
    query.awaitTermination()
    store = LogStore(spark, root)
    assert sorted(o[2] for o in _outcomes(store).values()) == ["malformed_json", "ok"]
    assert store.logs().count() == 2

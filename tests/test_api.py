import pytest

from sawmill.functions.cursor import decode_cursor_value
from sawmill.operators.rollup import minute_rollup
from sawmill.plans.api import aggregate, search
from sawmill.plans.args import ArgumentError


def test_search_pages_through_filters(small_logs):
    params = {"service": "svc-1", "level": "null", "limit": "7", "q": "", "attr.type": "undefined"}
    first = search(small_logs, params).collect()
    assert len(first) == 7 and all(r["service"] == "svc-1" for r in first)
    assert first[0]["timestamp"].endswith("Z") and isinstance(first[0]["id"], str)
    token = first[-1]["next_cursor"]
    assert decode_cursor_value(token)[1] == int(first[-1]["id"])
    second = search(small_logs, dict(params, cursor=token)).collect()
    assert int(second[0]["id"]) != int(first[-1]["id"])
    assert second[0]["timestamp"] <= first[-1]["timestamp"]


def test_search_rejects_bad_arguments(small_logs):
    with pytest.raises(ArgumentError) as err:
        search(small_logs, {"limit": "0", "since": "yesterday"})
    assert len(err.value.errors) == 2


def test_aggregate_routes_and_renders(small_logs):
    rollup = minute_rollup(small_logs)
    base = {"since": "2024-01-01T00:00:00Z", "until": "2024-02-01T00:00:00Z", "bucket": "1d"}
    by_level = aggregate(small_logs, rollup, dict(base, group_by="level")).collect()
    assert sum(r["count"] for r in by_level) == small_logs.count()
    raw = aggregate(small_logs, rollup, dict(base, q="purchase")).collect()
    assert sum(r["count"] for r in raw) == small_logs.where("message ILIKE '%purchase%'").count()
    assert all(r["group"] is None for r in raw)


def test_command_line_round_trip(spark, capsys):
    import json as _json

    from conftest import SF_SMALL
    from sawmill.__main__ import main
    from sawmill.plans.runs import write_body_files
    from sawmill.session import work_dir
    source = write_body_files(spark, SF_SMALL, files=2)
    store = work_dir(spark, "cli-store")
    assert main(["ingest", "--store", store, "--source", source]) == 0
    assert main(["search", "--store", store, "limit=3", "level=error"]) == 0
    assert main(["aggregate", "--store", store, "since=2024-01-01T00:00:00Z", "until=2024-02-01T00:00:00Z",
                 "bucket=1d"]) == 0
    assert main(["compact", "--store", store]) == 0
    assert main(["retention", "--store", store, "--days", "10", "--batch-size", "500",
                 "--as-of", "2024-01-31T00:00:00Z"]) == 0
    lines = [_json.loads(x) for x in capsys.readouterr().out.splitlines()]
    pages = [x for x in lines if "message" in x]
    assert len(pages) == 3 and all(x["level"] == "error" for x in pages)
    assert lines[-1]["cutoff"] == "2024-01-21T00:00:00.000Z"


def test_module_entry_point_help():
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-m", "sawmill", "--help"], cwd=root, capture_output=True,
                         text=True, timeout=120)
    assert out.returncode == 0
    for command in ("ingest", "search", "aggregate", "retention", "compact"):
        assert command in out.stdout

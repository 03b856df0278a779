"""Attribute statistics against a brute-force count, and sketches against the exact numbers."""

import json
from collections import Counter, defaultdict

import pytest

from sawmill.operators.attr_stats import attr_estimates, attr_sketches, attr_statistics, attr_top_values, merge_attr_sketches

LOGS = "id long, batch_id long, attributes string"


def rows():
    out = [(i, i % 3, json.dumps({"user": i % 700, "hot": "x" if i % 3 else "yy", "zone": "a=b" if i % 7 else None})) for i in range(3000)]
    return [*out, (3000, 0, "{}"), (3001, 0, None), (3002, 1, "[1]"), (3003, 1, '{"none": null}'), (3003, 1, '{"none": null, "rare": true}')]


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(rows(), LOGS).repartition(4)


def brute():
    values = defaultdict(Counter)
    for _, _, text in rows():
        doc = json.loads(text or "{}")
        for k, v in (doc.items() if isinstance(doc, dict) else ()):
            values[k][v if v is None or isinstance(v, str) else json.dumps(v)] += 1
    return values


def test_statistics_equal_brute_force(logs):
    got = {r["key"]: r for r in attr_statistics(logs).collect()}
    top = defaultdict(list)
    for r in attr_top_values(logs, top=3).orderBy("key", "rank").collect():
        top[r["key"]].append((r["value"], r["n"]))
    want = brute()
    assert set(got) == set(want)
    for key, counts in want.items():
        named = sorted(((v, n) for v, n in counts.items() if v is not None), key=lambda x: (-x[1], x[0]))
        assert (got[key]["n_logs"], got[key]["n_values"]) == (sum(counts.values()), len(named))
        assert top[key] == named[:3]


def test_merged_sketches_stay_within_their_bounds(logs):
    per_batch = attr_sketches(logs, "batch_id")
    assert per_batch.select("batch_id", "key").distinct().count() == per_batch.count()
    want = brute()
    for sketches in (merge_attr_sketches(per_batch), attr_sketches(logs)):
        got = {r["key"]: r for r in attr_estimates(sketches).collect()}
        assert set(got) == set(want)
        for key, counts in want.items():
            n, named = sum(counts.values()), {v: c for v, c in counts.items() if v is not None}
            assert got[key]["n_logs"] == n
            assert abs(got[key]["n_values"] - len(named)) <= 0.04 * len(named)
            for x in got[key]["top_values"] or []:
                if x["item"] is not None:
                    assert abs(x["count"] - named[x["item"]]) <= n / 1000 + 1


def test_no_logs(spark):
    none = spark.createDataFrame([], LOGS)
    assert attr_statistics(none).count() == 0
    assert attr_estimates(merge_attr_sketches(attr_sketches(none, "batch_id"))).count() == 0


def test_top_values_are_cut_before_the_shuffle(logs):
    plan = attr_top_values(logs)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan

"""Plan assertions: pushdown, pruning, top-k, no whole-table single-partition work."""

from conftest import SF_SMALL

from sawmill.operators.aggregate import aggregate_raw
from sawmill.operators.filters import search_logs
from sawmill.operators.paging import after_cursor, log_page
from sawmill.plans.store import LogStore
from sawmill.session import work_dir
from sawmill.sources.fixtures import AS_OF, ingest_bodies


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(small_logs):
    p = plan(search_logs(small_logs, since="2024-01-05T00:00:00Z", until="2024-01-08T00:00:00Z"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in p and "LessThan(ts," in p


def test_keyset_cursor_pushes_down(small_logs):
    p = plan(after_cursor(small_logs, "2024-01-15T00:00:00Z", 5))
    assert "LessThanOrEqual(ts," in p


def test_page_is_top_k_not_full_sort(small_logs):
    p = plan(log_page(small_logs, 100))
    assert "TakeOrderedAndProject" in p
    assert "Exchange SinglePartition" not in p


def test_bucket_count_reads_only_needed_columns(small_logs):
    p = plan(aggregate_raw(small_logs, "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z", "1h", "level"))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in p
    assert "partial_count" in p


def test_store_search_prunes_day_partitions(spark):
    store = LogStore(spark, work_dir(spark, "plan-store"))
    store.ingest_batch(ingest_bodies(spark, SF_SMALL), 0, AS_OF)
    df = search_logs(store.logs(), since="2024-01-05T00:00:00Z", until="2024-01-06T00:00:00Z")
    p = plan(df)
    partition_filters = p.split("PartitionFilters: ")[1].split(", PushedFilters")[0]
    assert "(log_date#" in partition_filters and "(batch_id#" in partition_filters
    assert df.count() == df.where("log_date >= '2024-01-05' AND log_date <= '2024-01-06'").count()


def test_store_page_probes_newest_days_only(spark):
    from pyspark.sql import functions as F
    from sawmill.operators.paging import newest_days
    store = LogStore(spark, work_dir(spark, "plan-store"))
    store.ingest_batch(ingest_bodies(spark, SF_SMALL), 0, AS_OF)
    logs = store.logs()
    page = [r["id"] for r in log_page(logs, 100).collect()]
    whole = [r["id"] for r in logs.orderBy(F.desc("timestamp"), F.desc("id")).limit(100).collect()]
    assert page == whole
    probed = newest_days(logs, 101)
    days = probed.select("log_date").distinct().count()
    assert days < logs.select("log_date").distinct().count()
    assert "(log_date#" in plan(probed).split("PartitionFilters: ")[1].split(", PushedFilters")[0]


def test_time_bounded_rollup_prunes_compacted_days(spark):
    from sawmill.operators.aggregate import aggregate_rollup
    store = LogStore(spark, work_dir(spark, "plan-store"))
    store.ingest_batch(ingest_bodies(spark, SF_SMALL), 0, AS_OF)
    store.compact_rollup()
    agg = aggregate_rollup(store.rollup(), "2024-01-05T00:00:00Z", "2024-01-06T00:00:00Z", "1h", "level")
    scans = [line for line in plan(agg).splitlines() if "FileScan" in line and "bucket_date#" in line]
    assert scans and any("(bucket_date#" in line.split("PartitionFilters: ")[1].split(", PushedFilters")[0]
                         for line in scans)
    assert agg.agg({"count": "sum"}).first()[0] == store.logs().where(
        "timestamp >= TIMESTAMP_NTZ'2024-01-05 00:00:00' AND timestamp < TIMESTAMP_NTZ'2024-01-06 00:00:00'").count()


def test_registered_query_plans_stay_distributed(spark):
    """No cartesian product or nested-loop join anywhere, and a window only over a bounded top-k."""
    from sawmill.plans import catalog
    bad = {}
    for name, build in catalog.queries().items():
        text = plan(build(spark, SF_SMALL))
        problems = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin") if w in text]
        if "Window [" in text and "TakeOrderedAndProject" not in text:
            problems.append("window over an unbounded input")
        if "Window [" in text and "Exchange SinglePartition" in text:
            problems.append("single-partition exchange feeding a window")
        if problems:
            bad[name] = problems
    assert bad == {}

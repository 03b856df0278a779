"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
  {"metric": "headline_total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query runs fully (``noop`` sink, so every row is produced but none is
collected); the time is the best of ``BENCH_REPEAT`` runs after one warm-up of
the session.  ``stream_ingest`` times the ``availableNow`` stream over the
body files (written beforehand) and also reports rows/s.  With
``BENCH_EVENT_LOG=<dir>`` Spark's event log (stage and task times) goes there.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sawmill.operators.aggregate import aggregate_rollup  # noqa: E402
from sawmill.operators.filters import search_logs  # noqa: E402
from sawmill.operators.paging import log_page  # noqa: E402
from sawmill.plans import catalog  # noqa: E402
from sawmill.plans.runs import write_body_files  # noqa: E402
from sawmill.plans.store import LogStore  # noqa: E402
from sawmill.session import build_session, work_dir  # noqa: E402
from sawmill.sources import fixtures as FX  # noqa: E402
from sawmill.streaming.ingest import stream_ingest_logs  # noqa: E402

HEADLINE = [
    "ingest_validated", "ingest_accepted", "ingest_ids",
    "search_combined", "filter_message", "filter_attrs",
    "latest_logs", "log_page_first", "log_page_next", "cursor_decode",
    "agg_1h_level", "agg_rollup_1h_service", "agg_exact_unaligned", "agg_raw_attrs",
    "minute_rollup", "rollup_mismatches",
    "retention_summary", "retention_after_batch",
]


def run_noop(df) -> None:
    df.write.mode("overwrite").format("noop").save()


def timed(fn, repeat: int) -> float:
    best = float("inf")
    for _ in range(repeat):
        t0 = time.perf_counter()
        fn()
        best = min(best, time.perf_counter() - t0)
    return best


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else None
    # spark.checkpoint.dir: taken from the session; sawmill makes a private one only when unset
    extra = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g")}
    if os.environ.get("BENCH_EVENT_LOG"):  # stage/task times without the UI: Spark's event log
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]})
    spark = build_session(f"local[{cpus}]", app="sawmill-bench", shuffle_partitions=max(2 * cpus, 4),
                          extra=extra)
    qs = catalog.queries()
    run_noop(qs["agg_1d"](spark, sf_dir))  # warm-up: JIT, parquet footers, codegen cache
    times: dict[str, float] = {}
    errors: dict[str, str] = {}

    def measure(name, fn):
        try:
            times[name] = round(timed(fn, repeat), 3)
        except Exception as exc:  # noqa: BLE001 - one failing query must not lose the line
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"

    for name in HEADLINE:
        measure(name, lambda: run_noop(qs[name](spark, sf_dir)))

    # streaming ingest: body files are written first; the stream alone is timed
    entries = FX.logs(spark, sf_dir).count()  # one ingest entry per event
    stored, stream_rate, store_queries = 0, None, {}
    try:
        source = write_body_files(spark, sf_dir, files=2 * cpus)
        root = work_dir(spark, "bench-store")
        t0 = time.perf_counter()
        q = stream_ingest_logs(spark, source, root, f"{root}/_checkpoint", as_of=FX.AS_OF,
                               max_files_per_trigger=cpus)
        q.awaitTermination(3600)
        stream_sec = time.perf_counter() - t0
        store = LogStore(spark, root)
        stored = store.logs().count()
        times["stream_ingest"] = round(stream_sec, 3)
        stream_rate = round(entries / stream_sec, 1)
        # the written store: page (newest-day probe), VARIANT attribute search, rollup aggregate
        store_queries = {
            "store_page": lambda: run_noop(log_page(store.logs(), 100)),
            "store_search_attrs": lambda: run_noop(search_logs(
                store.logs(), service="svc-3", attributes={"type": "error"})),
            "store_agg_rollup": lambda: run_noop(aggregate_rollup(
                store.rollup(), "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z", "1h", "level")),
        }
    except Exception as exc:  # noqa: BLE001
        errors["stream_ingest"] = f"{type(exc).__name__}: {str(exc)[:200]}"
    for name, fn in store_queries.items():
        measure(name, fn)

    total = round(sum(times.values()), 3)
    rates = {k: round(entries / v, 1) for k, v in times.items() if v > 0}  # input log rows per second
    rates.update({k: round(stored / times[k], 1) for k in store_queries if times.get(k)})  # stored rows/s
    print(json.dumps({
        "metric": "headline_total_sec", "value": total, "unit": "sec", "queries": times, "sf": sf,
        "cpus": cpus, "input_rows": entries, "rows_per_sec": rates,
        "stream_entries_per_sec": stream_rate, "stream_accepted_rows": stored,
        **({"errors": errors} if errors else {}),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

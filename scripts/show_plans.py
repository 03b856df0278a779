"""Writes PLANS.md: physical plans of the headline queries, with what to look for.

    python scripts/show_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from sawmill.operators.aggregate import aggregate_rollup  # noqa: E402
from sawmill.operators.filters import search_logs  # noqa: E402
from sawmill.operators.paging import log_page  # noqa: E402
from sawmill.plans import catalog  # noqa: E402
from sawmill.plans.runs import streamed_store  # noqa: E402
from sawmill.session import build_session  # noqa: E402

NOTES = {
    "search_combined": "every filter in PushedFilters; ReadSchema holds only the needed columns",
    "log_page_first": "late-materialized top-k: literal timestamp bound pushed, TakeOrderedAndProject, "
                      "windows only over the ≤101 fetched rows",
    "agg_1h_level": "partial_count → hash exchange → count; bucket floor inside codegen; 2-column scan",
    "agg_exact_unaligned": "two raw edge scans, each with literal time bounds; the rollup side is derived "
                           "from events in this registered query, so it scans them whole (a stored rollup "
                           "gets pushed bounds, see store_agg_rollup)",
    "retention_after_batch": "anti join against a broadcast of the bounded (LIMIT 500) id batch",
    "rollup_mismatches": "two aggregates on the key feed a full outer sort-merge join with no extra exchange",
    "ingest_accepted": "one parse of each body; Generate fence keeps the accepted filter above validation",
    "store_page": "stored logs: PartitionFilters on batch_id and log_date (newest days only)",
    "store_search_attrs": "stored VARIANT attributes: path lookups, no JSON parse; service pushed",
    "store_agg_rollup": "compacted rollup: PartitionFilters on bucket_date",
}


SCAN_PARTS = ("PartitionFilters: ", "PushedFilters: ", "ReadSchema: ")


def physical(df) -> str:
    """The plan, lines cut at 180 characters; a scan's filters and schema on lines of their own."""
    out = []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        out.append(line[:180])
        if "FileScan" in line:
            pad = " " * (len(line) - len(line.lstrip()) + 4)
            for part in SCAN_PARTS:
                if part in line:
                    value = line.split(part, 1)[1]
                    value = value.split(", " + SCAN_PARTS[SCAN_PARTS.index(part) + 1])[0] \
                        if part != SCAN_PARTS[-1] else value
                    out.append((pad + part + value)[:180])
    return "\n".join(out)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    qs = catalog.queries()
    frames = {name: qs[name](spark, sf_dir) for name in list(NOTES)[:7]}
    store = streamed_store(spark, sf_dir)
    store.compact_rollup()
    frames["store_page"] = log_page(store.logs(), 100)
    frames["store_search_attrs"] = search_logs(store.logs(), service="svc-3", attributes={"type": "error"})
    frames["store_agg_rollup"] = aggregate_rollup(store.rollup(), "2024-01-05T00:00:00Z",
                                                  "2024-01-06T00:00:00Z", "1h", "level")
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `scripts/show_plans.py` at `{os.path.basename(sf_dir)}` (initial adaptive plans; "
           "lines cut at 180 characters).", ""]
    for name, df in frames.items():
        out += [f"## {name}", "", f"Look for: {NOTES[name]}.", "", "```", physical(df), "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))


if __name__ == "__main__":
    main()

"""Request-level entry points: parameters in, rendered DataFrame out.

``search`` is ``GET /logs`` and ``aggregate`` is ``GET /logs/aggregate`` of the
reference, as DataFrame jobs over the store's tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sawmill.operators.aggregate import aggregate_logs, render_buckets
from sawmill.operators.filters import search_logs
from sawmill.operators.paging import log_page, render_logs
from sawmill.plans.args import parse_aggregate, parse_search


def search(logs: DataFrame, params: dict) -> DataFrame:
    """One rendered page of logs with ``next_cursor``."""
    req = parse_search(params)
    rows = search_logs(logs, req.service, req.level, req.since, req.until, req.q, req.attributes)
    return render_logs(log_page(rows, req.limit, req.cursor))


def aggregate(logs: DataFrame, rollup: DataFrame, params: dict) -> DataFrame:
    """Rendered buckets, routed to the rollup unless q or attribute filters are given."""
    req = parse_aggregate(params)
    return render_buckets(aggregate_logs(logs, rollup, req.since, req.until, req.bucket, req.group_by,
                                         req.service, req.level, req.q, req.attributes))

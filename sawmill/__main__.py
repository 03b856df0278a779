"""Command line: ``python -m sawmill <command> …`` (or ``spark-submit -m``-style runs).

    ingest     --store S --source DIR [--format parquet|json|text] [--files-per-trigger N] [--strict-storage]
    search     --store S [key=value …]            one rendered page as JSON lines
    aggregate  --store S key=value …             rendered buckets as JSON lines, or --out DIR (Parquet)
    retention  --store S [--days 30] [--batch-size 5000] [--as-of ISO]
    compact    --store S                          fold committed rollup deltas into a new generation

``key=value`` pairs are the request parameters (``service``, ``level``,
``since``, ``until``, ``q``, ``limit``, ``cursor``, ``attr.<key>``,
``bucket``, ``group_by``).  The session comes from ``spark-submit`` or a
local default; ``spark.checkpoint.dir`` is taken from it.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from sawmill.session import build_session


def _params(pairs: list[str]) -> dict[str, str]:
    out = {}
    for pair in pairs:
        key, sep, value = pair.partition("=")
        if not sep:
            raise SystemExit(f"expected key=value, got {pair!r}")
        out[key] = value
    return out


def _print_rows(df) -> None:
    for row in df.toLocalIterator():  # a page or a bucket list, streamed partition by partition
        print(json.dumps(row.asDict(), default=str))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sawmill")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("ingest")
    p.add_argument("--store", required=True)
    p.add_argument("--source", required=True)
    p.add_argument("--format", default="parquet", choices=("parquet", "json", "text"))
    p.add_argument("--files-per-trigger", type=int, default=None)
    p.add_argument("--strict-storage", action="store_true")
    for name in ("search", "aggregate"):
        p = sub.add_parser(name)
        p.add_argument("--store", required=True)
        p.add_argument("--out", default=None)
        p.add_argument("params", nargs="*")
    p = sub.add_parser("retention")
    p.add_argument("--store", required=True)
    p.add_argument("--days", type=int, default=None)
    p.add_argument("--batch-size", type=int, default=None)
    p.add_argument("--as-of", default=None)
    p = sub.add_parser("compact")
    p.add_argument("--store", required=True)
    args = parser.parse_args(argv)

    spark = build_session()
    from sawmill.plans.api import aggregate, search
    from sawmill.plans.args import retention_settings
    from sawmill.plans.store import LogStore
    store = LogStore(spark, args.store)

    if args.command == "ingest":
        from sawmill.streaming.ingest import stream_ingest_logs
        query = stream_ingest_logs(spark, args.source, args.store, f"{args.store.rstrip('/')}/_checkpoint",
                                   max_files_per_trigger=args.files_per_trigger,
                                   source_format=args.format, strict_storage=args.strict_storage)
        query.awaitTermination()
        print(json.dumps({"batches": store.commits().count()}))
    elif args.command in ("search", "aggregate"):
        params = _params(args.params)
        df = search(store.logs(), params) if args.command == "search" else \
            aggregate(store.logs(), store.rollup(), params)
        if args.out:
            df.write.mode("overwrite").parquet(args.out)
        else:
            _print_rows(df)
    elif args.command == "retention":
        for name, value in (("--days", args.days), ("--batch-size", args.batch_size)):
            if value is not None and value < 1:  # a destructive command takes no default for a wrong value
                raise SystemExit(f"retention: {name} must be at least 1")
        days, batch = retention_settings({"LOG_RETENTION_DAYS": args.days or "",
                                          "RETENTION_DELETE_BATCH_SIZE": args.batch_size or ""})
        as_of = args.as_of or datetime.now(timezone.utc).isoformat()
        print(json.dumps(store.run_retention(as_of, days, batch)))
    elif args.command == "compact":
        print(json.dumps({"rollup_upto": store.compact_rollup()}))
    return 0


if __name__ == "__main__":
    sys.exit(main())

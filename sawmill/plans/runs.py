"""End-to-end runs used by registered queries and the bench.

``streamed_store`` writes the ingest bodies derived from ``events`` as
JSON-lines envelope files, runs the ingest stream over them with
``availableNow`` (several micro-batches), and returns the resulting store.
All paths live below the session's checkpoint root.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from sawmill.plans.store import LogStore
from sawmill.session import work_dir
from sawmill.sources import fixtures as FX
from sawmill.sources.tables import read_table
from sawmill.streaming.ingest import stream_ingest_logs

SOURCE_FILES = 4  # at least
EVENTS_PER_FILE = 31_250  # about 5 MB of bodies, which one task reads and parses: several tasks a core keep all cores busy
FILES_PER_BATCH = 512  # at most: what a micro-batch caches is bounded
_RUNS: dict[tuple[str, str, str], str] = {}


def source_files(spark: SparkSession, sf_dir: str, files: int = SOURCE_FILES) -> int:
    """``files``, or the next multiple of it that leaves at most ``EVENTS_PER_FILE`` events to a file."""
    return files * max(1, -(-read_table(spark, sf_dir, "events").count() // (files * EVENTS_PER_FILE)))


def write_body_files(spark: SparkSession, sf_dir: str, files: int = SOURCE_FILES, bodies=FX.ingest_bodies) -> str:
    """Envelope records of the whole ``events`` table as Parquet files, ranges of ``body_id``.

    ``files`` of them, more where they would get large: each is written by one task and read by one.
    """
    source = work_dir(spark, "bodies")
    bodies(spark, sf_dir, ranges=source_files(spark, sf_dir, files)).write.mode("overwrite").parquet(source)
    return source


def run_stream(spark: SparkSession, sf_dir: str, files: int = SOURCE_FILES,
               files_per_trigger: int = 1, bodies=FX.ingest_bodies, store_class: type[LogStore] = LogStore) -> LogStore:
    """A store streamed from ``write_body_files``; a micro-batch takes ``files_per_trigger`` of ``files`` parts of the files."""
    source = write_body_files(spark, sf_dir, files, bodies)
    root = work_dir(spark, "store")
    each = min(files_per_trigger * source_files(spark, sf_dir, files) // files, FILES_PER_BATCH)
    query = stream_ingest_logs(spark, source, root, f"{root}/_checkpoint", as_of=FX.AS_OF,
                               max_files_per_trigger=each, store_class=store_class)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return store_class(spark, root)


def streamed_store(spark: SparkSession, sf_dir: str, tag: str = "shared", store_class: type[LogStore] = LogStore) -> LogStore:
    """One streamed store per (application, input, tag) — reused across queries.

    Queries that change a store (retention) use their own tag.
    """
    key = (spark.sparkContext.applicationId, sf_dir, tag)
    if key not in _RUNS:
        _RUNS[key] = run_stream(spark, sf_dir, store_class=store_class).root
    return store_class(spark, _RUNS[key])

"""The log store on plain Parquet: batches that become visible together.

Layout below ``root``::

    logs/batch_id=N/log_date=D/*.parquet      raw rows with dense ids
    deltas/batch_id=N/*.parquet               minute-rollup counts of batch N
    rollup/upto=N/bucket_date=D/*.parquet     compacted rollup of batches ≤ N
    rejected/batch_id=N/*.parquet             quarantined entries with reasons
    bodies/batch_id=N/*.parquet               outcome of every body, and the text of bad ones
    commits/batch_id=N/*.parquet              one row per finished batch, written last

A batch overwrites only its own ``batch_id=N`` directories, so a replay after a
failure (same N, same input, same id base) rewrites exactly what the failed
attempt may have left.  Readers see batches up to the newest commit; micro-batch
N+1 never starts before N has committed, so anything newer is in flight.

Everything data-sized runs on executors: validation, id assignment, the rollup
aggregate and the writes.  The driver touches only the commits table (one row
per batch) and per-partition counts.  With a MERGE/DELETE-capable table format
the commit marker and the retention rewrite each become one statement.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sawmill.functions.times import iso_text, to_utc_naive, ts_literal
from sawmill.operators.ids import assign_arrival_ids, partition_counts
from sawmill.operators.retention import check_positive, retain_rollup, retention_cutoff
from sawmill.operators.rollup import minute_rollup
from sawmill.operators.validate import (
    accepted_logs, body_outcomes, kept_fields, parse_ingest_bodies, rejected_entries, validate_entries,
)
from sawmill.sources.bodies import with_body_ids
from sawmill.schema import COMMITS, DEFAULT_RETENTION_BATCH, DEFAULT_RETENTION_DAYS, LOGS, ROLLUP
from sawmill.session import configure, work_dir

# Stored logs keep ``attributes`` as a VARIANT: parsed once at ingest, read by
# attribute filters without re-parsing JSON text on every query.
STORED_LOGS = T.StructType([
    f if f.name != "attributes" else T.StructField("attributes", T.VariantType(), False) for f in LOGS.fields])
_PARTITIONED_LOGS = T.StructType(STORED_LOGS.fields + [
    T.StructField("batch_id", T.LongType()), T.StructField("log_date", T.DateType())])
_PARTITIONED_ROLLUP = T.StructType(ROLLUP.fields + [T.StructField("batch_id", T.LongType())])
_ROLLUP_GENERATION = T.StructType(ROLLUP.fields + [T.StructField("bucket_date", T.DateType())])
_COMMIT_FILE = T.StructType([f for f in COMMITS.fields if f.name != "batch_id"])  # batch_id is the folder
_PARTITIONED_COMMITS = T.StructType(_COMMIT_FILE.fields + [T.StructField("batch_id", T.LongType())])
_PARTITIONED_REJECTED = T.StructType([
    T.StructField("body_id", T.LongType()), T.StructField("index", T.IntegerType()),
    T.StructField("reason", T.StringType()), T.StructField("entry", T.StringType()),
    T.StructField("batch_id", T.LongType())])
_PARTITIONED_BODIES = T.StructType([
    T.StructField("body_id", T.LongType()), T.StructField("accepted", T.LongType()),
    T.StructField("rejected", T.LongType()), T.StructField("outcome", T.StringType()),
    T.StructField("body", T.StringType()), T.StructField("batch_id", T.LongType())])


_INTENT = "kind string, staged string, target string, aside string"


@dataclass
class BatchResult:
    batch_id: int
    accepted: int
    rejected: int
    max_id: int
    owner: str = ""


class LogStore:
    """Partitioned Parquet tables of one log store (see module docstring)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = configure(spark)
        self.root = root.rstrip("/")
        self._last_commit: tuple[int, int] | None = None  # (batch_id, max_id) written by this object

    # ---- paths and file system -------------------------------------------------
    def path(self, table: str, batch_id: int | None = None) -> str:
        base = f"{self.root}/{table}"
        return base if batch_id is None else f"{base}/batch_id={batch_id}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return hpath.getFileSystem(conf), hpath

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return bool(fs.exists(p))

    def _children(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return []
        return [str(s.getPath().toString()) for s in fs.listStatus(p) if s.isDirectory()]

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        if fs.exists(p):
            fs.delete(p, True)

    def _rename(self, src: str, dst: str) -> None:
        fs, p = self._fs(src)
        _, q = self._fs(dst)
        fs.mkdirs(q.getParent())
        if not fs.rename(p, q):
            raise IOError(f"rename failed: {src} -> {dst}")

    # ---- readers -----------------------------------------------------------------
    def commits(self) -> DataFrame:
        """Finished batches (one row each)."""
        if not self._exists(self.path("commits")):
            return self.spark.createDataFrame([], COMMITS)
        return self.spark.read.schema(_PARTITIONED_COMMITS).parquet(self.path("commits")).select(
            *[f.name for f in COMMITS.fields])

    def _commit_ids(self) -> list[int]:
        ids = []
        for child in self._children(self.path("commits")):
            name = child.rstrip("/").rsplit("/", 1)[-1]
            if name.startswith("batch_id="):
                ids.append(int(name.split("=", 1)[1]))
        return sorted(ids)

    def _committed_upto(self, below: int | None = None) -> int | None:
        """Newest finished commit (optionally below a batch id), from the folder names.

        A commit folder counts once its write finished: a data file has been
        committed into it (task output stays under ``_temporary`` until the
        job commits).  Checked from the newest down, so normally one listing;
        no data is read.
        """
        for batch_id in reversed(self._commit_ids()):
            if below is not None and batch_id >= below:
                continue
            if self._has_data_file(self.path("commits", batch_id)):
                return batch_id
        return None

    def _has_data_file(self, path: str) -> bool:
        fs, p = self._fs(path)
        return any(s.isFile() and not s.getPath().getName().startswith(("_", "."))
                   for s in fs.listStatus(p))

    def _visible(self, table: str, schema: T.StructType) -> DataFrame:
        upto = self._committed_upto()
        if upto is None or not self._exists(self.path(table)):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(self.path(table))
        return df.where(F.col("batch_id") <= F.lit(upto))  # partition pruning on batch_id

    def logs(self) -> DataFrame:
        """Committed raw logs with partition columns ``batch_id``, ``log_date``.

        ``attributes`` is a VARIANT here; ``render_logs`` (or ``attributes_json``)
        turns it into JSON text for output.
        """
        return self._visible("logs", _PARTITIONED_LOGS)

    def rejected(self) -> DataFrame:
        return self._visible("rejected", _PARTITIONED_REJECTED)

    def bodies(self) -> DataFrame:
        """The outcome of every committed body; ``body`` holds the text of malformed and invalid ones."""
        return self._visible("bodies", _PARTITIONED_BODIES)

    def deltas(self) -> DataFrame:
        return self._visible("deltas", _PARTITIONED_ROLLUP)

    def _compacted_upto(self) -> int | None:
        gens = [c.rstrip("/").rsplit("=", 1)[-1] for c in self._children(self.path("rollup"))
                if c.rstrip("/").rsplit("/", 1)[-1].startswith("upto=")]
        done = [int(g) for g in gens if self._exists(f"{self.path('rollup')}/upto={g}/_SUCCESS")]
        return max(done) if done else None

    def rollup(self) -> DataFrame:
        """The minute rollup (#34): newest compacted generation + later committed deltas.

        Columns ``bucket_start, service, level, count`` plus ``bucket_date``
        (the day of ``bucket_start``, a partition column of the compacted
        generation): time bounds on ``bucket_start`` also bound it, so a
        time-bounded aggregate prunes whole day folders.  Generations and
        deltas are added, never overwritten in place, so a reader sees either
        the old or the new generation, both complete.
        """
        return self._rollup_upto(self._committed_upto())

    def _rollup_upto(self, committed: int | None) -> DataFrame:
        upto = self._compacted_upto()
        key = ["bucket_start", "service", "level"]
        deltas = self.deltas().where(F.col("batch_id") <= F.lit(committed if committed is not None else -1))
        if upto is not None:
            deltas = deltas.where(F.col("batch_id") > F.lit(upto))
        parts = deltas.select(*key, "count", F.to_date("bucket_start").alias("bucket_date"))
        if upto is not None:
            base = self.spark.read.schema(_ROLLUP_GENERATION).parquet(f"{self.path('rollup')}/upto={upto}")
            parts = base.select(*key, "count", "bucket_date").unionByName(parts)
        return (parts.groupBy("bucket_date", *key).agg(F.sum("count").cast("bigint").alias("count"))
                .select(*key, "count", "bucket_date"))

    def compact_rollup(self, retain_from=None) -> int | None:
        """Fold all committed deltas into a new rollup generation; returns its batch bound.

        One shuffle aggregate of (previous generation ∪ newer deltas), written
        partitioned by ``bucket_date`` under a new ``upto=N`` folder.
        ``retain_from`` (a cutoff) drops minutes wholly before it (#48): a new
        generation is then written even when no batch arrived since the last one.
        """
        upto = self._committed_upto()
        if upto is None or (upto == self._compacted_upto() and retain_from is None):
            return self._compacted_upto()
        merged = self._rollup_upto(upto)
        if retain_from is not None:
            merged = retain_rollup(merged, retain_from)
        if upto == self._compacted_upto():
            # Same bound: materialize the new generation (reliable checkpoint to the
            # shared checkpoint dir; it reads the old one), then replace it.  Until
            # the write ends, readers fall back to the deltas alone: complete
            # counts, just not yet pruned.
            merged = merged.checkpoint(eager=True)
            self._delete(f"{self.path('rollup')}/upto={upto}")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # range partitioning on time: each task writes a few whole days, no hot task
        (merged.repartitionByRange(n, "bucket_start")
         .write.mode("overwrite").partitionBy("bucket_date")
         .parquet(f"{self.path('rollup')}/upto={upto}"))
        return upto

    # ---- ingest ----------------------------------------------------------------------
    def _id_base(self, batch_id: int) -> int:
        """``max_id`` of the newest commit before this batch: a replay gets the same base."""
        if self._last_commit is not None and self._last_commit[0] == batch_id - 1:
            return self._last_commit[1]
        # ids grow with the batch id, so the newest earlier commit holds the base:
        # read that one tiny folder, not the whole commit table
        previous = self._committed_upto(below=batch_id)
        if previous is None:
            return 0
        row = (self.spark.read.schema(_COMMIT_FILE).parquet(self.path("commits", previous))
               .agg(F.max("max_id").alias("m")).first())
        return 0 if row is None or row["m"] is None else int(row["m"])

    def _committed(self, batch_id: int, owner: str) -> BatchResult | None:
        """The stored result of a batch that is already visible; another owner's batch is an error."""
        path = self.path("commits", batch_id)
        if not self._exists(f"{path}/_SUCCESS"):
            return None
        row = self.spark.read.parquet(path).first()
        theirs = row["owner"] if "owner" in row else ""
        if theirs != owner:
            raise ValueError(f"batch {batch_id} of this store was committed by {theirs!r}, not by {owner!r}")
        return BatchResult(batch_id, row["accepted"], row["rejected"], row["max_id"], owner)

    def _pinned_clock(self, batch_id: int, as_of) -> datetime:
        """The batch's clock, recorded before its first write: a replay validates against the same one."""
        if as_of is not None:
            return to_utc_naive(as_of)
        path = self.path("starts", batch_id)
        if not self._exists(f"{path}/_SUCCESS"):
            now = datetime.now(timezone.utc).replace(tzinfo=None)
            self.spark.createDataFrame([(iso_text(now),)], "as_of string").coalesce(1).write.mode("overwrite").json(path)
        return to_utc_naive(self.spark.read.schema("as_of string").json(path).first()["as_of"])

    def ingest_batch(self, bodies: DataFrame, batch_id: int, as_of=None,
                     strict_storage: bool = False, owner: str = "") -> BatchResult:
        """Validate, id, write and commit one batch of envelope records (#12, #13).

        A batch that ``owner`` has committed before is returned as stored and nothing is written.
        """
        if (stored := self._committed(batch_id, owner)) is not None:
            return stored
        as_of = self._pinned_clock(batch_id, as_of)
        validated = kept_fields(validate_entries(parse_ingest_bodies(with_body_ids(bodies), keep_bad=True), as_of,
                                                 strict_storage)).persist()
        try:
            # one job: materializes the cache and counts per input partition
            stats = partition_counts(validated, F.size("errors") == 0, F.size("errors") > 0)
            accepted_n = sum(s[1] for s in stats)
            rejected_n = sum(s[2] for s in stats)
            base = self._id_base(batch_id)
            accepted = assign_arrival_ids(accepted_logs(validated, attributes_as="variant"), base,
                                          {s[0]: s[1] for s in stats})
            logs = accepted.select(*LOGS.fieldNames(), F.to_date("timestamp").alias("log_date"))
            # rebalance(log_date): AQE sizes the output partitions, so a batch writes a
            # few well-sized files per day (a hot day is split) instead of one per task
            # and day.  Then a local sort: the writer needs log_date order anyway, and
            # service-then-time order gives row groups tight min/max statistics, so
            # service and time filters skip row groups inside each file.
            writes = [
                lambda: self._write_logs(logs, batch_id),
                lambda: (minute_rollup(accepted_logs(validated))
                         .write.mode("overwrite").parquet(self.path("deltas", batch_id))),
                lambda: (rejected_entries(validated).hint("rebalance")  # usually few rows: few files
                         .write.mode("overwrite").parquet(self.path("rejected", batch_id))),
                lambda: (body_outcomes(validated).hint("rebalance")
                         .write.mode("overwrite").parquet(self.path("bodies", batch_id))),
            ]
            # The outputs are independent jobs over the cached batch: submit
            # them together so the scheduler overlaps their tasks.  Any failure
            # surfaces here, before the commit row.
            with ThreadPoolExecutor(max_workers=len(writes)) as pool:
                for done in [pool.submit(inheritable_thread_target(self.spark)(w)) for w in writes]:
                    done.result()
        finally:
            validated.unpersist()
        result = BatchResult(batch_id, accepted_n, rejected_n, base + accepted_n, owner)
        self._commit(result, as_of)
        return result

    def _write_logs(self, logs: DataFrame, batch_id: int) -> None:
        (logs.hint("rebalance", "log_date").sortWithinPartitions("log_date", "service", "timestamp")
         .write.mode("overwrite").partitionBy("log_date").parquet(self.path("logs", batch_id)))

    def _commit(self, result: BatchResult, as_of: datetime) -> None:
        """Writes the batch's commit row — the last write, which makes the batch visible."""
        commit = self.spark.createDataFrame(
            [(result.batch_id, iso_text(as_of), result.accepted, result.rejected, result.max_id)],
            "batch_id long, as_of string, accepted long, rejected long, max_id long",
        ).select("batch_id", ts_literal(as_of).alias("as_of"), "accepted", "rejected", "max_id",
                 F.lit(result.owner).alias("owner"))
        commit.drop("batch_id").coalesce(1).write.mode("overwrite").parquet(self.path("commits", result.batch_id))
        self._last_commit = (result.batch_id, result.max_id)

    # ---- retention ----------------------------------------------------------------------
    def _intent_path(self) -> str:
        return f"{self.root}/_retention_intent"

    def _write_intent(self, swaps: list[tuple[str, str]]) -> None:
        """``swaps`` are (staged, target) folders; a target without a staged folder is dropped."""
        steps = [("swap" if self._exists(staged) else "drop", staged, target,
                  f"{self.root}/_retention_work/old-{uuid.uuid4().hex[:12]}") for staged, target in swaps]
        self.spark.createDataFrame(steps, _INTENT).coalesce(1).write.mode("overwrite").json(self._intent_path())

    def _finish_swaps(self) -> None:
        """Roll forward the boundary-day steps of the intent, also one left by a lost driver.

        ``drop`` deletes a folder without survivors.  ``swap`` moves the old folder aside, the staged
        one in, and only then deletes the old one; when the second move fails the first is undone.
        """
        if not self._exists(f"{self._intent_path()}/_SUCCESS"):
            return
        for step in self.spark.read.schema(_INTENT).json(self._intent_path()).collect():
            if step["kind"] == "swap":
                if not self._exists(step["target"]) and self._exists(step["aside"]) and self._exists(step["staged"]):
                    self._rename(step["aside"], step["target"])
                if self._exists(step["staged"]):
                    self._rename(step["target"], step["aside"])
                    try:
                        self._rename(step["staged"], step["target"])
                    except Exception:
                        self._rename(step["aside"], step["target"])
                        raise
                self._delete(step["aside"])
            else:
                self._delete(step["target"])
        self._delete(self._intent_path())

    def run_retention(self, as_of, days: int = DEFAULT_RETENTION_DAYS,
                      batch_size: int = DEFAULT_RETENTION_BATCH, prune_rollup: bool = False) -> dict:
        """Delete committed logs older than ``as_of − days`` (#47).

        The summary ``(cutoff, deleted, batches)`` is one aggregate taken before
        the delete.  Day partitions wholly before the cutoff are dropped as
        directories; the boundary day is staged (survivors only) into a new
        folder and swapped in.  Dynamic partition overwrite is not used: it
        would leave a day with no survivors untouched.
        """
        check_positive("batch_size", batch_size)
        self._finish_swaps()
        cutoff = retention_cutoff(as_of, days)
        cutoff_day = cutoff.date()
        day_text = cutoff_day.isoformat()
        upto = self._committed_upto()
        if upto is None or not self._exists(self.path("logs")):
            return {"cutoff": iso_text(cutoff, millis=True), "deleted": 0, "batches": 1}
        stored = (self.spark.read.schema(_PARTITIONED_LOGS).parquet(self.path("logs"))
                  .where((F.col("batch_id") <= F.lit(upto)) & (F.col("log_date") <= F.lit(cutoff_day))))
        deleted = stored.where(F.col("timestamp") < ts_literal(cutoff)).count()
        boundary_dirs = []
        for batch_dir in self._children(self.path("logs")):
            name = batch_dir.rstrip("/").rsplit("/", 1)[-1]
            if not name.startswith("batch_id=") or int(name.split("=", 1)[1]) > upto:
                continue  # in-flight batches are never touched
            for day_dir in self._children(batch_dir):
                day = day_dir.rstrip("/").rsplit("=", 1)[-1]
                if day < day_text:
                    self._delete(day_dir)
                elif day == day_text and cutoff != datetime.combine(cutoff_day, datetime.min.time()):
                    boundary_dirs.append((name, day_dir))
        if boundary_dirs:
            # staged below the store's root: the moves stay inside one file system
            work = f"{self.root}/_retention_work/{uuid.uuid4().hex[:12]}"
            survivors = stored.where((F.col("log_date") == F.lit(cutoff_day)) & (F.col("timestamp") >= ts_literal(cutoff)))
            survivors.write.mode("overwrite").partitionBy("batch_id", "log_date").parquet(f"{work}/staged")
            swaps = [(f"{work}/staged/{name}/log_date={day_text}", day_dir) for name, day_dir in boundary_dirs]
            # written before the first step: a driver lost in the middle leaves it behind,
            # and the next run finishes the steps first
            self._write_intent(swaps)
            self._finish_swaps()
            self._delete(work)
        if prune_rollup:  # opt-in; by default old aggregates outlive their logs, as in the reference
            self.compact_rollup(retain_from=cutoff)
        return {"cutoff": iso_text(cutoff, millis=True), "deleted": int(deleted),
                "batches": int(deleted) // batch_size + 1}

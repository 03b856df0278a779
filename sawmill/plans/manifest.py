"""A log store whose readers open files by list: every change is a numbered version of a manifest.

Layout below ``root``, beside the tables of ``LogStore`` that go by batch (deltas, rejected, bodies, commits)::

    logs/gen=G/log_date=D/*.parquet           raw rows; a generation is one batch, compaction or retention run
    rollup/gen=G/bucket_date=D/*.parquet      the minute rollup, by day
    manifest/data/U/*.parquet                 files added and removed: day, rows, least and most time
    manifest/00000000000000000007.json        version 7: what it adds to version 6, written last

A version becomes visible by one rename to its number, which fails if the number is taken: of two writers that started
from the same version one commits, the other looks at the new version and tries again, or gives up if files
it wanted to replace are gone.  Files are never changed or moved, so a reader keeps what it planned on; ``vacuum`` deletes
files that no kept version names.  Every ``CHECKPOINT`` versions the whole list is written anew, so reading the manifest takes
a bounded number of small files.

What readers need of the list is found by Spark (a filter on day or time, a sum by day); the driver gets the names
of the files to be opened, which Spark's reader takes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sawmill.functions.cursor import decode_cursor_value
from sawmill.functions.times import iso_text, minute_floor, to_utc_naive, ts_literal
from sawmill.operators.paging import after_cursor, check_limit, log_page
from sawmill.operators.retention import check_positive, delete_batch, oldest_expired, retain_rollup, retention_cutoff
from sawmill.plans.store import _PARTITIONED_LOGS, _PARTITIONED_ROLLUP, BatchResult, LogStore
from sawmill.schema import DEFAULT_LIMIT, DEFAULT_RETENTION_BATCH, DEFAULT_RETENTION_DAYS, ROLLUP

CHECKPOINT = 16  # versions after which the whole list is written anew
ATTEMPTS = 10  # at a version number, before a writer gives up
TARGET_ROWS = 4_000_000  # of a compacted file
MIN_FILES = 4  # small files of a day that are worth compacting

FILES = "action string, table string, path string, day date, rows long, least timestamp_ntz, most timestamp_ntz"
_GEN = T.StructField("gen", T.StringType())
_LOG_FILES = T.StructType([*_PARTITIONED_LOGS.fields[:-1], _GEN, _PARTITIONED_LOGS.fields[-1]])
_ROLLUP_FILES = T.StructType([*ROLLUP.fields, _GEN, T.StructField("bucket_date", T.DateType())])


class Conflict(RuntimeError):
    """Files that a writer wanted to replace were replaced by another one."""


@dataclass
class Snapshot:
    """One version of the store: its files (``FILES`` without removed ones) and newest batch."""

    version: int
    upto: int | None
    files: DataFrame
    chain: list[dict]

    def of(self, table: str, condition: Column | None = None) -> DataFrame:
        files = self.files.where(F.col("table") == table)
        return files if condition is None else files.where(condition)


class ManifestStore(LogStore):
    """``LogStore`` over a manifest (see the module's docstring)."""

    # ---- versions ------------------------------------------------------------------
    def _version_path(self, number: int) -> str:
        return f"{self.root}/manifest/{number:020d}.json"

    def _read_text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> bool:
        """Writes a small file that must not exist yet; False if it does."""
        sc = self.spark.sparkContext
        staged = f"{self.root}/manifest/data/{uuid.uuid4().hex}.json"
        fs, p = self._fs(staged)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        hadoop = sc._jvm.org.apache.hadoop.fs
        none = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        files = hadoop.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            files.rename(fs.makeQualified(p), fs.makeQualified(hadoop.Path(path)), none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            self._delete(staged)
            return False
        return True

    def _numbers(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isFile()]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self) -> Snapshot:
        """The newest version."""
        chain = []
        for number in reversed(self._numbers()):
            chain.append(json.loads(self._read_text(self._version_path(number))))
            if chain[-1]["whole"]:
                break
        chain.reverse()
        folders = [f"{self.root}/manifest/data/{v['data']}" for v in chain]
        rows = self.spark.read.schema(FILES).parquet(*folders) if folders else self.spark.createDataFrame([], FILES)
        removed = rows.where("action = 'remove'").select(F.col("path").alias("_removed"))
        live = rows.where("action = 'add'").join(removed, F.col("path") == F.col("_removed"), "left_anti")
        newest = chain[-1] if chain else {"version": -1, "upto": None}
        return Snapshot(newest["version"], newest["upto"], live, chain)

    def _append(self, kind: str, add: DataFrame | None = None, remove: DataFrame | None = None, upto: int | None = None) -> int:
        """Commits the next version; ``add`` and ``remove`` have the columns of ``FILES``."""
        parts = [x.withColumn("action", F.lit(a)).select(*_names(FILES)) for a, x in (("add", add), ("remove", remove)) if x is not None]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        changes = uuid.uuid4().hex
        rows.coalesce(1).write.parquet(f"{self.root}/manifest/data/{changes}")
        rows = self.spark.read.schema(FILES).parquet(f"{self.root}/manifest/data/{changes}")
        gone = rows.where("action = 'remove'").select(F.col("path").alias("_gone"))
        for _ in range(ATTEMPTS):
            now = self.snapshot()
            if remove is not None and gone.join(now.files, F.col("_gone") == F.col("path"), "left_anti").limit(1).count():
                raise Conflict(f"{kind}: files to be replaced are no longer there")
            number, data, whole = now.version + 1, changes, (now.version + 1) % CHECKPOINT == 0
            if whole:
                data = uuid.uuid4().hex
                (now.files.join(gone, F.col("path") == F.col("_gone"), "left_anti").unionByName(rows.where("action = 'add'"))
                 .coalesce(1).write.parquet(f"{self.root}/manifest/data/{data}"))
            version = {"version": number, "kind": kind, "data": data, "changes": changes, "whole": whole,
                       "upto": upto if upto is not None else now.upto}
            if self._create(self._version_path(number), json.dumps(version)):
                return number
        raise Conflict(f"{kind}: other writers took every version number tried")

    def _written(self, table: str, gen: str, time: str, day: str) -> DataFrame:
        """``FILES`` of a new generation: of each file its day, rows and times."""
        path = f"{self.root}/{table}/gen={gen}"
        schema = T.StructType([T.StructField(time, T.TimestampNTZType()), T.StructField(day, T.DateType())])
        rows = self.spark.read.schema(schema).parquet(path)
        return (rows.groupBy(F.regexp_extract("_metadata.file_path", f"({table}/gen={gen}/.*)$", 1).alias("path"), F.col(day).alias("day"))
                .agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("least"), F.max(time).alias("most"))
                .withColumn("table", F.lit(table)))

    def _open(self, table: str, schema: T.StructType, files: DataFrame) -> DataFrame:
        """The rows of ``files``: only they are looked at, no folder is listed."""
        paths = [f"{self.root}/{r['path']}" for r in files.select("path").orderBy("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], schema).drop("gen")
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths).drop("gen")

    # ---- readers -----------------------------------------------------------------
    def _committed_upto(self, below: int | None = None) -> int | None:
        chain = self._numbers()
        upto = json.loads(self._read_text(self._version_path(chain[-1])))["upto"] if chain else None
        return upto if below is None or upto is None or upto < below else super()._committed_upto(below)

    def commits(self) -> DataFrame:
        upto = self._committed_upto()
        return super().commits().where(F.col("batch_id") <= F.lit(-1 if upto is None else upto))

    def logs(self, since=None, until=None) -> DataFrame:
        """Committed raw logs; with bounds, of the files alone that may hold rows between them."""
        found = F.lit(True)
        if since is not None:
            found = found & (F.col("most") >= ts_literal(to_utc_naive(since)))
        if until is not None:
            found = found & (F.col("least") < ts_literal(to_utc_naive(until)))
        return self._open("logs", _LOG_FILES, self.snapshot().of("logs", found))

    def page(self, limit: int = DEFAULT_LIMIT, cursor: str | None = None,
             where: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """``log_page`` of the rows that ``where`` admits, from the newest days down (#23, #25).

        Without a filter the manifest's row counts tell which days hold the page.  With one, or behind a cursor, days
        are opened from the newest down, twice as many each time, until ``limit + 1`` rows are found; older days are never opened.
        """
        check_limit(limit)
        at = decode_cursor_value(cursor) if cursor else None
        if cursor and at is None:
            raise ValueError("cursor must be a valid base64url-encoded log cursor")
        before = F.lit(True) if at is None else F.col("least") <= ts_literal(at[0])
        files = self.snapshot().of("logs", before)
        days = [tuple(r) for r in files.groupBy("day").agg(F.sum("rows")).orderBy(F.col("day").desc()).collect()]  # a row a day
        opened, found, step = 0, 0, 1
        while opened < len(days) and found <= limit:
            some = days[opened:opened + step]
            opened += len(some)
            if where is None and at is None:
                found += sum(n for _, n in some)
                continue
            part = self._days(files, some)
            part = after_cursor(part, *at) if at is not None else part
            found += (where(part) if where else part).limit(limit + 1 - found).count()
            step *= 2
        rows = self._days(files, days[:opened])
        return log_page(where(rows) if where else rows, limit, cursor, newest=False)

    def _days(self, files: DataFrame, days: list[tuple[date, int]]) -> DataFrame:
        chosen = F.col("day").isin([d for d, _ in days]) if days else F.lit(False)
        return self._open("logs", _LOG_FILES, files.where(chosen))

    def deltas(self) -> DataFrame:
        return self._open("deltas", _PARTITIONED_ROLLUP, self.snapshot().of("deltas"))

    def rollup(self) -> DataFrame:
        """The minute rollup: the days' files and the deltas not yet folded into them, of one version."""
        now = self.snapshot()
        return self._merged(self._open("rollup", _ROLLUP_FILES, now.of("rollup")), self._open("deltas", _PARTITIONED_ROLLUP, now.of("deltas")))

    def _merged(self, days: DataFrame, deltas: DataFrame) -> DataFrame:
        key = ["bucket_start", "service", "level"]
        both = days.select(*key, "count", "bucket_date").unionByName(deltas.select(*key, "count", F.to_date("bucket_start").alias("bucket_date")))
        return both.groupBy("bucket_date", *key).agg(F.sum("count").cast("bigint").alias("count")).select(*key, "count", "bucket_date")

    # ---- ingest ----------------------------------------------------------------------
    def _committed(self, batch_id: int, owner: str) -> BatchResult | None:
        upto = self._committed_upto()
        return super()._committed(batch_id, owner) if upto is not None and batch_id <= upto else None

    def _write_logs(self, logs: DataFrame, batch_id: int) -> None:
        self._gen = f"batch-{batch_id}-{uuid.uuid4().hex[:12]}"
        self._write_days(logs.withColumn("batch_id", F.lit(batch_id).cast("long")), self._gen, "log_date")

    def _write_days(self, logs: DataFrame, gen: str, *deal: str) -> None:
        (logs.hint("rebalance", *deal).sortWithinPartitions("log_date", "service", "timestamp")
         .select(*(c for c in logs.columns if c in _PARTITIONED_LOGS.fieldNames()))
         .write.partitionBy("log_date").parquet(f"{self.root}/logs/gen={gen}"))

    def _commit(self, result: BatchResult, as_of: datetime) -> None:
        super()._commit(result, as_of)
        batch = result.batch_id
        delta = self.spark.range(1).select(
            F.lit("deltas").alias("table"), F.lit(f"deltas/batch_id={batch}").alias("path"), F.lit(None).cast("date").alias("day"),
            F.lit(None).cast("long").alias("rows"), F.lit(None).cast("timestamp_ntz").alias("least"), F.lit(None).cast("timestamp_ntz").alias("most"))
        self._append("ingest", add=self._written("logs", self._gen, "timestamp", "log_date").unionByName(delta), upto=batch)

    # ---- compaction --------------------------------------------------------------------
    def compact_logs(self, target_rows: int = TARGET_ROWS, min_files: int = MIN_FILES) -> int | None:
        """Packs the small files of each day into files of about ``target_rows``; returns the new version, or None.

        Small are files of less than half the target; days with fewer than ``min_files`` of them are left alone.  A day's files become
        slices of its time, as many as its rows need; a slice that holds far more than others is split by adaptive execution.
        """
        check_positive("target_rows", target_rows)
        small = self.snapshot().of("logs", F.col("rows") * 2 < target_rows)
        days = (small.groupBy(F.col("day").alias("_day")).agg(F.count(F.lit(1)).alias("_files"), F.ceil(F.sum("rows") / target_rows).alias("_slices"))
                .where(f"_files >= {min_files} AND _files > _slices"))
        files = small.join(days, F.col("day") == F.col("_day")).drop("_day", "_files", "_slices")
        if not files.limit(1).count():
            return None
        seconds = F.hour("timestamp") * 3600 + F.minute("timestamp") * 60 + F.second("timestamp")
        rows = (self._open("logs", _LOG_FILES, files).join(days.select("_day", "_slices"), F.col("log_date") == F.col("_day"))
                .withColumn("slice", F.floor(seconds * F.col("_slices") / 86400)))
        gen = f"packed-{uuid.uuid4().hex[:12]}"
        self._write_days(rows, gen, "log_date", "slice")
        return self._append("compact", self._written("logs", gen, "timestamp", "log_date"), files)

    def compact_rollup(self, retain_from=None) -> int | None:
        """Folds the deltas into the rollup, rewriting only the days they touch (#34); returns the newest batch.

        ``retain_from`` (a cutoff) also drops minutes wholly before it (#48): days before it lose their files, its own day is rewritten.
        """
        now = self.snapshot()
        folded, files = now.of("deltas"), now.of("rollup")
        deltas = self._open("deltas", _PARTITIONED_ROLLUP, folded)
        touched = {r[0] for r in deltas.select(F.to_date("bucket_start")).distinct().collect()}  # days
        old, dropped = F.lit(False), F.lit(False)
        if retain_from is not None:
            first = minute_floor(ts_literal(retain_from))
            dropped, old = F.col("most") < first, (F.col("least") < first) & (F.col("most") >= first)
        again = files.where((F.col("day").isin(sorted(touched)) if touched else F.lit(False)) | old)
        gone = files.where(dropped).unionByName(again).unionByName(folded).dropDuplicates(["path"])
        if not gone.limit(1).count():
            return now.upto
        merged = self._merged(self._open("rollup", _ROLLUP_FILES, again.where(~dropped) if retain_from is not None else again), deltas)
        if retain_from is not None:
            merged = retain_rollup(merged, retain_from)
        gen = f"rollup-{uuid.uuid4().hex[:12]}"
        merged.hint("rebalance", "bucket_date").sortWithinPartitions("bucket_date", "bucket_start").write.partitionBy("bucket_date").parquet(f"{self.root}/rollup/gen={gen}")
        self._append("rollup", self._written("rollup", gen, "bucket_start", "bucket_date"), gone)
        return now.upto

    # ---- retention ----------------------------------------------------------------------
    def run_retention(self, as_of, days: int = DEFAULT_RETENTION_DAYS, batch_size: int = DEFAULT_RETENTION_BATCH,
                      prune_rollup: bool = False) -> dict:
        """Deletes committed logs older than ``as_of - days`` in one version (#47): a reader sees all of it or nothing.

        Files wholly before the cutoff leave the list unread; files that reach over it are rewritten without their expired rows.
        """
        check_positive("batch_size", batch_size)
        cutoff = retention_cutoff(as_of, days)
        for attempt in range(ATTEMPTS):
            try:
                deleted = self._expire(cutoff)
                break
            except Conflict:  # a compaction replaced files meanwhile
                if attempt + 1 == ATTEMPTS:
                    raise
        if prune_rollup:
            self.compact_rollup(retain_from=cutoff)
        return {"cutoff": iso_text(cutoff, millis=True), "deleted": deleted, "batches": deleted // batch_size + 1}

    def _expire(self, cutoff: datetime) -> int:
        old = self.snapshot().of("logs", F.col("least") < ts_literal(cutoff))
        over = old.where(F.col("most") >= ts_literal(cutoff))
        n, n_over = old.agg(F.sum("rows"), F.sum(F.when(F.col("most") >= ts_literal(cutoff), F.col("rows")))).first()
        if not n:
            return 0
        return n - self._replace("retention", old, over, lambda rows: rows.where(F.col("timestamp") >= ts_literal(cutoff)) if n_over else None)

    def _replace(self, kind: str, gone: DataFrame, read: DataFrame, kept: Callable[[DataFrame], DataFrame | None]) -> int:
        """A version without the files ``gone``, and with what ``kept`` leaves of the files ``read``; returns the rows kept."""
        add, left = None, kept(self._open("logs", _LOG_FILES, read))
        if left is not None:
            gen = f"{kind}-{uuid.uuid4().hex[:12]}"
            self._write_days(left, gen, "log_date")
            add = self._written("logs", gen, "timestamp", "log_date")
        self._append(kind, add, gone)
        return (add.agg(F.sum("rows")).first()[0] or 0) if add is not None else 0

    def delete_oldest(self, as_of, days: int = DEFAULT_RETENTION_DAYS, batch_size: int = DEFAULT_RETENTION_BATCH) -> int:
        """Deletes the ``batch_size`` oldest expired rows (#45, #46) in one version; returns how many.

        Only the oldest files that can hold them are read and rewritten: by least time, until their rows make up the batch.
        """
        check_positive("batch_size", batch_size)
        cutoff = retention_cutoff(as_of, days)
        old = self.snapshot().of("logs", F.col("least") < ts_literal(cutoff))
        spans = old.orderBy("most").select("rows", "most").limit(batch_size).collect()  # each file has a row at least
        seen, bound = 0, None
        for rows, most in spans:
            seen, bound = seen + rows, most
            if seen >= batch_size:
                break
        if bound is None:
            return 0
        files = old.where(F.col("least") <= ts_literal(bound))
        n = files.agg(F.sum("rows")).first()[0]
        return n - self._replace("delete", files, files,
                                 lambda rows: delete_batch(rows, oldest_expired(rows, cutoff, batch_size), batch_size).select(*rows.columns))

    def vacuum(self, keep: int = CHECKPOINT) -> int:
        """Deletes files and folders that the newest ``keep`` versions no longer name; returns how many.  Versions before the whole
        list that these need go as well.  A reader must not be older than ``keep`` versions."""
        check_positive("keep", keep)
        numbers = self._numbers()
        versions = [json.loads(self._read_text(self._version_path(n))) for n in numbers]
        old = versions[:-keep] if len(versions) > keep else []
        start = max((i for i, v in enumerate(old) if v["whole"]), default=0)
        removed = 0
        if old:
            rows = self.spark.read.schema(FILES).parquet(*(f"{self.root}/manifest/data/{v['changes']}" for v in old))
            with ThreadPoolExecutor(16) as pool:
                gone = rows.where("action = 'remove'").select("path").toLocalIterator()
                removed = sum(pool.map(lambda r: self._delete(f"{self.root}/{r['path']}") is None, gone))
        for v in old[:start]:
            self._delete(self._version_path(v["version"]))
            for data in {v["data"], v["changes"]}:
                self._delete(f"{self.root}/manifest/data/{data}")
        return removed


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(",")]

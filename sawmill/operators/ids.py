"""Dense arrival ids (#11) without a global single-task window.

Rows are range-partitioned and sorted by their arrival key, then checkpointed
(reliable checkpoint to the shared ``spark.checkpoint.dir``) so the partition
contents are fixed even if an executor is lost and a task is recomputed.  One
small aggregate gives each partition's row count (one row per partition); the
running offsets are a tiny broadcast table of that bounded size, and each row's
id is ``offset + position within its partition``.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sawmill.session import checkpoint_root

_ROW_BITS = 33  # monotonically_increasing_id = partition index << 33 | row position


def in_ranges(df: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """``df`` in partitions that follow each other in ``order``.

    Range bounds come from a sample, which evaluates ``df`` once more: place the cheap input (the
    bodies), not what was parsed from it.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order)


def assign_log_ids(rows: DataFrame, base: int = 0, order=("body_id", "index"),
                   partitions: int | None = None, placed: bool = False) -> DataFrame:
    """Adds ``id`` = base+1, base+2, … in ``order`` (dense, gap-free).

    ``placed`` tells that the rows already lie in ranges of ``order``'s first column (``in_ranges`` of
    what they were made from): they are sorted in place, neither sampled nor moved.
    """
    spark = rows.sparkSession
    checkpoint_root(spark)
    ranged = rows if placed else in_ranges(rows, *order, partitions=partitions)
    staged = ranged.sortWithinPartitions(*order).checkpoint(eager=True)
    tagged = staged.select("*", F.spark_partition_id().alias("_pid"),
                           F.monotonically_increasing_id().alias("_mid"))
    counts = dict(tagged.groupBy("_pid").count().collect())  # ≤ n rows
    pids = list(range(staged.rdd.getNumPartitions()))
    sizes = [counts.get(p, 0) for p in pids]
    starts = [base + s for s in [0, *accumulate(sizes)][:-1]]
    offsets = spark.createDataFrame(
        list(zip(pids, starts)),
        T.StructType([T.StructField("_pid", T.IntegerType()), T.StructField("_start", T.LongType())]))
    position = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), _ROW_BITS)
    with_id = tagged.join(F.broadcast(offsets), "_pid")
    return with_id.select(
        (F.col("_start") + position + 1).alias("id"),
        *[c for c in staged.columns])


def partition_counts(df: DataFrame, *conditions) -> list[tuple[int, ...]]:
    """Per input partition: ``count_if(condition)`` for each condition (≤ #partitions rows)."""
    rows = df.groupBy(F.spark_partition_id().alias("_pid")).agg(
        *[F.count_if(c).alias(f"_c{i}") for i, c in enumerate(conditions)]).collect()
    return sorted(tuple(r) for r in rows)


def assign_arrival_ids(rows: DataFrame, base: int, counts: dict[int, int]) -> DataFrame:
    """Adds dense ``id`` in arrival order: input partition, then position in it.

    No shuffle and no sort: ``counts`` holds the rows per input partition
    (from ``partition_counts`` over the same, deterministic input — a
    micro-batch read from fixed source offsets, or a cached/checkpointed
    frame), and ``monotonically_increasing_id`` gives each row's position.
    """
    spark = rows.sparkSession
    pids = sorted(counts)
    starts, running = [], base
    for p in pids:
        starts.append(running)
        running += counts[p]
    offsets = spark.createDataFrame(
        list(zip(pids, starts)) or [(0, base)],
        T.StructType([T.StructField("_pid", T.IntegerType()), T.StructField("_start", T.LongType())]))
    tagged = rows.select("*", F.spark_partition_id().alias("_pid"),
                         F.monotonically_increasing_id().alias("_mid"))
    position = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), _ROW_BITS)
    return tagged.join(F.broadcast(offsets), "_pid").select(
        (F.col("_start") + position + 1).alias("id"), *rows.columns)

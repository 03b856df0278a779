"""Mixing sources to target weights by capped water-filling.

Each source has a weight and a size in words.  Targets are ``weight * level``, clamped at
``max_epochs`` times the source's size; the excess of clamped sources is shared among the others by
weight until none is above its cap.  A target becomes whole repetitions of the source plus a
fraction; the fraction is taken from the start of a seeded order of the documents.

The cut of a source's order is found by rounds of sums (4,096 hash ranges, 4,096 ranges inside the one that
holds the cut, then its distinct ids and sizes, file parts and rows), so no task sorts or holds a whole source.
Whether a row is taken depends on the row and on one cut per source, so texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sawmill.llm.common import WORD, col, text_of, written

MAX_EPOCHS = 3
SEED = "mix-1"
RANGE_BITS = 12  # hash ranges per round: 2 ** 12


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _order(id_col: Column, seed: str) -> Column:
    """48 seeded bits of the id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (``size``, ``weight``, one row each) with ``target``; the total size is shared.

    Each round is one aggregate over the sources.  Only the level and three sums reach the driver.
    """
    cap = F.col("size") * F.lit(max_epochs)
    total = sources.agg(F.sum("size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        above = cap < F.col("weight") * F.lit(level)
        got = sources.agg(F.count_if(above), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if got[0] == clamped:
            break
        clamped, level = got[0], (total - (got[1] or 0)) / got[2] if got[2] else level
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def source_weights(sizes: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, by source name in code point order, null last."""
    ranked = (sizes.groupBy("source").agg(F.sum("size").alias("size"))
              .orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex()
              .map(lambda r: (r[0][0], int(r[0][1]), 1 + r[1] % 3)))
    return sizes.sparkSession.createDataFrame(ranked, "source string, size long, weight long")


BROADCAST_BYTES = 8 << 20  # of a table with a row per source; beyond it its joins shuffle


def _per_source(df: DataFrame, bounded: bool) -> DataFrame:
    return F.broadcast(df) if bounded else df


def _boundary(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The range of each source in which its running size passes ``left``, with what is ``left`` there."""
    upto = Window.partitionBy("source").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (parts.withColumn("_before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
            .where((F.col("_before") <= F.col("left")) & (F.col("_before") + F.col("words") > F.col("left")))
            .select(F.col("source").alias("_s"), *(F.col(k).alias(f"_{k}") for k in keys), (F.col("left") - F.col("_before")).alias("left")))


def _within(rows: DataFrame, cut: DataFrame, keys: list[str], bounded: bool) -> DataFrame:
    """The rows of each source's cut range, with what is ``left`` there."""
    same = F.col("source").eqNullSafe(F.col("_s"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.drop("left").join(_per_source(cut, bounded), same).drop("_s", *(f"_{k}" for k in keys))


def mix_plan(sizes: DataFrame, targets: DataFrame, bounded: bool = False) -> DataFrame:
    """One row per source: ``whole`` repetitions, and the last row ``upto`` of the order that is taken once more.

    ``sizes`` has ``id``, ``source``, ``size``, ``u`` (the seeded order) and ``n``, a number no other row has, its
    upper bits those of the file part.  The cut is narrowed by ranges of ``u``, by rows of one (u, id, size), which may be many, by
    file part, and by row; only rows of one file part are ever sorted.
    """
    plan = targets.where("size > 0").select(
        F.col("source"), F.col("size").alias("source_size"), "target", F.floor(F.col("target") / F.col("size")).alias("whole"))
    plan = plan.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    shift = 48 - RANGE_BITS
    rows = (sizes.where("size > 0").withColumn("b1", F.shiftright("u", shift))
            .withColumn("b2", F.shiftright("u", shift - RANGE_BITS).bitwiseAND((1 << RANGE_BITS) - 1))
            .withColumn("part", F.shiftright("n", 33)))
    rows = rows.join(_per_source(plan.select(F.col("source").alias("_s"), "left"), bounded), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    for keys in (["b1"], ["b2"], ["u", "id", "size"], ["part"]):
        parts = rows.groupBy("source", *keys, "left").agg(F.sum("size").alias("words"))
        rows = _within(rows, _boundary(parts, keys), keys, bounded)
    upto = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    taken = (F.coalesce(F.sum("size").over(upto), F.lit(0)) + F.col("size") / 2) <= F.col("left")
    last = F.coalesce(F.max(F.when(F.col("_taken"), F.col("n"))), F.min(F.shiftleft("part", 33)) - 1)
    ends = (rows.withColumn("_taken", taken).groupBy("source", "u", "id", "size").agg(last.alias("n"))
            .select(F.col("source").alias("_s"), F.struct("u", "id", "size", "n").alias("upto")))
    return plan.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "left")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
                max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per input row: ``id_col``, ``size``, ``source_size``, ``target``, ``repeats``, ``taken``.

    ``size`` is the text's number of words, ``repeats`` how often the mix has the document (at most
    ``max_epochs``), ``taken`` their product.  The words taken of a source differ from its target by
    at most half of one document.

    Null texts and texts without a word have size 0 and are taken 0 times.  A null source is a source
    of its own, last in order.  Repeated rows and equal ids are separate documents, each taken or not; which of rows equal in id
    and size are taken once more is left open.  A source without words has target 0.  An empty table gives an empty
    result.  Other columns are not read.
    """
    sizes = written(docs.select(col(id_col).alias("id"), col(source_col).cast("string").alias("source"),
                                word_count(text_of(text_col)).alias("size"), _order(col(id_col), seed).alias("u"),
                                F.monotonically_increasing_id().alias("n")), "mix-sizes")
    sources = written(source_weights(sizes), "mix-sources")
    bounded = (sources.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 128)).first()[0] or 0) <= BROADCAST_BYTES
    targets = water_fill(sources, max_epochs)
    plan = mix_plan(sizes, targets, bounded).select(F.col("source").alias("_s"), "whole", "upto")
    every = targets.select(F.col("source").alias("_t"), F.col("size").alias("source_size"), "target")
    plan = every.join(plan, F.col("_t").eqNullSafe(F.col("_s")), "left").drop("_s")
    extra = F.struct("u", "id", "size", "n") <= F.col("upto")
    repeats = F.when(F.col("size") > 0, F.coalesce("whole", F.lit(0)) + F.coalesce(extra, F.lit(False)).cast("long")).otherwise(0)
    return (sizes.join(_per_source(plan, bounded), F.col("source").eqNullSafe(F.col("_t")), "left")
            .select(F.col("id").alias(id_col), "size", "source_size", "target",
                    F.least(repeats, F.lit(max_epochs)).cast("long").alias("repeats"))
            .withColumn("taken", F.col("repeats") * F.col("size")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::BIGINT AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size AS cap,
         coalesce(sum(3 * source_size) OVER before, 0) AS caps_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights_left,
         sum(source_size) OVER () AS total
  FROM s
  WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT (total - caps_before)::DOUBLE / weights_left::DOUBLE AS level FROM r
  WHERE cap >= weight * ((total - caps_before)::DOUBLE / weights_left::DOUBLE)
  ORDER BY 3 * source_size / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * level) AS target FROM r, l),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE least(whole + CASE WHEN seen + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END, 3) END::BIGINT AS repeats,
       size * CASE WHEN size = 0 THEN 0 ELSE least(whole + CASE WHEN seen + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END, 3) END::BIGINT AS taken
FROM c
"""

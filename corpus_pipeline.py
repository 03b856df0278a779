"""The corpus pipeline: toxic documents go, then exact copies, then near copies; sources are mixed to their
targets, and the mix is encoded.

Each stage reads all rows the one before it kept and returns the columns of ``documents``; the last
returns the encoded mix.  No stage is expressed in SQL as a whole, since the first one scores with a
trained model: tests hold each against brute force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.llm import exact_dedup as exact
from sawmill.llm import jaccard, mixing, queries
from sawmill.llm.common import scratch, table, written


KEY, ROWS = "_stage_key", "_stage_rows"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key that only equal rows share: the id, nulls last, and 128 bits of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn(KEY, F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"),
                                         F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")))


def _once(docs: DataFrame, told: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is among ``told`` (``KEY``, ``ROWS``: how many rows have it, and more); equal rows once.

    ``told`` is written first: both parts of the result read it, and the driver plans what leads to it once."""
    rows = _keyed(docs).join(written(told, "stage-told").withColumnRenamed(KEY, "_told"), F.col(KEY) == F.col("_told")).drop("_told")
    return rows.where(f"{ROWS} = 1").unionByName(rows.where(f"{ROWS} > 1").dropDuplicates([KEY]))


def _per_key(told: DataFrame, *more: Column) -> DataFrame:
    return told.groupBy(KEY).agg(F.count(F.lit(1)).alias(ROWS), *more)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go; every other row stays, repeated ones and null ids too."""
    told = queries.toxic(_keyed(docs), table(spark, sf_dir, "labels"), F.col(KEY)).where("predicted = 1")
    gone = told.select(F.col("doc_id").alias("_told")).distinct()
    return _keyed(docs).join(gone, F.col(KEY) == F.col("_told"), "left_anti").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays, null ids last; rows equal in id and text once."""
    told = exact.exact_dedup(_keyed(docs), KEY).where("kept")
    return _once(docs, _per_key(told)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links the one with the smallest id stays, null ids last; texts without a word stay."""
    told = jaccard.jaccard_join(_keyed(docs), KEY).where(F.col(KEY).eqNullSafe(F.col("component_id")))
    return _once(docs, _per_key(told)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows without a word are never taken.  Rows equal in id and text are
    taken as often as all of them together."""
    told = _per_key(mixing.mix_sources(_keyed(docs), KEY), F.sum("repeats").alias("_stage_repeats")).where("_stage_repeats > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "_stage_repeats"))
    return _once(docs, told).withColumn("_stage_copy", copies).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids, with digests of the ids and of the decoded text."""
    return queries.encoded(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("mix_sources", mix_sources), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

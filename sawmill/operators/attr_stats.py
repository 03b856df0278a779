"""Attribute statistics: what keys logs carry, how many values each has, and the commonest ones.

``attr_statistics`` and ``attr_top_values`` are exact.  ``attr_sketches`` makes one small row per key and group (a batch, a day): the exact number of
logs, a HyperLogLog sketch of the values and a sketch of the frequent ones.  Such rows can be kept beside a
batch and merged (``merge_attr_sketches``) without reading a log again; ``attr_estimates`` reads them.

A JSON null counts as a log of its key and is no value.  Values are compared as the text that attribute filters use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sawmill.functions.attrs import explode_attrs

LOG2_BUCKETS = 14  # of a HyperLogLog sketch (16,384 registers, about 16 KB at most): relative standard error 0.8 %
TRACKED = 4096  # values of a frequent-values sketch: a count of N logs is off by less than N / 1,000
TOP = 10


def attr_counts(logs: DataFrame, attrs_col: str = "attributes") -> DataFrame:
    """Logs per (key, value), with partial counts before the shuffle."""
    return explode_attrs(logs, attrs_col).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def attr_statistics(logs: DataFrame, attrs_col: str = "attributes") -> DataFrame:
    """Per key: ``n_logs`` and ``n_values`` (distinct), exact; neither a hot value nor a key with very many values makes a large group."""
    return attr_counts(logs, attrs_col).groupBy("key").agg(F.sum("n").alias("n_logs"), F.count("value").alias("n_values"))


def attr_top_values(logs: DataFrame, top: int = TOP, attrs_col: str = "attributes") -> DataFrame:
    """(key, rank, value, n) of the ``top`` commonest values of every key, ties by value; each task cuts its rows of a key to ``top``
    before they meet."""
    order = Window.partitionBy("key").orderBy(F.desc("n"), "value")
    named = attr_counts(logs, attrs_col).where(F.col("value").isNotNull())
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("key", "rank", "value", "n")


def attr_sketches(logs: DataFrame, *by: str, attrs_col: str = "attributes") -> DataFrame:
    """Per ``by`` and key: ``n_logs`` (exact), ``values_sketch`` and ``top_sketch``; one shuffle of partial sketches.

    ``by`` are columns of the logs other than ``key`` and ``value``, a batch or a day; without any the sketches are of all logs.
    """
    pairs = explode_attrs(logs.select("id", attrs_col), attrs_col) if not by else explode_attrs(
        logs.withColumn("id", F.struct(*by)), attrs_col).select("id.*", "key", "value")
    return pairs.groupBy(*by, "key").agg(
        F.count(F.lit(1)).alias("n_logs"), F.hll_sketch_agg("value", LOG2_BUCKETS).alias("values_sketch"),
        F.call_function("approx_top_k_accumulate", F.col("value"), F.lit(TRACKED)).alias("top_sketch"))


def merge_attr_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketch rows merged to one per ``by`` and key: the same columns, reading only sketches."""
    return sketches.groupBy(*by, "key").agg(
        F.sum("n_logs").alias("n_logs"), F.hll_union_agg("values_sketch").alias("values_sketch"),
        F.call_function("approx_top_k_combine", F.col("top_sketch"), F.lit(TRACKED)).alias("top_sketch"))


def attr_estimates(sketches: DataFrame, top: int = TOP) -> DataFrame:
    """Sketch rows read: ``n_values`` estimated, ``top_values`` as (item, count) with counts estimated."""
    return sketches.withColumn("n_values", F.hll_sketch_estimate("values_sketch")).withColumn(
        "top_values", F.call_function("approx_top_k_estimate", F.col("top_sketch"), F.lit(top))).drop("values_sketch", "top_sketch")

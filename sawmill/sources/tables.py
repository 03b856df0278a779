"""Readers for the driver's parquet tables and the stored log tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sawmill.session import configure


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, e.g. ``events``; Parquet scan with pushdown and pruning."""
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

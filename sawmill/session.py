"""Session setup and the shared scratch location.

The library needs three session settings: UTC as the session zone (all stored
timestamps are UTC wall-clock ``TIMESTAMP_NTZ``), duplicate JSON keys allowed in
``parse_json`` (JavaScript keeps the last one), and AQE on.  Scratch data
(checkpoints, staged rewrites) goes below ``spark.checkpoint.dir``; a private
folder is made only when the session has none, as in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session-level settings the operators rely on."""
    for key, value in SESSION_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, app: str = "sawmill",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_CONF)
    conf.setdefault("spark.ui.enabled", "false")
    # checkpoints written for dense ids are deleted once their DataFrame is gone
    conf.setdefault("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when it is unset (a local test session) a private folder is created
    and registered, so ``DataFrame.checkpoint`` works as well.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="sawmill-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh, uniquely named folder below the checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/sawmill/{name}-{uuid.uuid4().hex[:12]}"
    if "://" not in path or path.startswith("file:"):
        os.makedirs(path.replace("file:", "", 1), exist_ok=True)
    return path

"""Spark session helpers.

The library never creates a cluster-wide configuration itself: on a cluster
the session is handed in by the caller. ``get_spark`` is a convenience for
tests, benches and local runs only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.driver.memory": "8g",
    # Broadcast only what is proven small; AQE may still convert at runtime.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "equisel", conf: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one (tests / bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.master(master or os.environ.get("EQUISEL_MASTER", "local[8]")).appName(app)
    for k, v in {**_LOCAL_CONF, **(conf or {})}.items():
        b = b.config(k, v)
    if not SparkConf().contains("spark.checkpoint.dir") and "spark.checkpoint.dir" not in (conf or {}):
        # Local runs only: a scratch folder stands in for the shared one.
        b = b.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="equisel-ckpt-", dir="/tmp"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("FATAL")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` names it and is used as is. Where it is unset, a
    local session (one machine) gets a scratch folder; on a cluster that folder
    would not be shared, so there it is an error."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="equisel-ckpt-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def tasks(spark: SparkSession) -> int:
    """Partitions for an explicit shuffle: the session's own setting, and two
    for each core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage.

    A reliable checkpoint runs one job to count and another to write the
    files; persisting first lets the write reuse the computed blocks instead
    of re-running the whole plan. The cached copy is dropped afterwards —
    the checkpoint files (in ``spark.checkpoint.dir``) are what later jobs
    read, so an executor loss never re-runs the upstream plan."""
    from pyspark import StorageLevel

    checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out

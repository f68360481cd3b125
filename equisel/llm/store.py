"""Written tables in the shared folder: the only place where intermediate
results live. ``spark.checkpoint.dir`` names it on a cluster; where that is
unset (tests) a folder is created and the setting is filled in."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share. Where none is named, a local
    session (tests) gets one; on a cluster that is an error."""
    sc = spark.sparkContext
    conf = sc.getConf().get(KEY) or spark.conf.get(KEY, None) or sc.getCheckpointDir()
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"set {KEY} to a folder that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="equisel-llm-")
        spark.conf.set(KEY, conf)
    return conf.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, so a lost executor never re-runs what came before. ``files`` (see
    :func:`files_for`) limits the number of files."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_for(docs: DataFrame, rows: int = 4000) -> int:
    """Files for tables with at most a few rows per document: one for every
    ``rows`` documents, up to the session's shuffle partitions, so a small
    corpus does not write hundreds of nearly empty files."""
    return min(tasks(docs.sparkSession), max(1, -(-docs.count() // rows)))


def tasks(spark: SparkSession) -> int:
    """Partitions for an explicit shuffle: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Return a worker's freed memory to the machine: workers outlive their
    tasks, and what the allocators keep would count against the next stage."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run):
    """A task function that gives freed memory back when it ends."""

    def task(batches):
        yield from run(batches)
        give_back()

    return task


def free_name(taken: list[str], name: str) -> str:
    """A column name that is not taken."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name

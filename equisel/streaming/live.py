"""Live views of a growing trial / report log.

Sources are file streams over the log folders. Results are written with
``foreachBatch`` into a versioned parquet folder under the session's
shared checkpoint directory (``spark.checkpoint.dir``), together with the
stream checkpoint, so a restarted query resumes exactly where it stopped
and a lost executor only re-runs its tasks. ``latest`` reads such a
folder and keeps the newest version of every key.

* L1 ``live_trials``       – report count and last value per trial (update mode)
* L2 ``live_progress``     – finished count and best value per study, each trial counted once
                             (``dropDuplicatesWithinWatermark``)
* L3 ``live_asha``         – successive halving of the studies that reports arrive for
* L4 ``live_convergence``  – the loss-convergence rule for the trials that reports arrive for
* L5 ``reports_per_window``– report count / mean per tumbling window with a watermark
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equisel.session import checkpoint_dir
from equisel.sources.views import reports_from_events, trials_from_events


def file_stream(spark: SparkSession, folder: str, pattern: str | None = None, schema=None) -> DataFrame:
    """A parquet file stream over ``folder`` (optionally one file pattern).
    The schema is taken from the current files when not given."""
    if schema is None:
        reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
        schema = reader.parquet(folder).schema
    rs = spark.readStream.schema(schema)
    if pattern:
        rs = rs.option("pathGlobFilter", pattern)
    return rs.parquet(folder)


def events_stream(spark: SparkSession, data_dir: str) -> DataFrame:
    return file_stream(spark, data_dir, "events.parquet")


def output_dir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, name: str, mode: str = "update", out: str | None = None, batch_fn=None) -> str:
    """Process everything available now and stop; returns the output folder.
    Each micro-batch is appended with its batch id."""
    spark = stream.sparkSession
    out = out or output_dir(spark, name)

    def write(b: DataFrame, i: int):
        if batch_fn is not None:
            b = batch_fn(b, i, out)
        if b is not None:
            b.withColumn("__batch", F.lit(i)).write.mode("append").parquet(f"{out}/data")

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/_checkpoint")
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def latest(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key (each key has at most one row per batch)."""
    d = spark.read.parquet(f"{out}/data")
    rest = [c for c in d.columns if c not in keys and c != "__batch"]
    newest = d.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("__batch")).alias("__n"))
    return newest.select(*keys, *[F.col(f"__n.{c}").alias(c) for c in rest]).select(
        *[c for c in d.columns if c != "__batch"])


# ---------------------------------------------------------------- L1
def live_trials(reports: DataFrame) -> DataFrame:
    """L1: per trial the number of reports and the value at the largest step."""
    return reports.groupBy("study", "trial").agg(F.count(F.lit(1)).alias("n_reports"),
                                                 F.max_by("value", "step").alias("last_value"))


# ---------------------------------------------------------------- L2
def live_progress(trials: DataFrame, delay: str = "1 day") -> DataFrame:
    """L2: finished count and best COMPLETE value per study; a trial seen
    twice within the watermark delay counts once."""
    t = trials.withColumn("start_ts", F.col("start_ts").cast("timestamp")).withWatermark("start_ts", delay).dropDuplicatesWithinWatermark(["study", "trial"])
    fin = F.col("state").isin("COMPLETE", "PRUNED", "FAIL")
    return t.groupBy("study").agg(F.count_if(fin).alias("finished"),
                                  F.max(F.when(F.col("state") == "COMPLETE", F.col("f1"))).alias("best_value"))


# ---------------------------------------------------------------- report log
def report_log(spark: SparkSession, log: str) -> DataFrame:
    """All reports of a log folder written by :func:`logged_batches`."""
    return spark.read.option("basePath", log).parquet(f"{log}/batch=*").drop("batch")


def logged_batches(reports: DataFrame, folder: str, rule, keys: Sequence[str]) -> str:
    """Run ``rule`` for every micro-batch on all reports of the batch's
    ``keys``. Reports go to ``folder/log/batch=<id>`` and results to
    ``folder/data/batch=<id>``; both are written over when a batch is
    replayed, so a replay changes nothing, and a stream started again on the
    same folder goes on from its checkpoint. The rule sees whole histories, so
    its result does not depend on how reports were cut into batches."""
    log, data = f"{folder}/log", f"{folder}/data"

    def step(b: DataFrame, i: int):
        spark = b.sparkSession
        b.write.mode("overwrite").parquet(f"{log}/batch={i}")
        touched = spark.read.parquet(f"{log}/batch={i}").select(*keys).distinct()
        rule(report_log(spark, log).join(touched, list(keys), "left_semi"), touched).write.mode("overwrite").parquet(f"{data}/batch={i}")

    q = (reports.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/_checkpoint")
         .foreachBatch(step).trigger(availableNow=True).start())
    q.awaitTermination()
    return folder


def newest(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """Each key's rows from the last batch that had the key."""
    d = spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data/batch=*")
    last = d.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return d.join(last, [*keys, "batch"], "left_semi").drop("batch")


# ---------------------------------------------------------------- L3
def live_asha(spark: SparkSession, reports_stream: DataFrame, min_resource: int = 1, eta: int = 3, folder: str | None = None) -> DataFrame:
    """L3: keep / prune decisions of the studies that reports arrive for, from
    all their reports so far (the batch rule H12)."""
    from equisel.operators.search import asha_prune

    folder = folder or output_dir(spark, "live-asha")
    logged_batches(reports_stream, folder, lambda seen, _: asha_prune(seen, min_resource, eta), ["study"])
    return newest(spark, folder, ["study"])


# ---------------------------------------------------------------- L4
def live_convergence(spark: SparkSession, reports_stream: DataFrame, w: int, folder: str | None = None) -> DataFrame:
    """L4: the batch rule M11 for the trials that reports arrive for, from all
    their reports so far, and the number of reports."""
    from equisel.operators.train import loss_convergence

    def rule(seen: DataFrame, _):
        steps = seen.groupBy("study", "trial").agg(F.count(F.lit(1)).alias("n_steps"))
        return steps.join(loss_convergence(seen, w), ["study", "trial"]).select("study", "trial", "n_steps", "converged", "converged_step")

    folder = folder or output_dir(spark, "live-convergence")
    logged_batches(reports_stream, folder, rule, ["study", "trial"])
    return newest(spark, folder, ["study", "trial"])


# ---------------------------------------------------------------- L5
def reports_per_window(reports: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Count and mean value per tumbling event-time window; rows later
    than the watermark are dropped, old window state is evicted."""
    g = reports.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("n_reports"), F.avg("value").alias("mean_value"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n_reports",
                    F.round("mean_value", 6).alias("mean_value"))


# ---------------------------------------------------------------- runnable views
def run_live_trials(spark: SparkSession, data_dir: str) -> DataFrame:
    out = run_available(live_trials(reports_from_events(events_stream(spark, data_dir))), "live-trials")
    return latest(spark, out, ["study", "trial"])


def run_live_progress(spark: SparkSession, data_dir: str) -> DataFrame:
    out = run_available(live_progress(trials_from_events(events_stream(spark, data_dir))), "live-progress")
    return latest(spark, out, ["study"])


def run_live_asha(spark: SparkSession, data_dir: str) -> DataFrame:
    return live_asha(spark, reports_from_events(events_stream(spark, data_dir)))


def run_live_convergence(spark: SparkSession, data_dir: str, w: int = 2) -> DataFrame:
    return live_convergence(spark, reports_from_events(events_stream(spark, data_dir)), w)


def run_reports_per_window(spark: SparkSession, data_dir: str) -> DataFrame:
    out = run_available(reports_per_window(reports_from_events(events_stream(spark, data_dir))), "reports-per-window")
    return latest(spark, out, ["window_start"])

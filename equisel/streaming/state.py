"""Streams that keep their own bounded state and never read history again.

* L1 ``finished_trials``   – one final row per trial once it has been silent for ``gap``; its
                             state is dropped when the row is given (session windows, append)
* L3 ``async_halving``     – keep / prune decision for every report that reaches a rung, against
                             the reports that reached it before (ASHA, Li et al. 2018)
* L4 ``running_convergence`` – the loss-convergence rule M11 on arriving losses, with the last 2w

L3 and L4 are keyed state (``applyInPandasWithState``, RocksDB) in ``BUCKETS``
hash buckets of keys. A batch reads the buckets of the keys that it has reports
for or that fall idle, and nothing else; a bucket holds its share of the keys
under way. Arrival
order is the order of batches and, within a batch, of event time, then trial,
then step. A key that gets no report for ``idle`` of event time is dropped; if
it comes back it starts anew. Reports older than the watermark are left out, as
in any Spark stream.

Results go to one folder per batch id, written over when a batch is replayed;
state and offsets come from the stream's checkpoint, so a restarted or replayed
stream gives the same rows.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .live import events_stream, newest, output_dir
from equisel.sources.views import reports_from_events

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ORDER = ["ts", "trial", "step"]
#: Hash buckets of keys. Fixed: the state of a stream that goes on is filed under them.
BUCKETS = 4096


def _millis(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1000)


def _arrived(chunks: Iterator[pd.DataFrame], order: list[str]) -> Iterator[tuple]:
    """A batch's rows in the given order: study, trial, step, value (None: none), event time in ms."""
    rows = pd.concat(list(chunks), ignore_index=True).sort_values(order, kind="stable", na_position="first")
    rows = rows[["study", "trial", "step", "value", "ms"]].astype(object)
    return rows.where(rows.notna(), None).itertuples(index=False, name=None)


class _Buckets:
    """Keyed state, many keys to a bucket: a call from Spark per key costs far
    more than the key's reports. A bucket's state is its keys' states and alarms.
    A key is dropped ``idle_ms`` of event time after its last report; rows of a
    batch come before its alarms."""

    idle_ms: int

    def __call__(self, bucket, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept: dict = self.loaded(state.get) if state.exists else {}
        now = max(0, state.getCurrentWatermarkMs())
        out: list[tuple] = []
        touched = {}  # newest event time of each key with reports
        if not state.hasTimedOut:
            for row in _arrived(chunks, self.order):
                key = self.key(row)
                if key not in touched:
                    touched[key] = None
                    if key in kept and kept[key][-1] <= now:
                        del kept[key]
                    if key not in kept:
                        kept[key] = [*self.fresh(), 0]
                if row[4] is not None:
                    touched[key] = row[4] if touched[key] is None else max(touched[key], row[4])
                self.report(kept[key], row, out)
            for key, latest in touched.items():
                kept[key][-1] = max(kept[key][-1], now + 1, (now if latest is None else int(latest)) + self.idle_ms)
                self.done(key, kept[key], False, out)
        for key in [k for k, held in kept.items() if held[-1] <= now]:
            self.done(key, kept.pop(key), True, out)
        if kept:
            state.update(self.stored(kept))
            state.setTimeoutTimestamp(max(now + 1, min(held[-1] for held in kept.values())))
        else:
            state.remove()
        yield pd.DataFrame(out, columns=list(self.columns)).astype(self.columns)

    def done(self, key, held, final: bool, out: list[tuple]) -> None:
        """After a key's reports of a batch, and when it is dropped."""


def _keyed(rows: DataFrame, keys: list[str], what: _Buckets, shape: str, held: str, mode: str) -> DataFrame:
    ms = F.unix_millis("ts").alias("ms")
    at = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")

    def run(bucket, chunks, state):
        yield from what(bucket, chunks, state)

    return rows.select("*", ms, at).groupBy("bucket").applyInPandasWithState(run, shape, held, mode, "EventTimeTimeout")


# ---------------------------------------------------------------- L3
class Halving(_Buckets):
    """State of one study: per trial the reports seen, the next rung and whether
    it was pruned; per rung the sorted values of the trials that reached it."""

    order = ORDER
    columns = {"study": "int64", "trial": "int64", "rung": "int32", "resource": "int64", "step": "Int64", "value": "float64", "rank": "Int64", "n": "int64", "kept": "bool"}

    def __init__(self, min_resource: int, eta: int, idle_ms: int):
        self.least, self.eta, self.idle_ms = min_resource, eta, idle_ms

    def key(self, row):
        return row[0]

    def fresh(self) -> tuple:
        return {}, {}

    @staticmethod
    def loaded(state) -> dict:
        studies, alarms, trials, rungs = state
        return {s: [{x[0]: list(x[1:]) for x in of}, {i: list(v) for i, v in enumerate(known)}, at]
                for s, at, of, known in zip(studies, alarms, trials, rungs, strict=True)}

    @staticmethod
    def stored(kept: dict) -> tuple:
        # rungs are reached in order, so a study's are 0, 1, 2, ...
        return (list(kept), [held[-1] for held in kept.values()], [[[t, *x] for t, x in held[0].items()] for held in kept.values()],
                [[held[1].get(i, []) for i in range(max(held[1], default=-1) + 1)] for held in kept.values()])

    def report(self, held, row, out) -> None:
        study, trial, step, value, _ = row
        state = held[0].setdefault(trial, [0, 0, 0])
        index = state[0]  # 0-based number of this report
        state[0] += 1
        if state[2] or index != self.least * self.eta ** state[1]:
            return
        rung = state[1]
        known = held[1].setdefault(rung, [])
        if value is None or math.isnan(value):
            rank, kept = None, False  # no value: not recorded, pruned
        else:
            bisect.insort(known, value)
            rank = len(known) - bisect.bisect_right(known, value) + 1
            kept = rank <= max(1, len(known) // self.eta)
        state[1], state[2] = rung + 1, int(not kept)
        out.append((study, trial, rung, index, step, value, rank, len(known), kept))


HALVING = "studies array<long>, alarms array<long>, trials array<array<array<long>>>, rungs array<array<array<double>>>"
DECISION = "study long, trial long, rung int, resource long, step long, value double, rank long, n long, kept boolean"


def async_halving(spark: SparkSession, reports: DataFrame, min_resource: int = 1, eta: int = 3, idle: str = "30 days", delay: str = "30 days",
                  folder: str | None = None) -> DataFrame:
    """L3: one row per trial and rung reached: the rank of its value among those
    that reached the rung by then (equal values share a rank) and whether it is
    kept, i.e. among the best max(1, floor(n / eta)). Rung r is the report number
    ``min_resource * eta ** r`` of a trial, counted from 0 in arrival order. A
    pruned trial's later reports are ignored; a NULL or NaN value at a rung
    prunes and is not recorded there.

    ``reports`` has study, trial, step (long), value (double) and ts. A study's
    decisions depend on each other, so one task makes them; what it holds is the
    batch's reports of the study and one number per trial and rung."""
    folder = folder or output_dir(spark, "async-halving")
    rows = reports.select(F.col("study").cast("long"), F.col("trial").cast("long"), F.col("step").cast("long"), F.col("value").cast("double"),
                          F.col("ts").cast("timestamp")).where("study IS NOT NULL AND trial IS NOT NULL")
    out = _keyed(rows.withWatermark("ts", delay), ["study"], Halving(min_resource, eta, _millis(idle)), DECISION, HALVING, "append")
    _run(spark, out, folder)
    return spark.read.option("basePath", f"{folder}/data").schema(DECISION + ", batch long").parquet(f"{folder}/data").drop("batch")


# ---------------------------------------------------------------- L4
class Convergence(_Buckets):
    """State of one trial: counts, the last step, and the last 2w losses."""

    order = ["step", "ts"]
    columns = {"study": "int64", "trial": "int64", "n_steps": "int64", "n_late": "int64", "converged": "bool", "converged_step": "Int64", "final": "bool"}

    def __init__(self, w: int, idle_ms: int):
        self.w, self.idle_ms = w, idle_ms

    def key(self, row):
        return row[:2]

    def fresh(self) -> tuple:
        return 0, 0, 0, None, False, None, []

    @staticmethod
    def loaded(state) -> dict:
        # a stored trial has a last step; -1: not converged
        return {(s, t): [seen, late, used, last, bool(stopped), None if converged < 0 else converged, list(losses), at]
                for (s, t, seen, late, used, last, stopped, converged, at), losses in zip(*state, strict=True)}

    @staticmethod
    def stored(kept: dict) -> tuple:
        return ([[*k, *h[:4], int(h[4]), -1 if h[5] is None else h[5], h[7]] for k, h in kept.items()], [h[6] for h in kept.values()])

    def report(self, held, row, out) -> None:
        _, _, step, value, _ = row
        w = self.w
        held[0] += 1
        if held[3] is not None and step <= held[3]:
            held[1] += 1  # a step that was passed already: counted, not used
            return
        held[3] = step
        if held[4] or value is None or math.isnan(value):
            held[4] = True  # training stops at a loss that is no number
            return
        losses = held[6] = [*held[6], value][-2 * w :]
        held[2] += 1
        if held[5] is None and held[2] - 1 > 2 * w:
            before, now = sum(losses[:w]) / w, sum(losses[w:]) / w
            spread = math.sqrt(sum((x - now) ** 2 for x in losses[w:]) / w)
            if abs(before - now) <= spread / math.sqrt(w) / 2:
                held[5] = held[2] - 1

    def done(self, key, held, final, out) -> None:
        out.append((*key, held[0], held[1], held[5] is not None, held[5], final))


CONVERGENCE = "runs array<array<long>>, losses array<array<double>>"
VERDICT = "study long, trial long, n_steps long, n_late long, converged boolean, converged_step long, final boolean"


def running_convergence(spark: SparkSession, reports: DataFrame, w: int, idle: str = "30 days", delay: str = "30 days", folder: str | None = None) -> DataFrame:
    """L4: newest verdict per trial: reports seen, those whose step had been
    passed (counted as late, not used), whether and at which step it converged,
    and whether the trial was dropped as idle. Losses count in the order of
    their steps within a batch. A run in one batch, or in batches in the order of
    steps, equals the batch rule M11."""
    folder = folder or output_dir(spark, "running-convergence")
    rows = reports.select(F.col("study").cast("long"), F.col("trial").cast("long"), F.col("step").cast("long"), F.col("value").cast("double"),
                          F.col("ts").cast("timestamp")).where("study IS NOT NULL AND trial IS NOT NULL AND step IS NOT NULL")
    out = _keyed(rows.withWatermark("ts", delay), ["study", "trial"], Convergence(w, _millis(idle)), VERDICT, CONVERGENCE, "update")
    _run(spark, out, folder, "update")
    return newest(spark, folder, ["study", "trial"])


# ---------------------------------------------------------------- L1
def finished_trials(spark: SparkSession, reports: DataFrame, gap: str = "3 days", delay: str = "1 hour", folder: str | None = None,
                    progress: list | None = None) -> DataFrame:
    """L1: one row per finished stretch of a trial: report count, value at the
    largest step, first and last report. A trial is finished when the watermark
    (newest event time less ``delay``) is ``gap`` past its last report; then its
    row is final and its state is gone, so state holds the trials under way
    only. A trial that reports again later gets a further row. ``progress``
    takes the number of trials in state after each batch."""
    folder = folder or output_dir(spark, "finished-trials")
    rows = reports.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "study", "trial").agg(
        F.count(F.lit(1)).alias("n_reports"), F.max_by("value", "step").alias("last_value"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    names = ["study", "trial", "n_reports", "last_value", "first_ts", "last_ts"]
    out = out.select(*names)
    _run(spark, out, folder, progress=progress)
    return spark.read.schema(out.schema).parquet(f"{folder}/data").select(
        *names[:4], *(F.col(c).cast("timestamp_ntz").alias(c) for c in names[4:]))


def _run(spark: SparkSession, out: DataFrame, folder: str, mode: str = "append", progress: list | None = None) -> None:
    """Process what is available, one result folder per batch id."""

    def write(b: DataFrame, i: int):
        b.write.mode("overwrite").parquet(f"{folder}/data/batch={i}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/_checkpoint").foreachBatch(write).trigger(availableNow=True).start()
        q.awaitTermination()
        if progress is not None:
            progress += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


# ---------------------------------------------------------------- runnable views
def run_finished_trials(spark: SparkSession, data_dir: str) -> DataFrame:
    return finished_trials(spark, reports_from_events(events_stream(spark, data_dir)))


def run_async_halving(spark: SparkSession, data_dir: str) -> DataFrame:
    return async_halving(spark, reports_from_events(events_stream(spark, data_dir)))


def run_running_convergence(spark: SparkSession, data_dir: str, w: int = 2) -> DataFrame:
    return running_convergence(spark, reports_from_events(events_stream(spark, data_dir)), w).drop("final")

"""Trial-log and run-log analytics.

The trial log is ``(study, trial, state, f1, disparity, values, params,
model_type, n_steps, batch_size, start_ts, end_ts, error)``; reports are
``(study, trial, step, value, ts)``. Per-study results use partial
aggregation (``max_by``) or the bucketed running/top-k helpers, so a study
holding a third of all trials is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equisel.functions.exprs import r6, safe_div
from equisel.functions.prefix import running_agg, top_k_per_group
from equisel.sources.views import CLASSICAL_MODELS

FINISHED = ("COMPLETE", "PRUNED", "FAIL")
PARAMS = ["model_type", "C", "learning_rate", "n_layers"]


def family(model_type="model_type") -> F.Column:
    return F.when(F.col(model_type).isin(*CLASSICAL_MODELS), "classical").otherwise("quantum")


def scan_trials(log: DataFrame, finished_only: bool = True) -> DataFrame:
    """One row per trial; ``value`` (= values[0], the F1) only for
    COMPLETE trials, NULL for PRUNED / FAIL / RUNNING."""
    out = log.select("study", "trial", "state", "model_type", "values", "params",
                     F.when(F.col("state") == "COMPLETE", F.element_at("values", 1)).alias("value"))
    return out.where(F.col("state").isin(*FINISHED)) if finished_only else out


def best_trial(log: DataFrame, multi_objective: bool = False, feasible_col: str | None = None) -> DataFrame:
    """A1: per study the COMPLETE trial with the highest value (ties → lowest
    trial number). ``feasible_col`` restricts to feasible trials
    (constrained mode). Multi-objective: the Pareto point with the highest
    objective 0 — the highest-F1 point is never dominated on F1, and among
    equal F1 the lowest disparity is kept, then the lowest trial."""
    c = scan_trials(log).where(F.col("value").isNotNull())
    if feasible_col:
        c = c.where(F.col(feasible_col))
    key = F.struct(F.col("value"), -F.col("disparity"), -F.col("trial")) if multi_objective else \
        F.struct(F.col("value"), -F.col("trial"))
    if multi_objective:
        c = c.withColumn("disparity", F.element_at("values", 2))
    g = c.groupBy("study").agg(F.max_by(F.struct("trial", "value"), key).alias("b"))
    return g.select("study", F.col("b.trial").alias("trial"), F.col("b.value").alias("value"))


def pareto_front(log: DataFrame, f1: str = "f1", disparity: str = "disparity") -> DataFrame:
    """A2: COMPLETE trials not dominated on (max F1, min disparity); equal
    points both stay. Sort skyline per study: min disparity per F1 value,
    running min over strictly higher F1 (bucketed), keep a point that is the
    lowest at its F1 and strictly below every higher-F1 point."""
    c = log.where(F.col("state") == "COMPLETE").select("study", "trial", F.col(f1).alias("f1"),
                                                        F.col(disparity).alias("disparity"))
    per_f1 = c.groupBy("study", "f1").agg(F.min("disparity").alias("dmin"))
    run = running_agg(per_f1, "f1", ["dmin"], fn="min", by=["study"], descending=True, inclusive=False)
    j = c.join(run, on=["study", "f1"], how="inner")
    keep = (F.col("disparity") == F.col("dmin")) & (F.col("run_dmin").isNull() | (F.col("disparity") < F.col("run_dmin")))
    return j.where(keep).select("study", "trial", "f1", "disparity")


def optimisation_history(log: DataFrame) -> DataFrame:
    """A3: finished trials with value, model, family-split value columns and
    the running best per study (bucketed running max)."""
    s = scan_trials(log).select("study", "trial", "value", "model_type", "state")
    fam = family()
    s = s.withColumn("quantum_value", F.when(fam == "quantum", F.col("value"))).withColumn(
        "classical_value", F.when(fam == "classical", F.col("value")))
    r = running_agg(s, "trial", ["value"], fn="max", by=["study"], prefix="best_")
    return r.withColumnRenamed("best_value", "best_so_far")


def progress(log: DataFrame) -> DataFrame:
    """A4: finished count of total and percent per study (RUNNING not finished)."""
    g = log.groupBy("study").agg(F.count_if(F.col("state").isin(*FINISHED)).alias("finished"),
                                 F.count(F.lit(1)).alias("total"))
    return g.select("*", r6(F.col("finished") * 100.0 / F.col("total"), 2).alias("percent"))


def leaderboard(log: DataFrame, k: int = 10) -> DataFrame:
    """A5: per study the top ``k`` trials by value (desc, nulls last, ties by
    trial) — a top-k report, so the limit is the feature."""
    s = scan_trials(log).select("study", "trial", "value", "model_type")
    order = [F.col("value").desc_nulls_last(), F.col("trial")]
    return top_k_per_group(s, ["study"], order, k, "trial")


def best_per_family(log: DataFrame) -> DataFrame:
    """Per study and family (quantum / classical) the best COMPLETE trial."""
    s = scan_trials(log).where(F.col("value").isNotNull()).withColumn("family", family())
    g = s.groupBy("study", "family").agg(
        F.max_by(F.struct("trial", "value", "model_type"), F.struct(F.col("value"), -F.col("trial"))).alias("b"))
    return g.select("study", "family", "b.trial", "b.value", "b.model_type")


def repair_best_value(runs: DataFrame, log: DataFrame) -> DataFrame:
    """Where a run's stored best differs from the maximum over its
    finished trials, value and parameters (JSON, by name) become those of the
    best trial."""
    best = best_trial(log).join(log.select("study", "trial", "params"), ["study", "trial"])
    named = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("params"))))
    j = runs.join(best.select("study", F.col("value").alias("__v"), named.alias("__p")), "study", "left")
    stale = F.col("__v").isNotNull() & ~F.col("best_value").eqNullSafe(F.col("__v"))
    new = {"best_value": "__v", "best_params_json": "__p"}
    return j.select(*[F.when(stale, F.col(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in runs.columns],
                    stale.alias("repaired"))


def param_slices(log: DataFrame, params: Sequence[str] = PARAMS) -> DataFrame:
    """Long ``(study, trial, param, choice, value)`` of finished trials."""
    s = scan_trials(log)
    return s.select("study", "trial", "value", F.explode("params").alias("param", "choice")).where(
        F.col("param").isin(*params))


def parallel_coordinates(log: DataFrame, params: Sequence[str] = PARAMS) -> DataFrame:
    """A10: wide table value + one column per param (pivot with an explicit
    value list, so no extra pass to discover columns)."""
    long = param_slices(log, params)
    return long.groupBy("study", "trial", "value").pivot("param", list(params)).agg(F.first("choice"))


def param_importance(log: DataFrame, params: Sequence[str] = PARAMS) -> DataFrame:
    """A9 (exact variant): per study and param the share of the objective's
    variance explained by the param's choices (η² = between-choice sum of
    squares / total sum of squares), normalised to sum 1 over params.
    Needs ≥ 2 COMPLETE trials and ≥ 2 params; otherwise no rows."""
    done = scan_trials(log).where(F.col("value").isNotNull())
    long = param_slices(log, params).where(F.col("value").isNotNull())
    st = done.groupBy("study").agg(F.avg("value").alias("mu"), F.count(F.lit(1)).alias("n_trials"))
    npar = long.groupBy("study").agg(F.countDistinct("param").alias("n_params"))
    st = st.join(npar, "study").where((F.col("n_trials") >= 2) & (F.col("n_params") >= 2))
    tot = done.join(st, "study").groupBy("study").agg(F.sum((F.col("value") - F.col("mu")) ** 2).alias("ss_tot"))
    per_c = long.groupBy("study", "param", "choice").agg(F.count(F.lit(1)).alias("n_c"), F.avg("value").alias("m_c"))
    between = per_c.join(st.select("study", "mu"), "study").groupBy("study", "param").agg(
        F.sum(F.col("n_c") * (F.col("m_c") - F.col("mu")) ** 2).alias("ss_b"))
    e = between.join(tot, "study").select("study", "param", safe_div(F.col("ss_b"), F.col("ss_tot")).alias("eta2"))
    norm = F.sum("eta2").over(Window.partitionBy("study"))
    return e.select("study", "param", r6("eta2").alias("eta2"), r6(safe_div(F.col("eta2"), norm)).alias("importance"))


def forest_importance(log: DataFrame, study, params: Sequence[str] = PARAMS, n_trees: int = 64, depth: int = 8, seed: int = 0) -> DataFrame:
    """A9 (forest variant): importance of each param for a study's objective by
    a regression forest over the choices, one 0 / 1 feature per (param, choice)
    and the impurity decreases added up per param. Columns: param, importance
    (sum 1, or 0 where no split helps), best_choice (highest mean value).

    Rows are COMPLETE trials with a value; a param that a trial lacks sets no
    feature. Needs ≥ 2 trials and ≥ 2 params, as the exact variant; else no rows.
    The features are as many as there are choices: at most ``MAX_CHOICES``."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    spark = log.sparkSession
    done = scan_trials(log.where(F.col("study") == study)).where(F.col("value").isNotNull()).select("study", "trial", F.col("value").alias("label"))
    long = param_slices(log.where(F.col("study") == study), params).where(F.col("value").isNotNull())
    means = long.groupBy("param", "choice").agg(F.avg("value").alias("m")).orderBy("param", "choice").limit(MAX_CHOICES + 1).collect()
    if len(means) > MAX_CHOICES:
        raise ValueError(f"more than {MAX_CHOICES} choices in study {study!r}")
    known = sorted({r["param"] for r in means})
    out = "param string, importance double, best_choice string"
    if len(known) < 2 or done.limit(2).count() < 2:
        return spark.createDataFrame([], out)
    place = F.create_map(*[x for i, r in enumerate(means) for x in (F.lit(_cell(r["param"], r["choice"])), F.lit(i))])
    cell = F.concat(F.length("param").cast("string"), F.lit(":"), F.col("param"), F.coalesce(F.concat(F.lit("="), F.col("choice")), F.lit("")))
    on = long.select("trial", F.element_at(place, cell).alias("i")).groupBy("trial").agg(F.collect_set("i").alias("on"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(len(means) - 1)), lambda i: F.array_contains(F.coalesce("on", F.array().cast("array<int>")), i).cast("double"))
    rows = done.join(on, "trial", "left").orderBy("trial").select("label", array_to_vector(bits).alias("features"))
    forest = RandomForestRegressor(numTrees=n_trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(rows)
    weight = forest.featureImportances.toArray()
    total = {p: sum(float(w) for w, r in zip(weight, means, strict=True) if r["param"] == p) for p in known}
    best = {p: max((r for r in means if r["param"] == p), key=lambda r: (r["m"], str(r["choice"])))["choice"] for p in known}
    return spark.createDataFrame([(p, total[p], best[p]) for p in known], out)


#: Most (param, choice) pairs that a forest takes as features.
MAX_CHOICES = 1000


def _cell(param: str, choice: str | None) -> str:
    return f"{len(param)}:{param}" + ("" if choice is None else f"={choice}")


def timeline(log: DataFrame) -> DataFrame:
    """Start, end, duration (seconds) and state per trial."""
    dur = (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 1e6
    return log.select("study", "trial", "start_ts", "end_ts", dur.alias("duration_s"), "state")


def resource_totals(log: DataFrame) -> DataFrame:
    """Per study Σ steps, Σ steps × batch size and Σ wall time,
    pruned trials included."""
    dur = (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 1e6
    return log.groupBy("study").agg(
        F.sum(F.coalesce(F.col("n_steps"), F.lit(0))).cast("long").alias("total_steps"),
        F.sum(F.coalesce(F.col("n_steps") * F.col("batch_size"), F.lit(0))).cast("long").alias("total_samples"),
        r6(F.sum(F.coalesce(dur, F.lit(0.0))), 3).alias("total_seconds"))


def run_dashboard(runs: DataFrame) -> DataFrame:
    """Completed / in progress (running + pending) / other, plus per status."""
    st = runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    bucket = F.when(F.col("status") == "completed", "completed").when(
        F.col("status").isin("running", "pending"), "in_progress").otherwise("other")
    summary = st.groupBy(bucket.alias("status")).agg(F.sum("n").alias("n")).select(
        F.lit("summary").alias("kind"), "status", F.col("n").cast("long").alias("n"))
    return summary.unionByName(st.select(F.lit("status").alias("kind"), "status", F.col("n").cast("long").alias("n")))


def run_summaries(runs: DataFrame, datasets: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Runs newest first with the dataset name (fallback: its id); a
    live-state table (job_id, status), when given, overrides stored status."""
    j = runs.join(datasets.select("dataset_id", "name"), "dataset_id", "left")
    if live is not None:
        j = j.join(live.select("job_id", F.col("status").alias("__live")), "job_id", "left").withColumn(
            "status", F.coalesce("__live", "status")).drop("__live")
    return j.select("job_id", "status", "started_at", F.coalesce("name", "dataset_id").alias("dataset_name"),
                    "best_value").orderBy(F.col("started_at").desc(), "job_id")


def pruning_telemetry(reports: DataFrame) -> DataFrame:
    """Per trial the number of reports and the value at the largest step."""
    return reports.groupBy("study", "trial").agg(F.count(F.lit(1)).alias("n_reports"),
                                                 F.max_by("value", "step").alias("last_value"))


def failure_summary(log: DataFrame) -> DataFrame:
    """Failed trials per study with the last error (highest trial number)."""
    f = log.where(F.col("state") == "FAIL")
    return f.groupBy("study").agg(F.count(F.lit(1)).alias("n_failed"), F.max_by("error", "trial").alias("last_error"))

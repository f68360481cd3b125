"""Checked queries: trial/run logs (S10, A*), search and pruning (H*), record stores (S*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from equisel.operators import search as H
from equisel.operators import trials as A
from equisel.sources import stores as S
from equisel.sources import views as V
from equisel.sources.sql_views import CLASSICAL_SQL, H as HSQL, with_views

QUERIES: dict = {}
SQL: dict = {}


def reg(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        SQL[name] = sql


TR = V.trials
RP = V.reports
_VALUE = "CASE WHEN state = 'COMPLETE' THEN f1 END"
_FIN = "state IN ('COMPLETE', 'PRUNED', 'FAIL')"

reg("s10_scan_trials", lambda s, d: A.scan_trials(TR(s, d)).withColumn(
    "params", F.array_join(F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")),
    with_views(f"""SELECT study, trial, state, model_type, {_VALUE} AS value, CASE WHEN state = 'COMPLETE' THEN [f1, disparity] END AS values,
       'C=' || "C" || ',learning_rate=' || learning_rate || ',model_type=' || model_type || ',n_layers=' || n_layers AS params
       FROM trials WHERE {_FIN}""", "trials"))

reg("a01_best_trial", lambda s, d: A.best_trial(TR(s, d)),
    with_views(f"""SELECT study, trial, value FROM (SELECT study, trial, {_VALUE} AS value,
       row_number() OVER (PARTITION BY study ORDER BY {_VALUE} DESC, trial) AS rn FROM trials WHERE state = 'COMPLETE')
       WHERE rn = 1""", "trials"))
reg("a01_best_trial_multi_objective", lambda s, d: A.best_trial(TR(s, d), multi_objective=True),
    with_views("""SELECT study, trial, value FROM (SELECT study, trial, f1 AS value,
       row_number() OVER (PARTITION BY study ORDER BY f1 DESC, disparity, trial) AS rn FROM trials WHERE state = 'COMPLETE')
       WHERE rn = 1""", "trials"))
reg("a01_best_trial_feasible", lambda s, d: A.best_trial(
    TR(s, d).join(H.fairness_feasible(TR(s, d), 0.5).select("study", "trial", "feasible"), ["study", "trial"]),
    feasible_col="feasible"),
    with_views("""SELECT study, trial, value FROM (SELECT study, trial, f1 AS value,
       row_number() OVER (PARTITION BY study ORDER BY f1 DESC, trial) AS rn FROM trials
       WHERE state = 'COMPLETE' AND coalesce(disparity, 1.0) - 0.5 <= 0) WHERE rn = 1""", "trials"))

reg("a02_pareto_front", lambda s, d: A.pareto_front(TR(s, d)),
    with_views("""SELECT a.study, a.trial, a.f1, a.disparity FROM trials a WHERE a.state = 'COMPLETE' AND NOT EXISTS (
       SELECT 1 FROM trials b WHERE b.state = 'COMPLETE' AND b.study = a.study
         AND b.f1 >= a.f1 AND b.disparity <= a.disparity AND (b.f1 > a.f1 OR b.disparity < a.disparity))""", "trials"))

reg("a03_optimisation_history", lambda s, d: A.optimisation_history(TR(s, d)),
    with_views(f"""SELECT study, trial, value, model_type, state,
       CASE WHEN model_type NOT IN {CLASSICAL_SQL} THEN value END AS quantum_value,
       CASE WHEN model_type IN {CLASSICAL_SQL} THEN value END AS classical_value,
       max(value) OVER (PARTITION BY study ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far
       FROM (SELECT *, {_VALUE} AS value FROM trials WHERE {_FIN})""", "trials"))

reg("a04_progress", lambda s, d: A.progress(TR(s, d)),
    with_views(f"""SELECT study, CAST(count_if({_FIN}) AS BIGINT) AS finished, count(*) AS total,
       round(count_if({_FIN}) * 100.0::DOUBLE / count(*), 2) AS percent FROM trials GROUP BY study""", "trials"))

reg("a05_leaderboard_top10", lambda s, d: A.leaderboard(TR(s, d), 10),
    with_views(f"""SELECT study, trial, value, model_type, CAST(rank AS INTEGER) AS rank FROM (
       SELECT study, trial, value, model_type,
              row_number() OVER (PARTITION BY study ORDER BY value DESC NULLS LAST, trial) AS rank
       FROM (SELECT *, {_VALUE} AS value FROM trials WHERE {_FIN})) WHERE rank <= 10""", "trials"))

reg("a06_best_per_family", lambda s, d: A.best_per_family(TR(s, d)),
    with_views(f"""SELECT study, family, trial, value, model_type FROM (
       SELECT study, trial, f1 AS value, model_type,
              CASE WHEN model_type IN {CLASSICAL_SQL} THEN 'classical' ELSE 'quantum' END AS family,
              row_number() OVER (PARTITION BY study, CASE WHEN model_type IN {CLASSICAL_SQL} THEN 'classical' ELSE 'quantum' END
                                 ORDER BY f1 DESC, trial) AS rn
       FROM trials WHERE state = 'COMPLETE') WHERE rn = 1""", "trials"))

reg("a08_repair_best_value", lambda s, d: A.repair_best_value(V.runs(s, d), TR(s, d)),
    with_views("""SELECT r.job_id, r.dataset_id, r.study, r.status, r.started_at, b.value IS NOT NULL AND r.best_value IS DISTINCT FROM b.value AS repaired,
       CASE WHEN b.value IS NOT NULL AND r.best_value IS DISTINCT FROM b.value THEN b.value ELSE r.best_value END AS best_value,
       CASE WHEN b.value IS NOT NULL AND r.best_value IS DISTINCT FROM b.value THEN b.params ELSE r.best_params_json END AS best_params_json
       FROM runs r LEFT JOIN (SELECT study, f1 AS value, CAST(to_json(struct_pack("C" := "C", learning_rate := learning_rate, model_type := model_type,
            n_layers := n_layers)) AS VARCHAR) AS params, row_number() OVER (PARTITION BY study ORDER BY f1 DESC, trial) AS rn
            FROM trials WHERE state = 'COMPLETE' AND f1 IS NOT NULL) b ON b.study = r.study AND b.rn = 1""", "runs", "trials"))

_LONG = f"""SELECT study, trial, {_VALUE} AS value, param, choice FROM trials
  UNPIVOT (choice FOR param IN (model_type, "C", learning_rate, n_layers)) WHERE {_FIN}"""
def _forest(s, d):
    log = TR(s, d)
    best = A.scan_trials(log).where("value IS NOT NULL").groupBy("study").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "study").first()
    return A.forest_importance(log, best["study"])  # the study with the most finished trials


reg("a09_forest_importance", _forest)
reg("a09_param_importance", lambda s, d: A.param_importance(TR(s, d)),
    with_views("""
SELECT study, param, round(eta2, 6) AS eta2, round(CASE WHEN sum(eta2) OVER (PARTITION BY study) = 0 THEN 0.0
       ELSE eta2 / sum(eta2) OVER (PARTITION BY study) END, 6) AS importance
FROM (SELECT b.study, b.param, CASE WHEN t.ss_tot = 0 THEN 0.0 ELSE b.ss_b / t.ss_tot END AS eta2
      FROM (SELECT c.study, c.param, sum(c.n_c * (c.m_c - st.mu) ^ 2) AS ss_b
            FROM (SELECT study, param, choice, count(*) AS n_c, avg(value) AS m_c FROM long_ GROUP BY 1, 2, 3) c
            JOIN st ON st.study = c.study GROUP BY 1, 2) b
      JOIN (SELECT d.study, sum((d.value - st.mu) ^ 2) AS ss_tot FROM done d JOIN st ON st.study = d.study GROUP BY 1) t
      ON t.study = b.study)""", "trials", extra={
        "long_": _LONG.replace("WHERE", "WHERE state = 'COMPLETE' AND"),
        "done": "SELECT study, trial, f1 AS value FROM trials WHERE state = 'COMPLETE'",
        "st": "SELECT study, avg(value) AS mu FROM done GROUP BY study HAVING count(*) >= 2",
    }))

reg("a10_parallel_coordinates", lambda s, d: A.parallel_coordinates(TR(s, d)),
    with_views(f'SELECT study, trial, {_VALUE} AS value, model_type, "C", learning_rate, n_layers FROM trials WHERE {_FIN}',
               "trials"))
reg("a11_param_slices", lambda s, d: A.param_slices(TR(s, d)), with_views(_LONG, "trials"))
reg("a12_timeline", lambda s, d: A.timeline(TR(s, d)),
    with_views("SELECT study, trial, start_ts, end_ts, (epoch_us(end_ts) - epoch_us(start_ts)) / 1e6 AS duration_s, state "
               "FROM trials", "trials"))
reg("a13_resource_totals", lambda s, d: A.resource_totals(TR(s, d)),
    with_views("""SELECT study, CAST(sum(n_steps) AS BIGINT) AS total_steps, CAST(sum(n_steps * batch_size) AS BIGINT) AS total_samples,
       round(sum((epoch_us(end_ts) - epoch_us(start_ts)) / 1e6), 3) AS total_seconds FROM trials GROUP BY study""", "trials"))
reg("a14_run_dashboard", lambda s, d: A.run_dashboard(V.runs(s, d)),
    with_views("""SELECT 'summary' AS kind, CASE WHEN status = 'completed' THEN 'completed'
       WHEN status IN ('running', 'pending') THEN 'in_progress' ELSE 'other' END AS status, count(*) AS n FROM runs GROUP BY 2
       UNION ALL SELECT 'status', status, count(*) FROM runs GROUP BY status""", "runs"))
reg("a15_run_summaries", lambda s, d: A.run_summaries(V.runs(s, d), V.datasets(s, d)),
    with_views("""SELECT r.job_id, r.status, r.started_at, coalesce(d.name, r.dataset_id) AS dataset_name, r.best_value
       FROM runs r LEFT JOIN datasets d ON d.dataset_id = r.dataset_id""", "runs", "datasets"))
reg("a16_pruning_telemetry", lambda s, d: A.pruning_telemetry(RP(s, d)),
    with_views("SELECT study, trial, count(*) AS n_reports, arg_max(value, step) AS last_value FROM reports GROUP BY 1, 2",
               "reports"))
reg("a17_failure_summary", lambda s, d: A.failure_summary(TR(s, d)),
    with_views("SELECT study, count(*) AS n_failed, arg_max(error, trial) AS last_error FROM trials WHERE state = 'FAIL' "
               "GROUP BY study", "trials"))

# ---------------------------------------------------------------- search
_REG_VALUES = ", ".join(f"('{m}', '{p}')" for m, ps in H.MODEL_PARAMS.items() for p in ps)
reg("h01_relevant_params", lambda s, d: H.relevant_params(TR(s, d)),
    with_views(f"""SELECT l.study, l.trial, l.model_type, l.param, l.choice FROM (
       SELECT study, trial, model_type AS model_type, param, choice FROM trials
       UNPIVOT (choice FOR param IN ("C", learning_rate, n_layers))) l
       WHERE l.model_type NOT IN (SELECT DISTINCT m FROM (VALUES {_REG_VALUES}) r(m, p))
          OR (l.model_type, l.param) IN (SELECT (m, p) FROM (VALUES {_REG_VALUES}) r(m, p))""", "trials"))

_GRID_SPACE = {"C": [0.1, 1, 10, 100], "learning_rate": [0.001, 0.01, 0.1], "n_layers": [1, 5, 10]}


def _grid_cov(s, d):
    g = H.grid(s, V.MODEL_TYPES, _GRID_SPACE)
    t = TR(s, d).groupBy("model_type", "C", "learning_rate", "n_layers").agg(F.count(F.lit(1)).alias("n_trials"))
    return g.join(t, ["model_type", "C", "learning_rate", "n_layers"], "left").select(
        "model_type", "C", "learning_rate", "n_layers", F.coalesce("n_trials", F.lit(0)).alias("n_trials"))


_models_sql = ", ".join(f"('{m}')" for m in V.MODEL_TYPES)
reg("h02_grid_coverage", _grid_cov,
    with_views(f"""SELECT g.model_type, g."C", g.learning_rate, g.n_layers, coalesce(t.n, 0) AS n_trials FROM
       (SELECT * FROM (VALUES {_models_sql}) m(model_type)
        CROSS JOIN (VALUES ('0.1'), ('1'), ('10'), ('100')) c("C")
        CROSS JOIN (VALUES ('0.001'), ('0.01'), ('0.1')) l(learning_rate)
        CROSS JOIN (VALUES ('1'), ('5'), ('10')) n(n_layers)) g
       LEFT JOIN (SELECT model_type, "C", learning_rate, n_layers, count(*) AS n FROM trials GROUP BY 1, 2, 3, 4) t
       USING (model_type, "C", learning_rate, n_layers)""", "trials"))


def _h3_sql():
    models = V.MODEL_TYPES
    arr = "[" + ", ".join(f"'{m}'" for m in models) + "]"
    cols = [f"{arr}[{HSQL('trial', 5)} % {len(models)} + 1] AS model_type"]
    for i, (p, vs) in enumerate(_GRID_SPACE.items()):
        users = [m for m in models if p in H.MODEL_PARAMS.get(m, [])]
        ch = "[" + ", ".join(f"'{H.choice_text(v)}'" for v in vs) + "]"
        users_sql = "(" + ", ".join(f"'{m}'" for m in users) + ")"
        cols.append(f"CASE WHEN {arr}[{HSQL('trial', 5)} % {len(models)} + 1] IN {users_sql} "
                    f"THEN {ch}[{HSQL('trial', 5 * 1000 + i + 1)} % {len(vs)} + 1] END AS \"{p}\"")
    return with_views(f"SELECT trial, {', '.join(cols)} FROM trials WHERE state = 'COMPLETE'", "trials")


reg("h03_random_space", lambda s, d: H.random_space(TR(s, d).where(F.col("state") == "COMPLETE"), "trial", V.MODEL_TYPES,
                                                   _GRID_SPACE, seed=5), _h3_sql())


def _tpe(s, d):
    t = TR(s, d)
    cands = t.where(F.col("state") != "COMPLETE").select("study", F.col("trial").alias("cand_id"), "params")
    return H.tpe_rank(t, cands, ["model_type", "C", "learning_rate", "n_layers"])


_TPE_P = '(model_type, "C", learning_rate, n_layers)'
_TPE_CTES = {
    "lab": """SELECT study, trial, row_number() OVER (PARTITION BY study ORDER BY f1 DESC, trial)
                 <= ceil(count(*) OVER (PARTITION BY study) * 0.25::DOUBLE) AS good
              FROM trials WHERE state = 'COMPLETE'""",
    "long_": f"""SELECT l.study, l.good, u.param, u.choice FROM lab l JOIN (
                SELECT study, trial, param, choice FROM trials UNPIVOT (choice FOR param IN {_TPE_P})) u
                ON u.study = l.study AND u.trial = l.trial""",
    # every choice of the finished trials and of the candidates is one of the K
    "cnt": f"""SELECT study, param, choice, sum(g) AS ng_c, sum(b) AS nb_c FROM (
                SELECT study, param, choice, CAST(good AS INTEGER) AS g, CAST(NOT good AS INTEGER) AS b FROM long_
                UNION ALL SELECT study, param, choice, 0, 0 FROM trials UNPIVOT (choice FOR param IN {_TPE_P}) WHERE state <> 'COMPLETE')
              GROUP BY 1, 2, 3""",
    "k_": 'SELECT study, param, count(*) AS "K" FROM cnt GROUP BY 1, 2',
    "tot": "SELECT study, count_if(good) AS ng, count_if(NOT good) AS nb FROM lab GROUP BY 1",
    "dens": """SELECT c.study, c.param, c.choice,
                  ln((c.ng_c + 1) / (t.ng + k_."K")) - ln((c.nb_c + 1) / (t.nb + k_."K")) AS llr
               FROM cnt c JOIN k_ ON k_.study = c.study AND k_.param = c.param JOIN tot t ON t.study = c.study""",
    "cands": f"""SELECT study, trial AS cand_id, param, choice FROM trials UNPIVOT (choice FOR param IN {_TPE_P})
                WHERE state <> 'COMPLETE'""",
    "sc": """SELECT c.study, c.cand_id, round(sum(coalesce(d.llr, 0.0)), 6) + 0.0 AS score FROM cands c
             LEFT JOIN dens d ON d.study = c.study AND d.param = c.param AND d.choice = c.choice GROUP BY 1, 2""",
}
reg("h04_tpe_rank", _tpe, with_views(
    "SELECT study, cand_id, score, CAST(rank() OVER (PARTITION BY study ORDER BY score DESC, cand_id) AS INTEGER) AS rank FROM sc",
    "trials", extra=_TPE_CTES))

_PT_SC = "(SELECT trial, score AS s, count_if(y_true = 1) AS p, count_if(y_true <> 1) AS n FROM predictions_by_trial GROUP BY 1, 2)"
reg("h06_tune_threshold", lambda s, d: H.tune_threshold(V.predictions_by_trial(s, d)),
    with_views(f"""
SELECT b.trial, k / 20 AS best_threshold, round(f1, 6) AS best_f1, round(base_f1, 6) AS base_f1,
       f1 > base_f1 AS adopted
FROM (SELECT trial, k, f1, row_number() OVER (PARTITION BY trial ORDER BY f1 DESC, k) AS rn FROM (
        SELECT trial, k, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM (
          SELECT trial, k, sum(CASE WHEN s >= k / 20 THEN p ELSE 0 END) AS tp, sum(CASE WHEN s >= k / 20 THEN n ELSE 0 END) AS fp,
                 sum(CASE WHEN s < k / 20 THEN p ELSE 0 END) AS fn
          FROM {_PT_SC} CROSS JOIN (SELECT CAST(range AS INTEGER) AS k FROM range(1, 20)) GROUP BY 1, 2))) b
JOIN (SELECT trial, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS base_f1 FROM (
        SELECT trial, count_if(y_true = 1 AND y_pred = 1) AS tp, count_if(y_true <> 1 AND y_pred = 1) AS fp,
               count_if(y_true = 1 AND y_pred <> 1) AS fn FROM predictions_by_trial GROUP BY 1)) c ON c.trial = b.trial
WHERE rn = 1""", "predictions_by_trial"))


def _fam(s, d):
    t = TR(s, d).where(F.col("state") == "COMPLETE").select(
        "study", "trial", "model_type", F.round(1 - F.col("disparity"), 6).alias("accuracy"),
        F.col("f1").alias("f1_score"), F.col("f1").alias("score"))
    return H.family_attrs(t)


reg("h08_family_attrs", _fam,
    with_views(f"""SELECT study, trial, model_type, accuracy, f1_score, score,
       CASE WHEN c THEN accuracy ELSE 0.0 END AS Classical_accuracy, CASE WHEN NOT c THEN accuracy ELSE 0.0 END AS Quantum_accuracy,
       CASE WHEN c THEN f1_score ELSE 0.0 END AS Classical_f1_score, CASE WHEN NOT c THEN f1_score ELSE 0.0 END AS Quantum_f1_score,
       CASE WHEN c THEN score ELSE 0.0 END AS Classical_score, CASE WHEN NOT c THEN score ELSE 0.0 END AS Quantum_score
       FROM (SELECT study, trial, model_type, round(1 - disparity, 6) AS accuracy, f1 AS f1_score, f1 AS score,
                    model_type IN {CLASSICAL_SQL} AS c FROM trials WHERE state = 'COMPLETE')""", "trials"))

# a study's own lists are what its trials were set up with: every choice that occurs, in text order
_CUR = {"C": [0.1, 1, 10], "learning_rate": [0.001, 0.01, 0.1], "n_layers": [1, 10, 5]}


def _resume(s, d):
    """The choice lists kept for the trial log against a new space."""
    t = TR(s, d).select(F.explode("params").alias("param", "choice")).where(F.col("param").isin(*_CUR))
    kept = t.groupBy("param").agg(F.array_sort(F.collect_set("choice")).alias("choices")).withColumn(
        "model_types", F.array(F.lit("Perceptron"), F.lit("SVC")))
    return H.check_resume(kept, H.stored_space(s, _CUR, ["SVC", "SVClinear"]))


reg("h10_check_resume", _resume,
    with_views("""SELECT param, stored, "current" FROM (
       SELECT param, list_sort(list(DISTINCT choice)) AS stored FROM trials
       UNPIVOT (choice FOR param IN ("C", learning_rate, n_layers)) GROUP BY param) s
       JOIN (VALUES ('C', ['0.1', '1', '10']), ('learning_rate', ['0.001', '0.01', '0.1']), ('n_layers', ['1', '10', '5']))
            c(param, "current") USING (param) WHERE stored <> "current"
       UNION ALL SELECT 'model_type', ['Perceptron', 'SVC'], ['SVC', 'SVClinear'] FROM (SELECT 1 FROM trials LIMIT 1)""", "trials"))


ASHA_RUNGS = 12


def _asha_ctes(name: str, min_resource: int, eta: int, where: str = "true") -> tuple[dict, str]:
    """One CTE per rung: the trials that kept the rung below, ranked there."""
    ctes = {f"{name}_i": f"""SELECT *, row_number() OVER (PARTITION BY study, trial ORDER BY step) - 1 AS idx
             FROM reports_b WHERE {where}"""}
    for r in range(ASHA_RUNGS):
        at = min_resource * eta ** r
        below = "" if r == 0 else f"AND (study, trial) IN (SELECT (study, trial) FROM {name}_{r - 1} WHERE kept)"
        ctes[f"{name}_{r}"] = f"""SELECT study, trial, rung, resource, value, rank, n, rank <= greatest(1, floor(n / {eta})) AS kept FROM (
          SELECT study, trial, CAST({r} AS INTEGER) AS rung, idx AS resource, value,
                 row_number() OVER (PARTITION BY study ORDER BY value DESC, trial) AS rank, count(*) OVER (PARTITION BY study) AS n
          FROM {name}_i WHERE idx = {at} {below})"""
    return ctes, " UNION ALL ".join(f"SELECT * FROM {name}_{r}" for r in range(ASHA_RUNGS))


def _asha_sql() -> str:
    ctes, rows = _asha_ctes("a", 1, 3)
    return with_views(rows, "reports", extra={"reports_b": "SELECT * FROM reports", **ctes})


def _hyperband_sql() -> str:
    c0, r0 = _asha_ctes("a", 1, 3, "bracket = 0")
    c1, r1 = _asha_ctes("b", 3, 3, "bracket = 1")
    return with_views(f"SELECT CAST(0 AS INTEGER) AS bracket, * FROM ({r0}) UNION ALL SELECT CAST(1 AS INTEGER), * FROM ({r1})", "reports",
                      extra={"reports_b": f"SELECT *, CAST({HSQL('trial', 17)} % 2 AS INTEGER) AS bracket FROM reports", **c0, **c1})


reg("h12_asha_prune", lambda s, d: H.asha_prune(RP(s, d), 1, 3), _asha_sql())
reg("h13_hyperband_prune", lambda s, d: H.hyperband_prune(RP(s, d), 1, 3, 2), _hyperband_sql())
reg("h14_intermediate_neg_loss", lambda s, d: H.intermediate_neg_loss(RP(s, d), 3),
    with_views("""SELECT study, trial, step, row_number() OVER (PARTITION BY study, trial ORDER BY step) - 1 AS report_idx,
       round(-avg(value) OVER (PARTITION BY study, trial ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS neg_loss
       FROM reports""", "reports"))
for _m, _t in (("demographic_parity_difference", None), ("disparate_impact", 0.8)):
    reg(f"h15_fairness_feasible_{_m}", (lambda m, t: lambda s, d: H.fairness_feasible(TR(s, d), t, m))(_m, _t),
        with_views(f"""SELECT study, trial, state, round(coalesce(disparity, 1.0) - {0.1 if _t is None else 1.0 - _t!r}, 6) AS constraint,
           coalesce(disparity, 1.0) - {0.1 if _t is None else 1.0 - _t!r} <= 0 AS feasible FROM trials""", "trials"))

# ---------------------------------------------------------------- stores
def _ds_records(s, d):
    r = V.runs(s, d)
    return r.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("rows")).select(
        "dataset_id", F.concat(F.lit("upload-"), F.col("dataset_id")).alias("name"), F.lit("upload").alias("source"), "rows")


reg("s05_upsert_datasets", lambda s, d: S.upsert(V.datasets(s, d), _ds_records(s, d), "dataset_id"),
    with_views("""SELECT dataset_id, 'upload-' || dataset_id AS name, 'upload' AS source, count(*) AS "rows" FROM runs GROUP BY dataset_id
       UNION ALL SELECT * FROM datasets WHERE dataset_id NOT IN (SELECT dataset_id FROM runs)""", "runs", "datasets"))
reg("s06_upsert_runs", lambda s, d: S.upsert(V.runs(s, d), V.runs(s, d).where(F.col("status") == "failed").withColumn(
    "status", F.lit("retried")), "job_id"),
    with_views("SELECT * REPLACE (CASE WHEN status = 'failed' THEN 'retried' ELSE status END AS status) FROM runs", "runs"))


def _patch(s, d):
    r = V.runs(s, d)
    p = r.where(F.col("status") == "failed").select("job_id", F.lit(0.0).alias("best_value"))
    missing = r.where(F.col("status") == "pending").select(
        F.concat(F.col("job_id"), F.lit("-missing")).alias("job_id"), F.lit(1.0).alias("best_value"))
    return S.patch(r, p.unionByName(missing), "job_id")


reg("s06_patch_runs", _patch,
    with_views("SELECT * REPLACE (CASE WHEN status = 'failed' THEN 0.0 ELSE best_value END AS best_value) FROM runs", "runs"))
reg("s07_list_runs", lambda s, d: S.list_newest_first(V.runs(s, d)), with_views("SELECT * FROM runs", "runs"))
reg("s07_delete_runs", lambda s, d: S.delete_keys(V.runs(s, d), V.runs(s, d).where(F.col("status") == "failed"), "job_id"),
    with_views("SELECT * FROM runs WHERE job_id NOT IN (SELECT job_id FROM runs WHERE status = 'failed')", "runs"))
reg("s08_count_active_runs", lambda s, d: S.count_active_runs(V.runs(s, d)),
    with_views("SELECT CAST(count_if(status IN ('running', 'pending')) AS BIGINT) AS active FROM runs", "runs"))
reg("s08_mark_stale_interrupted", lambda s, d: S.mark_stale_interrupted(V.runs(s, d)),
    with_views("SELECT * REPLACE (CASE WHEN status IN ('running', 'pending') THEN 'interrupted' ELSE status END AS status) "
               "FROM runs", "runs"))


def _merge(s, d):
    src = V.runs(s, d).drop("best_params_json")
    dst = V.runs(s, d).where(F.col("status") == "completed").withColumn("artifact_storage", F.lit("s3"))
    return S.merge_store(src, dst, "job_id", defaults={"artifact_storage": F.lit("local")})


reg("s09_merge_stores", _merge,
    with_views("""SELECT job_id, dataset_id, study, status, started_at, best_value, best_params_json,
       CASE WHEN status = 'completed' THEN 's3' ELSE 'local' END AS artifact_storage FROM runs""", "runs"))
reg("s09_merge_dry_run", lambda s, d: S.merge_counts(V.runs(s, d), V.runs(s, d).where(F.col("status") == "completed"),
                                                   "job_id", "runs"),
    with_views("""SELECT 'runs' AS "table", CAST(count_if(status <> 'completed') AS BIGINT) AS inserted,
       CAST(count_if(status = 'completed') AS BIGINT) AS existing
       FROM runs""", "runs"))

AR = V.analysis_requests
reg("s11_config_key", lambda s, d: S.config_key(AR(s, d)).select("request_id", "config_json", "config_key"),
    with_views("SELECT request_id, CAST(config_json AS VARCHAR) AS config_json, config_key FROM config_keys",
               "analysis_requests", "config_keys"))


def _jobs(s, d):
    return S.config_key(AR(s, d)).where(F.col("event_type") == "purchase").select(
        "optimization_id", "config_key", F.lit("running").alias("status"))


reg("s12_request_snapshots", lambda s, d: S.request_snapshots(AR(s, d), _jobs(s, d)),
    with_views("""SELECT optimization_id, config_key, CAST(config_json AS VARCHAR) AS config_json, created_at, request_id,
       (optimization_id, config_key) NOT IN (SELECT (optimization_id, config_key) FROM config_keys WHERE event_type = 'purchase') AS new_job
       FROM (SELECT *, row_number() OVER (PARTITION BY optimization_id, config_key ORDER BY created_at DESC, request_id) AS rn
             FROM config_keys) WHERE rn = 1""", "analysis_requests", "config_keys"))


def _snap_complete(s, d):
    snaps = S.request_snapshots(AR(s, d)).drop("new_job").withColumn("revision", F.lit(0)).withColumn(
        "payload", F.lit(None).cast("string"))
    done = S.config_key(AR(s, d)).where(F.col("event_type") == "view").groupBy("optimization_id", "config_key").agg(
        F.concat(F.lit("done-"), F.max("request_id").cast("string")).alias("payload"))
    return S.list_snapshots(S.complete_snapshots(snaps, done))


reg("s13_complete_list_snapshots", _snap_complete,
    with_views("""SELECT s.optimization_id, s.config_key, CAST(s.config_json AS VARCHAR) AS config_json, s.created_at, s.request_id, 1 AS revision,
       'done-' || CAST(v.mx AS VARCHAR) AS payload
       FROM (SELECT *, row_number() OVER (PARTITION BY optimization_id, config_key ORDER BY created_at DESC, request_id) AS rn
             FROM config_keys) s
       JOIN (SELECT optimization_id, config_key, max(request_id) AS mx FROM config_keys WHERE event_type = 'view' GROUP BY 1, 2) v
       ON v.optimization_id = s.optimization_id AND v.config_key = s.config_key WHERE s.rn = 1""",
               "analysis_requests", "config_keys"))


def _cascade(s, d):
    snaps = S.request_snapshots(AR(s, d)).drop("new_job")
    # runs to delete: users with more error than purchase events
    gone = AR(s, d).groupBy("optimization_id").agg(
        F.count_if(F.col("event_type") == "error").alias("e"), F.count_if(F.col("event_type") == "purchase").alias("p")
    ).where(F.col("e") > F.col("p")).select("optimization_id")
    jobs = snaps.select(F.concat_ws("/", F.col("optimization_id").cast("string"), "config_key").alias("snapshot_id"), F.col("request_id").alias("job_id"))
    snaps = snaps.withColumn("snapshot_id", F.concat_ws("/", F.col("optimization_id").cast("string"), "config_key"))
    left = S.delete_for_run({"snapshots": snaps, "jobs": jobs}, gone, via={"jobs": ("snapshots", "snapshot_id")})
    return left["snapshots"].join(left["jobs"].select("snapshot_id", "job_id"), "snapshot_id", "full").drop("snapshot_id")


reg("s14_delete_for_run", _cascade,
    with_views("""SELECT optimization_id, config_key, CAST(config_json AS VARCHAR) AS config_json, created_at, request_id, request_id AS job_id FROM (
       SELECT *, row_number() OVER (PARTITION BY optimization_id, config_key ORDER BY created_at DESC, request_id) AS rn
       FROM config_keys) WHERE rn = 1
       AND optimization_id NOT IN (SELECT optimization_id FROM analysis_requests GROUP BY 1
                                   HAVING count_if(event_type = 'error') > count_if(event_type = 'purchase'))""",
               "analysis_requests", "config_keys"))

reg("s16_json_rows", lambda s, d: S.json_rows(TR(s, d).select(
    "study", "trial", "state", F.when(F.col("state") == "FAIL", F.lit(float("nan"))).otherwise(F.col("f1")).alias("f1"))),
    with_views("""SELECT CAST(to_json(struct_pack(study := study, trial := trial, state := state,
       f1 := CASE WHEN state = 'FAIL' THEN NULL ELSE f1 END)) AS VARCHAR) AS json FROM trials""", "trials"))


def _best_params(s, d):
    r = S.parse_json_columns(V.runs(s, d), {"best_params_json": "map<string,int>"}, "_parsed")
    return r.where(F.col("best_params_json_parsed").isNotNull()).select(
        "job_id", F.col("best_params_json_parsed")["C"].alias("best_C"))


reg("s06_parse_best_params_json", _best_params,
    with_views("SELECT job_id, CAST(json_extract(best_params_json, '$.C') AS INTEGER) AS best_C FROM runs "
               "WHERE best_params_json IS NOT NULL", "runs"))

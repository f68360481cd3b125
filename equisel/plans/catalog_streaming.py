"""Checked queries: streaming views (L*), run to completion with availableNow."""

from __future__ import annotations

from equisel.sources.sql_views import with_views
from equisel.streaming import live as L
from equisel.streaming import state as K

QUERIES: dict = {}
SQL: dict = {}


def reg(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        SQL[name] = sql


reg("l01_live_trials", L.run_live_trials,
    with_views("SELECT study, trial, count(*) AS n_reports, arg_max(value, step) AS last_value FROM reports GROUP BY 1, 2",
               "reports"))
reg("l02_live_progress", L.run_live_progress,
    with_views("""SELECT study, CAST(count_if(state IN ('COMPLETE', 'PRUNED', 'FAIL')) AS BIGINT) AS finished,
       max(CASE WHEN state = 'COMPLETE' THEN f1 END) AS best_value FROM trials GROUP BY study""", "trials"))
def _l03_sql():
    from equisel.plans.catalog_trials import _asha_sql
    return _asha_sql()


# one micro-batch (availableNow over one file) → equals the batch rung table
reg("l03_live_asha", L.run_live_asha, _l03_sql())
reg("l04_live_convergence", L.run_live_convergence,
    with_views("""
SELECT k.study, k.trial, k.n_steps, c.converged_step IS NOT NULL AS converged, c.converged_step
FROM (SELECT study, trial, count(*) AS n_steps FROM reports GROUP BY 1, 2) k LEFT JOIN (
  SELECT study, trial, min(p - 1) AS converged_step FROM (
    SELECT study, trial, p,
           avg(value) OVER (PARTITION BY study, trial ORDER BY step ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS m1,
           avg(value) OVER (PARTITION BY study, trial ORDER BY step ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING) AS m2,
           stddev_pop(value) OVER (PARTITION BY study, trial ORDER BY step ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s1
    FROM (SELECT *, row_number() OVER (PARTITION BY study, trial ORDER BY step) AS p FROM reports))
  WHERE p - 1 > 4 AND abs(m2 - m1) <= s1 / sqrt(2) / 2 GROUP BY study, trial) c
ON c.study = k.study AND c.trial = k.trial""", "reports"))
reg("l05_reports_per_window", L.run_reports_per_window,
    with_views("""SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       count(*) AS n_reports, round(avg(value), 6) AS mean_value FROM reports GROUP BY 1, 2""", "reports"))


# ---------------------------------------------------------------- streams with their own state (equisel.streaming.state)
reg("l01_finished_trials", K.run_finished_trials, with_views("""
SELECT study, trial, count(*) AS n_reports, arg_max(value, step) AS last_value, min(ts) AS first_ts, max(ts) AS last_ts
FROM (SELECT *, sum(is_new) OVER (PARTITION BY study, trial ORDER BY ts ROWS UNBOUNDED PRECEDING) AS stretch
      FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY study, trial ORDER BY ts) + INTERVAL 3 DAY THEN 0 ELSE 1 END AS is_new FROM reports))
GROUP BY study, trial, stretch
HAVING max(ts) + INTERVAL 3 DAY <= (SELECT max(ts) FROM reports) - INTERVAL 1 HOUR""", "reports"))


def _async_sql(rungs: int = 6, eta: int = 3) -> str:
    """Asynchronous halving, rung by rung: only survivors of a rung reach the next."""
    extra = {"placed": """SELECT *, row_number() OVER (PARTITION BY study, trial ORDER BY ts, step) - 1 AS idx,
       row_number() OVER (PARTITION BY study ORDER BY ts, trial, step) AS seq FROM reports"""}
    for r in range(rungs):
        alive = "" if r == 0 else f" AND EXISTS (SELECT 1 FROM d{r - 1} p WHERE p.study = q.study AND p.trial = q.trial AND p.kept)"
        extra[f"a{r}"] = f"SELECT q.study, q.trial, q.idx, q.step, q.value, q.seq FROM placed q WHERE q.idx = {eta ** r}{alive}"
        extra[f"d{r}"] = f"""SELECT *, rank <= greatest(1, n // {eta}) AS kept FROM (
  SELECT a.study, a.trial, CAST({r} AS INTEGER) AS rung, a.idx AS resource, a.step, a.value,
         CAST(1 + count_if(b.value > a.value) AS BIGINT) AS rank, count(*) AS n
  FROM a{r} a JOIN a{r} b ON b.study = a.study AND b.seq <= a.seq GROUP BY ALL)"""
    return with_views(" UNION ALL ".join(f"SELECT * FROM d{r}" for r in range(rungs)), "reports", extra=extra)


reg("l03_async_halving", K.run_async_halving, _async_sql())
reg("l04_running_convergence", K.run_running_convergence, SQL["l04_live_convergence"].replace("k.n_steps, ", "k.n_steps, CAST(0 AS BIGINT) AS n_late, "))

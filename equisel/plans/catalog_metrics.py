"""Checked queries: prediction metrics (Q*) and fairness (B*).

Each entry pairs a Spark callable ``(spark, data_dir) -> DataFrame`` built
from the library operators with DuckDB SQL over the same tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from equisel.operators import fairness as B
from equisel.functions.exprs import r6 as rounded
from equisel.operators import metrics as M
from equisel.plans.sqlfrag import GROUP_METRICS, counts_sql, cum_sql, percls_sql, r6, rates_sql, sdiv
from equisel.sources import views as V
from equisel.sources.sql_views import with_views

QUERIES: dict = {}
SQL: dict = {}


def reg(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        SQL[name] = sql


P = V.predictions
PT = V.predictions_by_trial
PM = V.predictions_mc
DQ = V.doc_quality

# ---------------------------------------------------------------- Q1–Q2
reg("q01_confusion_matrix", lambda s, d: M.confusion_matrix(P(s, d)))
SQL["q01_confusion_matrix"] = with_views(
    """SELECT a.label AS y_true, b.label AS y_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM labs a CROSS JOIN labs b LEFT JOIN cells c ON c.y_true = a.label AND c.y_pred = b.label""",
    "predictions",
    extra={"cells": "SELECT y_true, y_pred, count(*) AS n FROM predictions GROUP BY 1, 2",
           "labs": "SELECT y_true AS label FROM cells UNION SELECT y_pred FROM cells"},
)

_mc_extra = {
    "cells": "SELECT sensitive, y_true, y_pred, count(*) AS n FROM predictions_mc GROUP BY 1, 2, 3",
    "labs": "SELECT sensitive, y_true AS label FROM cells UNION SELECT sensitive, y_pred FROM cells",
    "cm": """SELECT a.sensitive, a.label AS y_true, b.label AS y_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
       FROM labs a JOIN labs b ON a.sensitive = b.sensitive
       LEFT JOIN cells c ON c.sensitive = a.sensitive AND c.y_true = a.label AND c.y_pred = b.label""",
}
reg("q01_confusion_matrix_mc_by_group", lambda s, d: M.confusion_matrix(PM(s, d), by=["sensitive"]),
    with_views("SELECT * FROM cm", "predictions_mc", extra=_mc_extra))

reg("q02_confusion_normalised_mc", lambda s, d: M.confusion_normalised(PM(s, d), by=["sensitive"]),
    with_views(f"""SELECT sensitive, y_true, y_pred, n,
       {r6(sdiv('n', 'sum(n) OVER (PARTITION BY sensitive, y_true)'))} AS rate FROM cm""",
               "predictions_mc", extra=_mc_extra))

# ---------------------------------------------------------------- Q3–Q8
reg("q03_accuracy_by_trial", lambda s, d: M.accuracy(PT(s, d), by=["trial"]),
    with_views(f"SELECT trial, {r6('avg(CAST(y_true = y_pred AS DOUBLE))')} AS accuracy "
               "FROM predictions_by_trial GROUP BY trial", "predictions_by_trial"))

reg("q04_prf_binary_by_trial", lambda s, d: M.precision_recall_f1(PT(s, d), by=["trial"]),
    with_views(f"""SELECT trial, {r6(sdiv('tp', 'tp + fp'))} AS precision, {r6(sdiv('tp', 'tp + fn'))} AS recall,
       {r6(sdiv('2 * tp', '2 * tp + fp + fn'))} AS f1 FROM ({counts_sql('predictions_by_trial', None, ['trial'])})""",
               "predictions_by_trial"))

_pc_mc = percls_sql("predictions_mc", [])
reg("q04_prf_macro_mc", lambda s, d: M.precision_recall_f1(PM(s, d), average="macro"),
    with_views(f"""SELECT {r6(f"avg({sdiv('tp', 'tp + fp')})")} AS precision, {r6(f"avg({sdiv('tp', 'tp + fn')})")} AS recall,
       {r6(f"avg({sdiv('2 * tp', '2 * tp + fp + fn')})")} AS f1 FROM {_pc_mc}""", "predictions_mc"))

_pc_g = percls_sql("predictions_mc", ["sensitive"])
reg("q05_classification_report_mc", lambda s, d: M.classification_report(PM(s, d), by=["sensitive"]))
SQL["q05_classification_report_mc"] = with_views(
    f"""SELECT sensitive, label, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1,
       CAST(support AS BIGINT) AS support FROM allrows""",
    "predictions_mc",
    extra={
        "rows_": f"""SELECT sensitive, CAST(label AS VARCHAR) AS label, {sdiv('tp', 'tp + fp')} AS precision,
            {sdiv('tp', 'tp + fn')} AS recall, {sdiv('2 * tp', '2 * tp + fp + fn')} AS f1, support, tp FROM {_pc_g}""",
        "allrows": """
  SELECT sensitive, label, precision, recall, f1, support FROM rows_
  UNION ALL SELECT sensitive, 'accuracy', NULL, NULL, sum(tp) / sum(support), sum(support) FROM rows_ GROUP BY sensitive
  UNION ALL SELECT sensitive, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rows_ GROUP BY sensitive
  UNION ALL SELECT sensitive, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM rows_ GROUP BY sensitive""",
    },
)


def _marg_sql(src: str, by: list[str]) -> str:
    b = ", ".join(by)
    pc = percls_sql(src, by)
    return f"""SELECT {b + ',' if by else ''} CAST(sum(support) AS DOUBLE) AS s, CAST(sum(tp) AS DOUBLE) AS c,
       sum(CAST(tp + fp AS DOUBLE) * support) AS sum_pt, sum(CAST(tp + fp AS DOUBLE) * (tp + fp)) AS sum_pp,
       sum(CAST(support AS DOUBLE) * support) AS sum_tt FROM {pc} {('GROUP BY ' + b) if by else ''}"""


reg("q06_mcc_mc_by_group", lambda s, d: M.matthews_corrcoef(PM(s, d), by=["sensitive"]),
    with_views(f"""SELECT sensitive, {r6(sdiv('c * s - sum_pt', 'sqrt((s * s - sum_pp) * (s * s - sum_tt))'))} AS mcc
       FROM ({_marg_sql('predictions_mc', ['sensitive'])})""", "predictions_mc"))

reg("q06_mcc_binary_by_trial", lambda s, d: M.matthews_corrcoef(PT(s, d), by=["trial"]),
    with_views(f"""SELECT trial, {r6(sdiv('c * s - sum_pt', 'sqrt((s * s - sum_pp) * (s * s - sum_tt))'))} AS mcc
       FROM ({_marg_sql('predictions_by_trial', ['trial'])})""", "predictions_by_trial"))

reg("q07_kappa_mc", lambda s, d: M.cohens_kappa(PM(s, d)),
    with_views(f"""SELECT {r6(sdiv('c / s - sum_pt / (s * s)', '1.0 - sum_pt / (s * s)'))} AS kappa
       FROM ({_marg_sql('predictions_mc', [])})""", "predictions_mc"))

reg("q07_kappa_by_trial", lambda s, d: M.cohens_kappa(PT(s, d), by=["trial"]),
    with_views(f"""SELECT trial, {r6(sdiv('c / s - sum_pt / (s * s)', '1.0 - sum_pt / (s * s)'))} AS kappa
       FROM ({_marg_sql('predictions_by_trial', ['trial'])})""", "predictions_by_trial"))

_EPS = "2.220446049250313e-16"
reg("q08_log_loss_mc", lambda s, d: M.log_loss(PM(s, d), by=["sensitive"]),
    with_views(f"""SELECT sensitive, {r6(f'-avg(ln(least(greatest(proba[y_true + 1], {_EPS}), 1 - {_EPS})))')} AS log_loss
       FROM predictions_mc GROUP BY sensitive""", "predictions_mc"))

reg("q08_log_loss_binary_by_trial", lambda s, d: M.log_loss(PT(s, d), by=["trial"], score="score"),
    with_views(f"""SELECT trial, {r6(f'-avg(ln(least(greatest(CASE WHEN y_true = 1 THEN score ELSE 1.0 - score END, {_EPS}), 1 - {_EPS})))')} AS log_loss
       FROM predictions_by_trial GROUP BY trial""", "predictions_by_trial"))

# ---------------------------------------------------------------- Q9–Q14
_cum_p = cum_sql("predictions", [])
reg("q09_roc_curve", lambda s, d: M.roc_curve(P(s, d)),
    with_views(f"""SELECT 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
       UNION ALL SELECT CAST(score AS DOUBLE), {r6('cum_neg / "N"')}, {r6('cum_pos / "P"')} FROM {_cum_p}""",
               "predictions"))

_cum_t = cum_sql("predictions_by_trial", ["trial"])
reg("q10_roc_auc_by_trial", lambda s, d: M.roc_auc(PT(s, d), by=["trial"]),
    with_views(f"""SELECT trial, {r6('sum((neg / "N") * ((2 * cum_pos - pos) / "P") / 2)')} AS auc
       FROM {_cum_t} GROUP BY trial""", "predictions_by_trial"))

_cum_dq = cum_sql("doc_quality", ["sensitive"])
reg("q10_roc_auc_docs_by_lang", lambda s, d: M.roc_auc(DQ(s, d), by=["sensitive"]),
    with_views(f"""SELECT sensitive, {r6('sum((neg / "N") * ((2 * cum_pos - pos) / "P") / 2)')} AS auc
       FROM {_cum_dq} WHERE "P" > 0 AND "N" > 0 GROUP BY sensitive""", "doc_quality"))

reg("q11_pr_curve", lambda s, d: M.pr_curve(P(s, d)),
    with_views(f"""SELECT CAST(score AS DOUBLE) AS threshold, {r6('cum_pos / (cum_pos + cum_neg)')} AS precision,
       {r6('cum_pos / "P"')} AS recall FROM {_cum_p} WHERE cum_pos - pos < "P"
       UNION ALL SELECT NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE""", "predictions"))

reg("q12_average_precision_by_trial", lambda s, d: M.average_precision(PT(s, d), by=["trial"]),
    with_views(f"""SELECT trial, {r6('sum((pos / "P") * (cum_pos / (cum_pos + cum_neg)))')} AS average_precision
       FROM {_cum_t} GROUP BY trial""", "predictions_by_trial"))

_ovr_src = "(SELECT u.k AS class_code, CASE WHEN y_true = u.k THEN 1 ELSE 0 END AS y_ind, proba[u.k + 1] AS score FROM predictions_mc CROSS JOIN (SELECT CAST(range AS INTEGER) AS k FROM range(3)) u)"
_cum_ovr = cum_sql(_ovr_src, ["class_code"], y="y_ind")
reg("q13_ovr_auc_ap_mc", lambda s, d: M.ovr_auc(PM(s, d), 3),
    with_views(f"""SELECT class_code, {r6('sum((neg / "N") * ((2 * cum_pos - pos) / "P") / 2)')} AS auc,
       {r6('sum((pos / "P") * (cum_pos / (cum_pos + cum_neg)))')} AS average_precision
       FROM {_cum_ovr} WHERE "P" > 0 AND "N" > 0 GROUP BY class_code""", "predictions_mc"))

reg("q13_ovr_roc_curves_mc", lambda s, d: M.ovr_curves(PM(s, d), 3),
    with_views(f"""SELECT class_code, 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
       FROM {_cum_ovr} WHERE "P" > 0 AND "N" > 0 GROUP BY class_code
       UNION ALL SELECT class_code, CAST(score AS DOUBLE), {r6('cum_neg / "N"')}, {r6('cum_pos / "P"')}
       FROM {_cum_ovr} WHERE "P" > 0 AND "N" > 0""", "predictions_mc"))

reg("q13_ovr_pr_curves_mc", lambda s, d: M.ovr_pr_curves(PM(s, d), 3),
    with_views(f"""SELECT class_code, CAST(score AS DOUBLE) AS threshold, {r6('cum_pos / (cum_pos + cum_neg)')} AS precision,
       {r6('cum_pos / "P"')} AS recall FROM {_cum_ovr} WHERE "P" > 0 AND cum_pos - pos < "P"
       UNION ALL SELECT class_code, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM {_cum_ovr} WHERE "P" > 0 GROUP BY class_code""",
               "predictions_mc"))

reg("q14_macro_ovr_auc_mc", lambda s, d: M.macro_ovr_auc(PM(s, d), 3),
    with_views(f"""SELECT CASE WHEN count(*) = 3 THEN {r6('avg(auc)')} END AS macro_auc FROM (
       SELECT class_code, sum((neg / "N") * ((2 * cum_pos - pos) / "P") / 2) AS auc
       FROM {_cum_ovr} WHERE "P" > 0 AND "N" > 0 GROUP BY class_code)""", "predictions_mc"))

reg("q16_apply_threshold_counts",
    lambda s, d: M.binary_counts(M.apply_threshold(P(s, d), 0.35), by=["sensitive"]),
    with_views(f"""SELECT sensitive, CAST(count_if(y_true = 1 AND yp = 1) AS BIGINT) AS tp,
       CAST(count_if(y_true <> 1 AND yp = 1) AS BIGINT) AS fp, CAST(count_if(y_true = 1 AND yp <> 1) AS BIGINT) AS fn,
       CAST(count_if(y_true <> 1 AND yp <> 1) AS BIGINT) AS tn, count(*) AS n
       FROM (SELECT *, CASE WHEN score >= 0.35 THEN 1 ELSE -1 END AS yp FROM predictions) GROUP BY sensitive""",
               "predictions"))

reg("q18_downsample_roc", lambda s, d: M.downsample_curve(M.roc_curve(P(s, d)), "threshold", max_points=50, descending=True),
    with_views(f"""SELECT threshold, fpr, tpr FROM (
       SELECT *, row_number() OVER (ORDER BY threshold DESC) - 1 AS pos, count(*) OVER () AS n FROM (
         SELECT CAST(score AS DOUBLE) AS threshold, {r6('cum_neg / "N"')} AS fpr, {r6('cum_pos / "P"')} AS tpr FROM {_cum_p}
         UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0))
       WHERE n <= 50 OR pos IN (SELECT DISTINCT CAST(round_even(CAST(i * (n - 1) AS DOUBLE) / 49, 0) AS BIGINT)
                                FROM range(50) r(i))""", "predictions"))

# ---------------------------------------------------------------- Q17
_rep_names = ["accuracy", "precision", "recall", "f1", "mcc", "kappa", "log_loss", "roc_auc", "average_precision"]
reg("q17_metric_report_by_trial", lambda s, d: M.metric_report(PT(s, d), by=["trial"]),
    with_views(f"""
SELECT trial, metric, value, CAST(NULL AS VARCHAR) AS error FROM (
  SELECT c.trial, {r6(sdiv('tp + tn', 'n'))} AS accuracy, {r6(sdiv('tp', 'tp + fp'))} AS precision,
         {r6(sdiv('tp', 'tp + fn'))} AS recall, {r6(sdiv('2 * tp', '2 * tp + fp + fn'))} AS f1,
         {r6(sdiv('m.c * m.s - m.sum_pt', 'sqrt((m.s * m.s - m.sum_pp) * (m.s * m.s - m.sum_tt))'))} AS mcc,
         {r6(sdiv('m.c / m.s - m.sum_pt / (m.s * m.s)', '1.0 - m.sum_pt / (m.s * m.s)'))} AS kappa,
         l.log_loss, a.roc_auc, a.average_precision
  FROM ({counts_sql('predictions_by_trial', None, ['trial'])}) c
  JOIN ({_marg_sql('predictions_by_trial', ['trial'])}) m ON m.trial = c.trial
  JOIN (SELECT trial, {r6(f'-avg(ln(least(greatest(CASE WHEN y_true = 1 THEN score ELSE 1.0 - score END, {_EPS}), 1 - {_EPS})))')} AS log_loss
        FROM predictions_by_trial GROUP BY trial) l ON l.trial = c.trial
  JOIN (SELECT trial, {r6('sum((neg / "N") * ((2 * cum_pos - pos) / "P") / 2)')} AS roc_auc,
               {r6('sum((pos / "P") * (cum_pos / (cum_pos + cum_neg)))')} AS average_precision
        FROM {_cum_t} GROUP BY trial) a ON a.trial = c.trial
) UNPIVOT (value FOR metric IN ({', '.join(_rep_names)}))""", "predictions_by_trial"))

# ---------------------------------------------------------------- fairness
_gc = counts_sql("predictions", "sensitive", [])
_go = f"SELECT * FROM ({_gc}) UNION ALL SELECT '__overall__', sum(tp), sum(fp), sum(fn), sum(tn), sum(n) FROM ({_gc})"
reg("b01_group_metrics", lambda s, d: B.group_metrics(P(s, d)),
    with_views(f"""SELECT "group", {', '.join(f'{r6(m)} AS {m}' for m in GROUP_METRICS)}
       FROM ({rates_sql(f'({_go})', ['"group"'])})""", "predictions"))

_gct = counts_sql("predictions_by_trial", "sensitive", ["trial"])
reg("b02_overall_metrics_by_trial", lambda s, d: B.overall_metrics(PT(s, d), by=["trial"]),
    with_views(f"""SELECT trial, {', '.join(f'{r6(m)} AS {m}' for m in GROUP_METRICS)}
       FROM ({rates_sql(f"({counts_sql('predictions_by_trial', None, ['trial'])})", ['trial'])})""",
               "predictions_by_trial"))


def _disp_sql(src: str, group: str, by: list[str], fav: str = "1") -> str:
    b = ", ".join(by)
    rt = rates_sql(f"({counts_sql(src, group, by, fav)})", by + ['"group"'])
    ratio = "CASE WHEN max(selection_rate) = 0 THEN 'nan'::DOUBLE ELSE min(selection_rate) / max(selection_rate) END"
    return f"""SELECT {b + ',' if by else ''}
       {r6('max(selection_rate) - min(selection_rate)')} AS demographic_parity_difference,
       {r6(ratio)} AS demographic_parity_ratio,
       {r6('greatest(max(recall) - min(recall), max(false_positive_rate) - min(false_positive_rate))')} AS equalized_odds_difference,
       {r6(ratio)} AS disparate_impact,
       {r6('max(recall) - min(recall)')} AS equal_opportunity_difference,
       count(*) AS n_groups
       FROM ({rt}) {('GROUP BY ' + b) if by else ''}"""


reg("b03_b06_disparities", lambda s, d: B.disparities(P(s, d)), with_views(_disp_sql("predictions", "sensitive", []), "predictions"))
reg("b03_b06_disparities_by_trial", lambda s, d: B.disparities(PT(s, d), by=["trial"]),
    with_views(_disp_sql("predictions_by_trial", "sensitive", ["trial"]), "predictions_by_trial"))
reg("b03_b06_disparities_docs", lambda s, d: B.disparities(DQ(s, d)), with_views(_disp_sql("doc_quality", "sensitive", []), "doc_quality"))
reg("b03_b06_disparities_mc_favorable", lambda s, d: B.disparities(PM(s, d), favorable=2),
    with_views(_disp_sql("predictions_mc", "sensitive", [], "2"), "predictions_mc"))

_DN = ["demographic_parity_difference", "demographic_parity_ratio", "equalized_odds_difference",
       "disparate_impact", "equal_opportunity_difference"]
reg("b07_audit", lambda s, d: B.audit(P(s, d)),
    with_views(f"""
SELECT CASE WHEN "group" = '__overall__' THEN 'overall' ELSE 'by_group' END AS section, metric,
       CASE WHEN "group" = '__overall__' THEN NULL ELSE "group" END AS "group", value
FROM (SELECT "group", {', '.join(f'{r6(m)} AS {m}' for m in GROUP_METRICS)} FROM ({rates_sql(f'({_go})', ['"group"'])}))
UNPIVOT (value FOR metric IN ({', '.join(GROUP_METRICS)}))
UNION ALL
SELECT 'disparities', metric, NULL, value FROM ({_disp_sql('predictions', 'sensitive', [])})
UNPIVOT (value FOR metric IN ({', '.join(_DN)}))""", "predictions"))


def _b8_sql(metric: str) -> str:
    d = _disp_sql("predictions_by_trial", "sensitive", ["trial"])
    if metric == "disparate_impact":
        v = "CASE WHEN isnan(disparate_impact) THEN 1.0 ELSE greatest(0.0, 1.0 - disparate_impact) END"
    else:
        v = metric
    return with_views(f"SELECT trial, {r6(f'CASE WHEN n_groups < 2 THEN 1.0 ELSE {v} END')} AS disparity FROM ({d})",
                      "predictions_by_trial")


for _m in B.FAIRNESS_METRICS:
    reg(f"b08_disparity_{_m}", (lambda m: lambda s, d: B.disparity(PT(s, d), m, by=["trial"]))(_m), _b8_sql(_m))

reg("b12_group_chart_data", lambda s, d: B.group_chart_data(P(s, d)))
_nc = [m for m in GROUP_METRICS if m != "count"]
SQL["b12_group_chart_data"] = with_views(
    """SELECT l."group", l.metric, l.value, o.value AS overall FROM long_ l
       JOIN long_ o ON o.metric = l.metric AND o."group" = '__overall__' WHERE l."group" <> '__overall__'""",
    "predictions",
    extra={"long_": f"""SELECT "group", metric, value FROM (SELECT "group", {', '.join(f'{r6(m)} AS {m}' for m in _nc)}
            FROM ({rates_sql(f'({_go})', ['"group"'])})) UNPIVOT (value FOR metric IN ({', '.join(_nc)}))"""},
)


def _mitigation(s, d):
    p = P(s, d)
    from equisel.operators.split import stratified_split

    sp = stratified_split(p, key="row_id", label="y_true", frac=0.75, seed=42)
    train = sp.where(F.col("split") == "train")
    test = sp.where(F.col("split") == "test")
    th = B.mitigate_thresholds(train, "sensitive", "equalized_odds")
    after = B.apply_group_thresholds(test, th)
    return B.mitigation_comparison(test, after)


# decisions are drawn by hash from rules found on the driver: no SQL; tests hold the gaps to bounds
reg("b11_mitigation_comparison", _mitigation)


def _group_cuts(s, d):
    """B11 with one plain cut per group (no draw), so that SQL can say what changes."""
    p = P(s, d)
    groups = sorted(r[0] for r in p.select("sensitive").distinct().limit(21).collect())
    cuts = s.createDataFrame([(g, 0.45 if len(g) % 2 == 0 else 0.55, float("inf"), 1.0, 0.0, 0.0) for g in groups], B.THRESHOLDS)
    return B.mitigation_comparison(p, B.apply_group_thresholds(p, cuts)).select("measure", "before", "after")


_now, _then = (_disp_sql(t, "sensitive", []) for t in ("predictions", "decided"))
reg("b11_group_cuts_comparison", _group_cuts, with_views(f"""
SELECT measure, b.before, a.after FROM (SELECT measure, before FROM ({_now}) UNPIVOT (before FOR measure IN ({', '.join(_DN)}))) b
JOIN (SELECT measure, after FROM ({_then}) UNPIVOT (after FOR measure IN ({', '.join(_DN)}))) a USING (measure)""", "predictions", extra={
    "decided": "SELECT * REPLACE (CASE WHEN score >= CASE WHEN length(sensitive) % 2 = 0 THEN 0.45 ELSE 0.55 END THEN 1 ELSE -1 END AS y_pred) FROM predictions"}))


def _mitigated_rates(s, d):
    """Expected rates per group on the fit data: equal for all groups."""
    p = P(s, d)
    th = B.mitigate_thresholds(p, "sensitive", "equalized_odds", n_grid=20)
    e = B.with_favorable_probability(p, th)
    t = F.col("y_true") == 1
    return e.groupBy(F.col("sensitive").cast("string").alias("group")).agg(
        rounded(F.avg(F.when(t, F.col("p_favorable")))).alias("tpr"), rounded(F.avg(F.when(~t, F.col("p_favorable")))).alias("fpr"))


def _mitigated_sql() -> str:
    """From the definition: a group reaches at a false positive rate x the best
    mix of two of its ROC points around x; the common point is the least of
    these over the groups; the best x of 0, 1/20 .. 1 by accuracy."""
    return with_views("""SELECT g."group", round(w.y, 6) + 0.0 AS tpr, round(w.x, 6) + 0.0 AS fpr FROM (SELECT DISTINCT "group" FROM roc) g, win w""", "predictions", extra={
        "sc": """SELECT CAST(sensitive AS VARCHAR) AS "group", score AS t, count_if(y_true = 1) AS pos, count_if(y_true <> 1) AS neg
                 FROM predictions GROUP BY 1, 2""",
        "cum": """SELECT *, sum(pos) OVER o AS cp, sum(neg) OVER o AS cn, sum(pos) OVER (PARTITION BY "group") AS P, sum(neg) OVER (PARTITION BY "group") AS N
                  FROM sc WINDOW o AS (PARTITION BY "group" ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "roc": """SELECT "group", x, max(y) AS y FROM (SELECT "group", cn / N AS x, cp / P AS y FROM cum
                  UNION ALL SELECT DISTINCT "group", 0.0, 0.0 FROM cum) GROUP BY 1, 2""",
        "tg": "SELECT range / 20.0::DOUBLE AS x FROM range(21)",
        "reach": """SELECT a."group", tg.x, max(CASE WHEN b.x = a.x THEN greatest(a.y, b.y) ELSE a.y + (b.y - a.y) * (tg.x - a.x) / (b.x - a.x) END) AS y
                    FROM tg JOIN roc a ON a.x <= tg.x JOIN roc b ON b."group" = a."group" AND b.x >= tg.x GROUP BY 1, 2""",
        "size": """SELECT sum(P) AS P, sum(N) AS N FROM (SELECT DISTINCT "group", P, N FROM cum)""",
        "win": """SELECT x, y FROM (SELECT x, min(y) AS y FROM reach GROUP BY x), size ORDER BY round((P * y + N * (1 - x)) / (P + N), 9) DESC, x LIMIT 1"""})


reg("b10_mitigated_rates", _mitigated_rates, _mitigated_sql())


def _q17_mc_sql() -> str:
    pc = percls_sql("predictions_mc", [])
    marg = _marg_sql("predictions_mc", [])
    ll = f"-avg(ln(least(greatest(proba[y_true + 1], {_EPS}), 1 - {_EPS})))"
    body = f"""
SELECT 'accuracy' AS metric, {r6('avg(CAST(y_true = y_pred AS DOUBLE))')} AS value FROM predictions_mc
UNION ALL SELECT 'precision', {r6(f"avg({sdiv('tp', 'tp + fp')})")} FROM {pc}
UNION ALL SELECT 'recall', {r6(f"avg({sdiv('tp', 'tp + fn')})")} FROM {pc}
UNION ALL SELECT 'f1', {r6(f"avg({sdiv('2 * tp', '2 * tp + fp + fn')})")} FROM {pc}
UNION ALL SELECT 'mcc', {r6(sdiv('c * s - sum_pt', 'sqrt((s * s - sum_pp) * (s * s - sum_tt))'))} FROM ({marg})
UNION ALL SELECT 'kappa', {r6(sdiv('c / s - sum_pt / (s * s)', '1.0 - sum_pt / (s * s)'))} FROM ({marg})
UNION ALL SELECT 'log_loss', {r6(ll)} FROM predictions_mc
UNION ALL SELECT 'macro_auc', CASE WHEN count(*) = 3 THEN {r6('avg(auc)')} END FROM (
    SELECT class_code, sum((neg / "N") * ((2 * cum_pos - pos) / "P") / 2) AS auc
    FROM {_cum_ovr} WHERE "P" > 0 AND "N" > 0 GROUP BY class_code)"""
    return with_views(f"""SELECT metric, value,
       CASE WHEN value IS NULL THEN 'ValueError: ' || metric || ' undefined' END AS error FROM ({body})""", "predictions_mc")


reg("q17_metric_report_mc", lambda s, d: M.metric_report(PM(s, d), multiclass=True, n_classes=3), _q17_mc_sql())

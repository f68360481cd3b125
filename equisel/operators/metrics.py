"""Prediction metrics (Q1–Q18), all grouped by optional key columns.

Raw rows are touched by one aggregate per metric family: a confusion table
``(by, y_true, y_pred, n)`` or a per-score table ``(by, score, pos, neg)``.
Everything after that works on those small tables. Curves use the
bucketed prefix sum of ``equisel.functions.prefix`` so no step needs a
global ordering of rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equisel.functions.exprs import indexed_explode, join_on, r6, refuse, safe_div
from equisel.functions.prefix import running_totals

MAX_LABELS = 20
LOG_EPS = 2.220446049250313e-16  # float64 machine epsilon (probability clip)
MAX_CURVE_POINTS = 500


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


# ---------------------------------------------------------------- confusion
def confusion_counts(df: DataFrame, by: Sequence[str] = (), y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Non-zero cells ``(by, y_true, y_pred, n)`` — the one raw-row aggregate.
    A NULL label or prediction is an error."""
    by = _by(by)
    cells = df.groupBy(*by, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return refuse(cells, F.col("y_true").isNull() | F.col("y_pred").isNull(), lacking(y_true, y_pred))


def lacking(*cols: str) -> str:
    return f"NULL in {' or '.join(cols)}: no row may lack it"


def counted(df: DataFrame, keys: Sequence, aggs: Sequence, cols: Sequence[str]) -> DataFrame:
    """``df.groupBy(keys).agg(aggs)``; a NULL in one of ``cols`` is an error
    (counted in the same pass, looked at on the aggregated rows)."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull()
    out = df.groupBy(*keys).agg(*aggs, F.count_if(bad).alias("__lacking"))
    return refuse(out, F.col("__lacking") > 0, lacking(*cols)).drop("__lacking")


def label_set(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sorted union of true and predicted labels per group, from the cells."""
    by = _by(by)
    return (
        cells.select(*by, F.col("y_true").alias("label"))
        .union(cells.select(*by, F.col("y_pred").alias("label")))
        .distinct()
    )


def confusion_matrix(df: DataFrame, by: Sequence[str] = (), y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Q1: counts for every (true, predicted) label pair, zero cells kept.

    The label grid is labels x labels per group; labels are capped at 20 by
    the task spec, so the grid is at most 400 cells per group."""
    by = _by(by)
    cells = confusion_counts(df, by, y_true, y_pred)
    labs = label_set(cells, by)
    # the grid is labels x labels: its size is checked before it is formed
    many = labs.groupBy(*by).agg(F.count(F.lit(1)).alias("__k")).where(F.col("__k") > MAX_LABELS)
    if not many.isEmpty():
        raise ValueError(f"more than {MAX_LABELS} labels; use confusion_counts for the cells that occur")
    grid = join_on(labs.select(*by, F.col("label").alias("y_true")), labs.select(*by, F.col("label").alias("y_pred")), by) if by else labs.select(F.col("label").alias("y_true")).crossJoin(labs.select(F.col("label").alias("y_pred")))
    return join_on(grid, cells, [*by, "y_true", "y_pred"], "left").select(
        *by, "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def confusion_normalised(df: DataFrame, by: Sequence[str] = (), y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Q2: row-normalised confusion matrix; an empty true row stays 0."""
    by = _by(by)
    cm = confusion_matrix(df, by, y_true, y_pred)
    row = F.sum("n").over(Window.partitionBy(*by, "y_true"))
    return cm.select(*by, "y_true", "y_pred", "n", r6(safe_div(F.col("n"), row)).alias("rate"))


# ---------------------------------------------------------------- scalars
def accuracy(df: DataFrame, by: Sequence[str] = (), y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Q3: share of rows with y_pred = y_true."""
    by = _by(by)
    return counted(df, by, [r6(F.avg((F.col(y_true) == F.col(y_pred)).cast("double"))).alias("accuracy")], (y_true, y_pred))


def binary_counts(df: DataFrame, by: Sequence[str] = (), y_true="y_true", y_pred="y_pred", pos=1) -> DataFrame:
    """tp, fp, fn, tn, n per group (positive label ``pos``) in one pass."""
    by = _by(by)
    t = F.col(y_true) == F.lit(pos)
    p = F.col(y_pred) == F.lit(pos)
    return counted(df, by, [
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
        F.count(F.lit(1)).alias("n"),
    ], (y_true, y_pred))


def _prf(tp, fp, fn):
    prec = safe_div(tp, tp + fp)
    rec = safe_div(tp, tp + fn)
    f1 = safe_div(2 * tp, 2 * tp + fp + fn)
    return prec, rec, f1


def precision_recall_f1(df: DataFrame, by: Sequence[str] = (), average: str = "binary", pos=1,
                        y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Q4: binary (positive = ``pos``) or macro over labels in true ∪ pred; 0/0 → 0."""
    by = _by(by)
    if average == "binary":
        c = binary_counts(df, by, y_true, y_pred, pos)
        p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
        return c.select(*by, r6(p).alias("precision"), r6(r).alias("recall"), r6(f).alias("f1"))
    if average != "macro":
        raise ValueError(f"unknown average {average!r}")
    pc = per_class_counts(df, by, y_true, y_pred)
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return pc.groupBy(*by).agg(r6(F.avg(p)).alias("precision"), r6(F.avg(r)).alias("recall"), r6(F.avg(f)).alias("f1"))


def per_class_counts(df: DataFrame, by: Sequence[str] = (), y_true="y_true", y_pred="y_pred") -> DataFrame:
    """``(by, label, tp, fp, fn, support)`` for every label in true ∪ pred."""
    by = _by(by)
    cells = confusion_counts(df, by, y_true, y_pred)
    as_true = cells.groupBy(*by, F.col("y_true").alias("label")).agg(
        F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("y_true") != F.col("y_pred"), F.col("n")).otherwise(0)).alias("fn"),
        F.sum("n").alias("support"),
    )
    as_pred = cells.groupBy(*by, F.col("y_pred").alias("label")).agg(
        F.sum(F.when(F.col("y_true") != F.col("y_pred"), F.col("n")).otherwise(0)).alias("fp")
    )
    return join_on(as_true, as_pred, [*by, "label"], "full").select(
        *by,
        "label",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn", "support")],
    )


def classification_report(df: DataFrame, by: Sequence[str] = (), y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Q5: per class precision/recall/F1/support, then accuracy, macro avg and
    support-weighted avg rows. ``label`` is text so summary rows fit."""
    by = _by(by)
    pc = per_class_counts(df, by, y_true, y_pred)
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    rows = pc.select(*by, F.col("label").cast("string").alias("label"), p.alias("precision"), r.alias("recall"),
                     f.alias("f1"), F.col("support"), F.col("tp"))
    tot = F.sum("support")
    macro = rows.groupBy(*by).agg(
        F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"), tot.alias("support"))
    weighted = rows.groupBy(*by).agg(
        F.lit("weighted avg").alias("label"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"), tot.alias("support"))
    acc = rows.groupBy(*by).agg(
        F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), (F.sum("tp") / tot).alias("f1"), tot.alias("support"))
    out = rows.drop("tp").unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select(*by, "label", *[r6(c).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


def _marginals(df: DataFrame, by, y_true, y_pred) -> DataFrame:
    """Per group: s = total, c = correct, sum_pt = Σ p_k t_k, sum_pp = Σ p_k², sum_tt = Σ t_k²."""
    pc = per_class_counts(df, by, y_true, y_pred)
    pred_k = F.col("tp") + F.col("fp")
    true_k = F.col("support")
    return pc.groupBy(*by).agg(
        F.sum("support").cast("double").alias("s"),
        F.sum("tp").cast("double").alias("c"),
        F.sum(pred_k.cast("double") * true_k).alias("sum_pt"),
        F.sum(pred_k.cast("double") * pred_k).alias("sum_pp"),
        F.sum(true_k.cast("double") * true_k).alias("sum_tt"),
    )


def matthews_corrcoef(df: DataFrame, by: Sequence[str] = (), y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Q6: K-class MCC from confusion marginals (doubles: no overflow); 0 when undefined."""
    by = _by(by)
    m = _marginals(df, by, y_true, y_pred)
    num = F.col("c") * F.col("s") - F.col("sum_pt")
    den = F.sqrt((F.col("s") * F.col("s") - F.col("sum_pp")) * (F.col("s") * F.col("s") - F.col("sum_tt")))
    return m.select(*by, r6(safe_div(num, den)).alias("mcc"))


def cohens_kappa(df: DataFrame, by: Sequence[str] = (), y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Q7: 1 − observed/expected disagreement."""
    by = _by(by)
    m = _marginals(df, by, y_true, y_pred)
    po = F.col("c") / F.col("s")
    pe = F.col("sum_pt") / (F.col("s") * F.col("s"))
    return m.select(*by, r6(safe_div(po - pe, F.lit(1.0) - pe)).alias("kappa"))


def log_loss(df: DataFrame, by: Sequence[str] = (), y_true="y_true", proba="proba", score=None, pos=1) -> DataFrame:
    """Q8: −mean ln p(true class), p clipped to [eps, 1−eps].

    Multiclass: ``proba`` array indexed by the class code. Binary: ``score``
    is P(pos) and the other class gets 1 − score."""
    by = _by(by)
    if score is not None:
        p = F.when(F.col(y_true) == F.lit(pos), F.col(score)).otherwise(F.lit(1.0) - F.col(score))
    else:
        p = F.when(F.col(y_true).isNotNull(), F.element_at(F.col(proba), (F.col(y_true) + 1).cast("int")))
    p = F.least(F.greatest(p.cast("double"), F.lit(LOG_EPS)), F.lit(1.0 - LOG_EPS))
    return df.groupBy(*by).agg(r6(-F.avg(F.ln(p))).alias("log_loss"))


# ---------------------------------------------------------------- curves
def required(score: str) -> "F.Column":
    """The score; a row without one is an error, never left out."""
    return F.coalesce(F.col(score), F.raise_error(F.lit(f"NULL in score column {score!r}")).cast("double"))


def score_counts(df: DataFrame, by: Sequence[str] = (), y_true="y_true", score="score", pos=1) -> DataFrame:
    """Ties collapse first: ``(by, score, pos, neg)`` per distinct score."""
    by = _by(by)
    is_pos = F.col(y_true) == F.lit(pos)
    return df.groupBy(*by, required(score).alias("score")).agg(
        F.count_if(is_pos).alias("pos"), F.count_if(~is_pos).alias("neg")
    )


def _materialise(df: DataFrame) -> DataFrame:
    """Write a small intermediate table to the shared checkpoint folder and
    cut its lineage: the bucket boundaries and the running sums then read
    the same rows, and an executor loss never re-runs the raw scan."""
    from equisel.session import materialise

    return materialise(df)


def _cumulative_from_counts(sc: DataFrame, by) -> DataFrame:
    by = _by(by)
    cum = running_totals(sc, "score", ["pos", "neg"], by=by, descending=True)
    totals = sc.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if by:
        return join_on(cum, totals, by)
    return cum.crossJoin(F.broadcast(totals))  # one-row totals


def _cumulative(df, by, y_true, score, pos) -> DataFrame:
    """Per distinct score, descending: cum_pos / cum_neg and group totals P / N."""
    sc = _materialise(score_counts(df, _by(by), y_true, score, pos))
    return _cumulative_from_counts(sc, by)


def _auc_ap(c: DataFrame, by) -> DataFrame:
    """AUC (trapezoid) and AP from one cumulative table."""
    by = _by(by)
    c = c.where((F.col("P") > 0) & (F.col("N") > 0))
    area = (F.col("neg") / F.col("N")) * ((2 * F.col("cum_pos") - F.col("pos")) / F.col("P")) / 2
    term = (F.col("pos") / F.col("P")) * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    return c.groupBy(*by).agg(r6(F.sum(area)).alias("auc"), r6(F.sum(term)).alias("average_precision"))


def curve_summary(df: DataFrame, by: Sequence[str] = (), y_true="y_true", score="score", pos=1) -> DataFrame:
    """AUC and average precision per group from a single cumulative pass."""
    return _auc_ap(_cumulative(df, by, y_true, score, pos), by)


def roc_curve(df: DataFrame, by: Sequence[str] = (), y_true="y_true", score="score", pos=1) -> DataFrame:
    """Q9: one point per distinct score (threshold, fpr, tpr) plus the (0, 0)
    start at threshold +inf. Groups with a single class are dropped (the
    curve is undefined there; the report turns that into an error text)."""
    by = _by(by)
    c = _cumulative(df, by, y_true, score, pos).where((F.col("P") > 0) & (F.col("N") > 0))
    pts = c.select(*by, F.col("score").cast("double").alias("threshold"),
                   (F.col("cum_neg") / F.col("N")).alias("fpr"), (F.col("cum_pos") / F.col("P")).alias("tpr"))
    start = c.select(*by).distinct().select(*by, F.lit(float("inf")).alias("threshold"),
                                            F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    out = start.unionByName(pts)
    return out.select(*by, "threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


def roc_auc(df: DataFrame, by: Sequence[str] = (), y_true="y_true", score="score", pos=1) -> DataFrame:
    """Q10: trapezoid area under Q9 (= Mann–Whitney statistic, ties count ½).
    The previous point is ``cum − own``, so no lag over ordered rows."""
    by = _by(by)
    c = _cumulative(df, by, y_true, score, pos).where((F.col("P") > 0) & (F.col("N") > 0))
    area = (F.col("neg") / F.col("N")) * ((2 * F.col("cum_pos") - F.col("pos")) / F.col("P")) / 2
    return c.groupBy(*by).agg(r6(F.sum(area)).alias("auc"))


def pr_curve(df: DataFrame, by: Sequence[str] = (), y_true="y_true", score="score", pos=1) -> DataFrame:
    """Q11: (threshold, precision, recall) per distinct score, descending,
    stopping at the first threshold reaching full recall, plus the final
    point (precision 1, recall 0) with a null threshold."""
    by = _by(by)
    c = _cumulative(df, by, y_true, score, pos).where(F.col("P") > 0)
    c = c.where(F.col("cum_pos") - F.col("pos") < F.col("P"))
    pts = c.select(*by, F.col("score").cast("double").alias("threshold"),
                   (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                   (F.col("cum_pos") / F.col("P")).alias("recall"))
    end = c.select(*by).distinct().select(*by, F.lit(None).cast("double").alias("threshold"),
                                          F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    out = pts.unionByName(end)
    return out.select(*by, "threshold", r6("precision").alias("precision"), r6("recall").alias("recall"))


def average_precision(df: DataFrame, by: Sequence[str] = (), y_true="y_true", score="score", pos=1) -> DataFrame:
    """Q12: AP = Σ (R_i − R_{i−1}) · P_i over descending thresholds."""
    by = _by(by)
    c = _cumulative(df, by, y_true, score, pos).where(F.col("P") > 0)
    term = (F.col("pos") / F.col("P")) * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    return c.groupBy(*by).agg(r6(F.sum(term)).alias("average_precision"))


def one_vs_rest(df: DataFrame, n_classes: int, by: Sequence[str] = (), y_true="y_true", proba="proba") -> DataFrame:
    """Long form ``(by, class_code, y_ind, score)``: indicator of each class
    against its probability column. Classes without a probability column
    produce no rows (skipped)."""
    by = _by(by)
    ex = indexed_explode(df.select(*by, F.col(y_true).alias("__y"), F.col(proba).alias("__proba")), "__proba",
                         "class_code", "score")
    # a label that is no class code would count as "rest" everywhere
    unknown = F.raise_error(F.concat(F.lit(f"class code outside 0..{n_classes - 1}: "), F.col("__y").cast("string")))
    ex = ex.where(F.when((F.col("__y") < 0) | (F.col("__y") >= n_classes), unknown.cast("boolean")).otherwise(F.lit(True)))
    beyond = F.raise_error(F.lit(f"more than {n_classes} probabilities in a row"))
    return ex.where(F.when(F.col("class_code") >= n_classes, beyond.cast("boolean")).otherwise(F.lit(True))).select(
        *by, F.col("class_code").cast("int").alias("class_code"),
        F.when(F.col("__y") == F.col("class_code"), 1).otherwise(0).alias("y_ind"), F.col("score").cast("double").alias("score"))


def ovr_auc(df: DataFrame, n_classes: int, by: Sequence[str] = (), y_true="y_true", proba="proba") -> DataFrame:
    """Q13 (AUC and AP part): per class one-vs-rest AUC and AP; classes whose
    indicator has one value only are skipped."""
    by = _by(by)
    long = one_vs_rest(df, n_classes, by, y_true, proba)
    return curve_summary(long, [*by, "class_code"], "y_ind", "score", 1)


def ovr_curves(df: DataFrame, n_classes: int, by: Sequence[str] = (), y_true="y_true", proba="proba") -> DataFrame:
    """Q13 (curve part): per class ROC points (classes whose indicator has
    one value only have no curve)."""
    by = _by(by)
    long = one_vs_rest(df, n_classes, by, y_true, proba)
    return roc_curve(long, [*by, "class_code"], "y_ind", "score", 1)


def ovr_pr_curves(df: DataFrame, n_classes: int, by: Sequence[str] = (), y_true="y_true", proba="proba") -> DataFrame:
    """Q13 (curve part): per class precision-recall points."""
    by = _by(by)
    long = one_vs_rest(df, n_classes, by, y_true, proba)
    return pr_curve(long, [*by, "class_code"], "y_ind", "score", 1)


def macro_ovr_auc(df: DataFrame, n_classes: int, by: Sequence[str] = (), y_true="y_true", proba="proba") -> DataFrame:
    """Q14: mean per-class AUC; null unless every class has a curve."""
    by = _by(by)
    per = ovr_auc(df, n_classes, by, y_true, proba)
    g = per.groupBy(*by).agg(F.avg("auc").alias("m"), F.count(F.lit(1)).alias("k"))
    return g.select(*by, F.when(F.col("k") == n_classes, r6("m")).alias("macro_auc"))


def apply_threshold(df: DataFrame, t, score="score", out="y_pred", pos=1, neg=-1) -> DataFrame:
    """Q16: score ≥ t → positive label, else negative. ``t`` may be a column
    (per-group thresholds)."""
    tcol = t if not isinstance(t, (int, float)) else F.lit(float(t))
    return df.withColumn(out, F.when(F.col(score) >= tcol, F.lit(pos)).otherwise(F.lit(neg)))


def downsample_curve(curve: DataFrame, order_col: str, by: Sequence[str] = (), max_points: int = MAX_CURVE_POINTS,
                     descending: bool = False) -> DataFrame:
    """Q18 / X7 on a curve: keep the evenly spaced positions
    unique(round_half_even(linspace(0, n − 1, max_points))) of each group."""
    from equisel.operators.split import even_downsample

    return even_downsample(curve, order_col, by=by, max_points=max_points, descending=descending)


def metric_report(df: DataFrame, by: Sequence[str] = (), multiclass: bool = False, n_classes: int = 2,
                  y_true="y_true", y_pred="y_pred", score="score", proba="proba", pos=1) -> DataFrame:
    """Q17: all metrics as rows ``(by, metric, value, error)``. A metric that
    cannot be computed for a group yields a null value with its message and
    never stops the others. Multiclass swaps in macro scores and the OvR
    macro AUC instead of the binary curve metrics.

    Binary: one raw aggregate ``(by, score, y_pred) → pos, neg`` (written
    once to the checkpoint folder) feeds every metric — confusion counts,
    log loss per distinct score, and the curves."""
    by = _by(by)
    if multiclass:
        return _metric_report_mc(df, by, n_classes, y_true, y_pred, proba)
    is_pos = F.col(y_true) == F.lit(pos)
    base = _materialise(df.groupBy(*by, F.col(score).alias("score"), F.col(y_pred).alias("yp")).agg(
        F.count_if(is_pos).alias("pos"), F.count_if(~is_pos).alias("neg")))
    hit = F.col("yp") == F.lit(pos)
    cnt = base.groupBy(*by).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    s_ = tp + fp + fn + tn
    p_, r_, f_ = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    # two-class marginals: predicted (tp+fp, fn+tn), true (tp+fn, fp+tn)
    sum_pt = (tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)
    sum_pp = (tp + fp) * (tp + fp) + (fn + tn) * (fn + tn)
    sum_tt = (tp + fn) * (tp + fn) + (fp + tn) * (fp + tn)
    c_ = tp + tn
    mcc = safe_div(c_ * s_ - sum_pt, F.sqrt((s_ * s_ - sum_pp) * (s_ * s_ - sum_tt)))
    kappa = safe_div(c_ / s_ - sum_pt / (s_ * s_), F.lit(1.0) - sum_pt / (s_ * s_))
    scal = cnt.select(*by, r6(c_ / s_).alias("accuracy"), r6(p_).alias("precision"), r6(r_).alias("recall"),
                      r6(f_).alias("f1"), r6(mcc).alias("mcc"), r6(kappa).alias("kappa"))
    # counts need a prediction for every row, score metrics a score
    rows = F.col("pos") + F.col("neg")
    unscored = base.groupBy(*by).agg(F.sum(F.when(F.col("score").isNull(), rows).otherwise(0)).alias("lacking"),
                                     F.sum(F.when(F.col("yp").isNull(), rows).otherwise(0)).alias("unpredicted"))
    sc = base.where(F.col("score").isNotNull()).groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    clip = lambda c: F.least(F.greatest(c.cast("double"), F.lit(LOG_EPS)), F.lit(1.0 - LOG_EPS))
    ll = sc.groupBy(*by).agg(r6(-(F.sum(F.col("pos") * F.ln(clip(F.col("score"))) +
                                      F.col("neg") * F.ln(clip(F.lit(1.0) - F.col("score")))) /
                               F.sum(F.col("pos") + F.col("neg")))).alias("log_loss"))
    curves = _auc_ap(_cumulative_from_counts(sc, by), by).withColumnRenamed("auc", "roc_auc")
    names = ["accuracy", "precision", "recall", "f1", "mcc", "kappa", "log_loss", "roc_auc", "average_precision"]
    if by:
        wide = join_on(join_on(join_on(scal, ll, by, "left"), curves, by, "left"), unscored, by, "left")
    else:  # one-row tables; an aggregate over an empty curve table still yields one (null) row
        one = curves.agg(F.max("roc_auc").alias("roc_auc"), F.max("average_precision").alias("average_precision"))
        wide = scal.crossJoin(ll.agg(F.max("log_loss").alias("log_loss"))).crossJoin(one).crossJoin(unscored)
    stack = ", ".join(f"'{m}', `{m}`" for m in names)
    by_score = ("log_loss", "roc_auc", "average_precision")
    for m in names:
        wide = wide.withColumn(m, F.when(F.col("lacking" if m in by_score else "unpredicted") == 0, F.col(m)))
    long = wide.select(*by, "lacking", "unpredicted", F.expr(f"stack({len(names)}, {stack}) AS (metric, value)"))
    err = F.when(F.col("value").isNull(), F.concat(F.lit("ValueError: no "), F.col("metric"), F.when(
        ~F.col("metric").isin(*by_score), F.concat(F.lit(", "), F.col("unpredicted").cast("string"), F.lit(" rows have no prediction"))).when(
        F.col("lacking") > 0, F.concat(F.lit(", "), F.col("lacking").cast("string"), F.lit(" rows have no score"))).otherwise(
        F.lit(", all labels are of one class"))))
    return long.select(*by, "metric", F.col("value").cast("double").alias("value"), err.alias("error"))


def _metric_report_mc(df: DataFrame, by, n_classes, y_true, y_pred, proba) -> DataFrame:
    parts = []

    def long(frame, cols):
        for c in cols:
            parts.append(frame.select(*by, F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")))

    long(accuracy(df, by, y_true, y_pred), ["accuracy"])
    long(precision_recall_f1(df, by, "macro", 1, y_true, y_pred), ["precision", "recall", "f1"])
    long(matthews_corrcoef(df, by, y_true, y_pred), ["mcc"])
    long(cohens_kappa(df, by, y_true, y_pred), ["kappa"])
    long(log_loss(df, by, y_true, proba=proba), ["log_loss"])
    long(macro_ovr_auc(df, n_classes, by, y_true, proba), ["macro_auc"])
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    err = F.when(F.col("value").isNull(), F.concat(F.lit("ValueError: "), F.col("metric"), F.lit(" undefined")))
    return got.select(*by, "metric", "value", err.alias("error"))

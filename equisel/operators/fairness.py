"""Group fairness (B1–B12) on favorable-outcome indicators.

One grouped aggregate over raw rows yields ``(by, group, tp, fp, fn, tn)``;
every rate, the overall row and every disparity are computed from that
small table. Conditional sums are partial-aggregated map-side, so a group
holding a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equisel.functions.exprs import join_on, r6, safe_div, unit_hash

MAX_SENSITIVE_GROUPS = 20
WORST_DISPARITY = 1.0
# Disparity metrics accepted by the fairness-aware search.
FAIRNESS_METRICS = ("equal_opportunity_difference", "disparate_impact", "demographic_parity_difference")
GROUP_METRICS = ["accuracy", "precision", "recall", "f1", "selection_rate", "false_positive_rate",
                 "false_negative_rate", "count"]
OVERALL = "__overall__"


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def binarize_favorable(df: DataFrame, favorable=1, cols=("y_true", "y_pred")) -> DataFrame:
    """1 where the value equals the favorable outcome, else 0."""
    return df.withColumns({c: (F.col(c) == F.lit(favorable)).cast("int") for c in cols})


def group_counts(df: DataFrame, group="sensitive", by: Sequence[str] = (), favorable=1,
                 y_true="y_true", y_pred="y_pred") -> DataFrame:
    """``(by, group, tp, fp, fn, tn, n)`` on favorable indicators: the one raw
    pass. A NULL label or prediction is an error."""
    from equisel.operators.metrics import counted

    by = _by(by)
    t = F.col(y_true) == F.lit(favorable)
    p = F.col(y_pred) == F.lit(favorable)
    return counted(df, [*by, F.col(group).cast("string").alias("group")], [
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"),
        F.count(F.lit(1)).alias("n"),
    ], (y_true, y_pred))


def _rates(c: DataFrame, by) -> DataFrame:
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    return c.select(
        *by, "group",
        safe_div(tp + tn, n).alias("accuracy"),
        safe_div(tp, tp + fp).alias("precision"),
        safe_div(tp, tp + fn).alias("recall"),
        safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        safe_div(tp + fp, n).alias("selection_rate"),
        safe_div(fp, fp + tn).alias("false_positive_rate"),
        safe_div(fn, fn + tp).alias("false_negative_rate"),
        n.cast("double").alias("count"),
    )


def group_and_overall_counts(df: DataFrame, group="sensitive", by: Sequence[str] = (), favorable=1,
                             y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Per-group counts plus the overall row (group = ``__overall__``) summed
    from the small per-group table (B1 + B2 in one raw pass)."""
    by = _by(by)
    c = group_counts(df, group, by, favorable, y_true, y_pred)
    tot = c.groupBy(*by).agg(F.lit(OVERALL).alias("group"),
                             *[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "tn", "n")])
    return c.unionByName(tot)


def group_metrics(df: DataFrame, group="sensitive", by: Sequence[str] = (), favorable=1,
                  y_true="y_true", y_pred="y_pred", include_overall: bool = True) -> DataFrame:
    """B1 (+B2): wide per-group metrics; 0/0 → 0. The overall row has
    group ``__overall__``."""
    by = _by(by)
    c = group_and_overall_counts(df, group, by, favorable, y_true, y_pred) if include_overall else \
        group_counts(df, group, by, favorable, y_true, y_pred)
    r = _rates(c, by)
    return r.select(*by, "group", *[r6(m).alias(m) for m in GROUP_METRICS])


def overall_metrics(df: DataFrame, by: Sequence[str] = (), favorable=1, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """B2: the same metrics, ungrouped."""
    by = _by(by)
    g = group_metrics(df.withColumn("__all", F.lit(OVERALL)), "__all", by, favorable, y_true, y_pred,
                      include_overall=False)
    return g.drop("group")


def disparities(df: DataFrame, group="sensitive", by: Sequence[str] = (), favorable=1,
                y_true="y_true", y_pred="y_pred") -> DataFrame:
    """B3–B6 per ``by`` key (wide): demographic parity difference and ratio
    (= disparate impact; NaN when every selection rate is 0), equalized-odds
    difference (max of TPR and FPR gaps), equal-opportunity difference."""
    by = _by(by)
    return disparities_from_counts(group_counts(df, group, by, favorable, y_true, y_pred), by)


def disparities_from_counts(c: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """B3–B6 from a ``(by, group, tp, fp, fn, tn, n)`` table."""
    by = _by(by)
    r = _rates(c, by)
    g = r.groupBy(*by).agg(
        F.min("selection_rate").alias("sr_min"), F.max("selection_rate").alias("sr_max"),
        (F.max("recall") - F.min("recall")).alias("tpr_gap"),
        (F.max("false_positive_rate") - F.min("false_positive_rate")).alias("fpr_gap"),
        F.count(F.lit(1)).alias("n_groups"),
    )
    ratio = F.when(F.col("sr_max") == 0, F.lit(float("nan"))).otherwise(F.col("sr_min") / F.col("sr_max"))
    return g.select(
        *by,
        r6(F.col("sr_max") - F.col("sr_min")).alias("demographic_parity_difference"),
        r6(ratio).alias("demographic_parity_ratio"),
        r6(F.greatest("tpr_gap", "fpr_gap")).alias("equalized_odds_difference"),
        r6(ratio).alias("disparate_impact"),
        r6("tpr_gap").alias("equal_opportunity_difference"),
        "n_groups",
    )


DISPARITY_NAMES = ["demographic_parity_difference", "demographic_parity_ratio", "equalized_odds_difference",
                   "disparate_impact", "equal_opportunity_difference"]


def audit(df: DataFrame, group="sensitive", by: Sequence[str] = (), favorable=1, y_true="y_true",
          y_pred="y_pred", max_groups: int = MAX_SENSITIVE_GROUPS) -> DataFrame:
    """One long report ``(by, section, metric, group, value)`` with
    sections ``by_group``, ``overall`` and ``disparities``. More than
    ``max_groups`` distinct groups is an error (bounded check first)."""
    by = _by(by)
    # one raw pass: per-group counts feed the group rows, the overall row and the disparities
    c = group_counts(df, group, by, favorable, y_true, y_pred)
    tot = c.groupBy(*by).agg(F.lit(OVERALL).alias("group"), *[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "tn", "n")])
    r = _rates(c.unionByName(tot), by)
    gm = r.select(*by, "group", *[r6(m).alias(m) for m in GROUP_METRICS])
    stack = ", ".join(f"'{m}', `{m}`" for m in GROUP_METRICS)
    long = gm.select(*by, "group", F.expr(f"stack({len(GROUP_METRICS)}, {stack}) as (metric, value)"))
    sect = F.when(F.col("group") == OVERALL, "overall").otherwise("by_group")
    long = long.select(*by, sect.alias("section"), "metric",
                       F.when(F.col("group") == OVERALL, None).otherwise(F.col("group")).alias("group"), "value")
    d = disparities_from_counts(c, by)
    # the group cap is asserted inside the plan (no extra pass over the rows)
    # as a filter, so that it is evaluated whichever columns are read later
    too_many = F.raise_error(F.lit(f"sensitive column {group!r} has more than {max_groups} groups"))
    d = d.where(F.when(F.col("n_groups") > max_groups, too_many.cast("boolean")).otherwise(F.lit(True)))
    dstack = ", ".join(f"'{m}', `{m}`" for m in DISPARITY_NAMES)
    dl = d.select(*by, F.lit("disparities").alias("section"),
                  F.expr(f"stack({len(DISPARITY_NAMES)}, {dstack}) as (metric, value)"),
                  F.lit(None).cast("string").alias("group"))
    return long.unionByName(dl.select(*by, "section", "metric", "group", "value"))


def disparity(df: DataFrame, metric: str, group="sensitive", by: Sequence[str] = (), favorable=1,
              y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Scalar to minimise per ``by`` key (e.g. per trial). Disparate
    impact maps to max(0, 1 − ratio) with NaN → 1.0; a key with fewer than
    two groups cannot be compared and gets 1.0."""
    by = _by(by)
    if metric not in FAIRNESS_METRICS:
        raise ValueError(f"{metric!r} is no fairness metric of the search; choose from {', '.join(FAIRNESS_METRICS)}")
    d = disparities(df, group, by, favorable, y_true, y_pred)
    if metric == "disparate_impact":
        v = F.when(F.isnan("disparate_impact"), F.lit(WORST_DISPARITY)).otherwise(
            F.greatest(F.lit(0.0), F.lit(1.0) - F.col("disparate_impact")))
    else:
        v = F.col(metric)
    v = F.when(F.col("n_groups") < 2, F.lit(WORST_DISPARITY)).otherwise(v)
    return d.select(*by, r6(v).alias("disparity"))


def group_chart_data(df: DataFrame, group="sensitive", by: Sequence[str] = (), favorable=1,
                     y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Long ``(metric, group, value, overall)`` for bar charts; count excluded."""
    by = _by(by)
    gm = group_metrics(df, group, by, favorable, y_true, y_pred)
    ms = [m for m in GROUP_METRICS if m != "count"]
    stack = ", ".join(f"'{m}', `{m}`" for m in ms)
    long = gm.select(*by, "group", F.expr(f"stack({len(ms)}, {stack}) as (metric, value)"))
    # the overall value of a metric, over the few rows of that metric
    overall = F.max(F.when(F.col("group") == OVERALL, F.col("value"))).over(Window.partitionBy(*by, "metric"))
    return long.withColumn("overall", overall).where(F.col("group") != OVERALL)


# ------------------------------------------------------------ mitigation
GRID = 1000
THRESHOLDS = "group string, threshold_a double, threshold_b double, p_a double, p_const double, const double"


def _upper_hull(points: list[tuple]) -> list[tuple]:
    """Upper convex hull of (x, y, ...) points, by increasing x."""
    hull: list[tuple] = []
    for p in sorted(points, key=lambda q: (q[0], -q[1])):
        if hull and hull[-1][0] == p[0]:
            continue
        while len(hull) > 1 and (hull[-1][0] - hull[-2][0]) * (p[1] - hull[-2][1]) >= (hull[-1][1] - hull[-2][1]) * (p[0] - hull[-2][0]):
            hull.pop()
        hull.append(p)
    return hull


def group_hulls(train: DataFrame, group="sensitive", constraint: str = "equalized_odds", score="score", y_true="y_true",
                favorable=1, n_cells: int = GRID, max_groups: int = MAX_SENSITIVE_GROUPS) -> dict:
    """Per group the upper hull of what its thresholds reach: (FPR, TPR) for
    equalized odds, (selection rate, share correct) for demographic parity.

    One raw aggregate per (group, score) and the bucketed prefix sum give the
    points; equal abscissae keep their best point; hulls of ``n_cells``
    abscissa ranges are formed in parallel and only their corners reach the
    driver. A group with one class has no ROC curve: an error."""
    import pyarrow as pa

    from equisel.functions.prefix import running_totals
    from equisel.operators.metrics import required
    from equisel.session import materialise

    if constraint not in ("equalized_odds", "demographic_parity"):
        raise ValueError(f"unknown constraint {constraint!r}")
    is_pos = F.col(y_true) == F.lit(favorable)
    sc = materialise(train.groupBy(F.col(group).cast("string").alias("group"), required(score).alias("t")).agg(
        F.count_if(is_pos).alias("pos"), F.count_if(~is_pos).alias("neg")))
    totals = sc.groupBy("group").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    sizes = {r["group"]: (r["P"], r["N"]) for r in totals.limit(max_groups + 1).collect()}
    if len(sizes) > max_groups:
        raise ValueError(f"more than {max_groups} groups in {group!r}")
    flat = [g for g, (p, n) in sizes.items() if constraint == "equalized_odds" and not (p and n)]
    if flat:
        raise ValueError(f"equalized odds need both classes in every group; one class only: {sorted(map(str, flat))}")
    c = running_totals(sc, "t", ["pos", "neg"], by=["group"], descending=True)
    c = join_on(c, totals, ["group"])
    if constraint == "equalized_odds":
        x, y = F.col("cum_neg") / F.col("N"), F.col("cum_pos") / F.col("P")
    else:
        n = F.col("P") + F.col("N")
        x, y = (F.col("cum_pos") + F.col("cum_neg")) / n, (F.col("cum_pos") + F.col("N") - F.col("cum_neg")) / n
    best = c.groupBy("group", x.alias("x")).agg(F.max(F.struct(y.alias("y"), F.col("t").alias("t"))).alias("b")).select(
        "group", "x", "b.y", "b.t").withColumn("cell", F.floor(F.col("x") * n_cells))

    def corners(table: pa.Table) -> pa.Table:
        cols = [table.column(k).to_pylist() for k in ("x", "y", "t", "group")]
        kept = _upper_hull(list(zip(*cols)))
        return pa.table({k: pa.array([p[i] for p in kept], pa.float64() if k != "group" else pa.string())
                         for i, k in enumerate(("x", "y", "t", "group"))})

    rows = best.groupBy("group", "cell").applyInArrow(corners, "x double, y double, t double, group string").collect()
    hulls = {}
    for g, (pos, neg) in sizes.items():
        start = 0.0 if constraint == "equalized_odds" else neg / (pos + neg)
        own = [(r["x"], r["y"], r["t"]) for r in rows if r["group"] == g]
        hulls[g] = (_upper_hull([*own, (0.0, start, float("inf"))]), pos, neg)
    return hulls


def _at(hull: list[tuple], x: float) -> tuple:
    """(y, threshold a, threshold b, weight of a) on the hull at ``x``."""
    for (xa, ya, ta), (xb, yb, tb) in zip(hull, hull[1:]):
        if x <= xb:
            w = (xb - x) / (xb - xa)
            return w * ya + (1 - w) * yb, ta, tb, w
    return hull[-1][1], hull[-1][2], hull[-1][2], 1.0


def mitigate_thresholds(train: DataFrame, group="sensitive", constraint: str = "equalized_odds", score="score",
                        y_true="y_true", favorable=1, n_grid: int = GRID) -> DataFrame:
    """B10 (Hardt et al. 2016): per-group randomised thresholds of the highest
    accuracy under a fairness constraint.

    Equalized odds: every group gets the same (FPR, TPR), the best common point
    below all groups' ROC hulls; a group whose hull lies above it mixes in a
    constant. Demographic parity: every group gets the same selection rate.
    Targets are the abscissae k / ``n_grid``. One row per group (bounded by the
    group cap): a row is positive with probability
    (1 − p_const)(p_a [score ≥ a] + (1 − p_a)[score ≥ b]) + p_const · const."""
    hulls = group_hulls(train, group, constraint, score, y_true, favorable)
    total = sum(p + n for _, p, n in hulls.values())
    best = None
    for k in range(n_grid + 1):
        x = k / n_grid
        on = {g: _at(h, x) for g, (h, _, _) in hulls.items()}
        if constraint == "equalized_odds":
            y = min(o[0] for o in on.values())
            correct = sum(p * y + n * (1 - x) for _, p, n in hulls.values())
        else:
            y = None
            correct = sum((p + n) * on[g][0] for g, (_, p, n) in hulls.items())
        accuracy = round(correct / total, 9)
        if best is None or accuracy > best[0]:
            best = (accuracy, x, y, on)
    _, x, y, on = best
    rows = []
    for g, (own, ta, tb, w) in on.items():
        mix = (own - y) / (own - x) if y is not None and own > x else 0.0
        rows.append((g, float(ta), float(tb), float(w), float(mix), float(x)))
    return train.sparkSession.createDataFrame(sorted(rows, key=lambda r: str(r[0])), THRESHOLDS)


def with_favorable_probability(df: DataFrame, thresholds: DataFrame, group="sensitive", score="score", out="p_favorable") -> DataFrame:
    """Probability that the mitigated decision is favorable; a group without
    thresholds is an error."""
    t = thresholds.withColumnRenamed("group", "__g").withColumn("__known", F.lit(True))
    j = df.join(t, F.col(group).cast("string").eqNullSafe(F.col("__g")), "left")
    s = F.col(score)
    step = F.col("p_a") * (s >= F.col("threshold_a")).cast("int") + (1 - F.col("p_a")) * (s >= F.col("threshold_b")).cast("int")
    p = (1 - F.col("p_const")) * step + F.col("p_const") * F.col("const")
    lacking = F.raise_error(F.concat(F.lit("no thresholds for group "), F.coalesce(F.col(group).cast("string"), F.lit("NULL")))).cast("double")
    return j.withColumn(out, F.when(F.col("__known").isNull(), lacking).otherwise(p)).select(*df.columns, out)


def apply_group_thresholds(df: DataFrame, thresholds: DataFrame, group="sensitive", score="score", out="y_pred", pos=1, neg=-1,
                           key: str = "row_id", seed: int = 0) -> DataFrame:
    """Mitigated decisions: the randomised rule with a draw that is a hash of
    (key, seed), so the same row always gets the same decision."""
    p = with_favorable_probability(df, thresholds, group, score, "__p")
    return p.withColumn(out, F.when(unit_hash(key, seed) < F.col("__p"), F.lit(pos)).otherwise(F.lit(neg))).drop("__p")


def mitigation_comparison(before: DataFrame, after: DataFrame, group="sensitive", favorable=1) -> DataFrame:
    """Every disparity before vs after mitigation."""
    def long(df, name):
        d = disparities(df, group, (), favorable)
        st = ", ".join(f"'{m}', `{m}`" for m in DISPARITY_NAMES)
        return d.select(F.expr(f"stack({len(DISPARITY_NAMES)}, {st}) as (measure, {name})"))
    return long(before, "before").join(long(after, "after"), "measure")

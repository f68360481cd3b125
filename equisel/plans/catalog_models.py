"""Checked queries: kernels (K*), generators (G*), training (M*), attribution (V*)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from equisel.operators import attribution as AT
from equisel.operators import generate as G
from equisel.operators import kernels as K
from equisel.operators import split as X
from equisel.operators import train as M
from equisel.sources import views as V
from equisel.sources.sql_views import H as HS, with_views
from equisel.session import materialise
from equisel.sources.tables import table
from equisel.functions.exprs import hash32, indexed_explode, r6, unit_hash

QUERIES: dict = {}
SQL: dict = {}


def reg(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        SQL[name] = sql


def _vec(s, d):
    return V.vectors(s, d).select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


N_LM = 10
_LM = f"""lm AS (SELECT vec_id AS lid, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS j FROM (
        SELECT vec_id FROM embeddings ORDER BY {HS('vec_id', K.LANDMARK_SEED)}, vec_id LIMIT {N_LM}))"""


def _k3(s, d):
    v = _vec(s, d)
    lm = K.landmarks(v, "vec_id", ["x"], N_LM)
    k = K.product_kernel(v, lm, "x", "vec_id")
    return indexed_explode(k.select("vec_id", "kernel"), "kernel", "j", "k").select("vec_id", "j", F.round("k", 6).alias("k"))


reg("k03_product_kernel", _k3, f"""
WITH e AS (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS f, unnest(embedding)::DOUBLE AS v FROM embeddings),
{_LM},
l AS (SELECT lm.j, e.f, e.v FROM e JOIN lm ON lm.lid = e.vec_id)
SELECT a.vec_id, l.j, round(product((3.0::DOUBLE + cos(a.v - l.v)) / 4), 6) AS k FROM e a JOIN l ON l.f = a.f GROUP BY a.vec_id, l.j""")


def _k4(s, d):
    v = _vec(s, d)
    lm = K.landmarks(v, "vec_id", ["x"], N_LM)
    k = K.rbf_kernel(v, lm, "x", "vec_id", gamma_factor=1.0)
    return indexed_explode(k.select("vec_id", "kernel"), "kernel", "j", "k").select("vec_id", "j", F.round("k", 6).alias("k"))


reg("k04_rbf_kernel", _k4, f"""
WITH e AS (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS f, unnest(embedding)::DOUBLE AS v FROM embeddings),
g AS (SELECT 1.0 / (var_pop(v) * max(f)) AS gamma FROM e),
{_LM},
l AS (SELECT lm.j, e.f, e.v FROM e JOIN lm ON lm.lid = e.vec_id)
SELECT a.vec_id, l.j, round(exp(-(SELECT gamma FROM g) * sum((a.v - l.v) * (a.v - l.v))), 6) AS k
FROM e a JOIN l ON l.f = a.f GROUP BY a.vec_id, l.j""")


def _kqs(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    from equisel.operators.encode import assemble_array, minmax_scale
    li = minmax_scale(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], -1.0, 1.0, fit_on="all")
    li = assemble_array(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    li = li.withColumn("rk", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return K.random_binary_features(li, "x", "rk", episodes=3, q=4, seed=1).select("l_orderkey", "l_linenumber", "qfeatures")


reg("k01_random_binary_features", _kqs)


def _k5(s, d):
    v = _vec(s, d).where(F.col("label").isin(0, 1)).withColumn("y", F.when(F.col("label") == 0, -1).otherwise(1))
    out = K.class_mean_similarity(_vec(s, d), v, "x", "vec_id", "y", 10)
    return out.select("vec_id", r6(F.element_at("proba", 1)).alias("p_neg"), r6(F.element_at("proba", 2)).alias("p_pos"),
                      "y_pred")


def _k5_sql() -> str:
    return f"""
WITH e AS (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS f, unnest(embedding)::DOUBLE AS v FROM embeddings),
ex AS (SELECT vec_id AS lid, CASE WHEN label = 0 THEN -1 ELSE 1 END AS cls FROM (
         SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {HS('vec_id', K.LANDMARK_SEED)}, vec_id) AS rn
         FROM embeddings WHERE label IN (0, 1)) WHERE rn <= 10),
l AS (SELECT ex.lid, ex.cls, e.f, e.v FROM e JOIN ex ON ex.lid = e.vec_id),
k AS (SELECT a.vec_id, l.lid, l.cls, product((3.0::DOUBLE + cos(a.v - l.v)) / 4) AS k FROM e a JOIN l ON l.f = a.f GROUP BY a.vec_id, l.lid, l.cls),
m AS (SELECT vec_id, avg(CASE WHEN cls = -1 THEN k END) AS sn, avg(CASE WHEN cls = 1 THEN k END) AS sp FROM k GROUP BY vec_id)
SELECT vec_id, round(sn / (sn + sp), 6) + 0.0 AS p_neg, round(sp / (sn + sp), 6) + 0.0 AS p_pos,
       CASE WHEN sp / (sn + sp) > sn / (sn + sp) THEN 1 ELSE -1 END AS y_pred FROM m"""


reg("k05_class_mean_similarity", _k5, _k5_sql())

# ---------------------------------------------------------------- generators (one draw per order key)
_OK = lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("k"))
reg("g01_linearly_separable", lambda s, d: G.gen_linearly_separable(_OK(s, d), "k", 4, 0.1, seed=3))
reg("g02_hidden_manifold", lambda s, d: G.gen_hidden_manifold(_OK(s, d), "k", 6, 3, seed=3))
reg("g03_hyperplanes_parity", lambda s, d: G.gen_hyperplanes_parity(_OK(s, d), "k", 2000, 5, 3, 3, seed=3))
reg("g04_two_curves", lambda s, d: G.gen_two_curves(_OK(s, d), "k", 4, 3, 0.1, 0.05, seed=3))
reg("g05_bars_and_stripes", lambda s, d: G.gen_bars_and_stripes(_OK(s, d), "k", 4, 4, 0.1, seed=3))

# ---------------------------------------------------------------- training
def _prepared(s, d):
    """orders → binary target (status F) with three numeric features, hash split."""
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus")
    df = o.select(F.col("o_orderkey").alias("row_id"),
                  (F.col("o_totalprice") / 100000).alias("f_price"),
                  (F.year("o_orderdate") - 1995).cast("double").alias("f_year"),
                  F.substring("o_orderpriority", 1, 1).cast("double").alias("f_prio"),
                  F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).alias("y"))
    from equisel.session import materialise
    # iterative fits read the prepared table many times: cut its lineage once
    return materialise(X.stratified_split(df, "row_id", "y", 0.75, 42))


_FEATS = ["f_price", "f_year", "f_prio"]


def _fit_score(s, d, which):
    df = M.to_ml_label(M.assemble(_prepared(s, d), _FEATS))
    tr = df.where(F.col("split") == "train")
    if which == "svc":
        m = M.fit_linear_svc(tr, C=1.0)
    elif which == "svc_balanced":
        m = M.fit_linear_svc(tr, C=10.0, class_weight="balanced")
    elif which == "logit":
        m = M.fit_logistic_head(tr)
    else:
        m = M.fit_mlp(tr, 3, 2, "(10, 5)", 0.1, 64, max_iter=20)
    return M.score(m, df.where(F.col("split") == "test")).select("row_id", "y", "y_pred", "score")


reg("m01_linear_svc_scores", lambda s, d: _fit_score(s, d, "svc"))
reg("m01_linear_svc_balanced_scores", lambda s, d: _fit_score(s, d, "svc_balanced"))
reg("m02_mlp_scores", lambda s, d: _fit_score(s, d, "mlp"))
reg("m04_logistic_head_scores", lambda s, d: _fit_score(s, d, "logit"))


def _perceptron(s, d):
    from equisel.operators.encode import assemble_array
    df = assemble_array(_prepared(s, d), _FEATS)
    w, b = M.fit_perceptron(df.where(F.col("split") == "train"), "x", "y", eta0=0.1, epochs=5)
    return s.createDataFrame([(i, round(float(v), 6) + 0.0) for i, v in enumerate([*w, b])], "idx int, weight double")


reg("m03_perceptron_weights", _perceptron)


def _kernel_svc(s, d):
    from equisel.operators.encode import assemble_array
    from pyspark.ml.functions import array_to_vector
    df = M.to_ml_label(assemble_array(_prepared(s, d), _FEATS))
    tr = df.where(F.col("split") == "train")
    lm = K.landmarks(tr, "row_id", ["x"], 50)
    m, g = M.fit_kernel_svc(tr, lm, "x", "row_id", C=1.0)
    te = K.rbf_kernel(df.where(F.col("split") == "test"), lm, "x", "row_id", gamma=g).withColumn(
        "kfeat", array_to_vector("kernel"))
    m.setFeaturesCol("kfeat")
    return M.score(m, te).select("row_id", "y", "y_pred", "score")


reg("m05_kernel_svc_scores", _kernel_svc)


def _ovr(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    df = o.select(F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / 100000).alias("f_price"),
                  (F.year("o_orderdate") - 1995).cast("double").alias("f_year"),
                  F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("y"))
    from equisel.session import materialise

    df = materialise(X.stratified_split(df, "row_id", "y", 0.75, 42))
    df = M.to_ml_label(M.assemble(df, ["f_price", "f_year"]), "y", binary=False)
    m = M.fit_one_vs_rest(df.where(F.col("split") == "train"), C=1.0, parallelism=3)
    return M.score(m, df.where(F.col("split") == "test"), binary=False).select("row_id", "y", "y_pred")


reg("m06_one_vs_rest_scores", _ovr)


def _refit(s, d):
    """M9: refit the best classical trial of the best study (its C) on the
    prepared orders data and score the test rows."""
    from equisel.operators.trials import best_per_family
    from equisel.plans.evaluate import refit_trial
    from equisel.operators.target import TaskSpec

    log = V.trials(s, d)
    best = best_per_family(log).where(F.col("family") == "classical").orderBy(F.col("value").desc(), "trial").first()
    if best is None:
        raise ValueError("no classical trial to refit")
    data = M.to_ml_label(_prepared(s, d)).drop("label")
    spec = TaskSpec("binary", 2, ["-1", "1"], "1", 1)
    out = refit_trial(log, data, _FEATS, spec, best["study"], best["trial"])
    return out.select("row_id", "y", "y_pred", "trial")


reg("m09_refit_best_trial", _refit)

reg("m11_loss_convergence", lambda s, d: M.loss_convergence(V.reports(s, d), 2),
    with_views("""
SELECT k.study, k.trial, c.converged_step, c.converged_step IS NOT NULL AS converged
FROM (SELECT DISTINCT study, trial FROM reports) k LEFT JOIN (
  SELECT study, trial, min(p - 1) AS converged_step FROM (
    SELECT study, trial, p,
           avg(value) OVER (PARTITION BY study, trial ORDER BY step ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS m1,
           avg(value) OVER (PARTITION BY study, trial ORDER BY step ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING) AS m2,
           stddev_pop(value) OVER (PARTITION BY study, trial ORDER BY step ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s1
    FROM (SELECT *, row_number() OVER (PARTITION BY study, trial ORDER BY step) AS p FROM reports))
  WHERE p - 1 > 4 AND abs(m2 - m1) <= s1 / sqrt(2) / 2 GROUP BY study, trial) c
ON c.study = k.study AND c.trial = k.trial""", "reports"))

reg("m12_normalise_loss", lambda s, d: M.normalise_loss(V.reports(s, d)),
    with_views("SELECT study, trial, step, value, ts, round(value / max(abs(value)) OVER (PARTITION BY study, trial), 6) AS norm_loss "
               "FROM reports", "reports"))

# ---------------------------------------------------------------- attribution
_W, _B = [0.5, -0.2, 0.3], 0.1
_X_SQL = "[p_size / 10, (p_retailprice - 900) / 10, length(p_name) / 10]"


def _part_x(s, d):
    p = table(s, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_name")
    return p.select("p_partkey", F.array(F.col("p_size") / 10.0, (F.col("p_retailprice") - 900) / 10.0,
                                         F.length("p_name") / 10.0).alias("x"))


_NAMES = ["size", "price", "name_len"]


def _lshap(s, d):
    px = _part_x(s, d)
    return AT.linear_shap(px, "x", "p_partkey", _W, _B, px, _NAMES)


_V1_SQL = f"""
WITH x AS (SELECT p_partkey, {_X_SQL} AS x FROM part),
m AS (SELECT avg(x[1]) AS m1, avg(x[2]) AS m2, avg(x[3]) AS m3 FROM x),
sh AS (SELECT p_partkey AS row_id, 0 AS class_code, f.name AS feature, f.w * (x[f.i] - CASE f.i WHEN 1 THEN m1 WHEN 2 THEN m2 ELSE m3 END) AS value,
              x[f.i] AS feature_value
       FROM x CROSS JOIN m CROSS JOIN (VALUES (1, 'size', {_W[0]}), (2, 'price', {_W[1]}), (3, 'name_len', {_W[2]})) f(i, name, w)),
base AS (SELECT {_W[0]} * m1 + {_W[1]} * m2 + {_W[2]} * m3 + {_B} AS base_value FROM m)
"""
reg("v01_linear_shap", lambda s, d: _lshap(s, d)[0].select("row_id", "class_code", "feature", r6("value").alias("value"),
                                                          r6("feature_value").alias("feature_value")),
    _V1_SQL + "SELECT row_id, class_code, feature, round(value, 6) + 0.0 AS value, round(feature_value, 6) + 0.0 AS feature_value FROM sh")


def _pshap(s, d, outputs=1):
    px = _part_x(s, d)
    bg = px.orderBy(hash32("p_partkey", 13), "p_partkey").limit(20)  # background set: a hash sample of 20 rows (the explainer's parameter)
    model = lambda arr: 1 / (1 + F.exp(-(F.aggregate(F.zip_with(arr, F.array(*[F.lit(w) for w in _W]), lambda a, b: a * b),
                                                    F.lit(0.0), lambda acc, v: acc + v) + F.lit(_B))))
    if outputs > 1:  # class c: (c + 1) times the share, and c
        several = lambda arr: F.array(*(model(arr) * (c + 1) + c for c in range(outputs)))
        sh, _ = AT.permutation_shap(px, "x", "p_partkey", several, bg, n_perm=3, seed=1, names=_NAMES, n_outputs=outputs)
        return sh.select("row_id", "class_code", "feature", r6("value").alias("value"))
    sh, base = AT.permutation_shap(px, "x", "p_partkey", model, bg, n_perm=3, seed=1, names=_NAMES)
    return sh.select("row_id", "feature", r6("value").alias("value"))


reg("v02_permutation_shap", _pshap)
reg("v02_permutation_shap_classes", lambda s, d: _pshap(s, d, 3))
reg("v03_class_slice", lambda s, d: AT.class_slice(_lshap(s, d)[0], 2).select("row_id", "feature", F.round("value", 6).alias("value")),
    _V1_SQL + "SELECT row_id, feature, round(value, 6) AS value FROM sh")
reg("v04_feature_importance", lambda s, d: AT.feature_importance(_lshap(s, d)[0]),
    _V1_SQL + "SELECT feature, round(avg(abs(value)), 6) AS importance FROM sh GROUP BY feature")
reg("v05_top_features", lambda s, d: AT.top_features(_lshap(s, d)[0], 2),
    _V1_SQL + "SELECT feature, round(avg(abs(value)), 6) AS importance FROM sh GROUP BY feature ORDER BY importance DESC, feature LIMIT 2")
reg("v06_shap_payload", lambda s, d: AT.shap_payload(*_lshap(s, d), max_rows=200).select(
    "row_id", "feature", F.round("value", 6).alias("value"), F.round("feature_value", 6).alias("feature_value"),
    F.round("base_value", 6).alias("base_value")),
    _V1_SQL + """, r AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pos, count(*) OVER () AS n
                       FROM (SELECT DISTINCT row_id FROM sh))
SELECT sh.row_id, feature, round(value, 6) AS value, round(feature_value, 6) AS feature_value,
       round((SELECT base_value FROM base), 6) AS base_value
FROM sh JOIN r ON r.row_id = sh.row_id
WHERE r.n <= 200 OR r.pos IN (SELECT CAST(round_even(CAST(i * ((SELECT max(n) FROM r) - 1) AS DOUBLE) / 199, 0) AS BIGINT)
                             FROM range(200) t(i))""")
reg("v07_waterfall", lambda s, d: AT.waterfall(*_lshap(s, d), top=2),
    _V1_SQL + """, rk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(value) DESC, feature) AS rk FROM sh),
steps AS (SELECT row_id, rk, feature || ' = ' || printf('%.3f', feature_value) AS name, value FROM rk WHERE rk <= 2
          UNION ALL SELECT row_id, 3, 'other (' || CAST(count(*) AS VARCHAR) || ' features)', sum(value) FROM rk WHERE rk > 2 GROUP BY row_id)
SELECT row_id, CAST(rk AS INTEGER) AS rk, name, round(value, 6) + 0.0 AS delta,
       round((SELECT base_value FROM base) + sum(value) OVER (PARTITION BY row_id ORDER BY rk) - value, 6) + 0.0 AS start,
       round((SELECT base_value FROM base) + sum(value) OVER (PARTITION BY row_id ORDER BY rk), 6) + 0.0 AS "end" FROM steps""")
reg("v08_beeswarm", lambda s, d: AT.beeswarm(_lshap(s, d)[0], top=3),
    _V1_SQL + """, st AS (SELECT feature, min(value) AS mn, max(value) AS mx, min(feature_value) AS rmn, max(feature_value) AS rmx FROM sh GROUP BY feature),
b AS (SELECT sh.*, st.*, CAST(floor(value / greatest((mx - mn) * 0.05, 1e-9) + 0.5) AS BIGINT) AS bin FROM sh JOIN st USING (feature)),
k AS (SELECT *, row_number() OVER (PARTITION BY feature, bin ORDER BY row_id) - 1 AS k FROM b)
SELECT feature, row_id, value, bin,
       round(least(ceil(k / 2) * 0.09, 0.38) * CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END, 6) + 0.0 AS offset,
       round(CASE WHEN rmx - rmn > 0 THEN (feature_value - rmn) / (rmx - rmn) ELSE 0.5 END, 6) + 0.0 AS colour FROM k""")
reg("v09_heatmap", lambda s, d: AT.heatmap(_lshap(s, d)[0], n_rows=50, top=3),
    _V1_SQL + """, h AS (SELECT * FROM sh WHERE row_id IN (SELECT DISTINCT row_id FROM sh ORDER BY row_id LIMIT 50))
SELECT row_id, feature, round(CASE WHEN (SELECT max(abs(value)) FROM h) > 0 THEN value / (SELECT max(abs(value)) FROM h) ELSE 0.0 END, 6)
       AS scaled FROM h""")
reg("v10_violin_histogram", lambda s, d: AT.violin_summary(_lshap(s, d)[0], bins=20)[0],
    _V1_SQL + """, st AS (SELECT feature, min(value) AS mn, max(value) AS mx FROM sh GROUP BY feature)
SELECT feature, CAST(CASE WHEN mx > mn THEN least(floor((value - mn) / (mx - mn) * 20), 19) ELSE 0 END AS INTEGER) AS bin,
       count(*) AS n FROM sh JOIN st USING (feature) GROUP BY 1, 2""")
reg("v10_violin_quartiles", lambda s, d: AT.violin_summary(_lshap(s, d)[0])[1].select(
    "feature", "prob", F.round("value", 6).alias("value")),
    _V1_SQL + """SELECT feature, unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS prob,
       unnest(list_transform(quantile_cont(value, [0.25, 0.5, 0.75]), lambda v: round(v, 6))) AS value FROM sh GROUP BY feature""")


def _bundle(s, d):
    from equisel.operators import fairness as B
    from equisel.operators import metrics as Q
    from equisel.operators.trials import leaderboard
    p = V.predictions(s, d)
    sh, base = _lshap(s, d)
    return AT.evidence_bundle({
        "metrics": Q.metric_report(p),
        "confusion": Q.confusion_matrix(p),
        "curves": lambda: Q.downsample_curve(Q.roc_curve(p), "threshold", max_points=50, descending=True),
        "importance": AT.feature_importance(sh),
        "shap": lambda: AT.violin_summary(sh)[1],
        "shap_base": base,
        "fairness": lambda: B.audit(p),
        "trials": lambda: leaderboard(V.trials(s, d), 3),
    })


reg("v11_evidence_bundle", _bundle)


def _bundle_shape(s, d):
    """Rows of every section of the bundle; warnings there must be none."""
    names = ["metrics", "confusion", "curves", "importance", "shap", "shap_base", "fairness", "trials", "warnings"]
    rows = F.array(*(F.struct(F.lit(n).alias("section"), F.json_array_length(F.get_json_object("bundle", f"$.{n}")).cast("long").alias("n_rows")) for n in names))
    return _bundle(s, d).select(F.inline(rows))


reg("v11_bundle_shape", _bundle_shape, with_views("""
SELECT unnest(['metrics', 'confusion', 'curves', 'importance', 'shap', 'shap_base', 'fairness', 'trials', 'warnings']) AS section,
       unnest([9, labels * labels, least(50, scores + 1), 3, 9, 1, (groups + 1) * 8 + 5, listed, 0]) AS n_rows
FROM (SELECT count(DISTINCT label) AS labels FROM (SELECT y_true AS label FROM predictions UNION SELECT y_pred FROM predictions)),
     (SELECT count(DISTINCT score) AS scores, count(DISTINCT sensitive) AS groups FROM predictions),
     (SELECT CAST(sum(least(3, n)) AS BIGINT) AS listed FROM (SELECT count(*) AS n FROM trials GROUP BY study))""", "predictions", "trials"))


def _evaluate(s, d):
    from equisel.plans.evaluate import evaluate_trials, prepare
    from equisel.sources.views import features

    data, feats, spec = prepare(features(s, d), "p_partkey", "target", "ordinal")
    configs = [{"model_type": "SVClinear", "C": 1.0}, {"model_type": "SVClinear", "C": 100.0, "class_weight": "balanced"},
               {"model_type": "LogisticRegression"}, {"model_type": "NotAModel"}]
    log, _ = evaluate_trials(data, feats, configs, spec)
    return log.drop("seconds")


reg("h05_evaluate_trials", _evaluate)

# ---------------------------------------------------------------- studies: many configurations in one pass
STUDY = [{"model_type": "SVClinear", "C": 0.1}, {"model_type": "SVClinear", "C": 10, "class_weight": "balanced"},
         {"model_type": "LogisticRegression", "C": 1}, {"model_type": "Perceptron", "eta0": 1.0, "epochs": 5}, {"model_type": "NotAModel"}]


def _study_data(s, d):
    """orders → one feature, a noisy label by it, a hash split, the buyer's segment."""
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(table(s, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    f, part = F.col("o_totalprice") / 100000, hash32("o_orderkey", 22) % 5
    return o.select(F.col("o_orderkey").alias("row_id"), f.alias("f"), F.when(f - 2 + 3 * (unit_hash("o_orderkey", 21) - 0.5) > 0, 1).otherwise(-1).alias("y"),
                    F.when(part < 3, "train").when(part == 3, "val").otherwise("test").alias("split"), F.col("c_mktsegment").alias("sensitive"))


def _study_constrained(s, d):
    from equisel.plans.study import run_study

    log, _, _ = run_study(_study_data(s, d), ["f"], configs=STUDY, sensitive="sensitive", mode="constrained", threshold=0.05)
    return log.select("trial", "model_type", "state", *(F.round(c, 6).alias(c) for c in (
        "value", "val_f1_unthresholded", "decision_threshold", "f1_score", "f1_score_thresholded", "accuracy", "fairness_disparity", "fairness_constraint")),
        "feasible", "batch_size", "pruned")


def _study_weights(s, d):
    from equisel.operators.many import Study

    train = _study_data(s, d).where("split = 'train'").select("row_id", "y", F.array("f").alias("x"))
    models, _ = Study(materialise(train)).fit(STUDY)
    rows = [(m.trial, i, round(float(w), 4) + 0.0) for m in models for u in m.units for i, w in enumerate(u.w)]
    return s.createDataFrame(rows, "trial int, idx int, weight double")


def _study_search(s, d):
    from equisel.plans.study import best_of, run_study

    log, _, _ = run_study(_study_data(s, d), ["f"], n_trials=8, per_round=4, models=["SVClinear", "Perceptron", "MLPClassifier"], sensitive="sensitive",
                          mode="multi_objective", max_steps=20)
    return best_of(log, "multi_objective").drop("training_time")


_STUDY_TABLES = {
    "data": f"""SELECT o_orderkey AS row_id, o_totalprice / 100000 AS f, c_mktsegment AS sensitive,
       CASE WHEN o_totalprice / 100000 - 2 + 3 * ({HS('o_orderkey', 21)} / 4294967296.0::DOUBLE - 0.5) > 0 THEN 1 ELSE -1 END AS y,
       CASE WHEN {HS('o_orderkey', 22)} % 5 < 3 THEN 'train' WHEN {HS('o_orderkey', 22)} % 5 = 3 THEN 'val' ELSE 'test' END AS split
       FROM orders JOIN customer ON o_custkey = c_custkey""",
    "train": "SELECT f, y, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY y)) AS balance FROM data WHERE split = 'train'",
    "w0": "SELECT * FROM (VALUES (0, 'hinge', 0.1, 0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 'hinge', 10.0, 1, 0.0, 0.0), (2, 'logistic', 1.0, 0, 0.0, 0.0)) v(trial, loss, c, balanced, w, b)"}


def _newton_sql(k: int) -> str:
    """One Newton step of every machine: gradient and curvature are sums over
    the train rows, the 2 x 2 system is solved in closed form."""
    return f"""SELECT trial, loss, c, balanced, w - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS w, b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b
FROM (SELECT trial, loss, c, balanced, w, b, w + c * sum(slope * f) AS g1, (CASE WHEN loss = 'hinge' THEN b ELSE 0 END) + c * sum(slope) AS g2,
        1 + c * sum(curve * f * f) AS h11, c * sum(curve * f) AS h12, (CASE WHEN loss = 'hinge' THEN 1 ELSE 1e-10 END) + c * sum(curve) AS h22
      FROM (SELECT u.*, t.f, (CASE WHEN u.balanced = 1 THEN t.balance ELSE 1 END) * CASE WHEN loss = 'hinge' THEN -2 * t.y * greatest(0, 1 - m) ELSE -t.y * (1 - 1 / (1 + exp(-m))) END AS slope,
              (CASE WHEN u.balanced = 1 THEN t.balance ELSE 1 END) * CASE WHEN loss = 'hinge' THEN CASE WHEN m < 1 THEN 2 ELSE 0 END ELSE exp(-m) / ((1 + exp(-m)) * (1 + exp(-m))) END AS curve
            FROM (SELECT u.*, t.f AS f0, t.y AS y0, t.balance AS bal0, t.y * (u.w * t.f + u.b) AS m FROM w{k} u, train t) u, LATERAL (SELECT u.f0 AS f, u.y0 AS y, u.bal0 AS balance) t)
      GROUP BY trial, loss, c, balanced, w, b)"""


def _study_sql(rows: str, steps: int = 14, epochs: int = 5) -> str:
    ctes = dict(_STUDY_TABLES)
    for k in range(steps):
        ctes[f"w{k + 1}"] = _newton_sql(k)
    ctes["p0"] = "SELECT 0.0::DOUBLE AS w, 0.0::DOUBLE AS b"
    for k in range(epochs):
        ctes[f"p{k + 1}"] = f"""SELECT p.w + coalesce(sum(t.y * t.f) FILTER (t.y * (p.w * t.f + p.b) <= 0), 0) AS w,
       p.b + coalesce(sum(t.y) FILTER (t.y * (p.w * t.f + p.b) <= 0), 0) AS b FROM p{k} p, train t GROUP BY p.w, p.b"""
    ctes["fitted"] = f"SELECT trial, loss, w, b FROM w{steps} UNION ALL SELECT 3, 'perceptron', w, b FROM p{epochs}"
    body = ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in ctes.items())
    return f"WITH {body}\n{rows}"


_f1 = lambda hit, y: f"coalesce(2.0 * count_if({hit} AND {y} = 1) / nullif(count_if({hit}) + count_if({y} = 1), 0), 0)"
reg("m01_m04_grid_weights", _study_weights, _study_sql(
    "SELECT trial, CAST(0 AS INTEGER) AS idx, round(w, 4) + 0.0 AS weight FROM fitted UNION ALL SELECT trial, 1, round(b, 4) + 0.0 FROM fitted"))
reg("h05_study_constrained", _study_constrained, _study_sql(f"""
, scored AS (SELECT f.trial, f.loss, d.split, d.y, d.sensitive, f.w * d.f + f.b > 0 AS hit, 1 / (1 + exp(-(f.w * d.f + f.b))) AS p FROM fitted f, data d WHERE d.split <> 'train'),
val AS (SELECT trial, {_f1('hit', 'y')} AS val_f1 FROM scored WHERE split = 'val' GROUP BY trial),
test AS (SELECT trial, {_f1('hit', 'y')} AS f1_score, avg((hit = (y = 1))::INT) AS accuracy FROM scored WHERE split = 'test' GROUP BY trial),
cuts AS (SELECT trial, k, {_f1('p >= k / 20.0::DOUBLE', 'y')} AS f1 FROM scored, range(1, 20) r(k) WHERE split = 'val' AND loss = 'logistic' GROUP BY trial, k),
tuned AS (SELECT c.trial, c.f1 AS best, c.k / 20.0::DOUBLE AS cut FROM (SELECT trial, arg_max({{'k': k, 'f1': f1}}, f1 * 1000 - k * 1e-9) AS b FROM cuts GROUP BY trial) x
  JOIN cuts c ON c.trial = x.trial AND c.k = x.b.k JOIN val v ON v.trial = c.trial WHERE c.f1 > v.val_f1),
after_ AS (SELECT s.trial, {_f1('p >= cut', 'y')} AS f1_score_thresholded FROM scored s JOIN tuned t ON t.trial = s.trial WHERE split = 'test' GROUP BY s.trial),
gap AS (SELECT trial, max(rate) - min(rate) AS disparity FROM (SELECT trial, sensitive, avg(hit::INT) AS rate FROM scored WHERE split = 'test' GROUP BY 1, 2) GROUP BY trial)
SELECT v.trial, m.model_type, 'COMPLETE' AS state, round(coalesce(t.best, v.val_f1), 6) AS value, CASE WHEN t.cut IS NOT NULL THEN round(v.val_f1, 6) END AS val_f1_unthresholded,
       round(t.cut, 6) AS decision_threshold, round(e.f1_score, 6) AS f1_score, round(a.f1_score_thresholded, 6) AS f1_score_thresholded, round(e.accuracy, 6) AS accuracy,
       round(g.disparity, 6) AS fairness_disparity, round(g.disparity - 0.05, 6) AS fairness_constraint, g.disparity <= 0.05 AS feasible, CAST(NULL AS INTEGER) AS batch_size, false AS pruned
FROM val v JOIN test e USING (trial) JOIN gap g USING (trial) LEFT JOIN tuned t USING (trial) LEFT JOIN after_ a USING (trial)
JOIN (VALUES (0, 'SVClinear'), (1, 'SVClinear'), (2, 'LogisticRegression'), (3, 'Perceptron')) m(trial, model_type) USING (trial)
UNION ALL SELECT 4, 'NotAModel', 'FAIL', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false"""))
reg("h05_study_search", _study_search)


def _grid_scores(s, d):
    """M1 / M4 / M7: predictions and probabilities of the test rows, all machines in one pass."""
    from equisel.operators.many import Study

    data = materialise(_study_data(s, d).withColumn("x", F.array("f")))
    study = Study(data.where("split = 'train'"))
    models, _ = study.fit(STUDY[:3])
    out = study.score(data.where("split = 'test'"), models, ["row_id", "y"])
    return out.select("row_id", "y", "trial", "y_pred", F.round("score", 4).alias("score"))


reg("m01_m04_grid_scores", _grid_scores, _study_sql("""
SELECT d.row_id, d.y, f.trial, CASE WHEN f.w * d.f + f.b > 0 THEN 1 ELSE -1 END AS y_pred,
       CASE WHEN f.loss = 'logistic' THEN round(1 / (1 + exp(-(f.w * d.f + f.b))), 4) END AS score
FROM fitted f, data d WHERE d.split = 'test' AND f.trial < 3"""))


def _refit_machine(s, d):
    """M9: the study's best trial is fitted again from its logged parameters and scores the test rows."""
    from equisel.plans.study import best_of, refit, run_study

    data = _study_data(s, d)
    log, _, _ = run_study(data, ["f"], configs=STUDY)
    best = best_of(log).first()
    return refit(log, data, ["f"], best["trial"]).select("row_id", "y", "trial", "y_pred")


reg("m09_refit_machine", _refit_machine, _study_sql(f"""
, scored AS (SELECT f.trial, f.loss, d.y, f.w * d.f + f.b > 0 AS hit, 1 / (1 + exp(-(f.w * d.f + f.b))) AS p FROM fitted f, data d WHERE d.split = 'val'),
val AS (SELECT trial, {_f1('hit', 'y')} AS f1 FROM scored GROUP BY trial UNION ALL
  SELECT trial, {_f1('p >= k / 20.0::DOUBLE', 'y')} FROM scored, range(1, 20) r(k) WHERE loss = 'logistic' GROUP BY trial, k),
best AS (SELECT trial FROM (SELECT trial, max(f1) AS f1 FROM val GROUP BY trial) ORDER BY round(f1, 6) DESC, trial LIMIT 1)
SELECT d.row_id, d.y, b.trial, CASE WHEN f.w * d.f + f.b > 0 THEN 1 ELSE -1 END AS y_pred FROM data d, best b JOIN fitted f USING (trial) WHERE d.split = 'test'"""))


def _one_vs_rest_machines(s, d):
    """M6: one machine per class against the rest, each with its own convergence."""
    from equisel.operators.many import Study

    data = materialise(_study_data(s, d).withColumn("x", F.array("f")).withColumn("y", _three_classes()))
    study = Study(data.where("split = 'train'"))
    models, _ = study.fit([{"model_type": "SVClinear", "C": 0.1}])
    ranks = study.score(data.where("split = 'test'"), models, ["y"]).groupBy("y", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    weights = s.createDataFrame([(u.target, round(float(u.w[0]), 4), round(float(u.w[1]), 4), u.converged) for u in models[0].units], "y int, w double, b double, converged boolean")
    return ranks.join(F.broadcast(weights), "y")  # three classes


def _three_classes():
    noisy = F.col("f") + 2 * unit_hash("row_id", 23)
    return F.when(noisy < 2, 0).when(noisy < 4.5, 1).otherwise(2)


_three = f"CASE WHEN f + 2 * ({HS('row_id', 23)} / 4294967296.0::DOUBLE) < 2 THEN 0 WHEN f + 2 * ({HS('row_id', 23)} / 4294967296.0::DOUBLE) < 4.5 THEN 1 ELSE 2 END"


def _one_vs_rest_sql(steps: int = 14) -> str:
    ctes = {"data": _STUDY_TABLES["data"], "coded": f"SELECT split, f, CAST({_three} AS INTEGER) AS code FROM data",
            "w0": "SELECT CAST(k AS INTEGER) AS trial, 'hinge' AS loss, 0.1 AS c, 0 AS balanced, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b FROM range(3) r(k)"}
    for k in range(steps):  # the rows of every machine carry its own signs
        ctes[f"w{k + 1}"] = _newton_sql(k).replace(f"FROM w{k} u, train t)", f"FROM w{k} u JOIN signed t ON t.machine = u.trial)")
    ctes = {**{n: q for n, q in ctes.items() if n in ("data", "coded")},
            "signed": "SELECT CAST(k AS INTEGER) AS machine, f, CASE WHEN code = k THEN 1 ELSE -1 END AS y, 1.0 AS balance FROM coded, range(3) r(k) WHERE split = 'train'",
            **{n: q for n, q in ctes.items() if n not in ("data", "coded")}}
    body = ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in ctes.items())
    return f"""WITH {body}
SELECT s.y, s.y_pred, s.n, round(m.w, 4) AS w, round(m.b, 4) AS b, true AS converged
FROM (SELECT y, y_pred, count(*) AS n FROM (
        SELECT code AS y, (SELECT arg_max(trial, w * d.f + b) FROM w{steps}) AS y_pred FROM coded d WHERE split = 'test') GROUP BY 1, 2) s
JOIN w{steps} m ON m.trial = s.y"""


reg("m06_one_vs_rest_machines", _one_vs_rest_machines, _one_vs_rest_sql())


# ---------------------------------------------------------------- generator oracles (md5 draws reproduced in SQL)
def _MU(*parts) -> str:
    args = ", ".join(p if not isinstance(p, (int, float)) else str(p) for p in parts)
    return f"(CAST('0x' || substr(md5(concat_ws(':', {args})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def _MN(*parts) -> str:
    u1 = f"(({_MU(*parts, chr(39) + 'a' + chr(39))} * 4294967296.0::DOUBLE + 1) / 4294967297.0::DOUBLE)"
    u2 = _MU(*parts, "'b'")
    return f"(sqrt(-2 * ln({u1})) * cos(2 * 3.141592653589793 * {u2}))"


SQL["g01_linearly_separable"] = f"""
SELECT k, x, CASE WHEN list_sum(x) > 0 THEN -1 ELSE 1 END AS y FROM (
  SELECT o_orderkey AS k,
         list_filter([[2 * {_MU('o_orderkey', 3, 'a', 'i')} - 1 for i in range(4)] for a in range(8)],
                     lambda v: abs(list_sum(v)) > 0.1)[1] AS x
  FROM orders) WHERE x IS NOT NULL"""


def _g5(s, d):
    g = G.gen_bars_and_stripes(_OK(s, d), "k", 4, 4, 0.1, seed=3)
    return g.select("k", F.transform("x", lambda v: F.round(v, 6) + F.lit(0.0)).alias("x"), "y")


QUERIES["g05_bars_and_stripes"] = _g5
_bars = f"{_MU('o_orderkey', 3, chr(39) + 'coin' + chr(39))} > 0.5"
_pix = []
for _r in range(4):
    for _c in range(4):
        _on = (f"CASE WHEN {_bars} THEN {_MU('o_orderkey', 3, chr(39) + 'r' + chr(39), _r)} > 0.5 "
               f"ELSE {_MU('o_orderkey', 3, chr(39) + 'c' + chr(39), _c)} > 0.5 END")
        _pix.append(f"round(CASE WHEN {_on} THEN 1.0 ELSE -1.0 END + "
                    f"{_MN('o_orderkey', 3, chr(39) + 'px' + chr(39), _r * 4 + _c)} * 0.1, 6) + 0.0")
SQL["g05_bars_and_stripes"] = (f"SELECT o_orderkey AS k, [{', '.join(_pix)}] AS x, "
                               f"CASE WHEN {_bars} THEN -1 ELSE 1 END AS y FROM orders")


def _g4(s, d):
    g = G.gen_two_curves(_OK(s, d), "k", 4, 3, 0.1, 0.05, seed=3)
    return g.select("k", F.transform("x", lambda v: F.round(v, 6) + F.lit(0.0)).alias("x"), "y")


QUERIES["g04_two_curves"] = _g4


def _g4_sql() -> str:
    co = G.two_curves_coefficients(4, 3, 3)
    t = _MU("o_orderkey", 3, "'t'")
    cls = f"CASE WHEN {_MU('o_orderkey', 3, chr(39) + 'cls' + chr(39))} < 0.5 THEN -1 ELSE 1 END"
    comps = []
    for i in range(4):
        e = repr(float(co[i, 0, 0] + co[i, 0, 1]))
        for f in range(1, 4):
            e = f"{e} + {float(co[i, f, 0])!r} * cos({f * math.pi!r} * t) + {float(co[i, f, 1])!r} * sin({f * math.pi!r} * t)"
        e = f"{e} + {_MN('o_orderkey', 3, chr(39) + 'n' + chr(39), i)} * 0.05 + CASE WHEN y = 1 THEN 0.1 ELSE 0.0 END"
        comps.append(f"{e} AS x{i}")
    z = [f"round((x{i} - avg(x{i}) OVER ()) / CASE WHEN coalesce(stddev_pop(x{i}) OVER (), 0) = 0 THEN 1.0 "
         f"ELSE stddev_pop(x{i}) OVER () END, 6) + 0.0" for i in range(4)]
    return f"""SELECT k, [{', '.join(z)}] AS x, y FROM (
  SELECT k, y, {', '.join(comps)} FROM (SELECT o_orderkey, o_orderkey AS k, {t} AS t, {cls} AS y FROM orders))"""


SQL["g04_two_curves"] = _g4_sql()


def _dot_sql(weights, xs) -> str:
    """Left-to-right dot product from 0.0, the association Spark's aggregate uses."""
    e = "0.0"
    for w, x in zip(weights, xs):
        e = f"({e} + {float(w)!r} * {x})"
    return e


def _g2(s, d):
    g = G.gen_hidden_manifold(_OK(s, d), "k", 6, 3, seed=3)
    return g.select("k", F.transform("x", lambda v: F.round(v, 6) + F.lit(0.0)).alias("x"), "y")


def _g2_sql() -> str:
    Fm, bias, W, v = G.hidden_manifold_constants(6, 3, 3)
    m = 3
    cs = [f"c{i}" for i in range(m)]
    xs = [f"round(tanh({_dot_sql(Fm[:, j], cs)} / {math.sqrt(m)!r} - {float(bias[j])!r}), 6) + 0.0" for j in range(6)]
    h = [f"tanh({_dot_sql(W[r], cs)})" for r in range(m)]
    net = f"{_dot_sql(v, h)} / {math.sqrt(m)!r}"
    draws = ", ".join(f"{_MN('o_orderkey', 3, chr(39) + 'c' + chr(39), i)} AS c{i}" for i in range(m))
    return f"""
WITH c AS (SELECT o_orderkey AS k, {draws} FROM orders),
g AS (SELECT k, [{', '.join(xs)}] AS x, {net} AS net FROM c)
SELECT k, x, CASE WHEN net - (SELECT quantile_cont(net, 0.5) FROM g) < 0 THEN -1 ELSE 1 END AS y FROM g"""


QUERIES["g02_hidden_manifold"] = _g2
SQL["g02_hidden_manifold"] = _g2_sql()


def _g3(s, d):
    g = G.gen_hyperplanes_parity(_OK(s, d), "k", 2000, 5, 3, 3, seed=3)
    return g.select("k", F.transform("x", lambda v: F.round(v, 6) + F.lit(0.0)).alias("x"), "y")


def _g3_sql() -> str:
    Wh, bh, emb = G.hyperplane_constants(5, 3, 3, 3)
    zs = [f"z{i}" for i in range(3)]
    acts = " + ".join(f"CASE WHEN {_dot_sql(Wh[h], zs)} + {float(bh[h])!r} > 0 THEN 1 ELSE 0 END" for h in range(3))
    draws = ", ".join(f"{_MN('o_orderkey', 3, chr(39) + 'z' + chr(39), i)} AS z{i}" for i in range(3))
    xs = [f"{_dot_sql(emb[:, j], zs)} AS x{j}" for j in range(5)]
    zsc = [f"round((x{j} - avg(x{j}) OVER ()) / CASE WHEN coalesce(stddev_pop(x{j}) OVER (), 0) = 0 THEN 1.0 "
           f"ELSE stddev_pop(x{j}) OVER () END, 6) + 0.0" for j in range(5)]
    return f"""
WITH z AS (SELECT o_orderkey AS k, {draws} FROM orders),
lab AS (SELECT *, CASE WHEN ({acts}) % 2 = 0 THEN -1 ELSE 1 END AS y FROM z),
take AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY k) AS rn FROM lab) WHERE rn <= 1000),
e AS (SELECT k, y, {', '.join(xs)} FROM take)
SELECT k, [{', '.join(zsc)}] AS x, y FROM e"""


QUERIES["g03_hyperplanes_parity"] = _g3
SQL["g03_hyperplanes_parity"] = _g3_sql()


def _k1_sql() -> str:
    E_, Q_, D_, seed = 3, 4, 4, 1
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    sc = ", ".join(f"""({c} * (2.0 / CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 1.0 ELSE max({c}) OVER () - min({c}) OVER () END)
        + (-1.0 - min({c}) OVER () * (2.0 / CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 1.0
        ELSE max({c}) OVER () - min({c}) OVER () END))) * 1.0 AS x{j}""" for j, c in enumerate(cols))
    raw = {}
    for e in range(E_):
        for i in range(Q_):
            th = "0.0"
            for j in range(D_):
                w = f"({_MN(seed, chr(39) + 'w' + chr(39), (e * Q_ + i) * D_ + j)} * 1.0)"
                th = f"({th} + {w} * x{j})"
            th = f"{th} + {_MU(seed, chr(39) + 'b' + chr(39), e * Q_ + i)} * 2 * 3.141592653589793"
            raw[(e, i)] = (f"CASE WHEN {_MU('rk', seed, chr(39) + 'bit' + chr(39), e, i)} < pow(sin(({th}) / 2), 2) "
                           f"THEN 1 ELSE 0 END")
    sel = []
    for e in range(E_):
        sel += [f"{raw[(e, i)]} AS r{e}_{i}" for i in range(Q_)]
    out = []
    for e in range(E_):
        c = [f"r{e}_{i}" if i % 2 == 0 else f"((r{e}_{i} + r{e}_{i - 1}) % 2)" for i in range(Q_)]
        for i in range(Q_):
            terms = [c[k] for k in range(i + 1) if k % 2 == i % 2]
            out.append(f"CAST(({' + '.join(terms)}) % 2 AS INTEGER)")
    return f"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_orderkey * 100 + l_linenumber AS rk, {sc} FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, {', '.join(sel)} FROM s)
SELECT l_orderkey, l_linenumber, [{', '.join(out)}] AS qfeatures FROM r"""


SQL["k01_random_binary_features"] = _k1_sql()


def _v2_sql() -> str:
    from equisel.sources.sql_views import H as HS

    d_ = 3
    xs = [f"x[{i + 1}]" for i in range(d_)]
    bs = [f"b[{i + 1}]" for i in range(d_)]
    hs = [HS(f"concat_ws(':', p_partkey, p, {i})", 1) for i in range(d_)]
    ranks = []
    for i in range(d_):
        terms = [f"CASE WHEN h{j} < h{i} OR (h{j} = h{i} AND {j} < {i}) THEN 1 ELSE 0 END" for j in range(d_) if j != i]
        ranks.append(f"({' + '.join(terms)}) AS r{i}")

    def f_at(k):
        comp = [f"CASE WHEN r{i} < {k} THEN {xs[i]} ELSE {bs[i]} END" for i in range(d_)]
        return f"1 / (1 + exp(-({_dot_sql(_W, comp)} + {_B!r})))"

    fs = ", ".join(f"{f_at(k)} AS f{k}" for k in range(d_ + 1))
    deltas = " UNION ALL ".join(
        f"""SELECT p_partkey AS row_id, '{_NAMES[i]}' AS feature,
                   CASE r{i} {' '.join(f'WHEN {k} THEN f{k + 1} - f{k}' for k in range(d_))} END AS delta FROM ev"""
        for i in range(d_))
    return f"""
WITH x AS (SELECT p_partkey, {_X_SQL} AS x FROM part),
bg AS (SELECT x AS b FROM x ORDER BY {HS('p_partkey', 13)}, p_partkey LIMIT 20),
pm AS (SELECT p_partkey, x, p, {', '.join(f'{h} AS h{i}' for i, h in enumerate(hs))}
       FROM x CROSS JOIN (SELECT range AS p FROM range(3))),
rk AS (SELECT p_partkey, x, p, {', '.join(ranks)} FROM pm),
ev AS (SELECT p_partkey, r0, r1, r2, {fs} FROM rk CROSS JOIN bg)
SELECT row_id, feature, round(avg(delta), 6) + 0.0 AS value FROM ({deltas}) GROUP BY row_id, feature"""


SQL["v02_permutation_shap"] = _v2_sql()
SQL["v02_permutation_shap_classes"] = f"""SELECT row_id, CAST(c AS INTEGER) AS class_code, feature, round(v * (c + 1), 6) + 0.0 AS value
FROM ({_v2_sql().replace('round(avg(delta), 6) + 0.0 AS value', 'avg(delta) AS v')}) CROSS JOIN range(3) r(c)"""


def _m03_sql() -> str:
    from equisel.sources.sql_views import H as HS

    prep = f"""
o_ AS (SELECT o_orderkey AS row_id, o_totalprice / 100000 AS f_price, CAST(year(o_orderdate) - 1995 AS DOUBLE) AS f_year,
              CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS f_prio,
              CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS y FROM orders),
s_ AS (SELECT *, {HS('row_id', 42)} AS h FROM o_),
c_ AS (SELECT y, count(*) AS n_c FROM s_ GROUP BY y),
q_ AS (SELECT y, floor(n_c * 0.75::DOUBLE) AS base, n_c * 0.75::DOUBLE - floor(n_c * 0.75::DOUBLE) AS rem,
              floor(sum(n_c) OVER () * 0.75::DOUBLE) - sum(floor(n_c * 0.75::DOUBLE)) OVER () AS left_ FROM c_),
qq_ AS (SELECT y, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, y) <= left_ THEN 1 ELSE 0 END AS quota FROM q_),
tr AS (SELECT * FROM (SELECT s_.*, row_number() OVER (PARTITION BY s_.y ORDER BY h, row_id) AS rn FROM s_ JOIN qq_ USING (y))
       JOIN qq_ USING (y) WHERE rn <= quota),
w0 AS (SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS b)"""
    epochs = []
    for e in range(5):
        m = "(((0.0 + f_price * w.w0) + f_year * w.w1) + f_prio * w.w2) + w.b"
        epochs.append(f"""w{e + 1} AS (SELECT w.w0 + 0.1 * coalesce(sum(f_price * y * 1.0), 0.0) AS w0,
            w.w1 + 0.1 * coalesce(sum(f_year * y * 1.0), 0.0) AS w1, w.w2 + 0.1 * coalesce(sum(f_prio * y * 1.0), 0.0) AS w2,
            w.b + 0.1 * coalesce(sum(y * 1.0), 0.0) AS b
          FROM w{e} w LEFT JOIN tr ON y * ({m}) <= 0 GROUP BY w.w0, w.w1, w.w2, w.b)""")
    return ("WITH " + prep + ",\n" + ",\n".join(epochs) +
            "\nSELECT CAST(idx AS INTEGER) AS idx, round(weight, 6) + 0.0 AS weight FROM (SELECT w0, w1, w2, b FROM w5) "
            "UNPIVOT (weight FOR name IN (w0, w1, w2, b)) JOIN (VALUES ('w0', 0), ('w1', 1), ('w2', 2), ('b', 3)) v(name, idx) "
            "USING (name)")


SQL["m03_perceptron_weights"] = _m03_sql()

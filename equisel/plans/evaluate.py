"""Trial evaluation (H5) and the prepare step.

``prepare`` turns a raw table into one DataFrame with ``row_id``, encoded
and scaled features, ``y`` and ``split`` (train / val / test) — E6, T1–T5,
X1, X3, E8 composed. ``evaluate_trials`` fits one Spark ML model per trial
configuration (each fit is a distributed job; the loop over configurations
is the only driver loop), unions all predictions with their trial id, and
computes the metrics of *all* trials in grouped jobs. A failing trial is
recorded as FAIL with ``Type: message`` and the others go on; if every
trial fails the last error is raised.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equisel.operators import encode as E
from equisel.operators import metrics as Q
from equisel.operators import search as H
from equisel.operators import split as X
from equisel.operators import target as T
from equisel.operators import train as M


def prepare(df: DataFrame, key: str, target: str, method: str = "ordinal", frac: float = 0.75, seed: int = 42,
            label_mapping: dict | None = None, scale_fit_on: str = "all", validation: float | None = 0.2) -> tuple[DataFrame, list[str], T.TaskSpec]:
    """Encode features, encode the target, split (stratified, exact sizes),
    carve validation rows, z-score the non-encoded features."""
    spec = T.derive_task_spec(df, target, label_mapping)
    enc, meta = E.encode_features(df, method, keep=[key, target])
    feats = [c for c in enc.columns if c not in (key, target)]
    passthrough = [r["out_column"] for r in E.passthrough_columns(meta).collect()]  # ≤ encoded columns
    y = T.encode_target(enc, spec, target, "y").drop(target) if target != "y" else T.encode_target(enc, spec, target, "y")
    y = y.withColumnRenamed(key, "row_id") if key != "row_id" else y
    sp = X.stratified_split(y, "row_id", "y", frac, seed)
    if validation:
        sp = X.validation_split(sp, "row_id", "y", validation, seed)
    sp = E.zscore(sp, feats, passthrough, fit_on=scale_fit_on)
    # cut the lineage once: every fit and metric job reads the prepared table
    # from the shared checkpoint folder instead of re-running encode / split
    from equisel.session import materialise
    return materialise(sp), feats, spec


def fit_config(cfg: dict, train: DataFrame, feats: Sequence[str], spec: T.TaskSpec):
    """A function that scores a frame with the configured model fitted on
    ``train``. An unknown ``model_type`` is an error; more than two classes
    use one-vs-rest where the model itself is binary."""
    binary, mt = spec.kind == "binary", cfg["model_type"]
    C = float(cfg.get("C", 1.0))
    if mt == "MLPClassifier":
        m = M.fit_mlp(train, len(feats), spec.n_classes, cfg.get("hidden_layer_sizes", "(100,)"),
                      float(cfg.get("learning_rate", 0.03)), int(cfg.get("batch_size", 32)))
    elif mt == "LogisticRegression":
        m = M.fit_logistic_head(train)
    elif mt == "SVClinear":
        m = M.fit_linear_svc(train, C, cfg.get("class_weight")) if binary else M.fit_one_vs_rest(train, C)
    elif mt == "Perceptron":
        return M.perceptron_scorer(train, spec.n_classes if not binary else None, float(cfg.get("eta0", 1.0)),
                                   int(cfg.get("epochs", 10)), cfg.get("class_weight"))
    elif mt == "SVC":
        return M.kernel_scorer(train, binary, C, cfg.get("gamma"), int(cfg.get("landmarks", 50)))
    else:
        raise ValueError(f"no such model type: {mt}")
    return lambda df: M.score(m, df, binary=binary)


def evaluate_trials(data: DataFrame, feats: Sequence[str], configs: Sequence[dict], spec: T.TaskSpec,
                    sensitive: str | None = None, fairness_metric: str = "demographic_parity_difference") -> tuple[DataFrame, DataFrame]:
    """H5: returns ``(trial_log, predictions)``. ``configs`` are dicts with
    ``model_type`` (SVClinear, SVC, Perceptron, MLPClassifier,
    LogisticRegression) and its params. The value is the validation F1 (macro
    when K > 2); for binary trials of models that give probabilities it is the F1
    after the threshold tuning of H6, and ``untuned_value`` the one before. With ``sensitive`` the log also
    has the validation ``disparity`` of each trial."""
    binary = spec.kind == "binary"
    df = M.to_ml_label(M.assemble(data, feats), "y", binary=binary)
    train = df.where(F.col("split") == "train")
    has_val = df.where(F.col("split") == "val").limit(1).count() > 0
    val_name = "val" if has_val else "test"
    preds, log, last_err = [], [], None
    for i, cfg in enumerate(configs):
        t0 = time.time()
        try:
            mt = cfg["model_type"]
            p = fit_config(cfg, train, feats, spec)(df.where(F.col("split").isin(val_name, "test")))
            # a cut is tuned on probabilities only: margins have no 0.05 … 0.95 scale
            score = F.col("score") if "proba" in p.columns else F.lit(None).cast("double")
            keep = ["row_id", "split", "y", "y_pred"] + ([sensitive] if sensitive else [])
            preds.append(p.withColumn("score", score if binary else F.lit(None).cast("double")).select(*keep, "score").withColumn("trial", F.lit(i)))
            log.append((i, mt, "COMPLETE", None, time.time() - t0))
        except Exception as e:  # a failing trial is recorded and the study goes on
            last_err = f"{type(e).__name__}: {e}"
            log.append((i, cfg.get("model_type"), "FAIL", last_err, time.time() - t0))
    if not preds:
        raise RuntimeError(f"All trials failed; last error: {last_err}")
    allp = preds[0]
    for p in preds[1:]:
        allp = allp.unionByName(p, allowMissingColumns=True)
    spark = data.sparkSession
    logdf = spark.createDataFrame(log, "trial int, model_type string, state string, error string, seconds double")
    avg = "binary" if binary else "macro"
    v = allp.where(F.col("split") == val_name).withColumnRenamed("y", "y_true")
    te = allp.where(F.col("split") == "test").withColumnRenamed("y", "y_true")
    vf = Q.precision_recall_f1(v, ["trial"], avg).select("trial", F.col("f1").alias("value"))
    tf = Q.precision_recall_f1(te, ["trial"], avg).select("trial", F.col("f1").alias("test_f1"))
    ta = Q.accuracy(te, ["trial"]).withColumnRenamed("accuracy", "test_accuracy")
    out = logdf.join(vf, "trial", "left").join(tf, "trial", "left").join(ta, "trial", "left")
    if binary:
        th = H.tune_threshold(v.where("score IS NOT NULL"), ["trial"]).select("trial", "best_threshold", "adopted", "best_f1")
        out = out.join(th, "trial", "left").withColumn("untuned_value", F.col("value")).withColumn(
            "value", F.when(F.col("adopted"), F.col("best_f1")).otherwise(F.col("value"))).drop("best_f1")
        # test F1 with the tuned cut applied (only where it was adopted); ≤ trials rows, broadcast
        cut = F.broadcast(th.where("adopted").select("trial", "best_threshold"))
        tt = te.join(cut, "trial").withColumn("y_pred", F.when(F.col("score") >= F.col("best_threshold"), 1).otherwise(-1))
        tfx = Q.precision_recall_f1(tt, ["trial"], "binary").select("trial", F.col("f1").alias("test_f1_thresholded"))
        out = out.join(tfx, "trial", "left")
    if sensitive:
        from equisel.operators.fairness import disparity

        out = out.join(disparity(v, fairness_metric, sensitive, ["trial"]), "trial", "left")
    return out, allp


def refit_trial(log: DataFrame, data: DataFrame, feats: Sequence[str], spec: T.TaskSpec, study, trial=None) -> DataFrame:
    """M9: take the parameters of the given trial (default: the study's best
    COMPLETE trial), refit that configuration on the train rows and score
    the test rows. An unknown trial number is an error."""
    from equisel.operators.trials import best_trial

    if trial is None:
        b = best_trial(log.where(F.col("study") == study)).first()
        if b is None:
            raise ValueError(f"study {study!r} has no completed trial")
        trial = b["trial"]
    row = log.where((F.col("study") == study) & (F.col("trial") == trial)).select("params").first()
    if row is None:
        raise ValueError(f"Trial {trial} not found in study {study!r}")
    cfg = dict(row["params"] or {})
    if "model_type" not in cfg:
        raise ValueError(f"Trial {trial} of study {study!r} names no model type")
    binary = spec.kind == "binary"
    df = M.to_ml_label(M.assemble(data, feats), "y", binary=binary)
    scored = fit_config(cfg, df.where(F.col("split") == "train"), feats, spec)
    return scored(df.where(F.col("split") == "test")).withColumn("trial", F.lit(trial))

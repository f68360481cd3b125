import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from equisel.operators import encode as E
from equisel.operators import hinge
from equisel.operators import split as X
from equisel.operators import train as M
from equisel.plans.evaluate import evaluate_trials, prepare


def _data(spark):
    rows = [(i, float(i % 13), float((i * 7) % 5), "a" if i % 3 else "b", "hi" if (i % 13) > 6 else "lo") for i in range(240)]
    return spark.createDataFrame(rows, "k long, f1 double, f2 double, cat string, target string")


def test_failed_trial_is_recorded_and_study_goes_on(spark):
    data, feats, spec = prepare(_data(spark), "k", "target", "ordinal")
    assert {r["split"] for r in data.select("split").distinct().collect()} == {"train", "val", "test"}
    log, preds = evaluate_trials(data, feats, [{"model_type": "LogisticRegression"}, {"model_type": "Bogus"}], spec)
    rows = {r["trial"]: r for r in log.collect()}
    assert rows[0]["state"] == "COMPLETE" and rows[0]["value"] is not None and rows[0]["value"] > 0.5
    assert rows[1]["state"] == "FAIL" and rows[1]["error"].startswith("ValueError: no such model type")
    with pytest.raises(RuntimeError, match="All trials failed"):
        evaluate_trials(data, feats, [{"model_type": "Bogus"}], spec)


def test_pca_projection_dims(spark):
    df = _data(spark).select("k", "f1", "f2").withColumn("y", F.lit(1))
    sp = X.stratified_split(df, "k", "y", 0.75, 42)
    out = E.pca_project(sp, ["f1", "f2"], 1)
    assert out.count() == 240 and {len(r["pca"]) for r in out.select("pca").collect()} == {1}


def test_normalise_loss_of_a_run_of_zeros(spark):
    rows = [(1, 0, 0, 0.0), (1, 0, 1, -0.0), (1, 0, 2, None), (1, 1, 0, 2.0), (1, 1, 1, -4.0), (2, 0, 0, None)]
    df = spark.createDataFrame(rows, "study long, trial long, step long, value double")
    got = {(r.study, r.trial, r.step): r.norm_loss for r in M.normalise_loss(df).collect()}
    assert math.isnan(got[1, 0, 0]) and math.isnan(got[1, 0, 1]) and got[1, 0, 2] is None
    assert (got[1, 1, 0], got[1, 1, 1], got[2, 0, 0]) == (0.5, -1.0, None) and len(got) == 6


def _three(spark, n, label):
    """``n`` rows with two features of 0 to 10 and a class by ``label``."""
    u = lambda seed: (F.xxhash64("row_id", F.lit(seed)) % 10007 + 10007) % 10007 / 10007.0
    df = spark.range(n).select(F.col("id").alias("row_id"), (u(1) * 10).alias("f1"), (u(2) * 10).alias("f2"), u(3).alias("u"))
    df = df.repartition(3, "row_id").select("row_id", "f1", "f2", label.cast("int").alias("y"))
    return M.to_ml_label(M.assemble(df, ["f1", "f2"]), "y", binary=False).localCheckpoint()


def test_one_vs_rest_passes_on_classes_without_a_line(spark):
    """Labels by chance: no line parts them, and the search for one ends in
    some passes for all classes, not in hundreds of jobs for each."""
    df = _three(spark, 60_000, F.floor(F.col("u") * 3))
    spark.sparkContext.setJobGroup("one against the rest", "")
    m = M.fit_one_vs_rest(df, C=1.0, parallelism=3)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("one against the rest"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 200
    for one in m.models:  # the least loss: every row counts as one of the rest
        assert abs(one.intercept + 1) < 0.01 and max(abs(one.coefficients.toArray())) < 0.01
    assert M.score(m, df, binary=False).count() == 60_000


def test_one_vs_rest_in_joint_passes_agrees_with_the_machines_of_spark(spark, monkeypatch):
    turn = F.col("f1") + F.col("f2") + 3 * F.col("u")
    df = _three(spark, 3_000, F.when(turn < 8, 0).when(turn < 15, 1).otherwise(2))
    small = M.fit_one_vs_rest(df)
    monkeypatch.setattr(hinge, "BLOCK", 512)
    monkeypatch.setattr(hinge, "TASK_BYTES", 20_000)
    joint = M.fit_one_vs_rest(df)
    monkeypatch.setattr(hinge, "MAX_SENT", 0)
    summed = M.fit_one_vs_rest(df)
    rows = df.select("f1", "f2", "y").toPandas()
    x, y = rows[["f1", "f2"]].to_numpy(), rows["y"].to_numpy()

    def loss(m, k):
        w, t = m.models[k].coefficients.toArray(), np.where(y == k, 1, -1)
        return np.maximum(0, 1 - t * (x @ w + m.models[k].intercept)).mean() + 0.5 / len(y) * ((w * x.std(axis=0, ddof=1)) ** 2).sum()

    for k in range(3):
        assert abs(loss(small, k) - loss(joint, k)) < 1e-4 and abs(loss(joint, k) - loss(summed, k)) < 1e-4
    labels = [[r.y_pred for r in M.score(m, df, binary=False).orderBy("row_id").select("y_pred").collect()] for m in (small, joint)]
    assert np.mean(np.array(labels[0]) == np.array(labels[1])) > 0.99
    wrong = M.assemble(df.drop("features").withColumn("f2", F.when(F.col("row_id") == 7, float("nan")).otherwise(F.col("f2"))), ["f1", "f2"])
    with pytest.raises(ValueError, match="not a finite number"):
        M.fit_one_vs_rest(wrong)

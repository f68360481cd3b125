"""NULL group keys are groups like any other; NULL labels and predictions are errors."""

import pytest
from pyspark.sql import functions as F

from equisel.functions.exprs import join_on
from equisel.functions.prefix import dense_position, running_agg, running_totals
from equisel.operators import fairness as B
from equisel.operators import metrics as Q
from equisel.operators import search as H
from equisel.operators import split as X
from equisel.operators import train as M


def test_positions_of_null_groups(spark):
    df = spark.createDataFrame([(None, 3), ("a", 1), (None, 1), ("a", 2), (None, 2)], "y string, k int")
    got = sorted([(str(r.y), r.k, r.pos) for r in dense_position(df, "k", by=["y"]).collect()])
    assert got == [("None", 1, 1), ("None", 2, 2), ("None", 3, 3), ("a", 1, 1), ("a", 2, 2)]
    two = df.withColumn("z", F.lit(None).cast("int"))
    assert sorted(r.cum_k for r in running_totals(two, "k", ["k"], by=["y", "z"]).collect()) == [1, 1, 3, 3, 6]
    assert sorted(r.run_k for r in running_agg(two, "k", ["k"], "max", by=["z", "y"]).collect()) == [1, 1, 2, 2, 3]
    assert dense_position(df, "k").columns == ["y", "k", "pos"]


@pytest.mark.parametrize("how,n", [("inner", 2), ("left", 3), ("full", 4), ("left_semi", 2), ("left_anti", 1)])
def test_join_on_null_keys(spark, how, n):
    a = spark.createDataFrame([(1, None, "x"), (1, "k", "y"), (2, "k", "z")], "i int, j string, a string")
    b = spark.createDataFrame([(1, None, "p"), (1, "k", "q"), (3, None, "r")], "i int, j string, b string")
    out = join_on(a, b, ["i", "j"], how)
    assert out.count() == n and out.columns[:2] == ["i", "j"]
    if how == "inner":
        assert sorted((r.a, r.b) for r in out.collect()) == [("x", "p"), ("y", "q")]
    if how == "full":
        assert {(r.i, r.j, r.b) for r in out.where("a IS NULL").collect()} == {(3, None, "r")}


def test_split_refuses_missing_labels(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(20)], "row_id int, y string")
    for make in (lambda d: X.stratified_split(d), lambda d: X.validation_split(d.withColumn("split", F.lit("train"))), lambda d: X.balanced_take(d, 4)):
        with pytest.raises(Exception, match="NULL in label column"):
            make(df).collect()
    assert X.stratified_split(df.fillna("b")).count() == 20


def test_downsampling_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(7)] + [("a", float(i)) for i in range(50)], "g string, x double")
    out = X.even_downsample(df, "x", ["g"], 10)
    assert out.where("g IS NULL").count() == 7 and out.where("g = 'a'").count() == 10


def predictions(spark):
    return spark.createDataFrame([(1, 1, "a"), (-1, None, "a"), (1, None, "b"), (-1, -1, "b")], "y_true int, y_pred int, sensitive string")


@pytest.mark.parametrize("rule", [
    lambda d: Q.accuracy(d), lambda d: Q.confusion_matrix(d), lambda d: Q.confusion_normalised(d), lambda d: Q.precision_recall_f1(d),
    lambda d: Q.precision_recall_f1(d, average="macro"), lambda d: Q.classification_report(d), lambda d: B.group_metrics(d),
    lambda d: B.overall_metrics(d), lambda d: B.disparities(d), lambda d: B.audit(d)])
@pytest.mark.parametrize("side", ["y_true", "y_pred"])
def test_missing_labels_and_predictions_are_errors(spark, rule, side):
    df = predictions(spark)
    df = df if side == "y_pred" else df.select(F.col("y_pred").alias("y_true"), F.col("y_true").alias("y_pred"), "sensitive")
    with pytest.raises(Exception, match="NULL in"):
        rule(df).collect()
    assert rule(df.fillna(1)).count() > 0


def test_report_names_rows_without_a_prediction(spark):
    df = predictions(spark).withColumn("score", F.lit(0.5) + F.col("y_true") / 4)
    r = {x["metric"]: x for x in Q.metric_report(df).collect()}
    assert all(r[m]["value"] is None and "2 rows have no prediction" in r[m]["error"] for m in ("accuracy", "f1", "mcc", "kappa"))
    assert r["roc_auc"]["value"] == 1.0 and r["roc_auc"]["error"] is None


def test_metrics_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 1, 1, 0.9), (None, -1, 1, 0.6), (None, -1, -1, 0.1), ("t", 1, 1, 0.8), ("t", -1, -1, 0.3)],
                               "trial string, y_true int, y_pred int, score double")
    pick = lambda d, c: {r.trial: r[c] for r in d.collect()}
    assert pick(Q.precision_recall_f1(df, ["trial"]), "precision") == {None: 0.5, "t": 1.0}
    assert pick(Q.curve_summary(df, ["trial"]), "auc") == {None: 1.0, "t": 1.0}
    assert Q.confusion_matrix(df, ["trial"]).where("trial IS NULL").agg(F.sum("n")).first()[0] == 3
    assert {r.trial for r in Q.metric_report(df, ["trial"]).collect()} == {None, "t"}
    best = {r.trial: r for r in H.tune_threshold(df, ["trial"]).collect()}
    assert best[None].best_f1 == 1.0 and best[None].adopted and abs(best[None].best_threshold - 0.65) < 1e-12
    assert not best["t"].adopted


def test_tuning_against_brute_force(spark):
    import random

    r = random.Random(8)
    rows = [(t, r.choice([1, -1]), r.choice([1, -1]), r.choice([0.0, 0.05, 0.15, 0.3, 0.55, 0.949999, 0.95, 1.0, r.random()])) for t in range(4) for _ in range(40)]
    df = spark.createDataFrame(rows, "trial int, y_true int, y_pred int, score double")

    def f1(pairs):
        tp = sum(t == 1 and p for t, p in pairs)
        wrong = sum((t == 1) != p for t, p in pairs)
        return 2 * tp / (2 * tp + wrong) if tp or wrong else 0.0

    for got in H.tune_threshold(df).collect():
        own = [x for x in rows if x[0] == got.trial]
        cuts = [(f1([(t, s >= k / 20) for _, t, _, s in own]), -k) for k in range(1, 20)]
        best, given = max(cuts), f1([(t, p == 1) for _, t, p, _ in own])
        assert abs(got.best_f1 - best[0]) < 1e-6 and abs(got.best_threshold + best[1] / 20) < 1e-12
        assert abs(got.base_f1 - given) < 1e-6 and got.adopted == (best[0] > given)
    with pytest.raises(Exception, match="NULL in score column"):
        H.tune_threshold(df.withColumn("score", F.when(F.col("trial") > 0, F.col("score")))).collect()


def test_convergence_of_a_run_without_a_name(spark):
    rows = [(None, 1, i, 1.0) for i in range(12)] + [("s", 1, i, 1.0) for i in range(12)]
    got = {r.study: r.converged_step for r in M.loss_convergence(spark.createDataFrame(rows, "study string, trial int, step int, value double"), 2).collect()}
    assert got == {None: 5, "s": 5}

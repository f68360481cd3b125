import numpy as np
import pytest

from equisel.operators import metrics as Q


def _df(spark, yt, yp, score=None):
    if score is None:
        return spark.createDataFrame(list(zip(map(int, yt), map(int, yp))), "y_true int, y_pred int")
    return spark.createDataFrame(list(zip(map(int, yt), map(int, yp), map(float, score))),
                                 "y_true int, y_pred int, score double")


def test_confusion_normalised(spark):
    # [[8, 2], [1, 9]] with labels 0/1
    yt = [0] * 10 + [1] * 10
    yp = [0] * 8 + [1] * 2 + [0] * 1 + [1] * 9
    cm = {(r["y_true"], r["y_pred"]): r["rate"] for r in Q.confusion_normalised(_df(spark, yt, yp)).collect()}
    assert cm == {(0, 0): 0.8, (0, 1): 0.2, (1, 0): 0.1, (1, 1): 0.9}


def test_confusion_zero_row(spark):
    # [[0, 0], [3, 7]]: label 0 only predicted, never true
    yt = [1] * 10
    yp = [0] * 3 + [1] * 7
    cm = {(r["y_true"], r["y_pred"]): (r["n"], r["rate"]) for r in Q.confusion_normalised(_df(spark, yt, yp)).collect()}
    assert cm[(0, 0)] == (0, 0.0) and cm[(0, 1)] == (0, 0.0)
    assert cm[(1, 0)] == (3, 0.3) and cm[(1, 1)] == (7, 0.7)


def _auc_bruteforce(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a != 1]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _ap_bruteforce(y, s):
    order = sorted(set(s), reverse=True)
    P = sum(1 for a in y if a == 1)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for a, b in zip(y, s) if b >= t and a == 1)
        fp = sum(1 for a, b in zip(y, s) if b >= t and a != 1)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


def test_auc_ap_match_bruteforce(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 200) * 2 - 1
    s = np.round(rng.uniform(size=200) * 0.6 + (y > 0) * 0.3, 2)  # ties on purpose
    df = _df(spark, y, y, s)
    auc = Q.roc_auc(df).first()["auc"]
    ap = Q.average_precision(df).first()["average_precision"]
    assert auc == pytest.approx(_auc_bruteforce(list(y), list(s)), abs=1e-6)
    assert ap == pytest.approx(_ap_bruteforce(list(y), list(s)), abs=1e-6)
    roc = Q.roc_curve(df).collect()
    assert (0.0, 0.0) in [(r["fpr"], r["tpr"]) for r in roc] and (1.0, 1.0) in [(r["fpr"], r["tpr"]) for r in roc]


def test_mcc_kappa_known(spark):
    yt = [1, 1, 1, 1, -1, -1, -1, -1]
    yp = [1, 1, 1, -1, -1, -1, -1, 1]
    df = _df(spark, yt, yp)
    assert Q.matthews_corrcoef(df).first()["mcc"] == pytest.approx(0.5)
    assert Q.cohens_kappa(df).first()["kappa"] == pytest.approx(0.5)
    # constant prediction → MCC undefined → 0
    assert Q.matthews_corrcoef(_df(spark, yt, [1] * 8)).first()["mcc"] == 0.0


def test_metric_report_isolates_failures(spark):
    # one class only: curve metrics cannot be computed, the others still are
    df = _df(spark, [1, 1, 1], [1, -1, 1], [0.9, 0.2, 0.8])
    rep = {r["metric"]: r for r in Q.metric_report(df).collect()}
    assert rep["accuracy"]["value"] == pytest.approx(2 / 3, abs=1e-6)
    assert rep["roc_auc"]["value"] is None and "one class" in rep["roc_auc"]["error"]


def test_macro_auc_null_when_class_absent(spark):
    rows = [(0, 0, [0.8, 0.1, 0.1]), (1, 1, [0.1, 0.8, 0.1]), (0, 1, [0.4, 0.5, 0.1]), (1, 0, [0.6, 0.3, 0.1])]
    df = spark.createDataFrame(rows, "y_true int, y_pred int, proba array<double>")
    assert Q.macro_ovr_auc(df, 3).first()["macro_auc"] is None
    per = {r["class_code"] for r in Q.ovr_auc(df, 3).collect()}
    assert per == {0, 1}

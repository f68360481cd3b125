import pytest
from pyspark.sql import functions as F

from equisel.operators import fairness as B
from equisel.operators import metrics as Q
from equisel.operators.split import stratified_split


def test_disparity_hand_values(spark):
    rows = [(1, 1, "a"), (1, 1, "a"), (-1, 1, "a"), (-1, -1, "a"),
            (1, 1, "b"), (1, -1, "b"), (-1, -1, "b"), (-1, -1, "b")]
    df = spark.createDataFrame(rows, "y_true int, y_pred int, sensitive string")
    d = B.disparities(df).first()
    assert d["demographic_parity_difference"] == pytest.approx(0.5)
    assert d["equal_opportunity_difference"] == pytest.approx(0.5)
    assert B.disparity(df, "disparate_impact").first()["disparity"] == pytest.approx(2 / 3, abs=1e-6)
    with pytest.raises(ValueError):
        B.disparity(df, "nope")


def test_parity_zero(spark):
    df = spark.createDataFrame([(1, 1, "a"), (-1, -1, "a"), (1, 1, "b"), (-1, -1, "b")],
                               "y_true int, y_pred int, sensitive string")
    d = B.disparities(df).first()
    assert d["demographic_parity_difference"] == 0 and d["equalized_odds_difference"] == 0


def test_favorable_multiclass(spark):
    df = spark.createDataFrame([(2, 2, "a"), (2, 2, "a"), (0, 0, "b"), (1, 1, "b")], "y_true int, y_pred int, sensitive string")
    assert B.disparities(df, favorable=2).first()["demographic_parity_difference"] == pytest.approx(1.0)


def test_audit_structure_and_overall(spark):
    from equisel.plans.audit import audit_report
    from tests.conftest import SF_SMALL

    a = audit_report(spark, SF_SMALL)
    sections = {r["section"] for r in a.select("section").distinct().collect()}
    assert sections == {"by_group", "overall", "disparities"}
    n = a.where((F.col("section") == "overall") & (F.col("metric") == "count")).first()["value"]
    tot = a.where((F.col("section") == "by_group") & (F.col("metric") == "count")).agg(F.sum("value")).first()[0]
    assert n == tot


def test_mitigation_equalises_on_fit_data(spark):
    from equisel.sources.views import predictions
    from tests.conftest import SF_SMALL

    p = predictions(spark, SF_SMALL)
    train = stratified_split(p, "row_id", "y_true", 0.75, 42).where(F.col("split") == "train")
    th = B.mitigate_thresholds(train, "sensitive", "equalized_odds")
    e = B.with_favorable_probability(train, th)
    for label in (1, -1):
        rates = [r[1] for r in e.where(F.col("y_true") == label).groupBy("sensitive").agg(F.avg("p_favorable")).collect()]
        assert max(rates) - min(rates) < 1e-9

from pyspark.sql import functions as F


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"section", "metric", "group", "value"}
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100


def test_window_stream_equals_batch(spark):
    from equisel.sources.views import reports
    from equisel.streaming import live as L
    from tests.conftest import SF_SMALL

    live = L.run_reports_per_window(spark, SF_SMALL)
    batch = reports(spark, SF_SMALL).groupBy(F.date_trunc("hour", "ts").alias("window_start")).count()
    j = live.join(batch, "window_start", "full")
    assert j.where(~F.col("n_reports").eqNullSafe(F.col("count"))).count() == 0


def test_metric_plans_stay_in_jvm(spark):
    from equisel.operators import metrics as Q
    from equisel.sources.views import predictions
    from tests.conftest import SF_SMALL

    p = predictions(spark, SF_SMALL)
    for df in (Q.roc_auc(p), Q.confusion_matrix(p), Q.precision_recall_f1(p)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PythonUDF" not in plan and "EvalPython" not in plan

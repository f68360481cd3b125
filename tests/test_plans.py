"""Plan checks: no window without a partition key reaches raw
scanned rows without an aggregate in between, and no Python UDF runs in
the metric / fairness / split plans."""

import pytest

from tests.conftest import SF_SMALL

AGGREGATES = ("HashAggregate", "ObjectHashAggregate", "SortAggregate")


def _children(node):
    kids = []
    try:
        it = node.children().iterator()
        while it.hasNext():
            kids.append(it.next())
    except Exception:
        pass
    name = node.nodeName()
    for attr in ("plan", "executedPlan", "child"):
        if name.endswith("QueryStage") or name.startswith("AdaptiveSparkPlan") or name == "InputAdapter":
            try:
                kids.append(getattr(node, attr)())
                break
            except Exception:
                continue
    return kids


def _reaches_scan_without_aggregate(node):
    name = node.nodeName()
    if any(name.startswith(a) for a in AGGREGATES):
        return False
    if "Scan" in name and ("parquet" in node.toString().lower() or "FileScan" in name or "Scan" == name[:4]):
        return True
    return any(_reaches_scan_without_aggregate(c) for c in _children(node))


def _global_windows_over_raw(plan):
    bad = []

    def walk(n):
        if n.nodeName() == "Window":
            try:
                empty = n.partitionSpec().isEmpty()
            except Exception:
                empty = False
            if empty and any(_reaches_scan_without_aggregate(c) for c in _children(n)):
                bad.append(n.toString()[:200])
        for c in _children(n):
            walk(c)

    walk(plan)
    return bad


def _final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan()


@pytest.mark.parametrize("name", [
    "q09_roc_curve", "q10_roc_auc_by_trial", "q17_metric_report_by_trial", "x01_stratified_split",
    "a02_pareto_front", "a03_optimisation_history", "a05_leaderboard_top10", "h12_asha_prune", "p06_describe_lineitem",
    "v08_beeswarm", "x07_even_downsample", "h06_tune_threshold", "b07_audit",
])
def test_no_global_window_over_raw_rows(spark, name):
    import __spark_entry__ as e

    df = e.queries()[name](spark, SF_SMALL)
    plan = _final_plan(df)
    assert _global_windows_over_raw(plan) == []
    s = plan.toString()
    assert "PythonUDF" not in s and "EvalPython" not in s


def test_detector_flags_a_global_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet").withColumn(
        "rn", F.row_number().over(Window.orderBy("o_orderkey")))
    assert _global_windows_over_raw(_final_plan(df)) != []

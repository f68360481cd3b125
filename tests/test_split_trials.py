import pytest
from pyspark.sql import functions as F

from equisel.operators import search as H
from equisel.operators import split as X
from equisel.operators import target as T
from equisel.operators import trials as A


def test_validation_split_sizes(spark):
    df = spark.createDataFrame([(i, i % 2, "train") for i in range(20)], "row_id long, y int, split string")
    out = X.validation_split(df, "row_id", "y", 0.2, 42)
    c = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert c == {"train": 16, "val": 4}
    assert X.validation_split(out, "row_id", "y").count() == 20  # idempotent
    tiny = spark.createDataFrame([(i, i % 2, "train") for i in range(6)], "row_id long, y int, split string")
    assert X.validation_split(tiny).where("split = 'val'").count() == 0  # validate on test instead


def test_validation_keeps_minority(spark):
    df = spark.createDataFrame([(i, 1 if i < 8 else 0, "train") for i in range(40)], "row_id long, y int, split string")
    v = X.validation_split(df).where("split = 'val'")
    assert {r["y"] for r in v.collect()} == {0, 1}


def test_stratified_split_exact(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(301)], "row_id long, y string")
    out = X.stratified_split(df, "row_id", "y", 0.75, 42)
    assert out.where("split = 'train'").count() == int(0.75 * 301)
    # a class with one row falls back to the plain split
    df2 = df.union(spark.createDataFrame([(999, "c")], "row_id long, y string"))
    assert X.stratified_split(df2).where("split = 'train'").count() == int(0.75 * 302)


def test_task_spec(spark):
    s = T.derive_task_spec(spark.createDataFrame([("c",), ("a",), ("b",), ("a",)], "y string"))
    assert s.class_labels == ["a", "b", "c"] and s.kind == "multiclass"
    with pytest.raises(ValueError):
        T.derive_task_spec(spark.createDataFrame([(i,) for i in range(21)], "y int"))
    with pytest.raises(ValueError):
        T.derive_task_spec(spark.createDataFrame([(1,), (1,)], "y int"))
    b = T.derive_task_spec(spark.createDataFrame([("g",), ("b",)], "y string"), label_mapping={"g": 1, "b": -1})
    assert b.class_labels == ["b", "g"]


def test_best_value_repaired(spark):
    log = spark.createDataFrame(
        [(1, 0, "COMPLETE", [0.5], 0.5), (1, 1, "COMPLETE", [0.9], 0.9), (1, 2, "COMPLETE", [0.2], 0.2)],
        "study long, trial long, state string, values array<double>, f1 double"
    ).withColumn("model_type", F.lit("SVC")).withColumn("params", F.create_map(F.lit("C"), F.lit("1")))
    runs = spark.createDataFrame([("job-1", 1, 0.2)], "job_id string, study long, best_value double")
    r = A.repair_best_value(runs, log).first()
    assert r["best_value"] == 0.9 and r["repaired"]


def test_threshold_tuning(spark):
    rows = [(i, 1 if i % 2 else -1, -1, 0.4 if i % 2 else 0.2) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, y_true int, y_pred int, score double").withColumn("trial", F.lit(0))
    t = H.tune_threshold(df).first()
    assert t["base_f1"] == 0.0 and t["best_f1"] == 1.0 and t["adopted"]
    assert 0.2 < t["best_threshold"] <= 0.4


def test_asha_survivors_bound(spark):
    import random

    random.seed(0)
    rows = [(1, t, s, random.random(), None) for t in range(30) for s in range(12)]
    rep = spark.createDataFrame(rows, "study long, trial long, step long, value double, ts timestamp")
    a = H.asha_prune(rep, 1, 3)
    for r in a.groupBy("rung").agg(F.count_if("kept").alias("k"), F.first("n").alias("n")).collect():
        assert r["k"] == max(1, r["n"] // 3)


def test_pareto_matches_bruteforce(spark):
    import random

    random.seed(3)
    pts = [(1, i, round(random.random(), 2), round(random.random(), 2)) for i in range(200)]
    log = spark.createDataFrame(pts, "study long, trial long, f1 double, disparity double").withColumn("state", F.lit("COMPLETE"))
    got = {r["trial"] for r in A.pareto_front(log).collect()}
    want = {i for (_, i, f, d) in pts if not any(
        (f2 >= f and d2 <= d and (f2 > f or d2 < d)) for (_, _, f2, d2) in pts)}
    assert got == want


def test_grid_dedupe_irrelevant(spark):
    space = {"C": [0.1, 1], "learning_rate": [0.01, 0.1]}
    full = H.grid(spark, ["SVClinear", "TreeTensorClassifier"], space)
    assert full.count() == 2 * 2 * 2
    d = H.grid(spark, ["SVClinear", "TreeTensorClassifier"], space, dedupe_irrelevant=True)
    # SVClinear uses C only (2 rows), TreeTensorClassifier learning_rate only (2 rows)
    assert d.count() == 4
    assert d.where("model_type = 'SVClinear' AND learning_rate IS NOT NULL").count() == 0

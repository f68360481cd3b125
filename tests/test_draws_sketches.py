"""Draws without positioning, several outputs explained at once, forest importance, stored sketches, mixed model kinds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from equisel.functions.exprs import hash32
from equisel.functions.prefix import dense_position
from equisel.operators import attribution as AT
from equisel.operators import generate as G
from equisel.operators import profile as P
from equisel.operators import split as X
from equisel.operators import trials as A


def positioned(df, batch, seed, key="row_id"):
    """The definition: every row gets its position, draws are joined to them."""
    n = df.count()
    draws = df.sparkSession.range(batch).select(F.col("id").alias("draw"), (hash32("id", seed) % n + 1).alias("__pos"))
    return dense_position(df, key, name="__pos").join(draws, "__pos").drop("__pos")


@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_draws_equal_positions(spark, buckets):
    r = random.Random(2)
    rows = [(i * 3 - 50 + r.randrange(2) * 10**6, r.choice("abc")) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, s string")
    got = X.minibatch(df, 40, 7, n_buckets=buckets)
    assert got.columns == ["row_id", "s", "draw"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, positioned(df, 40, 7).select("row_id", "s", "draw").collect()))
    many = X.minibatch(df, 2000, 3)
    assert many.count() == 2000 and many.select("draw").distinct().count() == 2000
    assert max(x["count"] for x in many.groupBy("row_id").count().collect()) > 1  # with replacement


def test_only_drawn_buckets_are_ranked(spark):
    df = spark.range(100_000).select(F.col("id").alias("row_id"))
    plan = X.minibatch(df, 5, 1, n_buckets=500)._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window [row_number()"):]
    assert "Join Inner" in window  # rows are cut to the drawn buckets below the ranking
    assert X.minibatch(df, 5, 1, n_buckets=500).count() == 5


def test_bootstrap_of_each_split(spark):
    rows = [(i, ["train", "val", "test"][i % 3] if i else None) for i in range(91)]
    df = spark.createDataFrame(rows, "row_id long, split string")
    got = X.bootstrap_rows(df, 25, 11)
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 25, "val": 25, "test": 25}
    for k, s in enumerate(["test", "train", "val"]):
        want = positioned(df.where(F.col("split") == s), 25, 11 + k)
        assert sorted(map(tuple, got.where(F.col("split") == s).select("row_id", "draw").collect())) == sorted(map(tuple, want.select("row_id", "draw").collect()))
    assert X.bootstrap_rows(df.limit(0), 5, 1).count() == 0 and X.minibatch(df.limit(0), 5, 1).count() == 0
    with pytest.raises(ValueError, match="more than 20 values"):
        X.bootstrap_rows(df.withColumn("split", F.col("row_id").cast("string")), 2, 1)


def test_shap_of_several_outputs(spark):
    r = np.random.default_rng(0)
    df = spark.createDataFrame([(i, [float(v) for v in r.normal(size=3)]) for i in range(20)], "k long, x array<double>")
    bg = spark.createDataFrame([([float(v) for v in r.normal(size=3)],) for _ in range(6)], "x array<double>")

    def model(x):
        z = [x[0] + 2 * x[1], x[1] * x[2], F.exp(x[0]) - x[2]]
        return F.array(*z)

    sh, base = AT.permutation_shap(df, "x", "k", model, bg, n_perm=3, n_outputs=3)
    assert "Exchange" not in sh._jdf.queryExecution().optimizedPlan().toString() and sh.count() == 20 * 9
    b = {x.class_code: x.base_value for x in base.collect()}
    out = {x.k: x.o for x in df.select("k", model(F.col("x")).alias("o")).collect()}
    for x in sh.groupBy("row_id", "class_code").agg(F.sum("value").alias("s")).collect():
        assert x.s == pytest.approx(out[x.row_id][x.class_code] - b[x.class_code], abs=1e-9)
    one, base1 = AT.permutation_shap(df, "x", "k", lambda x: model(x)[1], bg, n_perm=3)
    pick = lambda d: {(x.row_id, x.feature): x.value for x in d.collect()}
    alone, among = pick(one), pick(sh.where("class_code = 1"))
    assert all(alone[k] == pytest.approx(among[k], abs=1e-12) for k in alone) and base1.first().base_value == pytest.approx(b[1])


def _log(spark, rows):
    full = [(1, i, "COMPLETE", "SVC", [v], p) for i, (v, p) in enumerate(rows)]
    return spark.createDataFrame(full, "study long, trial long, state string, model_type string, values array<double>, params map<string,string>")


def test_forest_finds_the_dominant_parameter(spark):
    r = random.Random(4)
    gain = {"0.1": 0.1, "1": 0.6, "10": 0.9}
    rows = []
    for _ in range(150):
        p = {"C": r.choice(list(gain)), "learning_rate": r.choice(["0.001", "0.01"]), "n_layers": r.choice(["1", "5", "10"])}
        rows.append((gain[p["C"]] + (0.05 if p["learning_rate"] == "0.01" else 0) + r.gauss(0, 0.01), p))
    log = _log(spark, rows)
    got = {x.param: x for x in A.forest_importance(log, 1, ["C", "learning_rate", "n_layers"], n_trees=20).collect()}
    assert max(got, key=lambda p: got[p].importance) == "C" and got["C"].importance > 0.8 and got["C"].best_choice == "10"
    assert sum(x.importance for x in got.values()) == pytest.approx(1) and got["learning_rate"].importance > 0
    again = {x.param: x.importance for x in A.forest_importance(log.repartition(5), 1, ["C", "learning_rate", "n_layers"], n_trees=20).collect()}
    assert again == {p: x.importance for p, x in got.items()}
    assert A.forest_importance(log, 2, ["C", "n_layers"]).count() == 0 and A.forest_importance(log, 1, ["C"]).count() == 0


def test_merged_sketches(spark):
    r = random.Random(3)
    rows = [(i % 4, i % 1700, None if i % 10 == 0 else r.gauss(5, 2), f"s{i % 300}", float("nan") if i % 7 == 0 else 1.0) for i in range(20_000)]
    df = spark.createDataFrame(rows, "day int, k int, v double, s string, w double")
    daily = P.sketch_profile(df, by=["day"])
    assert daily.count() == 16 and "string" not in dict(daily.dtypes)["hll"]
    whole = {x.column: x for x in P.read_sketches(P.merge_sketches(daily), [0.1, 0.5, 0.9]).collect()}
    at_once = {x.column: x for x in P.read_sketches(P.sketch_profile(df.drop("day"))).collect()}
    values = sorted(x[2] for x in rows if x[2] is not None)
    for c, exact in (("k", 1700), ("s", 300), ("v", len(set(values)))):
        assert abs(whole[c].distinct - exact) <= 0.03 * exact and whole[c].n == at_once[c].n and whole[c].distinct == pytest.approx(at_once[c].distinct, rel=0.03)
    assert whole["v"].nulls == 2000 and whole["w"].nulls == len([x for x in rows if x[4] != x[4]]) and whole["s"].quantiles is None
    for p, q in zip((0.1, 0.5, 0.9), whole["v"].quantiles, strict=True):
        assert abs(sum(x <= q for x in values) / len(values) - p) < 0.015
    assert whole["v"].least == values[0] and whole["v"].greatest == values[-1]
    by = {(x.day, x.column): x for x in P.read_sketches(P.merge_sketches(daily, ["day"])).collect()}
    assert by[1, "s"].n == 5000 and by[0, "v"].quantiles is not None
    empty = {x.column: x for x in P.read_sketches(P.sketch_profile(df.limit(0))).collect()}
    assert empty["v"].n == 0 and empty["v"].distinct == 0 and empty["v"].quantiles is None


def test_models_with_and_without_probabilities_in_one_study(spark):
    from equisel.operators.target import TaskSpec
    from equisel.plans.evaluate import evaluate_trials

    r = random.Random(1)
    rows = [(i, r.gauss(0, 1), ["train", "train", "val", "test"][i % 4]) for i in range(160)]
    df = spark.createDataFrame(rows, "row_id long, a double, split string").withColumn("y", F.when(F.col("a") + 0.2 * F.sin("row_id") > 0, 1).otherwise(-1))
    log, preds = evaluate_trials(df, ["a"], [{"model_type": "Perceptron", "epochs": 2}, {"model_type": "SVClinear"}, {"model_type": "LogisticRegression"}],
                                 TaskSpec("binary", 2, ["-1", "1"], "1", 1))
    got = {x.model_type: x for x in log.collect()}
    assert all(x.state == "COMPLETE" and x.value > 0.5 for x in got.values())
    assert got["SVClinear"].best_threshold is None and got["LogisticRegression"].best_threshold is not None
    assert {x.trial: x.n for x in preds.groupBy("trial").agg(F.count("score").alias("n")).collect()} == {0: 0, 1: 0, 2: 80}


def test_a_section_that_fails_while_it_runs(spark):
    import json

    good = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    bad = good.withColumn("x", F.raise_error(F.concat(F.lit("no "), F.col("s"))).cast("int"))

    def unplanned():
        raise KeyError("plan")

    doc = json.loads(AT.evidence_bundle({"good": good, "bad": bad, "unplanned": unplanned, "more": lambda: good.where("n > 5")}).first()["bundle"])
    assert doc["good"] == [{"n": 1, "s": "a"}, {"n": 2, "s": "b"}] and doc["bad"] is None and doc["more"] == []
    said = {w["section"]: w["error"] for w in doc["warnings"]}
    assert set(said) == {"bad", "unplanned"} and "KeyError" in said["unplanned"] and "no " in said["bad"]


def test_separable_vectors_are_uniform_outside_the_margin(spark):
    """Further rounds and the corner draw against plain rejection."""
    r = np.random.default_rng(5)
    keys = spark.range(1500).withColumnRenamed("id", "k")
    for d, margin, attempts in ((2, 1.9, 2), (3, 0.9, 1), (2, 1.0, 1), (4, 1.8, 1)):
        got = np.array([x.x for x in G.gen_linearly_separable(keys, "k", d, margin, seed=2, attempts=attempts).collect()])
        x = r.uniform(-1, 1, size=(400_000, d))
        want = x[np.abs(x.sum(axis=1)) > margin]
        assert len(got) == 1500 and (np.abs(got.sum(axis=1)) > margin).all() and abs(len(want) / 400_000 - G.share_outside(d, margin)) < 0.01
        for stat in (lambda v: np.abs(v.sum(axis=1)), lambda v: v[:, 0] * np.sign(v.sum(axis=1)), lambda v: (v.sum(axis=1) > 0).astype(float)):
            a, b = stat(got), stat(want)
            assert abs(a.mean() - b.mean()) < 4 * b.std() * np.sqrt(1 / len(a) + 1 / len(b)) and abs(a.std() - b.std()) < 0.06
    with pytest.raises(ValueError, match="lies outside"):
        G.gen_linearly_separable(keys, "k", 30, 25.0)


def test_exact_counts_make_no_copy_of_rows_per_column(spark, tmp_path, monkeypatch):
    """Several distinct counts in one aggregate expand every row once per column."""
    from equisel.plans import catalog_prep

    rows = [(i % 40, i % 7, None if i % 9 == 0 else i % 5, i % 3, float(i % 11), i * 1.5, 0.01 * (i % 4), 0.0, "ANR"[i % 3], "FO"[i % 2], i) for i in range(300)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, at long").withColumn(
        "l_shipdate", F.timestamp_seconds("at").cast("timestamp_ntz")).drop("at").write.parquet(f"{tmp_path}/lineitem.parquet")
    plans, old = [], type(spark.range(1)).agg

    def agg(self, *exprs):
        plans.append(out := old(self, *exprs))
        return out

    monkeypatch.setattr(type(spark.range(1)), "agg", agg)
    got = {r["column"]: r for r in catalog_prep._sketches(spark, str(tmp_path)).collect()}
    assert plans and not any("Expand" in p._jdf.queryExecution().optimizedPlan().toString() for p in plans)
    assert (got["l_suppkey"].n, got["l_suppkey"].nulls, got["l_suppkey"].n_unique) == (266, 34, 5)
    assert got["l_shipdate"].n_unique == 300 and got["l_shipdate"].ranks_within_2_percent is None and len(got) == 10
    assert all(r.distinct_within_4_percent and r.ranks_within_2_percent is not False for r in got.values())

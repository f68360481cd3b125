"""Small inputs outside the fixtures: nulls, ties, infinities, many groups."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from equisel.functions.prefix import add_range_bucket, dense_position
from equisel.operators import clean as C
from equisel.operators import encode as E
from equisel.operators import fairness as B
from equisel.operators import generate as G
from equisel.operators import metrics as Q
from equisel.operators import search as H
from equisel.operators import target as T
from equisel.operators import train as M
from equisel.operators import trials as A
from equisel.sources import stores as S


def test_audit_refuses_more_than_twenty_groups(spark):
    rows = [(g, 1 if i % 2 else -1, 1) for g in range(25) for i in range(4)]
    df = spark.createDataFrame(rows, "sensitive int, y_true int, y_pred int")
    with pytest.raises(Exception, match="more than 20 groups"):
        B.audit(df).collect()
    assert B.audit(df.where("sensitive < 20")).count() > 0


def _scores(spark, rows):
    return spark.createDataFrame(rows, "y_true int, y_pred int, score double")


def test_report_counts_rows_without_a_score(spark):
    df = _scores(spark, [(1, 1, 0.9), (-1, -1, 0.1), (1, -1, None), (-1, 1, None)])
    r = {x["metric"]: x for x in Q.metric_report(df).collect()}
    assert r["accuracy"]["value"] == 0.5
    for m in ("log_loss", "roc_auc", "average_precision"):
        assert r[m]["value"] is None and "2 rows have no score" in r[m]["error"]
    for f in (Q.roc_curve, Q.roc_auc, Q.pr_curve, Q.average_precision):
        with pytest.raises(Exception, match="NULL in score column"):
            f(df).collect()
    with pytest.raises(Exception, match="NULL in score column"):
        H.tune_threshold(df.withColumn("trial", F.lit(0))).collect()


def test_downsampling_takes_the_start_of_a_curve(spark):
    df = _scores(spark, [(1 if i % 3 else -1, 1, i / 5) for i in range(5)])
    curve = Q.roc_curve(df)
    got = Q.downsample_curve(curve, "threshold", max_points=3, descending=True).collect()
    assert len(got) == 3 and max(r["threshold"] for r in got) == math.inf


def test_labels_and_class_codes_are_never_lost(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "y string")
    with pytest.raises(ValueError, match="without a label"):
        T.derive_task_spec(df)
    spec = T.derive_task_spec(df.dropna(), label_mapping={"neg": "b", "pos": "a"})
    assert spec.class_labels == ["b", "a"]
    with pytest.raises(Exception, match="neither of the two labels"):
        T.encode_binary(df, spec).collect()
    probs = spark.createDataFrame([(0, [0.5, 0.5]), (3, [0.5, 0.5])], "y_true int, proba array<double>")
    with pytest.raises(Exception, match="class code outside"):
        Q.ovr_auc(probs, 2).collect()
    many = spark.range(30).select(F.col("id").cast("int").alias("y_true"), F.col("id").cast("int").alias("y_pred"))
    with pytest.raises(ValueError, match="more than 20 labels"):
        Q.confusion_matrix(many)


def test_nan_counts_as_missing_in_scaling(spark):
    df = spark.createDataFrame([(1.0, "train"), (3.0, "train"), (float("nan"), "train")], "v double, split string")
    assert sorted(x[0] for x in E.zscore(df, ["v"]).select("v").dropna().collect()) == [-1.0, 1.0]
    assert sorted(x[0] for x in E.minmax_scale(df, ["v"], 0, 1).select("v").dropna().collect()) == [0.0, 1.0]
    assert sorted(x[0] for x in C.minmax_normalise(df, ["v"]).select("v").dropna().collect()) == [0.0, 1.0]


def test_every_key_gets_a_separable_vector(spark):
    got = G.gen_linearly_separable(spark.range(50).withColumnRenamed("id", "k"), "k", 4, 3.5, seed=1).collect()
    assert len(got) == 50
    for r in got:
        assert abs(sum(r["x"])) > 3.5 and all(-1 <= v <= 1 for v in r["x"]) and r["y"] == (-1 if sum(r["x"]) > 0 else 1)


def test_tied_values_are_spread_and_keep_their_order(spark):
    n = 20_000
    df = spark.range(n).select(F.when(F.col("id") % 10 == 0, F.col("id") / 7).otherwise(5.0).alias("v"), F.col("id").alias("k"))
    sizes = [r["count"] for r in add_range_bucket(df, ["v", "k"], 8).groupBy("__bucket").count().collect()]
    assert max(sizes) <= 2 * n / 8
    for down in (False, True):
        got = dense_position(df, ["v", "k"], descending=down, n_buckets=8).orderBy("pos").select("v", "k", "pos").collect()
        assert [r["pos"] for r in got] == list(range(1, n + 1))
        assert [(r["v"], r["k"]) for r in got] == sorted(((r["v"], r["k"]) for r in got), reverse=down)


@pytest.mark.parametrize("offset", [0.0, 1e4, 1e6])
def test_convergence_is_exact_at_any_offset(spark, offset):
    r, w = random.Random(4), 20
    values = [offset + 1 / (1 + i / 50) + r.gauss(0, 0.01) for i in range(9000)]
    want = next(s for s in range(2 * w + 1, len(values))
                if abs(np.mean(values[s - w + 1 : s + 1]) - np.mean(values[s - 2 * w + 1 : s - w + 1]))
                <= np.std(values[s - w + 1 : s + 1]) / math.sqrt(w) / 2)
    df = spark.createDataFrame([(1, 1, i, v) for i, v in enumerate(values)], "study long, trial long, step long, value double")
    assert M.loss_convergence(df.repartition(4), w).first()["converged_step"] == want


def test_halving_ranks_survivors_only(spark):
    # the best at the first rung are not those at the second
    rows = [(1, t, s, float(t if s <= 1 else -t)) for t in range(9) for s in range(10)]
    df = spark.createDataFrame(rows, "study long, trial long, step long, value double")
    got = H.asha_prune(df, 1, 3).collect()
    kept = {r: sorted(x["trial"] for x in got if x["rung"] == r and x["kept"]) for r in (0, 1)}
    assert kept[0] == [6, 7, 8] and kept[1] == [6]
    assert sorted(x["trial"] for x in got if x["rung"] == 1) == [6, 7, 8]


def test_unseen_choice_is_smoothed(spark):
    log = spark.createDataFrame([(1, t, "COMPLETE", float(t), {"C": "a" if t < 4 else "b"}) for t in range(8)],
                                "study long, trial long, state string, f1 double, params map<string,string>")
    cands = spark.createDataFrame([(1, 10, {"C": "a"}), (1, 11, {"C": "b"}), (1, 12, {"C": "z"})], "study long, cand_id long, params map<string,string>")
    got = {r["cand_id"]: r["score"] for r in H.tpe_rank(log, cands, ["C"]).collect()}
    k, good, bad = 3, 2, 6
    assert got[12] == pytest.approx(math.log(1 / (good + k)) - math.log(1 / (bad + k)), abs=1e-6)
    assert got[11] == pytest.approx(math.log(3 / (good + k)) - math.log(3 / (bad + k)), abs=1e-6)


def test_tpe_rank_counts_each_log_once(spark):
    log = spark.createDataFrame([(g, t, "COMPLETE", float(t % 3), {"C": "a" if t % 2 else "b"}) for g in (1, 2) for t in range(5 * g)],
                                "study long, trial long, state string, f1 double, params map<string,string>")
    cands = spark.createDataFrame([(g, i, {"C": c}) for g in (1, 2, 3) for i, c in enumerate("abz")], "study long, cand_id long, params map<string,string>")
    out = H.tpe_rank(log, cands, ["C"])
    want = {}
    for g in (1, 2):
        best = sorted(range(5 * g), key=lambda t: (-(t % 3), t))
        good = math.ceil(len(best) * 0.25)
        part = {True: best[:good], False: best[good:]}
        f = lambda c, k: math.log((sum(("a" if t % 2 else "b") == c for t in part[k]) + 1) / (len(part[k]) + 3))
        want.update({(g, i): f(c, True) - f(c, False) for i, c in enumerate("abz")})
    want.update({(3, i): 0.0 for i in range(3)})  # no finished trial
    got = {(r["study"], r["cand_id"]): r["score"] for r in out.collect()}
    assert got == pytest.approx(want, abs=1e-6)
    # the ranks read the written scores: the logs are in the plan no more
    assert "LogicalRDD" in out._jdf.queryExecution().analyzed().toString() and "params" not in out._jdf.queryExecution().analyzed().toString()


def test_resume_compares_kept_lists(spark):
    old = H.stored_space(spark, {"C": [0.1, 1, 10], "w": [None, "balanced"], "gone": [1]}, ["SVC"])
    same = H.stored_space(spark, {"C": [0.1, 1, 10], "w": [None, "balanced"]}, ["SVC"])
    assert H.check_resume(old, same).count() == 0
    other = H.stored_space(spark, {"C": [10, 1, 0.1], "w": [None, "balanced"]}, ["SVC", "MLP"])
    assert [r["param"] for r in H.check_resume(old, other).collect()] == ["C", "model_type"]


def _biased(spark, n=600):
    r = random.Random(2)
    rows = []
    for i in range(n):
        g = "abc"[i % 3]
        y = 1 if r.random() < (0.3, 0.5, 0.7)[i % 3] else -1
        rows.append((i, g, y, round(min(1.0, max(0.0, r.gauss(0.5 + 0.2 * y + 0.1 * (i % 3), 0.2))), 2)))
    return spark.createDataFrame(rows, "row_id long, sensitive string, y_true int, score double")


@pytest.mark.parametrize("constraint", ["equalized_odds", "demographic_parity"])
def test_mitigation_equalises_expected_rates(spark, constraint):
    df = _biased(spark)
    th = B.mitigate_thresholds(df, constraint=constraint)
    p = B.with_favorable_probability(df, th)
    t = F.col("y_true") == 1
    rates = p.groupBy("sensitive").agg(F.avg(F.when(t, F.col("p_favorable"))).alias("tpr"), F.avg(F.when(~t, F.col("p_favorable"))).alias("fpr"),
                                       F.avg("p_favorable").alias("sel")).collect()
    for c in ("tpr", "fpr") if constraint == "equalized_odds" else ("sel",):
        assert max(r[c] for r in rates) - min(r[c] for r in rates) < 1e-9
    drawn = B.apply_group_thresholds(df, th)
    assert drawn.count() == df.count()
    d = B.disparities(drawn).first()
    assert d["equalized_odds_difference" if constraint == "equalized_odds" else "demographic_parity_difference"] < 0.2


def test_mitigation_names_degenerate_and_unknown_groups(spark):
    df = _biased(spark)
    one = df.withColumn("y_true", F.when(F.col("sensitive") == "a", 1).otherwise(F.col("y_true")))
    with pytest.raises(ValueError, match="both classes in every group"):
        B.mitigate_thresholds(one)
    flat = df.withColumn("score", F.when(F.col("sensitive") == "a", 0.5).otherwise(F.col("score")))
    th = B.mitigate_thresholds(flat)
    assert th.count() == 3
    with pytest.raises(Exception, match="no thresholds for group z"):
        B.apply_group_thresholds(df.withColumn("sensitive", F.lit("z")), th).collect()


def test_cascade_follows_the_snapshot_id(spark):
    runs = spark.createDataFrame([(1,)], "optimization_id long")
    snaps = spark.createDataFrame([(1, "s1"), (2, "s2")], "optimization_id long, snapshot_id string")
    jobs = spark.createDataFrame([("s1", "j1"), ("s2", "j2")], "snapshot_id string, job_id string")
    logs = spark.createDataFrame([("j1", 1), ("j2", 2)], "job_id string, n int")
    left = S.delete_for_run({"snapshots": snaps, "jobs": jobs, "logs": logs}, runs,
                            via={"jobs": ("snapshots", "snapshot_id"), "logs": ("jobs", "job_id")})
    assert [tuple(r) for n in ("snapshots", "jobs", "logs") for r in left[n].collect()] == [(2, "s2"), ("s2", "j2"), ("j2", 2)]
    with pytest.raises(ValueError, match="no way to one"):
        S.delete_for_run({"logs": logs}, runs)


def test_finished_jobs_are_completed(spark):
    jobs = spark.createDataFrame([(1, "k", "running"), (1, "l", "running"), (2, "k", "failed")], "optimization_id long, config_key string, status string")
    done = spark.createDataFrame([(1, "k"), (2, "k")], "optimization_id long, config_key string")
    got = {(r[0], r[1]): r[2] for r in S.complete_jobs(jobs, done).collect()}
    assert got == {(1, "k"): "completed", (1, "l"): "running", (2, "k"): "failed"}


def test_three_class_models_and_unknown_type(spark):
    from equisel.plans.evaluate import evaluate_trials, refit_trial

    r = random.Random(1)
    rows = [(i, float(i % 3) + r.gauss(0, 0.2), float((i % 3) == 1) + r.gauss(0, 0.2), i % 3, ("train", "train", "val", "test")[i // 3 % 4]) for i in range(240)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, y int, split string")
    spec = T.TaskSpec("multiclass", 3, ["0", "1", "2"])
    log, preds = evaluate_trials(df, ["a", "b"], [{"model_type": m} for m in ("SVClinear", "Perceptron", "SVC", "LogisticRegression", "None")], spec)
    got = {x["model_type"]: x for x in log.collect()}
    assert got["None"]["state"] == "FAIL" and "no such model type" in got["None"]["error"]
    for m in ("SVClinear", "Perceptron", "SVC", "LogisticRegression"):
        assert got[m]["state"] == "COMPLETE" and got[m]["value"] > 0.5
    stored = spark.createDataFrame([(1, 0, "COMPLETE", {"model_type": "Tree"})], "study long, trial long, state string, params map<string,string>")
    with pytest.raises(ValueError, match="no such model type: Tree"):
        refit_trial(stored, df, ["a", "b"], spec, 1, 0)


def test_streams_replay_and_restart(spark, tmp_path):
    from equisel.streaming import live as L

    r, w = random.Random(6), 3
    rows = [(1, t, s, 1 / (1 + s) + r.gauss(0, 0.02)) for t in range(4) for s in range(30)]
    schema = "study long, trial long, step long, value double"
    whole = spark.createDataFrame(rows, schema)
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    mixed = rows[:]
    r.shuffle(mixed)  # reports of a trial arrive in any order, over two batches
    spark.createDataFrame(mixed[:50], schema).write.parquet(f"{src}/a")
    stream = lambda: spark.readStream.schema(whole.schema).option("recursiveFileLookup", "true").parquet(src)
    L.live_convergence(spark, stream(), w, folder=out)
    spark.createDataFrame(mixed[50:], schema).write.parquet(f"{src}/b")
    got = L.live_convergence(spark, stream(), w, folder=out)  # starts again where it stopped
    want = M.loss_convergence(whole, w)
    cols = ["study", "trial", "converged", "converged_step"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert {x["n_steps"] for x in got.collect()} == {30}
    asha = L.live_asha(spark, stream(), 1, 3, folder=f"{tmp_path}/asha")
    assert sorted(map(tuple, asha.collect())) == sorted(map(tuple, H.asha_prune(whole, 1, 3).select(asha.columns).collect()))


def test_upsert_with_several_records_for_a_key(spark):
    schema = "k int, v string, at int"
    store = spark.createDataFrame([(1, "old", 9), (2, "kept", 1)], schema)
    records = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (3, "new", 1)], schema)
    got = {r["k"]: r["v"] for r in S.upsert(store, records, "k", newest="at").collect()}
    assert got == {1: "b", 2: "kept", 3: "new"}
    one = {r["v"] for i in range(3) for r in S.upsert(store, records.repartition(i + 1), "k").where("k = 1").collect()}
    assert len(one) == 1


def test_merging_all_tables_of_a_store(spark):
    src = {"runs": spark.createDataFrame([(1, "db1"), (2, "db2")], "id int, db_name string"), "datasets": None,
           "jobs": spark.createDataFrame([(7, 1)], "job int, id int")}
    dst = {"runs": spark.createDataFrame([(2, "db2", "mine")], "id int, db_name string, study_storage_key string"),
           "datasets": spark.createDataFrame([(5,)], "id int"), "jobs": None}
    merged, counts = S.merge_all(src, dst, {"runs": "id", "datasets": "id", "jobs": "job", "snapshots": "id"})
    assert {r["id"]: r["study_storage_key"] for r in merged["runs"].collect()} == {1: "db1", 2: "mine"}
    assert {tuple(r) for r in counts.collect()} == {("runs", 1, 1), ("datasets", 0, 0), ("jobs", 1, 0)}
    assert set(merged) == {"runs", "datasets", "jobs"}


def test_reading_turns_nan_into_null(spark, tmp_path):
    from equisel.sources.tables import read_table

    spark.createDataFrame([(1.0, "a"), (float("nan"), "b")], "x double, y string").write.parquet(f"{tmp_path}/t.parquet")
    assert read_table(spark, f"{tmp_path}/t.parquet").where("x IS NULL").count() == 1


def test_several_patches_or_results_for_one_key(spark):
    store = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "job_id int, name string, n int")
    patches = spark.createDataFrame([(1, "old", 5), (1, "new", 9), (3, "none", 1), (1, "mid", 7)], "job_id int, name string, at int")
    assert sorted(map(tuple, S.patch(store, patches, "job_id", newest="at").collect())) == [(1, "new", 1), (2, "b", 2)]
    once = S.patch(store, patches.drop("at").repartition(3), "job_id").collect()
    assert len(once) == 2 and {r.name for r in once if r.job_id == 1} <= {"old", "new", "mid"}
    assert sorted(map(tuple, S.patch(store, patches.drop("at").coalesce(1).orderBy("name"), "job_id").collect())) == sorted(map(tuple, once))
    snaps = spark.createDataFrame([(1, "k", 0, None), (2, "k", 0, None)], "optimization_id int, config_key string, revision int, payload string")
    results = spark.createDataFrame([(1, "k", "p1"), (1, "k", "p2")], "optimization_id int, config_key string, payload string")
    got = {r.optimization_id: (r.revision, r.payload) for r in S.complete_snapshots(snaps, results).collect()}
    assert got[2] == (0, None) and got[1][0] == 1 and got[1][1] in ("p1", "p2") and len(got) == 2

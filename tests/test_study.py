"""Many configurations in one pass, and whole studies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from equisel.operators import fairness as B
from equisel.operators import many as N
from equisel.operators import train as M
from equisel.plans import study as S


def rows(spark, n=300, seed=1, classes=2, parts=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2))
    raw = x[:, 0] + 0.5 * x[:, 1] + 0.4 * r.normal(size=n)
    y = np.where(raw > 0, 1, -1) if classes == 2 else np.digitize(raw, [-0.5, 0.6])
    split = np.array(["train", "train", "train", "val", "test"])[np.arange(n) % 5]
    group = np.array(["g1", "g2"])[(x[:, 1] > 0.3).astype(int)]
    data = [(i, float(a), float(b), int(k), str(s), str(g)) for i, ((a, b), k, s, g) in enumerate(zip(x, y, split, group, strict=True))]
    df = spark.createDataFrame(data, "row_id long, a double, b double, y int, split string, grp string").repartition(parts)
    return df.withColumn("x", F.array("a", "b"))


def train_of(df):
    return df.where("split = 'train'")


class Passes(N.Study):
    """Counts the passes over the train rows."""

    passes = 0

    def _pass(self, units, spaces):
        self.passes += 1
        return super()._pass(units, spaces)


def test_fifty_configurations_in_the_passes_of_the_slowest(spark):
    df = rows(spark)
    study = Passes(train_of(df))
    configs = [{"model_type": m, "C": c, "class_weight": w, "epochs": 5} for m in ("SVClinear", "LogisticRegression", "Perceptron", "SVC")
               for c in (0.01, 0.1, 1, 10, 100, 1000) for w in (None, "balanced")] + [{"model_type": "SVClinear", "C": 3.0 + i} for i in range(2)]
    assert len(configs) == 50
    models, _ = study.fit(configs)
    together = study.passes
    assert all(m.state == "COMPLETE" for m in models) and all(m.converged for m in models if m.config["model_type"] != "Perceptron")
    study.passes = 0
    alone, _ = study.fit([configs[4]])
    assert together <= 3 * study.passes
    for i in (4, 13, 25, 40):
        one, _ = study.fit([configs[i]])
        for u, v in zip(one[0].units, models[i].units, strict=True):
            assert np.allclose(u.w, v.w, rtol=1e-9, atol=1e-9) and u.steps == v.steps


def test_machines_are_at_their_optimum(spark):
    df = train_of(rows(spark))
    got = df.select("x", "y").collect()
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got], dtype=float)
    models, _ = N.Study(df).fit([{"model_type": "SVClinear", "C": 0.5}, {"model_type": "LogisticRegression", "C": 0.5}, {"model_type": "SVClinear", "C": 0.5, "class_weight": "balanced"}])
    phi = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    weight = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    for m, s in zip(models, (1.0, 1.0, weight), strict=True):
        w = m.units[0].w
        t = y * (phi @ w)
        if m.config["model_type"] == "SVClinear":
            g = w - 2 * 0.5 * phi.T @ (s * y * np.maximum(0, 1 - t))
        else:
            g = w * [1, 1, 0] - 0.5 * phi.T @ (s * y / (1 + np.exp(t)))
        assert np.abs(g).max() < 1e-3 and m.converged


def test_perceptron_equals_the_single_fit(spark):
    df = train_of(rows(spark))
    models, _ = N.Study(df).fit([{"model_type": "Perceptron", "eta0": e, "epochs": k, "class_weight": w} for e, k, w in ((1.0, 7, None), (0.1, 3, "balanced"))])
    for m, (e, k, cw) in zip(models, ((1.0, 7, None), (0.1, 3, "balanced")), strict=True):
        w, b = M.fit_perceptron(df, "x", "y", e, k, cw)
        assert np.allclose(m.units[0].w, [*w, b])


def test_network_gradient(spark):
    r = np.random.default_rng(3)
    x, y = np.concatenate([r.normal(size=(20, 3)), np.ones((20, 1))], axis=1), r.integers(0, 3, 20).astype(float)
    u = N._units(0, {"model_type": "MLPClassifier", "hidden_layer_sizes": "(4, 3)"}, 4, 3, [0, 1, 2], 10)[0]
    total = u.partial(x, y, None)
    for i in r.integers(0, len(u.w), 12):
        old = u.w.copy()
        u.w = old.copy()
        u.w[i] += 1e-6
        up = u.partial(x, y, None)[0]
        u.w[i] -= 2e-6
        down = u.partial(x, y, None)[0]
        u.w = old
        assert abs((up - down) / 2e-6 - total[1 + i]) < 1e-4


def test_one_class_that_stops_early_is_not_converged(spark):
    df = train_of(rows(spark, classes=3))
    study = N.Study(df)
    full, _ = study.fit([{"model_type": "SVClinear", "C": 1.0}])
    assert len(full[0].units) == 3 and full[0].converged and all(u.converged for u in full[0].units)
    slowest = max(u.steps for u in full[0].units)
    assert min(u.steps for u in full[0].units) < slowest
    cut, _ = study.fit([{"model_type": "SVClinear", "C": 1.0}], limit=slowest - 1)
    assert any(u.converged for u in cut[0].units) and not cut[0].converged and cut[0].state == "COMPLETE"


def test_reports_are_scores_of_the_steps(spark):
    df = rows(spark)
    study = N.Study(train_of(df))
    val = df.where("split = 'val'")
    for metric in ("f1", "accuracy", "neg_loss"):
        models, reports = study.fit([{"model_type": "Perceptron", "eta0": 0.1, "epochs": 4}], validation=val, metric=metric)
        assert [r[1] for r in reports] == list(range(len(reports)))
        for _, index, step, value in reports:
            some, _ = study.fit([{"model_type": "Perceptron", "eta0": 0.1, "epochs": step}])
            look = study._looked(val)
            if metric != "neg_loss":
                label, _ = some[0].predict(N._mapped(look[0], ("linear",), study.marks), study.classes)
                tp = ((label == 1) & (look[1] == 1)).sum()
                want = (label == look[1]).mean() if metric == "accuracy" else 2 * tp / ((label == 1).sum() + (look[1] == 1).sum())
                assert value == pytest.approx(want)
            else:
                assert value == -some[0].units[0].losses[-1]
    with pytest.raises(ValueError, match="intermediate metric"):
        study.fit([{"model_type": "Perceptron"}], metric="auc")


def test_halving_prunes_and_keeps_the_rule():
    h = N.Halving(1, 2)
    assert h.keeps(0, 0, 0.1) and h.keeps(0, 1, 0.5)  # the first at a rung stays
    assert not h.keeps(1, 1, 0.4) and h.keeps(2, 1, 0.5)  # ties with the best stay
    assert h.keeps(3, 1, 0.45) is False and not h.keeps(4, 1, float("nan"))
    assert h.keeps(0, 2, 0.2) and h.rung[0] == 2


CONFIGS = [{"model_type": "SVClinear", "C": 1}, {"model_type": "SVC", "C": 1, "gamma": "scale"}, {"model_type": "Perceptron", "eta0": 0.1},
           {"model_type": "MLPClassifier", "hidden_layer_sizes": "(10,)", "learning_rate": 0.1, "batch_size": 32}, {"model_type": "LogisticRegression"}]


@pytest.mark.parametrize("classes", [2, 3])
def test_a_study_of_all_models(spark, classes):
    df = rows(spark, classes=classes)
    log, preds, _ = S.run_study(df.drop("x"), ["a", "b"], configs=[*CONFIGS, {"model_type": "Tree"}, {"model_type": "SVClinear", "C": "wide"}])
    got = {r.trial: r for r in log.collect()}
    assert [got[i].state for i in range(7)] == ["COMPLETE"] * 5 + ["FAIL"] * 2
    assert "no such model type" in got[5].error and "ValueError" in got[6].error and got[5].value is None
    assert all(got[i].value > 0.6 for i in range(5)) and got[3].batch_size == 32
    assert preds.count() == 5 * df.where("split <> 'train'").count()
    by = {(r.trial, r.split): r for r in preds.groupBy("trial", "split").agg(F.avg((F.col("y") == F.col("y_pred")).cast("double")).alias("acc"), F.count("score").alias("n")).collect()}
    for i in range(5):
        assert got[i].accuracy == pytest.approx(by[i, "test"].acc, abs=1e-6)
        gives = CONFIGS[i]["model_type"] == "MLPClassifier" or CONFIGS[i]["model_type"] == "LogisticRegression" and classes == 2
        assert (by[i, "val"].n > 0) == gives
        if got[i].decision_threshold is not None:  # adopted only where strictly better, and only with probabilities
            assert classes == 2 and by[i, "val"].n and got[i].value > got[i].val_f1_unthresholded


def test_constrained_study(spark):
    df = rows(spark)
    args = dict(configs=CONFIGS, sensitive="grp", mode="constrained", metric="demographic_parity_difference")
    log, preds, _ = S.run_study(df.drop("x"), ["a", "b"], threshold=0.5, **args)
    want = {r.trial: r.disparity for r in B.disparity(preds.where("split = 'test'").withColumnRenamed("y", "y_true"), "demographic_parity_difference", "grp", ["trial"]).collect()}
    done = log.collect()
    for r in done:
        assert r.fairness_disparity == pytest.approx(want[r.trial]) and r.fairness_constraint == pytest.approx(want[r.trial] - 0.5) and r.feasible == (want[r.trial] <= 0.5)
    limit = sorted(want.values())[1]
    log, _, _ = S.run_study(df.drop("x"), ["a", "b"], threshold=limit, **args)
    best, rows_ = S.best_of(log, "constrained").first(), log.collect()
    assert best.feasible and best.value == max(r.value for r in rows_ if r.feasible)
    log, _, _ = S.run_study(df.drop("x"), ["a", "b"], threshold=-1.0, **args)
    best = S.best_of(log, "constrained").first()
    assert not best.feasible and best.fairness_disparity == min(r.fairness_disparity for r in log.collect())


def test_multi_objective_study_gives_the_pareto_set(spark):
    log, _, reports = S.run_study(rows(spark).drop("x"), ["a", "b"], n_trials=8, per_round=4, sensitive="grp", mode="multi_objective", pruner="asha", max_steps=8, seed=3)
    done = [r for r in log.collect() if r.state == "COMPLETE"]
    assert not any(r.pruned for r in done) and reports.count() > 0
    front = {r.trial for r in S.best_of(log, "multi_objective").collect()}
    worse = lambda a, b: b.value >= a.value and b.fairness_disparity <= a.fairness_disparity and (b.value, b.fairness_disparity) != (a.value, a.fairness_disparity)
    assert front == {a.trial for a in done if not any(worse(a, b) for b in done)}


def test_pruned_study_and_proposals(spark):
    df = rows(spark).drop("x")
    log, _, reports = S.run_study(df, ["a", "b"], n_trials=10, per_round=5, pruner="asha", intermediate="f1", eta=2, max_steps=12, seed=5)
    got = log.collect()
    assert len(got) == 10 and {r.state for r in got} == {"COMPLETE", "PRUNED"}
    for r in got:
        assert r.pruned == (r.state == "PRUNED") and (r.pruned_at_step is not None) == r.pruned and r.n_steps <= 12
    again, _, _ = S.run_study(df, ["a", "b"], n_trials=10, per_round=5, pruner="asha", intermediate="f1", eta=2, max_steps=12, seed=5)
    assert [r.params for r in again.orderBy("trial").collect()] == [r.params for r in log.orderBy("trial").collect()]


def test_standing_puts_feasible_trials_first():
    rows_ = [dict(trial=0, state="COMPLETE", value=0.9, feasible=False, fairness_constraint=0.2, fairness_disparity=0.3),
             dict(trial=1, state="COMPLETE", value=0.5, feasible=True, fairness_constraint=-0.1, fairness_disparity=0.0),
             dict(trial=2, state="COMPLETE", value=0.8, feasible=False, fairness_constraint=0.1, fairness_disparity=0.2), dict(trial=3, state="FAIL")]
    by = lambda mode: sorted(S.standing(rows_, mode), key=lambda t: -S.standing(rows_, mode)[t])
    assert by("constrained") == [1, 2, 0] and by("off") == [0, 2, 1] and set(S.standing(rows_, "multi_objective").values()) == {0.0}


def test_wrong_studies_are_refused(spark):
    df = rows(spark).drop("x")
    for kw, said in ((dict(mode="fair"), "fairness mode"), (dict(mode="constrained"), "sensitive"), (dict(mode="constrained", sensitive="grp", metric="x"), "no fairness metric"),
                     (dict(mode="constrained", sensitive="grp", sampler="random"), "sampler"), (dict(pruner="median"), "pruner")):
        with pytest.raises(ValueError, match=said):
            S.run_study(df, ["a", "b"], configs=CONFIGS[:1], **kw)
    with pytest.raises(RuntimeError, match="All trials failed.*no such model type"):
        S.run_study(df, ["a", "b"], configs=[{"model_type": "Tree"}])
    with pytest.raises(ValueError, match="one class"):
        S.run_study(df.withColumn("y", F.lit(1)), ["a", "b"], configs=CONFIGS[:1])
    with pytest.raises(Exception, match="not a finite number"):
        S.run_study(df.withColumn("a", F.lit(float("nan"))), ["a", "b"], configs=CONFIGS[:1])

"""H5: a whole search study: propose, train, prune, score, judge, log.

Trials go in rounds. A round's configurations are trained together, one pass
over the train rows per optimiser step for all of them
(:mod:`equisel.operators.many`), their predictions on the validation and test
rows are written once, and every metric is a grouped job over that table. The
log holds one row per trial; nothing but the log, the models' weights and the
report rows (≤ 128) reaches the driver.

Fairness modes, as in the reference's search:

* ``off``: the value is the validation F1 (binary, or macro for more classes);
* ``constrained``: each trial also gets ``fairness_constraint`` = disparity −
  threshold on the test rows; proposals learn from feasible trials first, and
  the best trial is the best feasible one (the least violation if none is);
* ``multi_objective``: values [F1, disparity]; proposals learn from the trials
  that the fewest others dominate; the result is the Pareto set. No pruning.

The F1 of a binary model that gives probabilities is taken at the best of 19
cuts (H6) if that is strictly better; models without probabilities keep their
own decision.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from equisel.operators import fairness as B
from equisel.operators import metrics as Q
from equisel.operators import search as H
from equisel.operators.many import Fitted, Halving, Study
from equisel.operators.search import DEFAULT_SEARCH_SPACE, MODEL_PARAMS
from equisel.session import materialise

MODES = ("off", "constrained", "multi_objective")
SAMPLERS = ("tpe", "random")
#: The models of the search that this library trains.
MODELS = ["SVC", "SVClinear", "MLPClassifier", "Perceptron"]
WORST = 1.0

LOG = ST.StructType([ST.StructField(n, t) for n, t in [
    ("study", ST.StringType()), ("trial", ST.IntegerType()), ("model_type", ST.StringType()), ("params", ST.MapType(ST.StringType(), ST.StringType())),
    ("state", ST.StringType()), ("error", ST.StringType()), ("value", ST.DoubleType()), ("val_f1_unthresholded", ST.DoubleType()),
    ("decision_threshold", ST.DoubleType()), ("f1_score", ST.DoubleType()), ("f1_score_thresholded", ST.DoubleType()), ("accuracy", ST.DoubleType()),
    ("score", ST.DoubleType()), ("fairness_disparity", ST.DoubleType()), ("fairness_metric", ST.StringType()), ("fairness_constraint", ST.DoubleType()),
    ("feasible", ST.BooleanType()), ("converged", ST.BooleanType()), ("pruned", ST.BooleanType()), ("pruned_at_step", ST.IntegerType()),
    ("n_steps", ST.IntegerType()), ("batch_size", ST.IntegerType()), ("training_time", ST.DoubleType())]])
REPORTS = "study string, trial long, report_idx long, step long, value double"


def _draw(key: str, n: int) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % n


def random_config(trial: str, models: Sequence[str], space: dict, seed: int) -> dict:
    """A uniform draw (H3's rule on the driver): a model, then its parameters."""
    model = models[_draw(f"{trial}:{seed}:model_type", len(models))]
    return {"model_type": model, **{p: vs[_draw(f"{trial}:{seed}:{p}", len(vs))] for p, vs in space.items() if p in MODEL_PARAMS.get(model, space)}}


def _text(cfg: dict) -> dict:
    return {k: v if k == "model_type" else json.dumps(v) for k, v in cfg.items()}


def standing(rows: Sequence[dict], mode: str) -> dict[int, float]:
    """What proposals rank finished trials by: the value; feasible trials
    before others, those by violation; or minus the number of trials that
    dominate a trial. ``rows`` is the log, as long as the study has trials."""
    done = [r for r in rows if r["state"] == "COMPLETE"]
    if mode == "constrained":
        return {r["trial"]: r["value"] if r["feasible"] else -1.0 - r["fairness_constraint"] for r in done}
    if mode == "multi_objective":
        points = [(r["value"], -r["fairness_disparity"]) for r in done]
        return {r["trial"]: -float(sum(q != p and q[0] >= p[0] and q[1] >= p[1] for q in points)) for r, p in zip(done, points, strict=True)}
    return {r["trial"]: r["value"] for r in done}


def propose(spark, study: str, rows: Sequence[dict], n: int, models: Sequence[str], space: dict, mode: str, seed: int, candidates: int = 24) -> list[dict]:
    """``n`` configurations: of n × ``candidates`` random draws those that H4
    ranks first, given how the finished trials stand; drawn ones while fewer
    than two trials are finished."""
    first = len(rows)
    stand = standing(rows, mode)
    if len(stand) < 2:
        return [random_config(f"{study}/{first + i}", models, space, seed) for i in range(n)]
    drawn = {}
    for i in range(n * candidates):
        cfg = random_config(f"{study}/{first}/{i}", models, space, seed)
        drawn.setdefault(json.dumps(_text(cfg), sort_keys=True), cfg)
    pool = list(drawn.values())
    log = spark.createDataFrame([(study, r["trial"], "COMPLETE", stand[r["trial"]], r["params"]) for r in rows if r["trial"] in stand],
                                "study string, trial int, state string, f1 double, params map<string,string>")
    cand = spark.createDataFrame([(study, i, _text(c)) for i, c in enumerate(pool)], "study string, cand_id int, params map<string,string>")
    ranked = H.tpe_rank(log, cand, ["model_type", *space]).orderBy("rank").limit(n).collect()
    return [pool[r["cand_id"]] for r in ranked]


def judge(preds: DataFrame, binary: bool, val: str, sensitive: str | None, metric: str, favorable=1) -> DataFrame:
    """One row per trial from its predictions: validation and test F1, test
    accuracy, the tuned cut where there are probabilities, and the disparity on
    the test rows. Nothing else is needed to recompute a log's values."""
    v = preds.where(F.col("split") == val).withColumnRenamed("y", "y_true")
    t = preds.where(F.col("split") == "test").withColumnRenamed("y", "y_true")
    average = "binary" if binary else "macro"
    pick = lambda d, a, b: d.select("trial", F.col(a).alias(b))
    out = pick(Q.precision_recall_f1(v, ["trial"], average), "f1", "val_f1")
    out = out.join(pick(Q.precision_recall_f1(t, ["trial"], average), "f1", "f1_score"), "trial", "left")
    out = out.join(pick(Q.accuracy(t, ["trial"]), "accuracy", "accuracy"), "trial", "left")
    if binary:
        cuts = H.tune_threshold(v.where("score IS NOT NULL"), ["trial"]).where("adopted").select("trial", "best_threshold", "best_f1")
        cuts = materialise(cuts)  # one row per trial with probabilities
        at = t.join(F.broadcast(cuts.select("trial", "best_threshold")), "trial").withColumn("y_pred", F.when(F.col("score") >= F.col("best_threshold"), 1).otherwise(-1))
        out = out.join(cuts, "trial", "left").join(pick(Q.precision_recall_f1(at, ["trial"]), "f1", "f1_thresholded"), "trial", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("best_threshold", "best_f1", "f1_thresholded")})
    if sensitive:
        out = out.join(B.disparity(t, metric, sensitive, ["trial"], favorable).select("trial", "disparity"), "trial", "left")
    return out


def _checked(mode: str, metric: str, sensitive, sampler: str, pruner: str) -> str:
    if mode not in MODES:
        raise ValueError(f"fairness mode {mode!r} is none of {', '.join(MODES)}")
    if sampler not in SAMPLERS:
        raise ValueError(f"sampler {sampler!r} is none of {', '.join(SAMPLERS)}")
    if pruner not in ("asha", "none"):
        raise ValueError(f"pruner {pruner!r} is none of asha, none")
    if mode == "off":
        return pruner
    if metric not in B.FAIRNESS_METRICS:
        raise ValueError(f"{metric!r} is no fairness metric of the search; choose from {', '.join(B.FAIRNESS_METRICS)}")
    if sensitive is None:
        raise ValueError(f"fairness mode {mode!r} needs a sensitive column")
    if mode == "constrained" and sampler != "tpe":
        raise ValueError("a constrained search needs the sampler that learns from constraints (tpe)")
    return "none" if mode == "multi_objective" else pruner


def run_study(data: DataFrame, feats: Sequence[str], n_trials: int = 12, configs: Sequence[dict] | None = None, study: str = "study",
              models: Sequence[str] = tuple(MODELS), space: dict | None = None, sampler: str = "tpe", seed: int = 0, per_round: int = 6,
              sensitive: str | None = None, mode: str = "off", metric: str = "demographic_parity_difference", threshold: float | None = None, favorable: int = 1,
              pruner: str = "none", intermediate: str = "neg_loss", interval: int = 1, min_resource: int = 1, eta: int = 3, max_steps: int = 60,
              key: str = "row_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (log, predictions, reports). ``data`` is :func:`prepare`'s table
    (row_id, features, y, split, and the ``sensitive`` column where a mode needs
    it). With ``configs`` these are the trials, in rounds; else ``n_trials`` are
    proposed. A trial that fails is logged with its error; if all do, that is
    an error."""
    pruner = _checked(mode, metric, sensitive, sampler, pruner)
    spark, space = data.sparkSession, space or DEFAULT_SEARCH_SPACE
    keep = [key, "split", "y", *([sensitive] if sensitive else [])]
    df = materialise(data.select(*keep, F.array(*(F.col(f"`{c}`").cast("double") for c in feats)).alias("x")).withColumnRenamed(key, "row_id"))
    keep[0] = "row_id"
    train, val = df.where(F.col("split") == "train"), "val"
    if df.where(F.col("split") == "val").isEmpty():
        val = "test"
    trainer = Study(train)
    binary = len(trainer.classes) == 2
    limit = (1.0 - (0.8 if threshold is None else threshold)) if metric == "disparate_impact" else (0.1 if threshold is None else threshold)
    halving = Halving(min_resource, eta) if pruner == "asha" else None
    rows: list[dict] = []
    reports: list[tuple] = []
    parts: list[DataFrame] = []
    total = len(configs) if configs is not None else n_trials
    while len(rows) < total:
        n = min(per_round, total - len(rows))
        if configs is not None:
            todo = [dict(c) for c in configs[len(rows) : len(rows) + n]]
        elif sampler == "tpe":
            todo = propose(spark, study, rows, n, models, space, mode, seed)
        else:
            todo = [random_config(f"{study}/{len(rows) + i}", models, space, seed) for i in range(n)]
        fitted, said = trainer.fit(todo, max_steps, len(rows), df.where(F.col("split") == val), intermediate, interval, halving)
        reports += [(study, *r) for r in said]
        judged = {}
        if any(m.state == "COMPLETE" for m in fitted):
            preds = materialise(trainer.score(df.where(F.col("split").isin(val, "test")), fitted, keep))
            parts.append(preds)
            judged = {r["trial"]: r.asDict() for r in judge(preds, binary, val, sensitive if mode != "off" else None, metric, favorable).collect()}  # one row per trial
        rows += [_logged(study, m, judged.get(m.trial), mode, metric, limit) for m in fitted]
    if not parts:
        raise RuntimeError(f"All trials failed; last error: {next((r['error'] for r in reversed(rows) if r['error']), 'all trials were pruned')}")
    preds = parts[0]
    for p in parts[1:]:
        preds = preds.unionByName(p)
    log = spark.createDataFrame([tuple(r[f] for f in LOG.names) for r in rows], LOG)
    return log, preds, spark.createDataFrame(reports, REPORTS)


def _logged(study: str, m: Fitted, j: dict | None, mode: str, metric: str, limit: float) -> dict:
    row = dict.fromkeys(LOG.names)
    cfg = m.config
    row |= {"study": study, "trial": m.trial, "model_type": cfg.get("model_type"), "params": _text(cfg), "state": m.state, "error": m.error,
            "pruned": m.state == "PRUNED", "pruned_at_step": m.pruned_at, "batch_size": int(cfg["batch_size"]) if "batch_size" in cfg else None}
    if m.state != "FAIL":
        row |= {"n_steps": m.n_steps, "training_time": m.seconds}
    if m.state != "COMPLETE" or j is None:
        return row
    row |= {"converged": m.converged, "f1_score": j["f1_score"], "accuracy": j["accuracy"], "score": j["accuracy"], "value": j["val_f1"]}
    if j["best_threshold"] is not None:
        row |= {"value": j["best_f1"], "val_f1_unthresholded": j["val_f1"], "decision_threshold": j["best_threshold"], "f1_score_thresholded": j["f1_thresholded"]}
    if mode != "off":
        disparity = WORST if j.get("disparity") is None else j["disparity"]
        row |= {"fairness_disparity": disparity, "fairness_metric": metric}
        if mode == "constrained":
            row |= {"fairness_constraint": round(disparity - limit, 12), "feasible": disparity <= limit}
    return row


def best_of(log: DataFrame, mode: str = "off") -> DataFrame:
    """The study's result: its best trial; the best feasible one, or the least
    violation where none is; or the Pareto set on (F1, disparity)."""
    done = log.where("state = 'COMPLETE'")
    if mode == "multi_objective":
        from equisel.operators.trials import pareto_front

        front = pareto_front(done.select("study", "trial", "state", F.col("value").alias("f1"), F.col("fairness_disparity").alias("disparity")))
        return done.join(front.select("study", "trial"), ["study", "trial"], "left_semi")
    rank = [F.col("value"), -F.col("trial")]
    if mode == "constrained":
        rank = [F.col("feasible"), F.when(F.col("feasible"), F.col("value")).otherwise(-F.col("fairness_constraint")), -F.col("trial")]
    order = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(rank)))
    rest = [c for c in done.columns if c != "study"]
    return done.groupBy("study").agg(F.max_by(F.struct(*rest), order).alias("b")).select("study", "b.*")


def refit(log: DataFrame, data: DataFrame, feats: Sequence[str], trial: int | None = None, max_steps: int = 60, key: str = "row_id") -> DataFrame:
    """M9: fit a trial's logged parameters again (default: the best trial) and
    score the test rows: the key, split, y, trial, y_pred and score."""
    row = (best_of(log) if trial is None else log.where(F.col("trial") == trial)).select("trial", "params").first()
    if row is None:
        raise ValueError("no completed trial" if trial is None else f"Trial {trial} not found")
    cfg = {k: v if k == "model_type" else json.loads(v) for k, v in row["params"].items()}
    df = materialise(data.select(key, "split", "y", F.array(*(F.col(f"`{c}`").cast("double") for c in feats)).alias("x")))
    study = Study(df.where(F.col("split") == "train"), key)
    models, _ = study.fit([cfg], max_steps, row["trial"])
    if models[0].state != "COMPLETE":
        raise ValueError(models[0].error)
    return study.score(df.where(F.col("split") == "test"), models, [key, "split", "y"])

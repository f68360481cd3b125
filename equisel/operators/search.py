"""Search space, trial evaluation helpers and pruning.

The search space and the model registry are tiny fixed tables; every
query joins them against the trial / report logs, so work grows with the
logs. ASHA / Hyperband are expressed as rung tables: report index
(bucketed position per trial), rung membership, rank per (study, rung).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equisel.functions.exprs import hash32, join_on, r6, refuse, safe_div
from equisel.functions.prefix import dense_position, sliding
from equisel.session import materialise

# Default search space (param → ordered choices) of the reference.
DEFAULT_SEARCH_SPACE: dict = {
    "max_vmap": [32],
    "batch_size": [32],
    "learning_rate": [0.001, 0.01, 0.1],
    "n_input_copies": [1, 2, 3],
    "n_layers": [1, 5, 10],
    "observable_type": ["single", "half", "full"],
    "repeats": [1, 5, 10],
    "C": [0.1, 1, 10, 100],
    "gamma_factor": [0.1, 1, 10],
    "trotter_steps": [1, 3, 5],
    "t": [0.01, 0.1, 1.0],
    "n_qfeatures": ["full", "half"],
    "n_episodes": [10, 100, 500, 2000],
    "visible_qubits": ["single", "half", "full"],
    "temperature": [1, 10, 100],
    "encoding_layers": [1, 3, 5, 10],
    "degree": [2, 3, 4],
    "n_qchannels": [1, 5, 10],
    "qkernel_shape": [2, 3],
    "kernel_shape": [2, 3, 5],
    "filter_name": ["edge_detect", "smooth", "sharpen"],
    "gamma": [0.001, 0.01, 0.1, 1],
    "alpha": [0.01, 0.001, 0.0001],
    "hidden_layer_sizes": ["(100,)", "(10, 10, 10, 10)", "(50, 10, 5)"],
    "eta0": [0.1, 1, 10],
    "class_weight": [None, "balanced"],
}

# Model registry (model_type → parameters it uses).
MODEL_PARAMS: dict = {
    "CircuitCentricClassifier": ["max_vmap", "batch_size", "learning_rate", "n_input_copies", "n_layers"],
    "DataReuploadingClassifier": ["max_vmap", "batch_size", "learning_rate", "n_layers", "observable_type"],
    "DataReuploadingClassifierSeparable": ["max_vmap", "batch_size", "learning_rate", "n_layers", "observable_type"],
    "DressedQuantumCircuitClassifier": ["max_vmap", "batch_size", "learning_rate", "n_layers"],
    "DressedQuantumCircuitClassifierSeparable": ["max_vmap", "batch_size", "learning_rate", "n_layers"],
    "IQPKernelClassifier": ["max_vmap", "repeats", "C"],
    "ProjectedQuantumKernel": ["max_vmap", "gamma_factor", "C", "trotter_steps", "t"],
    "QuantumKitchenSinks": ["max_vmap", "n_qfeatures", "n_episodes"],
    "QuantumMetricLearner": ["max_vmap", "batch_size", "learning_rate", "n_layers"],
    "QuantumBoltzmannMachine": ["max_vmap", "batch_size", "learning_rate", "visible_qubits", "temperature"],
    "QuantumBoltzmannMachineSeparable": ["max_vmap", "batch_size", "learning_rate", "visible_qubits", "temperature"],
    "TreeTensorClassifier": ["max_vmap", "batch_size", "learning_rate"],
    "QuanvolutionalNeuralNetwork": ["max_vmap", "batch_size", "learning_rate", "n_qchannels", "qkernel_shape",
                                    "kernel_shape"],
    "WeiNet": ["max_vmap", "batch_size", "learning_rate", "filter_name"],
    "SeparableVariationalClassifier": ["batch_size", "learning_rate", "encoding_layers"],
    "SeparableKernelClassifier": ["C", "encoding_layers"],
    "ConvolutionalNeuralNetwork": ["batch_size", "learning_rate", "kernel_shape"],
    "SVC": ["gamma", "C", "class_weight"],
    "SVClinear": ["C", "class_weight"],
    "MLPClassifier": ["batch_size", "hidden_layer_sizes", "alpha", "learning_rate"],
    "Perceptron": ["eta0", "class_weight"],
}

THRESHOLD_STEPS = 20  # cuts k/20 for k = 1..19


def choice_text(v) -> str:
    """Choices mix int / float / string / null: kept as JSON text."""
    return json.dumps(v)


def space_table(spark: SparkSession, space: dict | None = None) -> DataFrame:
    space = space or DEFAULT_SEARCH_SPACE
    rows = [(p, i, choice_text(v)) for p, vs in space.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "param string, choice_idx int, choice string")


def registry_table(spark: SparkSession, registry: dict | None = None) -> DataFrame:
    registry = registry or MODEL_PARAMS
    return spark.createDataFrame([(m, p) for m, ps in registry.items() for p in ps], "model_type string, param string")


def conditional_space(spark: SparkSession, models: Sequence[str], space: dict | None = None,
                      registry: dict | None = None) -> DataFrame:
    """H1: per model only its own params (an unknown model gets all params)."""
    sp = space_table(spark, space)
    reg = registry_table(spark, registry)
    m = spark.createDataFrame([(x,) for x in models], "model_type string")
    known = m.join(reg, "model_type")
    unknown = m.join(reg.select("model_type").distinct(), "model_type", "left_anti").crossJoin(sp.select("param").distinct())
    return known.unionByName(unknown).join(sp, "param").select("model_type", "param", "choice_idx", "choice")


def relevant_params(log: DataFrame, registry: dict | None = None) -> DataFrame:
    """H1 on a trial log: each trial's params restricted to those its model
    uses (join with the registry); unknown models keep every param."""
    spark = log.sparkSession
    reg = registry_table(spark, registry)
    long = log.select("study", "trial", "model_type", F.explode("params").alias("param", "choice")).where(
        F.col("param") != "model_type")
    known = F.broadcast(reg.select("model_type").distinct().withColumn("__known", F.lit(True)))
    j = long.join(known, "model_type", "left").join(F.broadcast(reg.withColumn("__rel", F.lit(True))),
                                                     ["model_type", "param"], "left")
    return j.where(F.col("__known").isNull() | F.col("__rel").isNotNull()).select("study", "trial", "model_type", "param",
                                                                                  "choice")


def grid(spark: SparkSession, models: Sequence[str], space: dict, dedupe_irrelevant: bool = False,
         registry: dict | None = None) -> DataFrame:
    """H2: flat Cartesian product of all params × models (successive
    cross joins of tiny tables; the size is the product of choice counts,
    redundant on purpose). ``dedupe_irrelevant`` blanks the params a model
    does not use and keeps one row per distinct relevant configuration."""
    g = spark.createDataFrame([(m,) for m in models], "model_type string")
    for p, vs in space.items():
        t = spark.createDataFrame([(choice_text(v),) for v in vs], f"`{p}` string")
        g = g.crossJoin(F.broadcast(t))
    if not dedupe_irrelevant:
        return g
    registry = registry or MODEL_PARAMS
    blanked = g.select("model_type", *[
        F.when(F.col("model_type").isin(*[m for m in models if p in registry.get(m, list(space))]), F.col(f"`{p}`"))
        .alias(p) for p in space])
    return blanked.dropDuplicates()


def random_space(keys: DataFrame, key: str, models: Sequence[str], space: dict, seed: int = 0,
                 registry: dict | None = None) -> DataFrame:
    """H3: one uniform draw per key row: a model, then each of its params
    (hash of (key, seed) per dimension, so redraws are reproducible)."""
    registry = registry or MODEL_PARAMS
    arr = F.array(*[F.lit(m) for m in models])
    out = keys.select(key).withColumn("model_type", F.element_at(arr, (hash32(key, seed) % len(models) + 1).cast("int")))
    for i, (p, vs) in enumerate(space.items()):
        choices = F.array(*[F.lit(choice_text(v)) for v in vs])
        users = [m for m in models if p in registry.get(m, list(space))]
        pick = F.element_at(choices, (hash32(key, seed * 1000 + i + 1) % len(vs) + 1).cast("int"))
        out = out.withColumn(p, F.when(F.col("model_type").isin(*users), pick) if users else F.lit(None).cast("string"))
    return out


def tpe_rank(log: DataFrame, candidates: DataFrame, params: Sequence[str], gamma: float = 0.25) -> DataFrame:
    """H4 (Bergstra et al. 2011, categorical form): finished trials split
    into good (top ceil(γ·n) by value, ties by trial) and bad; per param and
    choice the smoothed frequencies l = (n_good,c + 1)/(n_good + K) and
    g = (n_bad,c + 1)/(n_bad + K); a candidate scores Σ log(l/g). Returns
    candidates with ``score`` and ``rank`` per study."""
    done = log.where(F.col("state") == "COMPLETE").select("study", "trial", "f1", "params")
    pos = dense_position(done.withColumn("__neg", -F.col("f1")), ["__neg", "trial"], by=["study"], name="__pos")
    n = done.groupBy("study").agg(F.count(F.lit(1)).alias("__n"))
    # positions are dense, so a study has ceil(γ·n) good trials
    most = F.ceil(F.col("__n") * F.lit(gamma))
    lab = pos.join(n, "study").withColumn("good", F.col("__pos") <= most)
    long = lab.select("study", "good", F.explode("params").alias("param", "choice")).where(F.col("param").isin(*params))
    cnt = long.groupBy("study", "param", "choice").agg(F.count_if("good").alias("ng_c"), F.count_if(~F.col("good")).alias("nb_c"))
    cl = candidates.select("study", "cand_id", F.explode("params").alias("param", "choice")).where(F.col("param").isin(*params))
    # a choice that no finished trial has counts 0 in both groups and as one of the K choices;
    # one row per choice, written once: positions and logs are not computed again for each use
    cnt = materialise(cl.select("study", "param", "choice").distinct().join(cnt, ["study", "param", "choice"], "full").fillna(0, ["ng_c", "nb_c"]))
    k = cnt.groupBy("study", "param").agg(F.count(F.lit(1)).alias("K"))
    tot = n.select("study", F.least("__n", most).alias("ng"), (F.col("__n") - F.least("__n", most)).alias("nb"))
    dens = cnt.join(k, ["study", "param"]).join(tot, "study").select(
        "study", "param", "choice",
        (F.log((F.col("ng_c") + 1) / (F.col("ng") + F.col("K"))) - F.log((F.col("nb_c") + 1) / (F.col("nb") + F.col("K")))).alias("llr"))
    sc = materialise(cl.join(dens, ["study", "param", "choice"], "left").groupBy("study", "cand_id").agg(
        r6(F.sum(F.coalesce("llr", F.lit(0.0)))).alias("score")))
    # candidate ids are unique, so rank = position by (score desc, id); bucketed, not one window per study
    pos = dense_position(sc.withColumn("__neg", -F.col("score")), ["__neg", "cand_id"], by=["study"], name="rank")
    return pos.select("study", "cand_id", "score", F.col("rank").cast("int").alias("rank"))


def tune_threshold(preds: DataFrame, by: Sequence[str] = ("trial",), score: str = "score", y_true: str = "y_true",
                   y_pred: str = "y_pred", pos: int = 1) -> DataFrame:
    """H6: binary only. F1 at each cut k/20 (k = 1..19); the first best cut
    wins and is adopted only if strictly better than the F1 of the given
    predictions.

    No rows × cuts product and no join: each row falls in cut bucket b =
    number of cuts ≤ its score (exact comparison with the same k/20 doubles),
    one aggregate gives ≤ 40 rows per group, and the counts at cut k are
    conditional sums over them. A NULL score or prediction is an error."""
    from equisel.operators.metrics import lacking

    by = list(by)
    steps = THRESHOLD_STEPS
    t_ = F.col(y_true) == pos
    s_ = F.col(score)
    b0 = F.least(F.greatest(F.floor(s_ * steps), F.lit(0)), F.lit(steps - 1)).cast("int")
    cut = lambda k: k.cast("double") / F.lit(float(steps))
    b1 = F.when((b0 > 0) & (s_ < cut(b0)), b0 - 1).when((b0 < steps - 1) & (s_ >= cut(b0 + 1)), b0 + 1).otherwise(b0)
    # the one raw pass: (group, cut bucket, given prediction) → positives / negatives
    raw = preds.groupBy(*by, F.when(s_.isNotNull(), b1).alias("b"), (F.col(y_pred) == pos).alias("hit")).agg(F.count_if(t_).alias("p"), F.count_if(~t_).alias("n"))
    raw = refuse(raw, F.col("b").isNull(), f"NULL in score column {score!r}")
    raw = refuse(raw, F.col("hit").isNull(), lacking(y_pred))
    # ≤ 2 · steps rows per group become one: the counts of the given prediction and, per cut, of the buckets from it on
    at = [F.col("b") >= k for k in range(1, steps)]
    sums = raw.groupBy(*by).agg(
        F.sum(F.when(F.col("hit"), F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum("p").alias("P"), *(F.sum(F.when(c, F.col(x)).otherwise(0)).alias(f"{x}{k}") for k, c in enumerate(at, 1) for x in ("p", "n")))
    f1 = lambda tp, fp: safe_div(2 * tp, tp + fp + F.col("P"))  # noqa: E731  (P = tp + fn)
    best = F.array_max(F.array(*(F.struct(f1(F.col(f"p{k}"), F.col(f"n{k}")).alias("f1"), F.lit(-k).alias("k")) for k in range(1, steps))))
    out = sums.select(*by, best.alias("bst"), f1(F.col("tp"), F.col("fp")).alias("base_f1"))
    # compared before rounding
    return out.select(*by, (-F.col("bst.k") / F.lit(float(steps))).alias("best_threshold"), r6("bst.f1").alias("best_f1"),
                      r6("base_f1").alias("base_f1"), (F.col("bst.f1") > F.col("base_f1")).alias("adopted"))


def family_attrs(scores: DataFrame, model_type: str = "model_type",
                 metrics: Sequence[str] = ("accuracy", "f1_score", "score")) -> DataFrame:
    """H8: ``Classical_<m>`` / ``Quantum_<m>`` columns; the other family 0."""
    from equisel.sources.views import CLASSICAL_MODELS

    cl = F.col(model_type).isin(*CLASSICAL_MODELS)
    cols = {}
    for m in metrics:
        cols[f"Classical_{m}"] = F.when(cl, F.col(m)).otherwise(F.lit(0.0))
        cols[f"Quantum_{m}"] = F.when(~cl, F.col(m)).otherwise(F.lit(0.0))
    return scores.withColumns(cols)


def stored_space(spark: SparkSession, space: dict, model_types: Sequence[str]) -> DataFrame:
    """The choice lists of a search as a table to store with its run:
    ``(param, choices, model_types)``, choices as JSON texts in their order."""
    rows = [(p, [json.dumps(v, sort_keys=True) for v in vs], sorted(model_types)) for p, vs in space.items()]
    return spark.createDataFrame(rows, "param string, choices array<string>, model_types array<string>")


def check_resume(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Parameters whose stored choice list differs from the current one
    (content or order), by name; a changed list of model types is the conflict
    ``model_type``. Parameters of one side only are no conflict. Both tables
    are :func:`stored_space`'s, kept when a search starts; lists are never
    inferred from the values that trials happened to draw."""
    pick = lambda df, name: df.select("param", F.col("choices").alias(name)).unionByName(
        df.select(F.lit("model_type").alias("param"), F.array_sort("model_types").alias(name)).distinct())
    both = pick(stored, "stored").join(pick(current, "current"), "param")
    return both.where(F.col("stored") != F.col("current")).orderBy("param")


def report_index(reports: DataFrame) -> DataFrame:
    """0-based report index per (study, trial) ordered by step (bucketed)."""
    return dense_position(reports, "step", by=["study", "trial"], name="__pos").withColumn(
        "report_idx", F.col("__pos") - 1).drop("__pos")


def asha_prune(reports: DataFrame, min_resource: int = 1, eta: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """H12 (Li et al. 2018, successive halving on report indices): rung r
    sits at report index min·eta^r. The trials that reach a rung and survived
    the rung below are ranked by their value there (desc, ties by trial); the
    top max(1, floor(n/eta)) survive. Output
    ``(by, study, trial, rung, resource, value, rank, n, kept)``.

    One index pass over the reports keeps only rung rows (written once); each
    rung then works on the survivors, a 1/eta share, and the number of rungs is
    the logarithm of the longest run."""
    from equisel.session import materialise

    by = list(by)
    ri = report_index(reports)
    r = F.log(F.col("report_idx") / F.lit(float(min_resource))) / F.log(F.lit(float(eta)))
    at = ri.where(F.col("report_idx") >= min_resource).withColumn("rung", F.round(r).cast("int")).where(
        F.col("report_idx") == F.lit(min_resource) * F.pow(F.lit(float(eta)), F.col("rung")).cast("long"))
    at = materialise(at.withColumn("__neg", -F.col("value")))
    top = at.agg(F.max("rung").alias("r")).first()["r"]
    out = kept = None
    for rung in range(0 if top is None else top + 1):
        here = at.where(F.col("rung") == rung)
        if kept is not None:
            here = join_on(here, kept, [*by, "study", "trial"], "left_semi")
        ranked = dense_position(here, ["__neg", "trial"], by=[*by, "study"], name="rank")
        n = here.groupBy(*by, "study").agg(F.count(F.lit(1)).alias("n"))
        done = join_on(ranked, n, [*by, "study"]).select(
            *by, "study", "trial", "rung", F.col("report_idx").alias("resource"), "value", "rank", "n",
            (F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") / F.lit(eta)))).alias("kept"))
        done = materialise(done)
        kept = done.where("kept").select(*by, "study", "trial")
        out = done if out is None else out.unionByName(done)
    if out is None:
        out = at.select(*by, "study", "trial", "rung", F.col("report_idx").alias("resource"), "value", F.lit(0).cast("long").alias("rank"),
                        F.lit(0).cast("long").alias("n"), F.lit(False).alias("kept"))
    return out


def hyperband_prune(reports: DataFrame, min_resource: int = 1, eta: int = 3, n_brackets: int = 2) -> DataFrame:
    """Trials hashed into brackets; bracket b runs successive halving
    with minimum resource min·eta^b. The brackets are few (a parameter), and
    each reads only its own trials' reports."""
    b = reports.withColumn("bracket", (hash32("trial", 17) % n_brackets).cast("int"))
    out = None
    for k in range(n_brackets):
        own = asha_prune(b.where(F.col("bracket") == k), min_resource * eta ** k, eta, by=["bracket"])
        out = own if out is None else out.unionByName(own)
    return out


def intermediate_neg_loss(reports: DataFrame, window: int = 3) -> DataFrame:
    """H14 (loss form): per report −mean of the last ``window`` values of
    its trial."""
    ri = report_index(reports).withColumn("__p", F.col("report_idx") + 1)
    s = sliding(ri, "__p", {"__mean": (F.avg("value"), window - 1, 0)}, window - 1, ["study", "trial"])
    return s.select("study", "trial", "step", "report_idx", r6(-F.col("__mean")).alias("neg_loss"))


def fairness_feasible(log: DataFrame, threshold: float | None = None, metric: str = "demographic_parity_difference",
                      disparity: str = "disparity") -> DataFrame:
    """constraint = disparity − threshold (feasible when ≤ 0); a missing
    disparity counts 1.0 (infeasible). For disparate impact a ratio
    threshold r becomes 1 − r. Defaults 0.1 (differences) / 0.8 (ratio)."""
    if threshold is None:
        threshold = 0.8 if metric == "disparate_impact" else 0.1
    t = 1.0 - threshold if metric == "disparate_impact" else threshold
    c = F.coalesce(F.col(disparity), F.lit(1.0)) - F.lit(t)
    return log.select("study", "trial", "state", r6(c).alias("constraint"), (c <= 0).alias("feasible"))

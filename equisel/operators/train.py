"""Training and scoring with ``pyspark.ml``.

Labels inside the library are ±1 (binary) or 0..K−1; Spark ML wants
0..K−1, so binary labels are mapped with (y + 1) / 2 on the way in and
back on the way out. Fits are distributed ML jobs; the driver only holds
the fitted coefficients.
"""

from __future__ import annotations

import ast
from collections.abc import Sequence

import numpy as np
from pyspark import SparkContext
from pyspark.ml.classification import (LinearSVC, LinearSVCModel, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
                                       OneVsRestModel)
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equisel.operators import hinge
from equisel.functions.exprs import join_on, r6
from equisel.functions.prefix import dense_position, sliding


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def to_ml_label(df: DataFrame, y: str = "y", out: str = "label", binary: bool = True) -> DataFrame:
    lab = ((F.col(y) + 1) / 2) if binary else F.col(y)
    return df.withColumn(out, lab.cast("double"))


def fit_linear_svc(train: DataFrame, C: float = 1.0, class_weight: str | None = None, features: str = "features",
                   label: str = "label", max_iter: int = 50, tol: float = 1e-4):
    """M1: linear SVM (hinge loss); regParam = 1/(C·n). ``balanced`` class
    weights (T9) become ``weightCol``."""
    n = train.count()
    est = LinearSVC(featuresCol=features, labelCol=label, regParam=1.0 / (C * max(n, 1)), maxIter=max_iter, tol=tol)
    if class_weight == "balanced":
        from equisel.operators.target import balanced_class_weights
        train = balanced_class_weights(train, label, "weight")
        est.setWeightCol("weight")
    return est.fit(train)


def parse_hidden(text: str) -> list[int]:
    """Hidden sizes given as text, e.g. ``"(50, 10, 5)"``."""
    v = ast.literal_eval(text)
    return [int(v)] if isinstance(v, int) else [int(x) for x in v]


def fit_mlp(train: DataFrame, n_features: int, n_classes: int, hidden: str = "(100,)", learning_rate: float = 0.03,
            batch_size: int = 128, alpha: float | None = None, features: str = "features", label: str = "label",
            seed: int = 42, max_iter: int = 100):
    """M2: multi-layer perceptron. ``alpha`` (L2) has no Spark counterpart
    and is ignored (documented)."""
    layers = [n_features, *parse_hidden(hidden), n_classes]
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=layers, stepSize=learning_rate,
                                          blockSize=batch_size, seed=seed, maxIter=max_iter, solver="gd").fit(train)


def fit_perceptron(train: DataFrame, x: str = "x", y: str = "y", eta0: float = 1.0, epochs: int = 10,
                   class_weight: str | None = None) -> tuple[list[float], float]:
    """M3: batch perceptron. Each epoch is one distributed aggregate of the
    updates of misclassified rows (Σ y·x, Σ y); the weights (d numbers)
    go back into the plan as literals."""
    d = len(train.select(x).first()[0])
    w, b = [0.0] * d, 0.0
    if class_weight == "balanced":
        from equisel.operators.target import balanced_class_weights
        train = balanced_class_weights(train, y, "__w")
    else:
        train = train.withColumn("__w", F.lit(1.0))
    for _ in range(epochs):
        wl = F.array(*[F.lit(v) for v in w])
        margin = F.aggregate(F.zip_with(F.col(x), wl, lambda a, c: a * c), F.lit(0.0), lambda acc, v: acc + v) + F.lit(b)
        mis = train.where(F.col(y) * margin <= 0)
        upd = mis.agg(*[F.sum(F.col(x)[i] * F.col(y) * F.col("__w")).alias(f"g{i}") for i in range(d)],
                      F.sum(F.col(y) * F.col("__w")).alias("gb"), F.count(F.lit(1)).alias("n")).first()
        if not upd["n"]:
            break
        w = [w[i] + eta0 * (upd[f"g{i}"] or 0.0) for i in range(d)]
        b = b + eta0 * (upd["gb"] or 0.0)
    return w, b


def fit_logistic_head(train: DataFrame, features: str = "features", label: str = "label"):
    """M4: unregularised logistic regression (tol 1e-3, 1000 iterations)."""
    return LogisticRegression(featuresCol=features, labelCol=label, regParam=0.0, tol=1e-3, maxIter=1000).fit(train)


def fit_kernel_svc(train: DataFrame, lm: DataFrame, x: str, key: str, C: float = 1.0, gamma: float | None = None,
                   gamma_factor: float = 1.0, label: str = "label"):
    """M5: RBF kernel SVC re-aimed: kernel values against a bounded landmark
    set (K4) as features, linear SVM on top. Returns (model, gamma)."""
    from equisel.operators.kernels import rbf_gamma, rbf_kernel
    from pyspark.ml.functions import array_to_vector

    g = gamma if gamma is not None else rbf_gamma(train, x)
    k = rbf_kernel(train, lm, x, key, gamma_factor, gamma=g).withColumn("kfeat", array_to_vector("kernel"))
    return fit_linear_svc(k, C, features="kfeat", label=label), g


def fit_one_vs_rest(train: DataFrame, C: float = 1.0, parallelism: int = 4, features: str = "features",
                    label: str = "label"):
    """M6: K one-vs-rest sub-models (``OneVsRest`` of ``LinearSVC``). Rows of
    more than one block are fitted for all classes together (``hinge``): the
    same loss and optimiser in far fewer jobs."""
    est = OneVsRest(featuresCol=features, labelCol=label, parallelism=parallelism)
    s = train.agg(F.count(F.lit(1)).alias("n"), F.max(label).alias("last"),
                  Summarizer.metrics("mean", "std").summary(F.col(features)).alias("s")).first()
    base = LinearSVC(regParam=1.0 / (C * max(s["n"], 1)))
    est.setClassifier(base)
    if s["n"] * (s["s"]["mean"].size + 1) <= hinge.BLOCK:
        return est.fit(train.coalesce(1))
    mean, std = s["s"]["mean"].toArray(), s["s"]["std"].toArray()
    if not (np.isfinite(mean).all() and np.isfinite(std).all()):
        raise ValueError("a feature is not a finite number")
    fitted = hinge.fit_machines(train, s["n"], int(s["last"]) + 1, mean, std, base.getRegParam(), features, label, base.getMaxIter(), base.getTol())
    return est._copyValues(OneVsRestModel([_svc_model(base, w, b, features) for w, b in fitted]))


def _svc_model(base: LinearSVC, w: np.ndarray, b: float, features: str) -> LinearSVCModel:
    """The model that ``base`` would give for these weights."""
    vector = _py2java(SparkContext._active_spark_context, Vectors.dense(w))
    made = LinearSVCModel(JavaWrapper._new_java_obj("org.apache.spark.ml.classification.LinearSVCModel", base.uid, vector, b))
    return base._copyValues(made).setFeaturesCol(features)


def _margin(x: str, w: list[float], b: float) -> F.Column:
    wl = F.array(*[F.lit(v) for v in w])
    return F.aggregate(F.zip_with(F.col(x), wl, lambda a, c: a * c), F.lit(0.0), lambda acc, v: acc + v) + F.lit(b)


def perceptron_scorer(train: DataFrame, n_classes: int | None = None, eta0: float = 1.0, epochs: int = 10,
                      class_weight: str | None = None, features: str = "features", y: str = "y"):
    """M3 on an assembled vector column: a function that adds ``y_pred``. With
    ``n_classes`` one perceptron per class is fitted against the rest and the
    largest margin wins (the smaller class on a tie)."""
    def arrays(df):
        return df.withColumn("__x", vector_to_array(features))

    data = arrays(train)
    if n_classes is None:
        w, b = fit_perceptron(data, "__x", y, eta0, epochs, class_weight)
        return lambda df: arrays(df).withColumn("y_pred", F.when(_margin("__x", w, b) > 0, 1).otherwise(-1)).drop("__x")
    each = [fit_perceptron(data.withColumn("__y", F.when(F.col(y) == k, 1).otherwise(-1)), "__x", "__y", eta0, epochs, class_weight)
            for k in range(n_classes)]

    def scored(df):
        best = F.greatest(*[F.struct(_margin("__x", w, b).alias("m"), F.lit(-k).alias("k")) for k, (w, b) in enumerate(each)])
        return arrays(df).withColumn("y_pred", -best["k"]).drop("__x")

    return scored


def kernel_scorer(train: DataFrame, binary: bool, C: float = 1.0, gamma: float | None = None, n_landmarks: int = 50,
                  features: str = "features", key: str = "row_id"):
    """M5 on an assembled vector column: kernel values against ``n_landmarks``
    train rows (in hash order of the key) as features of a linear machine, one
    against the rest when there are more than two classes."""
    from pyspark.ml.functions import array_to_vector

    from equisel.operators.kernels import landmarks, rbf_gamma, rbf_kernel

    def arrays(df):
        return df.withColumn("__x", vector_to_array(features))

    data = arrays(train)
    lm = landmarks(data, key, ["__x"], n_landmarks)
    g = float(gamma) if gamma not in (None, "scale") else rbf_gamma(data, "__x")

    def mapped(df):
        return rbf_kernel(arrays(df), lm, "__x", key, gamma=g).withColumn("__k", array_to_vector("kernel")).drop("kernel", "__x")

    fitted = mapped(train)
    m = fit_linear_svc(fitted, C, features="__k") if binary else fit_one_vs_rest(fitted, C, features="__k")
    return lambda df: score(m, mapped(df), binary=binary).drop("__k")


def score(model, df: DataFrame, binary: bool = True) -> DataFrame:
    """M7: ``y_pred`` (±1 or class code), probability array when the model
    gives one, positive-class probability and margin P(+1) − P(−1)."""
    out = model.transform(df)
    pred = F.col("prediction").cast("int")
    out = out.withColumn("y_pred", (pred * 2 - 1) if binary else pred)
    if "probability" in out.columns:
        out = out.withColumn("proba", vector_to_array("probability"))
        if binary:
            out = out.withColumn("score", F.element_at("proba", 2)).withColumn(
                "margin", F.element_at("proba", 2) - F.element_at("proba", 1))
    elif "rawPrediction" in out.columns:
        raw = vector_to_array("rawPrediction")
        if binary:
            out = out.withColumn("score", F.element_at(raw, 2)).withColumn("margin", F.element_at(raw, 2) - F.element_at(raw, 1))
    return out


def loss_convergence(loss: DataFrame, w: int, by: Sequence[str] = ("study", "trial"), step: str = "step",
                     value: str = "value") -> DataFrame:
    """A run converges at the first 0-based step s > 2w where
    |mean(last w) − mean(previous w)| ≤ std_pop(last w)/√w/2. Steps after
    a NaN loss are ignored (training stops)."""
    by = list(by)
    pos = dense_position(loss.select(*by, step, value), step, by=by, name="__p")
    nan_at = pos.where(F.isnan(value)).groupBy(*by).agg(F.min("__p").alias("__nan"))
    pos = join_on(pos, nan_at, by, "left").where(F.col("__nan").isNull() | (F.col("__p") < F.col("__nan")))
    j = sliding(pos, "__p", {"__last": (F.avg(value), w - 1, 0), "__before": (F.avg(value), 2 * w - 1, w),
                             "__spread": (F.stddev_pop(value), w - 1, 0)}, 2 * w - 1, by)
    met = (F.col("__p") - 1 > 2 * w) & (F.abs(F.col("__before") - F.col("__last")) <= F.col("__spread") / F.lit(w ** 0.5) / 2)
    first = j.where(met).groupBy(*by).agg(F.min(F.col("__p") - 1).alias("converged_step"))
    allk = loss.select(*by).distinct()
    return join_on(allk, first, by, "left").withColumn("converged", F.col("converged_step").isNotNull())


def normalise_loss(loss: DataFrame, by: Sequence[str] = ("study", "trial"), value: str = "value",
                   out: str = "norm_loss") -> DataFrame:
    """Loss / max|loss| per run (per-run max by partial aggregation, joined
    back). A run whose losses are all 0 has no scale: NaN, as 0 / 0 is."""
    by = list(by)
    mx = loss.groupBy(*by).agg(F.max(F.abs(value)).alias("__mx"))
    scaled = F.when(F.col("__mx") == 0, F.col(value) * F.lit(float("nan"))).otherwise(F.col(value) / F.col("__mx"))
    return join_on(loss, mx, by).withColumn(out, r6(scaled)).drop("__mx")

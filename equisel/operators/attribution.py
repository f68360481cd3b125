"""Attribution (SHAP) and explanation tables.

Attributions live in a long table ``(row_id, class_code, feature,
value, feature_value)`` plus ``base(class_code, base_value)``. The
model-agnostic explainer explodes rows × permutations × background ×
(features + 1) coalitions, evaluates the model as a Column expression
(JVM-side) and averages marginal contributions per (row, feature) — a
grouped aggregate partitioned by row key. Chart tables (waterfall,
beeswarm, heatmap, violin) are per-feature / per-row windows over the
bounded explained set.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equisel.functions.exprs import hash32, indexed_explode, r6
from equisel.functions.prefix import dense_position
from equisel.operators.split import even_downsample
from equisel.session import tasks

MAX_SHAP_ROWS = 200


def linear_shap(df: DataFrame, x: str, key: str, weights: Sequence[float], bias: float, background: DataFrame,
                names: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """V1: exact SHAP of a linear margin with an independent background:
    φ_f = w_f (x_f − mean_f); base = w · mean + b. Means are one
    aggregate over the background."""
    d = len(weights)
    names = list(names) if names else [f"feature_{i}" for i in range(d)]
    mrow = background.agg(*[F.avg(F.col(x)[i]).alias(f"m{i}") for i in range(d)]).first()
    means = [mrow[f"m{i}"] for i in range(d)]
    wl = F.array(*[F.lit(float(w)) for w in weights])
    ml = F.array(*[F.lit(float(m)) for m in means])
    nl = F.array(*[F.lit(n) for n in names])
    ex = indexed_explode(df.select(key, x), x, "i", "feature_value")
    sh = ex.select(F.col(key).alias("row_id"), F.lit(0).alias("class_code"),
                   F.element_at(nl, F.col("i") + 1).alias("feature"),
                   (F.element_at(wl, F.col("i") + 1) * (F.col("feature_value") - F.element_at(ml, F.col("i") + 1))).alias("value"),
                   "feature_value")
    base_value = sum(w * m for w, m in zip(weights, means)) + bias
    base = df.sparkSession.createDataFrame([(0, float(base_value))], "class_code int, base_value double")
    return sh, base


def permutation_shap(df: DataFrame, x: str, key: str, model: Callable[[F.Column], F.Column], background: DataFrame,
                     n_perm: int = 4, seed: int = 0, names: Sequence[str] | None = None, n_outputs: int = 1) -> tuple[DataFrame, DataFrame]:
    """V2: model-agnostic permutation SHAP. For each row, permutation p
    (feature order by hash(row, p, feature)) and background row b, the
    coalition of the first k features takes the row's values and the rest
    the background's; the marginal change of ``model`` when feature π_k
    joins is averaged over permutations and background rows. ``model``
    maps an array<double> Column to the model output Column (stays in the
    JVM): one number, or an array of ``n_outputs`` numbers, one per class, which
    are explained together. Values of a row and class add up to the output less
    the class's base value. A step's output is added up over the
    background rows as it is made, so a row holds one number per order, step and
    class. Rows are dealt evenly to the session's tasks; the rest happens inside
    the row. Background rows are attached by a broadcast of a bounded table."""
    d = len(df.select(x).first()[0])
    names = list(names) if names else [f"feature_{i}" for i in range(d)]
    bg_rows = background.select(x).limit(1001).collect()
    if len(bg_rows) > 1000:
        raise ValueError("background set must have at most 1000 rows")
    spark = df.sparkSession
    outputs = model if n_outputs > 1 else lambda v: F.array(model(v))
    bg = spark.createDataFrame([(i, [float(v) for v in r[0]]) for i, r in enumerate(bg_rows)], "__bi int, __b array<double>")
    one = bg.agg(F.transform(F.array_sort(F.collect_list(F.struct("__bi", "__b"))), lambda r: r["__b"]).alias("__bg"))
    upto = lambda n: F.sequence(F.lit(0), F.lit(n))

    def order(p):
        """The features of permutation p: by hash(row, p, feature)."""
        hashed = F.transform(upto(d - 1), lambda i: F.struct(
            hash32(F.concat_ws(":", F.col(key).cast("string"), p.cast("string"), i.cast("string")), seed).alias("h"), i.alias("i")))
        return F.transform(F.array_sort(hashed), lambda s: s["i"])

    # the work per row is large and the rows are small: dealt to tasks by number, not by the files they lie in
    j = df.select(key, x).repartition(tasks(spark)).withColumn("__orders", F.transform(upto(n_perm - 1), order)).crossJoin(F.broadcast(one))  # one row of bounded background
    ranks = F.transform("__orders", lambda o: F.transform(upto(d - 1), lambda i: F.array_position(o, i).cast("int")))
    j = j.withColumn("__ranks", ranks)

    def mixed(rank, k, b):
        """The row's values for the first k features of the order, else b's."""
        return F.array(*[F.when(F.element_at(rank, i + 1) <= k, F.element_at(F.col(x), i + 1)).otherwise(F.element_at(b, i + 1)) for i in range(d)])

    def total(inputs):
        """Sum of the model's outputs over an array of its inputs."""
        if n_outputs == 1:
            return F.array(F.aggregate(inputs, F.lit(0.0), lambda acc, v: acc + model(v)))
        added = lambda made: F.transform(upto(n_outputs - 1), lambda c: F.aggregate(made, F.lit(0.0), lambda acc, o: acc + F.element_at(o, c + 1)))
        return F.element_at(F.transform(F.array(F.transform(inputs, model)), added), 1)

    # the two ends of every order are the same: the background alone, once in all, and the row alone, once per row
    j = j.crossJoin(F.broadcast(one.select(total(F.col("__bg")).alias("__first"))))
    j = j.withColumn("__last", F.transform(total(F.array(x)), lambda o: o * F.size("__bg")))

    def path(rank):
        between = F.transform(F.sequence(F.lit(1), F.lit(d - 1)), lambda k: total(F.transform("__bg", lambda b: mixed(rank, k, b))))
        return F.concat(F.array("__first"), *([between] if d > 1 else []), F.array("__last"))

    within = F.transform("__ranks", path)
    j = j.withColumn("__paths", F.arrays_zip(F.col("__ranks").alias("r"), within.alias("path")))

    def value(f, c):
        """Mean change of output c when feature f joins."""
        def change(z):
            at = F.element_at(z["r"], f + 1)
            return F.element_at(F.element_at(z["path"], at + 1), c + 1) - F.element_at(F.element_at(z["path"], at), c + 1)
        return F.aggregate("__paths", F.lit(0.0), lambda acc, z: acc + change(z) / F.size("__bg")) / F.lit(float(n_perm))

    nl = F.array(*[F.lit(n) for n in names])
    each = F.flatten(F.transform(upto(n_outputs - 1), lambda c: F.transform(upto(d - 1), lambda f: F.struct(
        c.alias("class_code"), F.element_at(nl, f + 1).alias("feature"), value(f, c).alias("value"), F.element_at(F.col(x), f + 1).alias("feature_value")))))
    sh = j.select(F.col(key).alias("row_id"), F.inline(each))
    per = bg.select(F.inline(F.transform(F.arrays_zip(upto(n_outputs - 1).alias("class_code"), outputs(F.col("__b")).alias("o")), lambda z: z)))
    return sh, per.groupBy("class_code").agg(F.avg("o").alias("base_value"))


def class_slice(shap: DataFrame, n_classes: int, requested: int | None = None) -> DataFrame:
    """V3: per-class attributions → one class: binary takes the last class;
    multiclass honours the request, else class 0."""
    if n_classes == 2:  # the last class present (a single-output explanation has one)
        last = shap.agg(F.max("class_code").alias("__last"))
        return shap.join(F.broadcast(last), F.col("class_code") == F.col("__last")).drop("__last")
    k = requested if requested is not None and 0 <= requested < n_classes else 0
    return shap.where(F.col("class_code") == k)


def feature_importance(shap: DataFrame) -> DataFrame:
    """V4: mean |value| per feature, class axis averaged, descending."""
    per = shap.groupBy("feature", "class_code").agg(F.avg(F.abs("value")).alias("m"))
    return per.groupBy("feature").agg(r6(F.avg("m")).alias("importance")).orderBy(F.col("importance").desc(), "feature")


def top_features(shap: DataFrame, n: int = 10) -> DataFrame:
    """V5: the first n features by V4 (a top-n report)."""
    return feature_importance(shap).limit(n)


def shap_payload(shap: DataFrame, base: DataFrame, max_rows: int = MAX_SHAP_ROWS, class_code: int = 0) -> DataFrame:
    """V6: at most ``max_rows`` evenly spaced explained rows (X7), NaN/inf →
    null, with the base value of the class and the row-aligned data."""
    s = shap.where(F.col("class_code") == class_code)
    rows = s.select("row_id").distinct()
    keep = even_downsample(rows, "row_id", max_points=max_rows)
    s = s.join(keep, "row_id")
    clean = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c))
    b = base.where(F.col("class_code") == class_code).select("base_value")
    return s.crossJoin(F.broadcast(b)).select("row_id", "feature", clean("value").alias("value"),
                                              clean("feature_value").alias("feature_value"), "base_value")


def waterfall(shap: DataFrame, base: DataFrame, top: int = 10, class_code: int = 0) -> DataFrame:
    """V7: per explained row the top ``top`` features by |value| (ties by
    name), the rest summed as ``other (k features)``, with running
    start/end from the base value."""
    s = shap.where(F.col("class_code") == class_code)
    w = Window.partitionBy("row_id").orderBy(F.abs("value").desc(), "feature")
    r = s.withColumn("rk", F.row_number().over(w))
    head = r.where(F.col("rk") <= top).select("row_id", "rk", F.concat(F.col("feature"), F.lit(" = "),
                                                                       F.format_number("feature_value", 3)).alias("name"), "value")
    rest = r.where(F.col("rk") > top).groupBy("row_id").agg(F.count(F.lit(1)).alias("k"), F.sum("value").alias("value"))
    rest = rest.select("row_id", F.lit(top + 1).alias("rk"),
                       F.concat(F.lit("other ("), F.col("k").cast("string"), F.lit(" features)")).alias("name"), "value")
    steps = head.unionByName(rest)
    b = base.where(F.col("class_code") == class_code).select("base_value")
    cum = F.sum("value").over(Window.partitionBy("row_id").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0))
    out = steps.crossJoin(F.broadcast(b)).withColumn("end", F.col("base_value") + cum)
    return out.select("row_id", "rk", "name", r6("value").alias("delta"), r6(F.col("end") - F.col("value")).alias("start"),
                      r6("end").alias("end"))


def beeswarm(shap: DataFrame, top: int = 10, class_code: int = 0) -> DataFrame:
    """V8: per top feature: bin = round(value / binSize) with binSize = 5 %
    of the value range (≥ 1e−9); the k-th point of a bin (row order) gets
    offset min(ceil(k/2)·0.09, 0.38) alternating sign; colour = min-max of
    the feature value (0.5 if constant). Stack positions are bucketed
    prefix counts, so a crowded bin is not one task."""
    s = shap.where(F.col("class_code") == class_code)
    feats = top_features(s, top).select("feature")
    s = s.join(F.broadcast(feats), "feature")
    st = s.groupBy("feature").agg(F.min("value").alias("mn"), F.max("value").alias("mx"),
                                  F.min("feature_value").alias("rmn"), F.max("feature_value").alias("rmx"))
    j = s.join(st, "feature")
    bin_size = F.greatest((F.col("mx") - F.col("mn")) * 0.05, F.lit(1e-9))
    j = j.withColumn("bin", F.floor(F.col("value") / bin_size + 0.5).cast("long"))
    j = dense_position(j, "row_id", by=["feature", "bin"], name="__k")
    k = F.col("__k") - 1
    off = F.least(F.ceil(k / 2) * 0.09, F.lit(0.38)) * F.when(k % 2 == 1, 1.0).otherwise(-1.0)
    rng = F.col("rmx") - F.col("rmn")
    norm = F.when(rng > 0, (F.col("feature_value") - F.col("rmn")) / rng).otherwise(0.5)
    return j.select("feature", "row_id", "value", "bin", r6(off).alias("offset"), r6(norm).alias("colour"))


def heatmap(shap: DataFrame, n_rows: int = 50, top: int = 10, class_code: int = 0) -> DataFrame:
    """V9: the first ``n_rows`` explained rows × top features, value / max|value|."""
    s = shap.where(F.col("class_code") == class_code)
    feats = top_features(s, top).select("feature")
    rows = s.select("row_id").distinct().orderBy("row_id").limit(n_rows)
    h = s.join(F.broadcast(feats), "feature").join(F.broadcast(rows), "row_id")
    mx = h.agg(F.max(F.abs("value")).alias("m"))
    return h.crossJoin(mx).select("row_id", "feature", r6(F.when(F.col("m") > 0, F.col("value") / F.col("m")).otherwise(0.0)).alias("scaled"))


def violin_summary(shap: DataFrame, bins: int = 20, class_code: int = 0) -> DataFrame:
    """Per feature quartiles (exact) and a ``bins``-bucket histogram of values."""
    from equisel.operators.profile import long_quantiles

    s = shap.where(F.col("class_code") == class_code)
    st = s.groupBy("feature").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    j = s.join(st, "feature")
    b = F.when(F.col("mx") > F.col("mn"),
               F.least(F.floor((F.col("value") - F.col("mn")) / (F.col("mx") - F.col("mn")) * bins), F.lit(bins - 1))).otherwise(0)
    hist = j.groupBy("feature", b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    q = long_quantiles(s.select(F.col("feature").alias("column"), F.col("value").cast("double").alias("value")), [0.25, 0.5, 0.75])
    q = q.select(F.col("column").alias("feature"), "prob", "value")
    return hist, q


def evidence_bundle(sections: dict) -> DataFrame:
    """One JSON document from bounded section tables: each section is
    collected into a sorted array of structs by an aggregate and the sections
    are combined into one row; an empty section becomes an empty list. A
    section is a table, or a function that makes one: if that fails, while it
    is planned or while it runs, the section is null and ``warnings`` has its
    name and error, and the others stay; so every section is run and written on
    its own. Only bounded tables (metric rows, confusion cells, feature summaries,
    downsampled curves, audit rows) belong here."""
    from equisel.session import materialise

    warnings, made = [], {}
    for name, section in sections.items():
        try:
            df = section() if callable(section) else section
            # sorted rows: the same inputs always give the same document
            made[name] = materialise(df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name)))
        except Exception as e:  # whatever a section does, the others are delivered
            warnings.append((name, f"{type(e).__name__}: {str(e).strip().splitlines()[0]}"))
    if not made:
        raise ValueError(f"no section could be made: {warnings}")
    one = None
    for agg in made.values():
        one = agg if one is None else one.crossJoin(agg)  # one-row tables
    notes = [F.struct(F.lit(n).alias("section"), F.lit(e).alias("error")) for n, e in warnings]
    empty = F.array().cast("array<struct<section:string,error:string>>")
    cols = [F.col(n) if n in made else F.lit(None).cast("string").alias(n) for n in sections]
    return one.select(F.to_json(F.struct(*cols, (F.array(*notes) if notes else empty).alias("warnings")), {"ignoreNullFields": "false"}).alias("bundle"))

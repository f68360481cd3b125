"""Derived inputs built from the driver's tables (see FIXTURES.md).

Each view is a lazy DataFrame over the parquet tables, so its work grows
with them. Pseudo-random columns come from ``hash32``/``unit_hash`` of the
row key, never from ``rand()``, so a recomputed partition is identical and
the DuckDB oracle (``equisel.sources.sql_views``) can express the same
numbers. Integer arithmetic is used wherever a value is later compared
exactly, so both engines produce bit-identical doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equisel.functions.exprs import TWO_POW_32, hash32, unit_hash
from equisel.sources.tables import table

N_TRIALS = 12

# Model names of the search (registry order) and the classical subset.
MODEL_TYPES = [
    "CircuitCentricClassifier",
    "DataReuploadingClassifier",
    "DataReuploadingClassifierSeparable",
    "DressedQuantumCircuitClassifier",
    "DressedQuantumCircuitClassifierSeparable",
    "ProjectedQuantumKernel",
    "QuantumKitchenSinks",
    "QuantumMetricLearner",
    "TreeTensorClassifier",
    "SeparableVariationalClassifier",
    "SeparableKernelClassifier",
    "SVC",
    "SVClinear",
    "MLPClassifier",
    "Perceptron",
]
CLASSICAL_MODELS = ["SVC", "SVClinear", "MLPClassifier", "Perceptron"]
# Choices used for the synthetic trial parameters (a subset of the default space).
TRIAL_C = ["0.1", "1", "10", "100"]
TRIAL_LR = ["0.001", "0.01", "0.1"]
TRIAL_LAYERS = ["1", "5", "10"]

# Run status per event type for the synthetic run log.
RUN_STATUS = {"view": "completed", "click": "running", "purchase": "failed", "signup": "pending", "error": "interrupted"}


def _pick(values: list[str], h) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (h % len(values) + 1).cast("int"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Binary scored predictions: one row per order, group = market segment."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    f = (F.col("o_orderstatus") == "F").cast("int")
    score = (F.lit(350) * f + F.floor(F.lit(650) * hash32("o_orderkey", 7) / F.lit(TWO_POW_32))) / F.lit(1000.0)
    return (
        o.join(c, o["o_custkey"] == c["c_custkey"])
        .select(
            F.col("o_orderkey").alias("row_id"),
            F.when(f == 1, 1).otherwise(-1).alias("y_true"),
            score.alias("score"),
            F.col("c_mktsegment").alias("sensitive"),
            F.col("o_orderpriority").alias("alt_group"),
        )
        .withColumn("y_pred", F.when(F.col("score") >= 0.5, 1).otherwise(-1))
    )


def predictions_by_trial(spark: SparkSession, d: str, n_trials: int = N_TRIALS) -> DataFrame:
    """``predictions`` re-scored by ``n_trials`` trials of differing quality.

    Each order fans out to the trials with ``explode(sequence)`` (a
    generator, no join); the output grows linearly with orders."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    # one md5 per order, before the fan-out; each trial re-draws with an exact
    # odd-multiplier affine map mod 2^32 (a bijection, reproducible in SQL)
    o = o.withColumn("__h", hash32("o_orderkey", 100))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    base = o.join(c, o["o_custkey"] == c["c_custkey"]).withColumn(
        "trial", F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1))))  # int elements
    f = (F.col("o_orderstatus") == "F").cast("int")
    w = F.lit(200) + F.lit(25) * F.col("trial")
    mult = (F.lit(7919) * F.col("trial") + F.lit(12345)) * 2 + 1
    h = F.pmod(F.col("__h") * mult + F.lit(104729) * F.col("trial"), F.lit(4294967296))
    score = (w * f + F.floor((F.lit(1000) - w) * h / F.lit(TWO_POW_32))) / F.lit(1000.0)
    return base.select(
        "trial",
        F.col("o_orderkey").alias("row_id"),
        F.when(f == 1, 1).otherwise(-1).alias("y_true"),
        score.alias("score"),
        F.col("c_mktsegment").alias("sensitive"),
    ).withColumn("y_pred", F.when(F.col("score") >= 0.5, 1).otherwise(-1))


def predictions_mc(spark: SparkSession, d: str) -> DataFrame:
    """Three-class predictions with a probability array (classes F=0, O=1, P=2)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    o = o.withColumn("__h", hash32("o_orderkey", 11))  # one md5 per order; classes re-drawn by affine maps mod 2^32
    y = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    hk = lambda k: F.pmod(F.col("__h") * F.lit(2 * (7919 * k + 12345) + 1) + F.lit(104729 * k), F.lit(4294967296))
    ws = [
        F.floor(F.lit(1000) * hk(k) / F.lit(TWO_POW_32)) + F.when(y == k, 600).otherwise(0)
        for k in range(3)
    ]
    df = o.select(
        F.col("o_orderkey").alias("row_id"),
        y.alias("y_true"),
        ws[0].alias("w0"),
        ws[1].alias("w1"),
        ws[2].alias("w2"),
        F.col("o_orderpriority").alias("sensitive"),
    )
    tot = F.col("w0") + F.col("w1") + F.col("w2")
    pred = (
        F.when((F.col("w0") >= F.col("w1")) & (F.col("w0") >= F.col("w2")), 0)
        .when(F.col("w1") >= F.col("w2"), 1)
        .otherwise(2)
    )
    return df.select(
        "row_id",
        "y_true",
        pred.alias("y_pred"),
        *[(F.col(f"w{k}") / tot).alias(f"p{k}") for k in range(3)],
        "sensitive",
    ).withColumn("proba", F.array("p0", "p1", "p2"))


def doc_quality(spark: SparkSession, d: str) -> DataFrame:
    """Second binary data set: document quality labels, score from length, group = language."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, d, "labels").select("doc_id", "quality")
    score = F.least(F.col("n_chars"), F.lit(10000)) / F.lit(10000.0)
    return (
        docs.join(lab, "doc_id")
        .select(
            F.col("doc_id").alias("row_id"),
            (F.col("quality") * 2 - 1).alias("y_true"),
            score.alias("score"),
            F.col("lang").alias("sensitive"),
            F.col("source").alias("alt_group"),
        )
        .withColumn("y_pred", F.when(F.col("score") >= 0.1, 1).otherwise(-1))
    )


def features(spark: SparkSession, d: str) -> DataFrame:
    """Mixed-type feature table from ``part`` with injected nulls (null
    injection by key residue: a column edit, not a row filter)."""
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand", "p_type")
    size = F.when(F.col("p_partkey") % 7 == 0, F.lit(None).cast("int")).otherwise(F.col("p_size"))
    ptype = F.when(F.col("p_partkey") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type"))
    return p.select(
        "p_partkey",
        size.alias("p_size"),
        "p_retailprice",
        "p_brand",
        ptype.alias("p_type"),
        (size > 25).alias("flag"),
        F.when(F.col("p_retailprice") >= 950, "high").otherwise("low").alias("target"),
    )


def split_input(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("y"))


def trials(spark: SparkSession, d: str) -> DataFrame:
    """Trial log: one row per event; study = user, trial number = event id."""
    return trials_from_events(table(spark, d, "events"))


def trials_from_events(e: DataFrame) -> DataFrame:
    """Row-local transform events → trial log (usable on a stream)."""
    e = e.select("event_id", "ts", "user_id", "event_type", "value")
    state = (
        F.when(F.col("event_type") == "error", "FAIL")
        .when(F.col("event_type") == "signup", "PRUNED")
        .otherwise("COMPLETE")
    )
    f1 = F.round(F.col("value") / (F.col("value") + 1), 6)
    disp = F.round(unit_hash("event_id", 3), 6)
    n_steps = (hash32("event_id", 9) % 200 + 1).cast("int")
    dur = hash32("event_id", 10) % 600
    model = _pick(MODEL_TYPES, hash32("event_id", 5))
    out = e.select(
        F.col("user_id").alias("study"),
        F.col("event_id").alias("trial"),
        state.alias("state"),
        f1.alias("f1"),
        disp.alias("disparity"),
        model.alias("model_type"),
        _pick(TRIAL_C, hash32("event_id", 6)).alias("C"),
        _pick(TRIAL_LR, hash32("event_id", 7)).alias("learning_rate"),
        _pick(TRIAL_LAYERS, hash32("event_id", 8)).alias("n_layers"),
        n_steps.alias("n_steps"),
        F.lit(32).alias("batch_size"),
        F.col("ts").alias("start_ts"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + dur * 1000000).cast("timestamp_ntz").alias("end_ts"),
    )
    complete = F.col("state") == "COMPLETE"
    return out.select(
        "*",
        F.when(complete, F.array("f1", "disparity")).alias("values"),
        F.create_map(
            F.lit("model_type"), F.col("model_type"),
            F.lit("C"), F.col("C"),
            F.lit("learning_rate"), F.col("learning_rate"),
            F.lit("n_layers"), F.col("n_layers"),
        ).alias("params"),
        F.when(
            F.col("state") == "FAIL",
            F.concat(F.lit("ValueError: trial "), F.col("trial").cast("string"), F.lit(" failed")),
        ).alias("error"),
    )


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Intermediate reports: (study, trial, step, value, ts); step is the raw step."""
    return reports_from_events(table(spark, d, "events"))


def reports_from_events(e: DataFrame) -> DataFrame:
    """Row-local transform events → report log (usable on a stream)."""
    e = e.select("event_id", "ts", "user_id", "value")
    return e.select(
        F.col("user_id").alias("study"),
        (F.col("event_id") % 9).alias("trial"),
        (F.col("event_id") / 9).cast("long").alias("step"),
        F.col("value"),
        F.col("ts"),
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Run store rows reshaped from events."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    status = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in RUN_STATUS.items()], F.lit("unknown"))
    done = status == "completed"
    return e.select(
        F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"),
        F.concat(F.lit("ds-"), (F.col("user_id") % 25).cast("string")).alias("dataset_id"),
        F.col("user_id").alias("study"),
        status.alias("status"),
        F.col("ts").alias("started_at"),
        F.when(done, F.round(F.col("value") / (F.col("value") + 1), 6)).alias("best_value"),
        F.when(done, F.concat(F.lit('{"C": '), (hash32("event_id", 6) % 100).cast("string"), F.lit("}"))).alias(
            "best_params_json"
        ),
    )


def datasets(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return n.select(
        F.concat(F.lit("ds-"), F.col("n_nationkey").cast("string")).alias("dataset_id"),
        F.col("n_name").alias("name"),
        F.lit("uci").alias("source"),
        (F.col("n_regionkey") * 100 + F.col("n_nationkey")).cast("long").alias("rows"),
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label")


def analysis_requests(spark: SparkSession, d: str) -> DataFrame:
    """Analysis requests (one per event) for the snapshot store: run id per
    user, settings derived from the event, some left to their defaults."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return e.select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("optimization_id"),
        F.when(F.col("event_type") != "click", (F.col("event_id") % 5).cast("int")).alias("trial_number"),
        (F.col("event_type") != "error").alias("use_proba"),
        F.when(F.col("event_type") != "view", (50 + (F.col("event_id") % 3) * 25).cast("int")).alias("subset_size"),
        (F.col("event_id") % 2).cast("int").alias("class_index"),
        F.lit(None).cast("int").alias("sample_index"),
        F.col("ts").alias("created_at"),
        F.col("event_type"),
    )

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from equisel.functions.prefix import dense_position, running_agg, running_totals
from equisel.operators import attribution as AT
from equisel.operators import kernels as K


def test_running_totals_match_window_with_hot_group(spark):
    rng = np.random.default_rng(5)
    rows = [(("hot" if i % 3 else f"g{i % 7}"), float(i), int(rng.integers(0, 10))) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, t double, v long")
    got = running_totals(df, "t", ["v"], by=["g"], n_buckets=7)
    want = df.withColumn("w", F.sum("v").over(Window.partitionBy("g").orderBy("t")))
    bad = got.join(want, ["g", "t"]).where(F.col("cum_v") != F.col("w")).count()
    assert bad == 0
    pos = dense_position(df, "t", by=["g"], descending=True)
    rn = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(F.col("t").desc())))
    assert pos.join(rn, ["g", "t"]).where(F.col("pos") != F.col("rn")).count() == 0
    mx = running_agg(df, "t", ["v"], fn="max", by=["g"], inclusive=False)
    wmx = df.withColumn("w", F.max("v").over(Window.partitionBy("g").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)))
    assert mx.join(wmx, ["g", "t"]).where(~F.col("run_v").eqNullSafe(F.col("w"))).count() == 0


def _cnot_circuit(bits):
    b = list(bits)
    q = len(b)
    for i in range(0, q - 1, 2):
        b[i + 1] ^= b[i]
    for i in range(q - 2):
        b[i + 2] ^= b[i]
    return b


def test_kitchen_sink_xor_law(spark):
    # with ω = 0 and β = π the rotation is a deterministic X flip: every bit is 1
    df = spark.createDataFrame([(1, [0.3, -0.2, 0.5, 0.1, 0.7])], "k long, x array<double>")
    out = K.random_binary_features(df, "x", "k", episodes=2, q=5, var=0.0, seed=0)
    # with var 0 θ = β ~ U(0, 2π): compare against the classical circuit on the same raw bits
    bits = out.first()["qfeatures"]
    assert len(bits) == 10 and set(bits) <= {0, 1}
    for raw in ([1, 0, 1, 1, 0], [1, 1, 1, 1, 1], [0, 1, 0, 0, 1]):
        # the array form of the XOR layers equals the sequential CNOT circuit
        c = [raw[i] ^ (raw[i - 1] if i % 2 == 1 else 0) for i in range(5)]
        fin = [0] * 5
        for i in range(5):
            acc = 0
            for k in range(i + 1):
                if k % 2 == i % 2:
                    acc ^= c[k]
            fin[i] = acc
        assert fin == _cnot_circuit(raw)


def test_random_binary_features_by_hand(spark):
    e_, q, d, seed = 2, 3, 2, 4
    rows = [(7, [0.5, -1.0]), (None, [2.0, 0.25]), (8, [None, 1.0]), (9, None), (10, [1.0]), (11, [1.0, 2.0, 3.0]), (12, [float("nan"), 0.0])]
    df = spark.createDataFrame(rows, "k long, x array<double>")
    out = K.random_binary_features(df, "x", "k", episodes=e_, q=q, seed=seed)
    p = K.kitchen_sink_params(spark, e_, q, d, seed=seed).first()

    def raw(k, x, e, i):
        if x is None or len(x) != d or None in x:
            return 0
        th = sum(w * v for w, v in zip(p["omegas"][e][i], x)) + p["betas"][e][i]
        text = ":".join([*([] if k is None else [str(k)]), str(seed), "bit", str(e), str(i)])
        u = int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2 ** 32
        return int(math.isnan(th) or u < math.sin(th / 2) ** 2)

    want = {k: [b for e in range(e_) for b in _cnot_circuit([raw(k, x, e, i) for i in range(q)])] for k, x in rows}
    assert {r["k"]: list(r["qfeatures"]) for r in out.collect()} == want
    # the draws are not left to lambda functions, which are interpreted row by row
    assert "lambdafunction" not in out._jdf.queryExecution().toString()


def test_rbf_kernel_by_hand(spark):
    rows = [(1, [0.5, -1.0]), (2, [2.0, 0.25]), (3, [None, 1.0]), (4, None), (5, [1.0]), (6, [0.5, -1.0])]
    df = spark.createDataFrame(rows, "k long, x array<double>")
    out = K.rbf_kernel(df, df.where("k in (1, 2, 3, 5)"), "x", "k", gamma=0.3)
    whole = lambda v: v is not None and None not in v
    value = lambda a, b: math.exp(-0.3 * sum((u - w) ** 2 for u, w in zip(a, b))) if whole(a) and whole(b) and len(a) == len(b) else None
    for r in out.collect():
        assert list(r["kernel"]) == pytest.approx([value(dict(rows)[r["k"]], dict(rows)[k]) for k in (1, 2, 3, 5)], abs=1e-15)
    # the sums over the features are not left to lambda functions, which are interpreted row by row
    assert "zip_with" not in out._jdf.queryExecution().toString()


def test_product_kernel_numpy(spark):
    df = spark.createDataFrame([(i, [0.1 * i, -0.3 * i, 0.7]) for i in range(5)], "k long, x array<double>")
    lm = K.landmarks(df, "k", ["x"], 2)
    got = K.product_kernel(df, lm, "x", "k").collect()
    lms = [r["x"] for r in sorted(lm.collect())]
    for r in got:
        for j, l in enumerate(lms):
            want = np.prod([math.cos((a - b) / 2) ** 2 + math.sin((a - b) / 2) ** 2 / 2 for a, b in zip(r["x"], l)])
            assert r["kernel"][j] == pytest.approx(want, abs=1e-12)
    with pytest.raises(ValueError):
        K.landmarks(df, "k", ["x"], K.MAX_LANDMARKS + 1)


def test_shap_linear_exact_and_additive(spark):
    rows = [(i, [float(i % 5), float(i % 3) - 1, 0.5 * i]) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, x array<double>")
    w, b = [0.5, -1.0, 0.2], 0.3
    sh, base = AT.linear_shap(df, "x", "k", w, b, df)
    base_v = base.first()["base_value"]
    tot = {r["row_id"]: r["s"] for r in sh.groupBy("row_id").agg(F.sum("value").alias("s")).collect()}
    for k, x in rows:
        pred = sum(wi * xi for wi, xi in zip(w, x)) + b
        assert tot[k] + base_v == pytest.approx(pred)
    model = lambda arr: F.aggregate(F.zip_with(arr, F.array(*[F.lit(v) for v in w]), lambda a, c: a * c), F.lit(b),
                                    lambda acc, v: acc + v)
    ps, _ = AT.permutation_shap(df, "x", "k", model, df.orderBy("k").limit(30), n_perm=2)
    lin = {(r["row_id"], r["feature"]): r["value"] for r in sh.collect()}
    for r in ps.collect():
        assert r["value"] == pytest.approx(lin[(r["row_id"], r["feature"])], abs=1e-9)


def test_running_totals_keep_null_order_rows(spark):
    from pyspark.sql import Window

    rows = [("a", None, 1), ("a", 1.0, 2), ("a", 2.0, 3), ("b", None, 4), ("b", 5.0, 5)] + \
        [("a", float(i), 1) for i in range(3, 60)]
    df = spark.createDataFrame(rows, "g string, t double, v long")
    for desc in (False, True):
        got = running_totals(df, "t", ["v"], by=["g"], descending=desc, n_buckets=4)
        assert got.count() == df.count()
        o = F.col("t").desc() if desc else F.col("t").asc()
        want = df.withColumn("w", F.sum("v").over(Window.partitionBy("g").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)))
        j = got.join(want, ["g", "t", "v"])
        assert j.where(F.col("cum_v") != F.col("w")).count() == 0


def test_permutation_shap_is_dealt_to_all_tasks(spark):
    """The rows of one small file are one partition: the explanation may not stay in it."""
    df = spark.range(0, 400, 1, 1).select(F.col("id").alias("k"), F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(3)]).alias("x"))
    sh, _ = AT.permutation_shap(df, "x", "k", lambda a: a[0] * a[1] + F.exp(a[2]), df.orderBy("k").limit(5), n_perm=2)
    assert sh.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rows = {tuple(r) for r in sh.groupBy(F.spark_partition_id().alias("p")).count().select("p").collect()}
    assert len(rows) >= spark.sparkContext.defaultParallelism and sh.count() == 1200


def test_permutation_shap_of_a_single_feature(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "k long, x array<double>")
    sh, base = AT.permutation_shap(df, "x", "k", lambda a: a[0] * 2, df.where("k < 2"), n_perm=2)
    assert base.first().base_value == pytest.approx(1.0)
    assert {r.row_id: r.value for r in sh.collect()} == pytest.approx({i: 2.0 * i - 1.0 for i in range(6)})


@pytest.mark.parametrize("outputs", [1, 2])
def test_permutation_shap_of_a_missing_value_is_missing(spark, outputs):
    df = spark.createDataFrame([(i, [None if i == 3 else float(i), 1.0 + i, 2.0]) for i in range(6)], "k long, x array<double>")
    model = (lambda a: a[0] + a[1] * a[2]) if outputs == 1 else (lambda a: F.array(a[0] + a[1] * a[2], a[1]))
    sh, _ = AT.permutation_shap(df, "x", "k", model, df.where("k < 2"), n_perm=2, n_outputs=outputs)
    got = {(r.row_id, r.class_code, r.feature): r.value for r in sh.collect()}
    assert {k[0] for k, v in got.items() if v is None} == {3} and len(got) == 18 * outputs
    assert all(got[i, 0, "feature_0"] == pytest.approx(i - 0.5) for i in (0, 1, 2, 4, 5))

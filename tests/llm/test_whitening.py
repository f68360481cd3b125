import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from equisel.llm import whitening as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def make(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def ints(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def brute(rows, weights="counts", components=32):
    """{vec_id: (deviation, whitened)} and (n, explained) by numpy on all rows."""
    x = np.array([ints(v) for _, v, _ in rows], dtype=object)
    fit = x if weights == "counts" else np.unique(x.astype(np.int64), axis=0).astype(object)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * x - s)
    yf = (n * fit - s).astype(float) / n
    e, p = np.linalg.eigh(yf.T @ yf / n)
    e, p = e[::-1][:components], p[:, ::-1][:, :components]
    return n, e / np.trace(yf.T @ yf / n), {r[0]: (int((y[i] ** 2).sum()), np.abs((y[i].astype(float) / n) @ p / np.sqrt(e))) for i, r in enumerate(rows)}


def vectors(n, d, seed, copies=0):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(d, d))
    out = [(i, [float(c) for c in r.normal(size=d) @ mix * 3], i % 3) for i in range(n)]
    return out + [(n + i, out[0][1], 0) for i in range(copies)]


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_against_numpy(spark, weights):
    rows = vectors(120, 7, 1, copies=60)
    got = H.components(H.whiten(make(spark, rows), weights=weights, components=5)).collect()
    n, explained, want = brute(rows, weights, 5)
    assert len(got) == 180 * 5 and {r.n for r in got} == {n}
    for r in got:
        deviation, white = want[r.vec_id]
        assert r.deviation == deviation and abs(abs(r.whitened) - white[r.component - 1]) < 1e-8
        assert abs(r.explained - explained[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
    signs = {}
    for r in got:  # one sign for all rows: copies agree
        signs.setdefault((rows[r.vec_id][1][0], r.component), set()).add(r.whitened)
    assert all(len(s) == 1 for s in signs.values())


def test_whitened_rows_have_identity_covariance(spark):
    rows = vectors(90, 6, 4, copies=30)
    w = np.array([r.whitened for r in H.whiten(make(spark, rows)).collect()])
    assert np.abs(w.T @ w / len(w) - np.eye(6)).max() < 1e-9


def test_rows_left_out_and_kept(spark):
    good = vectors(40, 4, 2)
    odd = [(100, None, 1), (101, [1.0, None, 2.0, 3.0], 1), (102, [float("nan"), 1.0, 2.0, 3.0], 1), (103, [float("inf"), 1.0, 2.0, 3.0], 1),
           (104, [-float("inf"), 1.0, 2.0, 3.0], 1), (105, [], 1), (106, [1.0, 2.0], 1)]
    more = [(None, good[0][1], None), (7, good[1][1], 1), (7, good[1][1], 1)]
    got = H.whiten(make(spark, good + odd + more)).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(str(r[0]) for r in good + more)
    assert {r.n for r in got} == {43}


def test_without_variance_and_empty(spark):
    plain = H.components(H.whiten(make(spark, vectors(30, 3, 1))))
    for rows in ([], [(1, [1.0, 2.0, 3.0], 0)], [(i, [1.0, 2.0, 3.0], 0) for i in range(5)], [(1, None, 0), (2, [], 0)]):
        out = H.components(H.whiten(make(spark, rows)))
        assert out.count() == 0 and out.dtypes == plain.dtypes
    flat = [(i, [float(i % 5), 2.0 * (i % 5), 1.0], 0) for i in range(20)]  # rank one
    got = H.components(H.whiten(make(spark, flat))).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-9 for r in got)


def test_clashing_columns_and_other_names(spark):
    df = make(spark, vectors(30, 3, 5))
    for c in ("x", "k0", "size", "weight", "n", "deviation", "whitened"):
        df = df.withColumn(c, F.lit("mine"))
    out = H.whiten(df.withColumnRenamed("embedding", "vec"), key_cols=("vec_id", "label"), vector_col="vec")
    assert out.count() == 30 and out.columns[:2] == ["vec_id", "label"]
    assert H.components(out).where("deviation IS NULL").count() == 0


def test_deviation_beyond_64_bits_is_exact(spark):
    rows = [(i, [3.0e7 * (i + 1), -2.0e7 * i * i], 0) for i in range(3)]
    n, _, want = brute(rows)
    got = {r.vec_id: r for r in H.components(H.whiten(make(spark, rows))).where("component = 1").collect()}
    assert {k: int(r.deviation_exact) for k, r in got.items()} == {k: v[0] for k, v in want.items()}
    assert all((r.deviation == want[k][0]) if want[k][0] < 2**63 else r.deviation is None for k, r in got.items())
    assert any(v[0] >= 2**63 for v in want.values())


def test_weights_are_checked(spark):
    with pytest.raises(ValueError):
        H.whiten(make(spark, []), weights="other")

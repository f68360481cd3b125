"""Synthetic data generation (G1–G5) as Spark jobs.

Each generator draws one candidate sample per row of a key table (any
DataFrame with a key column), so generation is partitioned like its
input and grows with it. Per-row randomness is a hash of (key, seed, tag)
(md5 where a SQL oracle reproduces the draw, xxhash64 elsewhere);
the few shared model constants (weight matrices of a few × d entries)
come from a seeded numpy generator on the driver and enter the plan as
literals. Labels that need a global statistic (median, class balance,
z-score) use distributed aggregates.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equisel.functions.exprs import md5_normal, md5_uniform
from equisel.operators.profile import exact_quantiles
from equisel.operators.split import balanced_take


def _lit_matrix(m) -> F.Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in np.atleast_2d(m)])


def _lit_vec(v) -> F.Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _dot(a: F.Column, b: F.Column) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _matvec(m: F.Column, v: F.Column) -> F.Column:
    return F.transform(m, lambda row: _dot(row, v))


def _zscore_array(df: DataFrame, x: str, d: int) -> DataFrame:
    """Column-wise z-score (population std) of a fixed-width array column."""
    st = df.agg(*[F.avg(F.col(x)[i]).alias(f"m{i}") for i in range(d)],
                *[F.stddev_pop(F.col(x)[i]).alias(f"s{i}") for i in range(d)]).first()
    mu = [st[f"m{i}"] for i in range(d)]
    sd = [st[f"s{i}"] or 1.0 for i in range(d)]
    return df.withColumn(x, F.transform(F.col(x), lambda v, i: (v - F.element_at(_lit_vec(mu), i + 1)) /
                                        F.element_at(_lit_vec(sd), i + 1)))


#: Least share of draws that must lie outside the margin.
MIN_SHARE = 1e-5


def share_outside(d: int, margin: float) -> float:
    """P(|Σx| > margin) for x uniform in [−1, 1]^d (Irwin–Hall)."""
    def below(t):
        return sum((-1) ** k * math.comb(d, k) * (t - k) ** d for k in range(math.floor(t) + 1)) / math.factorial(d) if t > 0 else 0.0
    return 2 * below((d - margin) / 2)


def gen_linearly_separable(keys: DataFrame, key: str, d: int, margin: float, seed: int = 0, attempts: int = 8,
                           n: int | None = None) -> DataFrame:
    """G1: x uniform in [−1, 1]^d outside |Σx| ≤ margin, label −1 if Σx > 0
    else +1; optionally the first ``n`` by key. Each key keeps its first draw that
    passes: ``attempts`` draws in the first round, and twice as many in every
    further round for the keys that are left, until none is. A margin that fewer
    than ``MIN_SHARE`` of all vectors pass is an error."""
    if margin >= d:
        raise ValueError(f"no vector of [-1, 1]^{d} lies outside a margin of {margin}")
    if margin >= max(0, d - 2):
        return _corners(keys, key, d, margin, seed, n)
    if share_outside(d, margin) < MIN_SHARE:
        raise ValueError(f"less than {MIN_SHARE:g} of [-1, 1]^{d} lies outside a margin of {margin}")
    from equisel.session import materialise

    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)

    def draw(a):
        return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: 2 * md5_uniform(F.col(key), seed, a, i) - 1)

    out, left, start = None, keys.select(key), 0
    while True:
        tries = F.transform(F.sequence(F.lit(start), F.lit(start + attempts - 1)), draw)
        tried = materialise(left.select(key, F.get(F.filter(tries, lambda x: F.abs(total(x)) > margin), F.lit(0)).alias("x")))
        found = tried.where(F.col("x").isNotNull())
        out = found if out is None else out.unionByName(found)
        left = tried.where(F.col("x").isNull()).select(key)
        if left.isEmpty():
            break
        start, attempts = start + attempts, 2 * attempts
    out = out.withColumn("y", F.when(total(F.col("x")) > 0, -1).otherwise(1))
    return out.orderBy(key).limit(n) if n else out


def _corners(keys: DataFrame, key: str, d: int, margin: float, seed: int, n: int | None) -> DataFrame:
    """Uniform outside a margin of at least d − 2: 1 − |x_i| along a random
    corner's axes is uniform in the simplex of sum d − margin."""
    spacing = F.transform(F.sequence(F.lit(0), F.lit(d)), lambda i: -F.ln(1 - md5_uniform(F.col(key), seed, "corner", i)))
    side = F.when(md5_uniform(F.col(key), seed, "side") < 0.5, F.lit(1.0)).otherwise(F.lit(-1.0))
    out = keys.select(key, spacing.alias("__e"), side.alias("__s"))
    whole = F.aggregate("__e", F.lit(0.0), lambda acc, v: acc + v)
    x = F.transform(F.slice("__e", 1, d), lambda v: F.col("__s") * (1 - v / whole * F.lit(float(d - margin))))
    out = out.select(key, x.alias("x"), F.when(F.col("__s") > 0, -1).otherwise(1).alias("y"))
    return out.orderBy(key).limit(n) if n else out


def hidden_manifold_constants(d: int, m: int, seed: int = 0):
    """Feature matrix F (m × d), biases (d), hidden weights W (m × m), readout v (m)."""
    rng = np.random.default_rng(seed)
    Fm = rng.normal(size=(m, d))
    bias = 2 * rng.uniform(size=d) - 1
    W = rng.normal(size=(m, m))
    v = rng.normal(size=m)
    return Fm, bias, W, v


def hyperplane_constants(d: int, n_hyperplanes: int, dim_hyperplanes: int, seed: int = 0):
    """Hyperplane weights and biases, and the linear embedding into d features."""
    rng = np.random.default_rng(seed)
    Wh = rng.uniform(size=(n_hyperplanes, dim_hyperplanes))
    bh = rng.uniform(size=n_hyperplanes)
    emb = rng.uniform(size=(dim_hyperplanes, d))
    return Wh, bh, emb


def gen_hidden_manifold(keys: DataFrame, key: str, d: int, m: int, seed: int = 0) -> DataFrame:
    """Latent c ~ N(0, I_m); x = tanh(c·F/√m − bias); label = sign of the
    one-layer tanh net v·tanh(W c)/√m minus its exact median."""
    Fm, bias, W, v = hidden_manifold_constants(d, m, seed)
    c = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: md5_normal(F.col(key), seed, "c", i))
    base = keys.select(key, c.alias("c"))
    x = F.transform(_matvec(_lit_matrix(Fm.T), F.col("c")), lambda z, i: F.tanh(z / math.sqrt(m) - F.element_at(_lit_vec(bias), i + 1)))
    h = F.transform(_matvec(_lit_matrix(W), F.col("c")), lambda z: F.tanh(z))
    net = _dot(_lit_vec(v), h) / math.sqrt(m)
    g = base.select(key, x.alias("x"), net.alias("__net"))
    med = exact_quantiles(g.select("__net"), [0.5]).first()["value"]
    return g.select(key, "x", F.when(F.col("__net") - F.lit(med) < 0, -1).otherwise(1).alias("y"))


def gen_hyperplanes_parity(keys: DataFrame, key: str, n: int, d: int, n_hyperplanes: int, dim_hyperplanes: int,
                           seed: int = 0) -> DataFrame:
    """Gaussian points in dim_hyperplanes; label from the parity of the
    number of hyperplanes with w·x + b > 0 (even parity → −1 after the
    class halves are stacked), first n/2 of each class (X8), linear
    embedding into d features, z-score."""
    Wh, bh, emb = hyperplane_constants(d, n_hyperplanes, dim_hyperplanes, seed)
    z = F.transform(F.sequence(F.lit(0), F.lit(dim_hyperplanes - 1)), lambda i: md5_normal(F.col(key), seed, "z", i))
    base = keys.select(key, z.alias("z"))
    acts = F.transform(_matvec(_lit_matrix(Wh), F.col("z")), lambda s, i: F.when(s + F.element_at(_lit_vec(bh), i + 1) > 0, 1).otherwise(0))
    ones = F.aggregate(acts, F.lit(0), lambda acc, v: acc + v)
    lab = base.withColumn("y", F.when(ones % 2 == 0, -1).otherwise(1))
    take = balanced_take(lab, n, "y", key)
    x = _matvec(_lit_matrix(emb.T), F.col("z"))
    out = take.select(key, x.alias("x"), "y")
    return _zscore_array(out, "x", d)


def two_curves_coefficients(d: int, degree: int, seed: int = 0) -> np.ndarray:
    """The shared Fourier coefficient tensor (d, degree + 1, 2), unit Frobenius norm."""
    rng = np.random.default_rng(seed)
    co = rng.uniform(size=(d, degree + 1, 2))
    return co / np.linalg.norm(co)


def gen_two_curves(keys: DataFrame, key: str, d: int, degree: int, offset: float, noise: float, seed: int = 0) -> DataFrame:
    """Points on a Fourier-series curve (shared unit-norm coefficient
    tensor) and on its copy shifted by ``offset``; class by a hash coin;
    Gaussian noise; z-score."""
    co = two_curves_coefficients(d, degree, seed)
    t = md5_uniform(F.col(key), seed, "t")
    cls = F.when(md5_uniform(F.col(key), seed, "cls") < 0.5, -1).otherwise(1)
    scaling = math.pi

    def comp(i):
        expr = F.lit(float(co[i, 0, 0] + co[i, 0, 1]))
        for f in range(1, degree + 1):
            expr = expr + F.lit(float(co[i, f, 0])) * F.cos(F.lit(f * scaling) * t) + \
                F.lit(float(co[i, f, 1])) * F.sin(F.lit(f * scaling) * t)
        return expr + md5_normal(F.col(key), seed, "n", i) * noise + F.when(cls == 1, F.lit(offset)).otherwise(0.0)

    out = keys.select(key, F.array(*[comp(i) for i in range(d)]).alias("x"), cls.alias("y"))
    return _zscore_array(out, "x", d)


def gen_bars_and_stripes(keys: DataFrame, key: str, height: int, width: int, noise_std: float, seed: int = 0) -> DataFrame:
    """±1 images; a coin picks bars (rows switched on, label −1) or
    stripes (columns switched on, label +1); Gaussian pixel noise. The
    image is flattened row-major."""
    bars = md5_uniform(F.col(key), seed, "coin") > 0.5
    row_on = F.array(*[md5_uniform(F.col(key), seed, "r", r) > 0.5 for r in range(width)])
    col_on = F.array(*[md5_uniform(F.col(key), seed, "c", c) > 0.5 for c in range(height)])

    def pix(r, c):
        on = F.when(bars, F.element_at(row_on, r + 1) if r < width else F.lit(False)).otherwise(
            F.element_at(col_on, c + 1) if c < height else F.lit(False))
        return F.when(on, 1.0).otherwise(-1.0) + md5_normal(F.col(key), seed, "px", r * width + c) * noise_std

    img = F.array(*[pix(r, c) for r in range(height) for c in range(width)])
    return keys.select(key, img.alias("x"), F.when(bars, -1).otherwise(1).alias("y"))

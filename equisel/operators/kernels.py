"""Feature maps and similarity against landmarks (K1–K5).

Pairwise kernels are never an n × n cross product. One side is a bounded
landmark set (``MAX_LANDMARKS`` is checked before anything is collected), a hash
sample of the rows, which goes along with every task, and each row computes its
whole kernel row as an array — no shuffle, no pair explosion. Random parameters and draws
come from md5 of (seed, tag, index / row key), so a recomputed partition
yields the same features and SQL can reproduce them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equisel.functions.exprs import TWO_POW_32, hash32, md5_normal, md5_uniform

MAX_LANDMARKS = 4096
LANDMARK_SEED = 11
MAX_PARAMS = 2_000_000


_u = md5_uniform
_normal = md5_normal


def kitchen_sink_params(spark: SparkSession, episodes: int, q: int, d: int, var: float = 1.0, seed: int = 0) -> DataFrame:
    """ω ~ N(0, var) of shape (episodes, q, d) and β ~ U(0, 2π) of shape
    (episodes, q) as one row of nested arrays (bounded, checked)."""
    if episodes * q * (d + 1) > MAX_PARAMS:
        raise ValueError("too many kitchen-sink parameters to broadcast")
    w = spark.range(episodes * q * d).select(
        (F.col("id") / (q * d)).cast("int").alias("e"), ((F.col("id") / d).cast("int") % q).alias("i"),
        (F.col("id") % d).cast("int").alias("j"), (_normal(seed, "w", F.col("id")) * math.sqrt(var)).alias("w"))
    b = spark.range(episodes * q).select((F.col("id") / q).cast("int").alias("e"), (F.col("id") % q).cast("int").alias("i"),
                                         (_u(seed, "b", F.col("id")) * 2 * math.pi).alias("b"))
    wi = w.groupBy("e", "i").agg(F.array_sort(F.collect_list(F.struct("j", "w"))).alias("ws")).select(
        "e", "i", F.transform("ws", lambda s: s["w"]).alias("w"))
    ei = wi.join(b, ["e", "i"]).groupBy("e").agg(F.array_sort(F.collect_list(F.struct("i", "w", "b"))).alias("qs"))
    one = ei.agg(F.array_sort(F.collect_list(F.struct("e", "qs"))).alias("eps"))
    return one.select(
        F.transform("eps", lambda s: F.transform(s["qs"], lambda t: t["w"])).alias("omegas"),
        F.transform("eps", lambda s: F.transform(s["qs"], lambda t: t["b"])).alias("betas"))


def random_binary_features(df: DataFrame, x: str, key: str, episodes: int, q: int | None = None, var: float = 1.0,
                           seed: int = 0, out: str = "qfeatures") -> DataFrame:
    """K1: for each episode θ = ω·x + β; bit_i ~ Bernoulli(sin²(θ_i/2)) (the
    single-qubit X rotations measured once), then the CNOT layer as XORs:
    pairs (0→1, 2→3, …), then i→i+2 in order, which is a running XOR over
    same-parity positions. Bits of all episodes are concatenated. The
    Bernoulli draw is seeded by (row key, episode, qubit) so fit and
    predict see the same bits."""
    d = len(df.select(x).first()[0])
    q = q or d
    p = kitchen_sink_params(df.sparkSession, episodes, q, d, var, seed).first()  # bounded, checked
    omega, beta = np.array(p["omegas"], dtype=float).reshape(episodes * q, d), np.array(p["betas"], dtype=float).ravel()
    tails = [f":{e}:{i}".encode() for e in range(episodes) for i in range(q)]
    md5 = hashlib.md5

    @F.arrow_udf("array<int>")
    def bits(texts: pa.Array, xs: pa.Array) -> pa.Array:
        whole = pc.equal(pc.list_value_length(xs), d).fill_null(False)
        flat = xs.filter(whole).flatten()
        v = flat.to_numpy(zero_copy_only=False).reshape(pc.sum(whole).as_py() or 0, d)
        lacks = flat.is_null().to_numpy(zero_copy_only=False).reshape(v.shape).any(axis=1)
        theta = np.zeros((len(v), len(beta)))
        for k in range(d):
            theta += v[:, k, None] * omega[:, k]
        # one measurement shot: bit ~ Bernoulli(sin²(θ/2)), seeded by (row, episode, qubit); 0 where x lacks a value
        heads = texts.filter(whole).to_pylist()
        u = np.frombuffer(b"".join([md5(h + t).digest()[:4] for h in map(str.encode, heads) for t in tails]), ">u4").reshape(theta.shape)
        raw = np.zeros((len(xs), episodes, q), dtype=np.int32)
        with np.errstate(invalid="ignore"):
            hit = ~(np.sin((theta + beta) / 2) ** 2 <= u / TWO_POW_32)  # NaN counts as large, as in SQL
        raw[whole.to_numpy(zero_copy_only=False)] = (hit & ~lacks[:, None]).reshape(-1, episodes, q)
        # CNOT(i, i+1) for even i
        for i in range(1, q, 2):
            raw[:, :, i] ^= raw[:, :, i - 1]
        # CNOT(i, i+2) in order: running XOR over positions of the same parity
        for i in range(2, q):
            raw[:, :, i] ^= raw[:, :, i - 2]
        ends = np.arange(0, raw.size + 1, episodes * q, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(raw.ravel()))

    text = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)), F.lit("bit"))
    return df.withColumn(out, bits(text, F.col(x).cast("array<double>")))


# ---------------------------------------------------------------- product kernel
def landmarks(df: DataFrame, key: str, cols: Sequence[str], m: int) -> DataFrame:
    """A landmark set of ``m`` rows in the order of a seeded hash of the key (a
    uniform sample; ``m`` is bounded because the set rides on every row)."""
    if m > MAX_LANDMARKS:
        raise ValueError(f"at most {MAX_LANDMARKS} landmarks")
    return df.orderBy(hash32(key, LANDMARK_SEED), key).limit(m).select(key, *cols)


def _landmark_row(lm: DataFrame, key: str, value: F.Column, name: str) -> DataFrame:
    """All landmarks as one row: array of ``value`` ordered by key."""
    return lm.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))),
                              lambda s: s["v"]).alias(name))


def product_kernel(df: DataFrame, lm: DataFrame, x: str, key: str, out: str = "kernel") -> DataFrame:
    """K(row, l) = Π_f (3 + cos(row_f − l_f)) / 4 for every landmark l, as an
    array per row (landmarks in key order)."""
    lrow = _landmark_row(lm, key, F.col(x), "__lm")
    j = df.crossJoin(F.broadcast(lrow))  # one row of bounded landmarks
    k = F.transform(F.col("__lm"), lambda l: F.aggregate(
        F.zip_with(F.col(x), l, lambda a, b: (F.lit(3.0) + F.cos(a - b)) / 4), F.lit(1.0), lambda acc, v: acc * v))
    return j.withColumn(out, k).drop("__lm")


def rbf_gamma(df: DataFrame, x: str) -> float:
    """γ = 1 / (var_pop of all values of the vectors · d), one aggregate."""
    st = df.select(F.explode(x).alias("v"), F.size(x).alias("d")).agg(F.var_pop("v").alias("var"), F.max("d").alias("d")).first()
    return 1.0 / (st["var"] * st["d"]) if st["var"] else 1.0


def rbf_kernel(df: DataFrame, lm: DataFrame, x: str, key: str, gamma_factor: float = 1.0, gamma: float | None = None,
               out: str = "kernel") -> DataFrame:
    """K4: exp(−γ · factor · ‖v − l‖²) against every landmark, array per row."""
    g = rbf_gamma(df, x) if gamma is None else gamma
    near = squared_distances([v for v in _landmark_row(lm, key, F.col(x), "l").first()["l"]])
    return df.withColumn(out, F.transform(near(F.col(x).cast("array<double>")), lambda v: F.exp(F.lit(-g * gamma_factor) * v)))


def squared_distances(points: list):
    """A function of a vector column: ‖v − p‖² for each of ``points`` (bounded,
    collected) as an array; null where either lacks a value or sizes differ."""
    sizes = {n: [i for i, p in enumerate(points) if p is not None and len(p) == n and None not in p]
             for n in {len(p) for p in points if p is not None}}
    sets = {n: (at, np.array([points[i] for i in at], dtype=float).reshape(len(at), n)) for n, at in sizes.items()}
    m = len(points)

    @F.arrow_udf("array<double>")
    def distances(xs: pa.Array) -> pa.Array:
        res, known = np.zeros((len(xs), m)), np.zeros((len(xs), m), dtype=bool)
        for n, (at, p) in sets.items():
            whole = pc.equal(pc.list_value_length(xs), n).fill_null(False)
            flat = xs.filter(whole).flatten()
            rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
            v = flat.to_numpy(zero_copy_only=False).reshape(len(rows), n)
            full = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(v.shape).any(axis=1)
            for s in range(0, len(rows), 1024):
                acc = np.zeros((len(rows[s : s + 1024]), len(at)))
                for k in range(n):  # in order, as a running sum
                    acc += (v[s : s + 1024, k, None] - p[:, k]) ** 2
                res[np.ix_(rows[s : s + 1024], at)] = acc
            known[np.ix_(rows[full], at)] = True
        flat = pa.array(res.ravel()) if known.all() else pa.array(res.ravel(), mask=~known.ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(xs) + 1, dtype=np.int32) * m), flat)

    return distances


def class_mean_similarity(df: DataFrame, train: DataFrame, x: str, key: str, y: str, n_examples: int, out: str = "proba") -> DataFrame:
    """Mean product kernel with ``n`` training examples of class −1 and of +1
    (a hash sample of each, n clipped to the smaller class), normalised to sum
    1; the label is the larger side."""
    sides = train.agg(F.count_if(F.col(y) == -1).alias("neg"), F.count_if(F.col(y) == 1).alias("pos")).first()
    n = min(n_examples, sides["neg"], sides["pos"])
    if not n:
        raise ValueError("both classes need at least one training example")
    neg = landmarks(train.where(F.col(y) == -1), key, [x], n)
    pos = landmarks(train.where(F.col(y) == 1), key, [x], n)
    a = product_kernel(df, neg, x, key, "__kn")
    b = product_kernel(a, pos, x, key, "__kp")
    mean = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda acc, v: acc + v) / F.size(F.col(c))
    s_neg, s_pos = mean("__kn"), mean("__kp")
    tot = s_neg + s_pos
    res = b.withColumn(out, F.array(s_neg / tot, s_pos / tot)).drop("__kn", "__kp")
    return res.withColumn("y_pred", F.when(F.element_at(out, 2) > F.element_at(out, 1), 1).otherwise(-1))

"""Embedding whitening by a covariance weighted with multiplicities.

Equal integer vectors are grouped first (summed per task, so a vector that a
third of all rows share is one row per task). The distinct vectors, weighted
with their counts (or with one each), give exact integer sums, then one
centred, weighted matrix product per task; the d x d parts are added up in
Spark and only their sum, d (d + 1) / 2 numbers, reaches the driver, which
solves the d x d eigenproblem. Each distinct vector is whitened once and the
results are joined back to the rows.

A row is left out if its vector is null, empty or holds a null, NaN or infinite
entry, or if its length is not the most common one (ties: the longest), as one
covariance has one dimension. Components without variance (eigenvalue under
d * 2.2e-16 of the largest) are not returned, as dividing by their root is
undefined; so equal vectors only, or one, give no rows. Null and repeated keys
and extra columns are fine. An entry whose 64 c + 1000000 is no 64-bit integer
is an arithmetic error.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .hot import join_back
from .store import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Most dimensions: the driver holds two d x d matrices.
MAX_DIMS = 4096
_LONG = 1 << 63


def integers(df: DataFrame, vector_col: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` and x, the integer vector, of the rows whose entries are all finite."""
    c = F.col(f"`{vector_col}`")
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    bad = F.exists(c, odd)
    # filters on x may be asked before the one on the entries, and an infinite entry has no integer
    x = F.transform(c, lambda v: F.when(~odd(v), F.floor(F.lit(float(SCALE)) * v.cast("double")) + F.lit(SHIFT)))
    return df.where(c.isNotNull() & (F.size(c) > 0)).where(~bad).select(*(F.col(f"`{k}`") for k in keep), x.alias("x"))


def _matrix(column, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def weighted_sums(vectors: DataFrame, col: str, d: int) -> tuple[int, list]:
    """(sum of ``weight``, sums of ``weight`` times each entry). Integer entries
    are added exactly; a sum beyond 64 bits is an error."""
    whole = "bigint" in vectors.schema[col].dataType.simpleString()
    kind = "long" if whole else "double"

    def run(batches):
        total, n = np.zeros(d, dtype=np.int64 if whole else float), 0
        for b in batches:
            m, w = _matrix(b.column(0), d), b.column(1).to_numpy()
            if whole and len(w) and float(np.abs(m).max()) * float(w.sum()) + float(np.abs(total).max()) >= _LONG:
                raise OverflowError("sums of the vectors exceed 64 bits")
            total, n = total + (m * w[:, None]).sum(axis=0), n + int(w.sum())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(total), pa.array(np.full(d, n))], ["dim", "value", "n"])

    got = vectors.select(col, "weight").mapInArrow(run, f"dim int, value {kind}, n long").groupBy("dim").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).collect()
    values = {r["dim"]: r["value"] for r in got}
    return (got[0]["n"] if got else 0), [values.get(i, 0) for i in range(d)]


def covariance(vectors: DataFrame, col: str, base: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """Weighted covariance with divisor ``n``; entries are centred by ``base``
    (exactly, where both are integers) and ``rest`` before they are multiplied."""
    d = len(base)
    upper = np.triu_indices(d)

    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            y = (_matrix(b.column(0), d) - base).astype(float) - rest
            total += (y * b.column(1).to_numpy()[:, None]).T @ y
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[upper])], ["i", "j", "value"])

    out = np.zeros((d, d))
    for r in vectors.select(col, "weight").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["value"] / n
    return out


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns), falling, with variance;
    each vector's entry of largest size is positive."""
    e, p = np.linalg.eigh(v)
    e, p = e[::-1], p[:, ::-1]
    k = min(most, int((e > len(e) * np.finfo(float).eps * max(e[0], 0.0)).sum()) if e[0] > 0 else 0)
    p = p[:, :k] * np.sign(p[np.abs(p[:, :k]).argmax(axis=0), np.arange(k)])
    return e[:k], p


def _deviations(x: np.ndarray, base: np.ndarray, left: np.ndarray, n: int) -> pa.Array:
    """Sums of (n x - S)^2, exact, where S = n base + left."""
    y = x - base
    bound = float(np.abs(y).max(initial=0) + 1) * n
    if bound * bound * len(base) < _LONG:
        return pa.array(((n * y - left) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    exact = ((n * y.astype(object) - left.astype(object)) ** 2).sum(axis=1)
    return pa.array([int(v) for v in exact], pa.decimal128(38, 0))


def whiten(df: DataFrame, key_cols: Sequence[str] = ("vec_id",), vector_col: str = "embedding", components: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """One row per remaining row of ``df``: the key columns, x, deviation
    (decimal), whitened (array, one entry per component), n, explained (array)
    and identity_error. ``weights``: "counts" fits on all rows, "one" on the
    distinct vectors."""
    if weights not in ("counts", "one"):
        raise ValueError("weights: counts or one")
    spark, keys = df.sparkSession, [f"k{i}" for i in range(len(key_cols))]
    rows = integers(df, vector_col, key_cols).toDF(*keys, "x")
    vectors = written(rows.groupBy("x").agg(F.count(F.lit(1)).alias("size")), "vectors")
    length = vectors.groupBy(F.size("x").alias("d")).agg(F.sum("size").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    back = [F.col(k).alias(c) for k, c in zip(keys, key_cols, strict=True)]
    if length is None:
        return rows.select(*back, "x", *(F.lit(None).cast(t).alias(c) for c, t in (
            ("deviation", "decimal(38,0)"), ("whitened", "array<double>"), ("n", "long"), ("explained", "array<double>"), ("identity_error", "double"))))
    d, total = length["d"], length["n"]
    if d > MAX_DIMS:
        raise ValueError(f"more than {MAX_DIMS} dimensions")
    rows = rows.where(F.size("x") == d)
    vectors = vectors.where(F.size("x") == d).withColumn("weight", F.col("size") if weights == "counts" else F.lit(1).cast("long"))

    n, sums = weighted_sums(vectors, "x", d)
    base, left = np.array([s // n for s in sums]), np.array([s % n for s in sums])
    v = covariance(vectors, "x", base, left / n, n)
    e, p = principal(v, components)
    scaled = p / np.sqrt(e)

    def run(batches):
        for b in batches:
            x = _matrix(b.column(0), d)
            white = ((x - base).astype(float) - left / n) @ scaled
            flat = pa.ListArray.from_arrays(np.arange(0, white.size + 1, len(e) or 1, dtype=np.int32) if len(e) else np.zeros(len(x) + 1, dtype=np.int32), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _deviations(x, base, left, n), flat], ["x", "size", "weight", "deviation", "whitened"])

    white = written(vectors.select("x", "size", "weight").mapInArrow(run, "x array<long>, size long, weight long, deviation decimal(38,0), whitened array<double>"), "whitened")
    error = None
    if len(e):
        _, mean = weighted_sums(white, "whitened", len(e))
        error = float(np.abs(covariance(white, "whitened", np.array(mean) / n, np.zeros(len(e)), n) - np.eye(len(e))).max())
    out = join_back(rows, white, "x", "size", total)
    return out.select(*back, "x", "deviation", "whitened", F.lit(n).cast("long").alias("n"),
                      F.array(*(F.lit(float(a)) for a in e / np.trace(v))).cast("array<double>").alias("explained") if len(e) else F.array().cast("array<double>").alias("explained"),
                      F.lit(error).cast("double").alias("identity_error"))


def components(found: DataFrame, key_col: str = "vec_id") -> DataFrame:
    """One row per row and component. ``deviation`` is null where the exact
    value is no 64-bit integer; ``deviation_exact`` always holds it."""
    k = F.size("whitened")
    each = found.select(F.col(key_col).alias("vec_id"), "n", "deviation", "whitened", "explained", "identity_error",
                        F.explode(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))).alias("component"))
    return each.select("vec_id", "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.element_at("whitened", F.col("component")).alias("whitened"),
                       F.element_at("explained", F.col("component")).alias("explained"), "identity_error", F.col("deviation").alias("deviation_exact"))

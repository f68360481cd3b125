"""Deterministic hashing and guarded arithmetic as Spark Column expressions.

Everything here is a built-in expression, so it stays inside whole-stage
codegen. Randomness that is ever joined back or recomputed is derived from
``md5(key || ':' || seed)`` instead of ``rand()``: recomputation after an
executor loss then yields the same values, and DuckDB can express the same
number (first 8 hex digits of the md5, read as an unsigned 32-bit integer).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash32(key, seed) -> Column:
    """h(key, seed): first 8 hex digits of md5(key || ':' || seed) as bigint.

    ``seed`` is an int literal or a Column (e.g. a per-trial seed)."""
    seed_text = F.lit(f":{seed}") if isinstance(seed, int) else F.concat(F.lit(":"), seed.cast("string"))
    text = F.concat(_col(key).cast("string"), seed_text)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def unit_hash(key, seed) -> Column:
    """u(key, seed) = h(key, seed) / 2^32, uniform in [0, 1)."""
    return hash32(key, seed) / F.lit(TWO_POW_32)


def safe_div(num, den, zero=0.0) -> Column:
    """num / den, with ``zero`` when the denominator is 0 (0/0 -> 0 convention)."""
    num, den = _col(num), _col(den)
    return F.when(den == 0, F.lit(zero)).otherwise(num.cast("double") / den)


def nan_to_null(c) -> Column:
    """NaN and +-inf become NULL (pandas treats NaN as missing; JSON has no NaN)."""
    c = _col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def is_missing(c, numeric: bool) -> Column:
    c = _col(c)
    return (c.isNull() | F.isnan(c)) if numeric else c.isNull()


def r6(c, digits: int = 6) -> Column:
    """Round derived doubles so independent engines agree on printed values
    (adding 0.0 turns a rounded −0.0 into 0.0)."""
    return F.round(_col(c).cast("double"), digits) + F.lit(0.0)


def xx_uniform(*parts) -> Column:
    """Fast uniform [0, 1) from xxhash64 of the parts (for synthetic data
    without a SQL oracle; reproducible on recomputation)."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.pmod(F.xxhash64(*cols), F.lit(2 ** 53)).cast("double") / F.lit(float(2 ** 53))


def xx_normal(*parts) -> Column:
    """Standard normal by Box–Muller from two xxhash uniforms."""
    u1 = (xx_uniform(*parts, "a") * F.lit(float(2 ** 53)) + 1) / F.lit(float(2 ** 53) + 1)
    u2 = xx_uniform(*parts, "b")
    return F.sqrt(-2 * F.ln(u1)) * F.cos(2 * 3.141592653589793 * u2)


def md5_uniform(*parts) -> Column:
    """Uniform [0, 1) from the first 8 hex digits of md5(parts joined by ':')
    — reproducible in DuckDB (slower than ``xx_uniform``)."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(TWO_POW_32)


def md5_normal(*parts) -> Column:
    """Standard normal by Box–Muller from two md5 uniforms (u1 shifted into (0, 1])."""
    u1 = (md5_uniform(*parts, "a") * F.lit(TWO_POW_32) + 1) / F.lit(TWO_POW_32 + 1)
    u2 = md5_uniform(*parts, "b")
    return F.sqrt(-2 * F.ln(u1)) * F.cos(2 * 3.141592653589793 * u2)


def key_of(by):
    """One column for a list of key columns. A struct is never NULL itself and
    equals another where all fields are equal, a NULL field to a NULL field:
    rows whose key is NULL meet in joins and windows like any others."""
    return F.struct(*[F.col(c) for c in by])


def join_on(left, right, keys, how: str = "inner"):
    """``left.join(right, on=keys)``, except that NULL keys meet each other."""
    keys, k = list(keys), "__key"
    out = left.withColumn(k, key_of(keys)).join(right.withColumn(k, key_of(keys)).drop(*keys), k, how)
    rest = [c for c in out.columns if c != k and c not in keys]
    return out.select(*[F.col(f"{k}.{c}").alias(c) for c in keys], *rest)


def refuse(df, bad, message: str):
    """``df``, failing with ``message`` at a row for which ``bad`` holds. The
    check is a filter, so it goes with the plan; put it on aggregated rows."""
    return df.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def indexed_explode(df, arr: str, pos: str = "pos", value: str = "value", keep: list | None = None):
    """One row per array element with its 0-based position (the rows
    ``posexplode`` gives). Positions come from ``explode(sequence)`` and
    values from ``element_at``: in this Spark build a generator over a
    stored array column runs an order of magnitude slower than that form.
    Empty and NULL arrays give no rows."""
    n = F.size(F.col(arr))
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cols = [F.col(c) for c in (keep if keep is not None else [c for c in df.columns if c != arr])]
    out = df.select(*cols, F.col(arr).alias("__arr"), F.explode(idx).alias(pos))
    return out.withColumn(value, F.element_at(F.col("__arr"), F.col(pos) + 1)).drop("__arr")


def melt(df, pairs, key: str = "column", value: str = "value"):
    """Wide → long: one row per (key literal, value Column) pair, via
    ``inline`` over an array of structs (faster than ``stack`` on raw rows
    in this Spark build)."""
    arr = F.array(*[F.struct(F.lit(k).alias(key), v.alias(value)) for k, v in pairs])
    return df.select(F.inline(arr))

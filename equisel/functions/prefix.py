"""Scale-safe running totals (prefix sums) without a global window.

A ``Window.orderBy(x)`` with no ``partitionBy`` moves every row into one
task. Instead the ordered key range is cut into buckets at approximate
quantiles (a bounded list of boundaries reaches the driver), each
``(by..., bucket)`` is summed in a small table, the per-bucket offsets are
a window over that small table, and the final running sum is a window
partitioned by ``(by..., bucket)`` plus the offset. Every window partition
holds about ``rows / n_buckets`` rows, and a hot ``by`` key is spread over
all buckets. The boundaries are literals, so recomputation after an
executor loss re-buckets identically.

``by`` columns may be NULL: NULL is a group like any other.

Rows must be unique on ``by + order_cols`` (aggregate ties first, as curves
do) unless ``order_cols`` ends with a unique tie-breaker.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exprs import key_of

_BUCKET = "__bucket"
_KEY = "__by"


def _n_buckets(df: DataFrame, n_buckets: int | None) -> int:
    if n_buckets:
        return n_buckets
    spark = df.sparkSession
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _is_numeric(df: DataFrame, c: str) -> bool:
    from pyspark.sql import types as T

    return isinstance(df.schema[c].dataType, T.NumericType)


def add_range_bucket(df: DataFrame, order_cols: str | Sequence[str], n_buckets: int | None = None) -> DataFrame:
    """Add ``__bucket``: range bucket of the order columns, in their order.

    The first column is cut at approximate quantiles. A value that holds
    several of them (a tie of at least 1/n of the rows) is cut again at the
    quantiles of the next numeric order column, so a tied value is spread over
    as many buckets as it has shares of the rows."""
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    order_col = order_cols[0]
    n = _n_buckets(df, n_buckets)
    probs = [i / n for i in range(1, n)]
    row = df.select(F.percentile_approx(F.col(order_col).cast("double"), probs, 10000).alias("q")).first()
    found = [float(b) for b in (row["q"] or []) if b is not None and math.isfinite(b)]
    bounds = sorted(set(found))
    tied = {b: found.count(b) for b in bounds if found.count(b) > 1}
    out = _first_bucket(df, order_col, bounds)
    if not tied or len(order_cols) == 1 or not _is_numeric(df, order_cols[1]):
        return out
    value, second = F.col(order_col).cast("double"), F.col(order_cols[1]).cast("double")
    cuts = df.where(value.isin(list(tied))).groupBy(value.alias("v")).agg(F.percentile_approx(second, probs, 10000).alias("q"))
    sub = F.lit(0)
    for r in cuts.collect():  # at most n / 2 tied values with n cuts each
        k, q = tied[r["v"]] + 1, [x for x in r["q"] or [] if math.isfinite(x)]
        inner = sorted({q[i * len(q) // k] for i in range(1, k)}) if q else []
        step = F.size(F.filter(F.array(*map(F.lit, inner)), lambda x: x < second)) if inner else F.lit(0)
        sub = F.when(value == F.lit(r["v"]), step).otherwise(sub)
    # a tied value is a lower limit: its rows come first in its bucket, by part, then the rest
    return out.withColumn(_BUCKET, F.when(F.col(_BUCKET) < 0, F.col(_BUCKET)).otherwise(
        F.col(_BUCKET) * (n + 1) + F.when(value.isin(list(tied)), F.coalesce(sub, F.lit(0))).otherwise(F.lit(n))))


def _first_bucket(df: DataFrame, order_col: str, bounds: list[float]) -> DataFrame:
    splits = [float("-inf"), *bounds, float("inf")]
    if len(splits) < 3:
        return df.withColumn(_BUCKET, F.when(F.col(order_col).isNull(), F.lit(-1.0)).otherwise(F.lit(0.0)))
    tmp = "__order_dbl"
    out = Bucketizer(splits=splits, inputCol=tmp, outputCol=_BUCKET, handleInvalid="keep").transform(
        df.withColumn(tmp, F.col(order_col).cast("double"))
    )
    # NULL order values get bucket −1: first when ascending, last when descending,
    # which is Spark's default null placement for both directions
    return out.withColumn(_BUCKET, F.when(F.col(tmp).isNull(), F.lit(-1.0)).otherwise(F.col(_BUCKET))).drop(tmp)


def running_totals(
    df: DataFrame,
    order_cols: str | Sequence[str],
    sum_cols: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    prefix: str = "cum_",
    n_buckets: int | None = None,
) -> DataFrame:
    """Add ``<prefix><c>`` = sum of ``c`` over rows up to and including this one.

    Order is ``order_cols`` ascending (or descending) within each ``by`` group.
    The first order column must be numeric; it defines the range buckets.
    """
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    by = list(by)
    b = add_range_bucket(df, order_cols, n_buckets)
    bucket_order = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()

    b = b.withColumn(_KEY, key_of(by)) if by else b.withColumn(_KEY, F.lit(0))  # one key, in which NULLs meet
    totals = b.groupBy(_KEY, _BUCKET).agg(*[F.sum(c).alias(f"__tot_{c}") for c in sum_cols])
    before = Window.partitionBy(_KEY).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        _KEY,
        _BUCKET,
        *[F.coalesce(F.sum(f"__tot_{c}").over(before), F.lit(0)).alias(f"__off_{c}") for c in sum_cols],
    )

    ords = [F.col(c).desc() if descending else F.col(c).asc() for c in order_cols]
    within = Window.partitionBy(_KEY, _BUCKET).orderBy(*ords).rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(offsets, on=[_KEY, _BUCKET], how="inner")
    out = out.select(
        *[c for c in b.columns if c not in (_BUCKET, _KEY)],
        *[(F.col(f"__off_{c}") + F.sum(c).over(within)).alias(f"{prefix}{c}") for c in sum_cols],
    )
    return out


def dense_position(
    df: DataFrame,
    order_cols: str | Sequence[str],
    by: Sequence[str] = (),
    name: str = "pos",
    descending: bool = False,
    n_buckets: int | None = None,
) -> DataFrame:
    """1-based row position within ``by`` ordered by ``order_cols`` (skew-safe row_number)."""
    one = "__one"
    out = running_totals(
        df.withColumn(one, F.lit(1).cast("long")), order_cols, [one], by, descending, prefix="__cum", n_buckets=n_buckets
    )
    return out.withColumnRenamed(f"__cum{one}", name).drop(one)


def running_agg(
    df: DataFrame,
    order_cols: str | Sequence[str],
    cols: Sequence[str],
    fn: str = "max",
    by: Sequence[str] = (),
    descending: bool = False,
    inclusive: bool = True,
    prefix: str = "run_",
    n_buckets: int | None = None,
) -> DataFrame:
    """Running ``min``/``max``/``sum`` of ``cols`` in the order of
    ``order_cols`` within ``by``, with the same bucket decomposition as
    ``running_totals``. ``inclusive=False`` excludes the current row (e.g.
    "best among strictly earlier rows")."""
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    by = list(by)
    agg = {"max": F.max, "min": F.min, "sum": F.sum}[fn]
    b = add_range_bucket(df, order_cols, n_buckets)
    bucket_order = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()
    b = b.withColumn(_KEY, key_of(by)) if by else b.withColumn(_KEY, F.lit(0))
    totals = b.groupBy(_KEY, _BUCKET).agg(*[agg(c).alias(f"__tot_{c}") for c in cols])
    before = Window.partitionBy(_KEY).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_KEY, _BUCKET, *[agg(f"__tot_{c}").over(before).alias(f"__off_{c}") for c in cols])
    ords = [F.col(c).desc() if descending else F.col(c).asc() for c in order_cols]
    end = 0 if inclusive else -1
    within = Window.partitionBy(_KEY, _BUCKET).orderBy(*ords).rowsBetween(Window.unboundedPreceding, end)
    out = b.join(offsets, on=[_KEY, _BUCKET], how="inner")

    def combine(c):
        w = agg(c).over(within)
        off = F.col(f"__off_{c}")
        if fn == "sum":
            return F.coalesce(off, F.lit(0)) + F.coalesce(w, F.lit(0))
        pick = F.greatest if fn == "max" else F.least  # both skip NULLs
        return pick(off, w)

    return out.select(*[c for c in b.columns if c not in (_BUCKET, _KEY)], *[combine(c).alias(f"{prefix}{c}") for c in cols])


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence, k: int, salt_col: str,
                    n_salts: int = 32, rank_col: str = "rank") -> DataFrame:
    """Top ``k`` rows per group in two rounds: top k per (group, salt) over
    a hash salt, then top k per group over at most ``n_salts × k`` rows,
    so a hot group never lands in one window partition whole."""
    by = list(by)
    salt = F.pmod(F.xxhash64(F.col(salt_col)), F.lit(n_salts))
    w1 = Window.partitionBy(*by, "__salt").orderBy(*order)
    first = df.withColumn("__salt", salt).withColumn("__r1", F.row_number().over(w1)).where(F.col("__r1") <= k)
    w2 = Window.partitionBy(*by).orderBy(*order)
    return first.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k).drop("__salt", "__r1")


def sliding(df: DataFrame, pos_col: str, aggs: dict, width: int, by: Sequence[str] = (), block: int = 4096) -> DataFrame:
    """Aggregates over the last rows of each group in the order of the dense
    1-based ``pos_col``. ``aggs`` maps an output name to (aggregate, first,
    last): the frame from ``first`` to ``last`` rows back. Rows are cut into
    blocks of positions, each with the ``width`` rows before it carried along,
    so frames are exact (no differences of large sums) and a long group is
    many window partitions."""
    by, block = list(by), max(block, 2 * width)
    at = F.floor((F.col(pos_col) - 1) / block)
    own = df.withColumn("__block", at).withColumn("__carried", F.lit(False))
    tail = df.where((F.col(pos_col) - 1) % block >= block - width).withColumn("__block", at + 1).withColumn("__carried", F.lit(True))
    over = Window.partitionBy(*by, "__block").orderBy(pos_col)
    out = own.unionByName(tail)
    out = out.withColumns({name: agg.over(over.rowsBetween(-first, -last)) for name, (agg, first, last) in aggs.items()})
    return out.where(~F.col("__carried")).drop("__block", "__carried")

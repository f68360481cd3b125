"""Profiling (P1–P9): one pass per table with one aggregate list.

Per-column statistics are computed in long form (``stack`` of
``(column, value)``) so adding columns adds rows, not aggregate buffers.
Exact quantiles use value counts + the bucketed prefix count instead of
``percentile`` (which keeps a value→count map in one buffer)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equisel.functions.exprs import melt, r6
from equisel.functions.prefix import running_totals

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
ONEHOT_CAP = 10
ORDINAL_CAP = 100


def is_numeric_type(dt) -> bool:
    return isinstance(dt, NUMERIC) or isinstance(dt, T.BooleanType)


def column_types(df: DataFrame) -> list[tuple[str, str, bool]]:
    """(column, dtype, numeric) from the schema (no data pass)."""
    return [(f.name, f.dataType.simpleString(), is_numeric_type(f.dataType)) for f in df.schema.fields]


def _missing(c: str, dt) -> F.Column:
    col = F.col(f"`{c}`")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def _long(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, value string) for every non-missing cell of the chosen columns."""
    fields = [f for f in df.schema.fields if cols is None or f.name in cols]
    pairs = [(f.name, F.when(_missing(f.name, f.dataType), None).otherwise(F.col(f"`{f.name}`")).cast("string"))
             for f in fields]
    return melt(df, pairs).where(F.col("value").isNotNull())


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """P1+P2+P3+P7 as one table: (column, dtype, is_numeric, n_rows,
    n_missing, n_unique). Missing = NULL or NaN.

    Exact: a single long-form pass — every cell becomes (column, value or
    NULL), grouped by (column, value) with map-side combining; rows,
    missing and distinct counts per column come from that table.
    ``exact=False`` uses one wide aggregate with HyperLogLog distinct counts."""
    fields = df.schema.fields
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), is_numeric_type(f.dataType)) for i, f in enumerate(fields)],
        "i int, column string, dtype string, is_numeric boolean",
    )
    if exact:
        pairs = [(i, F.when(_missing(f.name, f.dataType), None).otherwise(F.col(f"`{f.name}`").cast("string")))
                 for i, f in enumerate(fields)]
        long = melt(df, pairs, "i", "value")
        vc = long.groupBy("i", "value").agg(F.count(F.lit(1)).alias("c"))
        per = vc.groupBy("i").agg(F.sum("c").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), F.col("c"))).alias("n_missing"),
                                  F.count("value").alias("n_unique"))
        out = meta.join(per, "i", "left")
        return out.select("column", "dtype", "is_numeric", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
                          F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"),
                          F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"))
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count_if(_missing(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(fields)]
    aggs += [F.approx_count_distinct(F.col(f"`{f.name}`")).alias(f"u{i}") for i, f in enumerate(fields)]
    one = df.agg(*aggs)
    mu = ", ".join(f"{i}, m{i}, u{i}" for i in range(len(fields)))
    st = one.select("__rows", F.expr(f"stack({len(fields)}, {mu}) AS (i, n_missing, n_unique)"))
    out = meta.join(F.broadcast(st), "i")  # one row per column
    return out.select("column", "dtype", "is_numeric", F.col("__rows").alias("n_rows"),
                      F.col("n_missing").cast("long").alias("n_missing"), F.col("n_unique").cast("long").alias("n_unique"))


def missing_counts(df: DataFrame) -> DataFrame:
    """Nulls per column plus the grand total row ``__total__``."""
    p = profile(df, exact=False).select("column", "n_missing")
    tot = p.agg(F.lit("__total__").alias("column"), F.sum("n_missing").cast("long").alias("n_missing"))
    return p.unionByName(tot)


def unique_counts(df: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct non-null values per column."""
    return profile(df, exact).select("column", "n_unique")


def candidate_targets(df: DataFrame, max_values: int = 20) -> DataFrame:
    """Columns with ≤ ``max_values`` distinct values and those values,
    sorted (Spark has no first-seen order; documented change). Counts come
    first; values are gathered only for qualifying columns, so no list
    grows past ``max_values``."""
    vals = _long(df).distinct()
    n = vals.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique")).where(F.col("n_unique") <= max_values)
    keep = vals.join(F.broadcast(n), "column")  # ≤ number of columns rows
    return keep.groupBy("column", "n_unique").agg(F.array_sort(F.collect_list("value")).alias("values"))


def head(df: DataFrame, n: int = 10, key: str | None = None) -> DataFrame:
    """P5: first n rows by key (limit is the feature)."""
    return (df.orderBy(key) if key else df).limit(n)


def exact_quantiles(df: DataFrame, probs: Sequence[float], cols: Sequence[str] | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per numeric column, long form
    ``(column, prob, value)``. Works from ``(column, value, count)`` and a
    bucketed prefix count, so no task holds a whole column."""
    fields = [f for f in df.schema.fields if is_numeric_type(f.dataType) and (cols is None or f.name in cols)]
    return long_quantiles(melt(df, [(f.name, F.col(f"`{f.name}`").cast("double")) for f in fields]), probs)


def long_quantiles(long: DataFrame, probs: Sequence[float]) -> DataFrame:
    """:func:`exact_quantiles` of a long table ``(column, value)``."""
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
    # the value-count table feeds the bucket boundaries and the running counts:
    # write it once to the shared checkpoint folder (lineage cut, one raw pass)
    from equisel.session import materialise
    vc = materialise(vc)
    cum = running_totals(vc, "value", ["c"], by=["column"])  # cum_c = rows with value ≤ this one
    n = vc.groupBy("column").agg(F.sum("c").alias("n"))
    spark = long.sparkSession
    pr = spark.createDataFrame([(float(p),) for p in probs], "prob double")
    ranks = n.crossJoin(F.broadcast(pr)).select(
        "column", "prob", "n", (F.col("prob") * (F.col("n") - 1)).alias("r"))
    ranks = ranks.select("*", F.floor("r").alias("lo"), F.ceil("r").alias("hi"))
    # the value at 0-based rank k is the one with cum_c - c <= k < cum_c; both ranks in one join (columns x probs rows)
    before = F.col("cum_c") - F.col("c")
    holds = lambda k: (before <= F.col(k)) & (F.col(k) < F.col("cum_c"))
    q = cum.join(F.broadcast(ranks), "column").where(holds("lo") | holds("hi")).groupBy("column", "prob", "r", "lo").agg(
        *(F.max(F.when(holds(k), F.col("value"))).alias(f"v_{k}") for k in ("lo", "hi")))
    val = F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (F.col("r") - F.col("lo"))
    return q.select("column", "prob", val.alias("value"))


def describe(df: DataFrame) -> DataFrame:
    """Long ``(column, stat, value)`` for numeric columns (booleans
    excluded, as pandas does): count, mean, std (ddof=1), min, 25%, 50%,
    75% (exact, linear), max; NaN → 0."""
    fields = [f for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    long = melt(df, [(f.name, F.col(f"`{f.name}`").cast("double")) for f in fields]).where(
        F.col("value").isNotNull() & ~F.isnan("value"))
    st = long.groupBy("column").agg(
        F.count("value").cast("double").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    st_long = st.select("column", F.expr("stack(5, 'count', `count`, 'mean', mean, 'std', std, 'min', `min`, 'max', `max`) AS (stat, value)"))
    q = exact_quantiles(df, [0.25, 0.5, 0.75], [f.name for f in fields]).select(
        "column", F.concat((F.col("prob") * 100).cast("int").cast("string"), F.lit("%")).alias("stat"), "value")
    out = st_long.unionByName(q)
    return out.select("column", "stat", r6(F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0))).alias("value"))


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns)."""
    return df.count(), len(df.columns)


def class_distribution(df: DataFrame, y: str = "y") -> DataFrame:
    """Value counts of the target, descending."""
    return df.groupBy(F.col(y).alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.col("count").desc(), F.col("value"))


def select_usable_columns(df: DataFrame, target: str, method: str = "onehot") -> DataFrame:
    """Decide per column whether it can be used: the target is dropped,
    categoricals over the cap (10 one-hot, 100 ordinal) are dropped,
    ``smart`` keeps numeric columns only. Result ``(column, kept, reason)``."""
    cap = {"onehot": ONEHOT_CAP, "ordinal": ORDINAL_CAP, "smart": None}[method]
    p = profile(df.drop(target), exact=True)
    cat_over = (~F.col("is_numeric")) & F.lit(cap is not None) & (F.col("n_unique") > F.lit(cap or 0))
    reason = (F.when(~F.col("is_numeric") & F.lit(method == "smart"), "non-numeric")
              .when(cat_over, F.concat(F.lit("more than "), F.lit(str(cap)), F.lit(" categories"))))
    return p.select("column", reason.isNull().alias("kept"), reason.alias("reason"))


# ---------------------------------------------------------------- stored sketches
#: Bits of the distinct-count sketches (relative error about 0.8 %) and size of
#: the quantile sketches (rank error under 1 %).
HLL_BITS, KLL_K = 14, 400


def sketch_profile(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """P3 / P4 as stored sketches: one row per ``by`` key and column with count,
    nulls, a distinct-count sketch (HyperLogLog) and, for numeric columns, a
    quantile sketch (KLL), least and greatest value. One aggregate of raw rows
    with map-side merging: what is shuffled is a sketch per task, key and column,
    never a value. Rows of several runs (days, partitions) can be kept in one
    table and merged with :func:`merge_sketches`."""
    by = list(by)
    cols = [c for c in (columns or df.columns) if c not in by]
    aggs, parts = [], []
    for i, c in enumerate(cols):
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        v = F.col(f"`{c}`")
        if numeric:
            v = F.when(F.isnan(v.cast("double")), F.lit(None)).otherwise(v)
        plain = v if isinstance(df.schema[c].dataType, (T.LongType, T.IntegerType, T.StringType)) else v.cast("string")
        aggs += [F.count(v).alias(f"n{i}"), F.count_if(v.isNull()).alias(f"z{i}"), F.hll_sketch_agg(plain, HLL_BITS).alias(f"h{i}")]
        if numeric:
            aggs += [F.kll_sketch_agg_double(v.cast("double"), KLL_K).alias(f"q{i}"), F.min(v.cast("double")).alias(f"lo{i}"), F.max(v.cast("double")).alias(f"hi{i}")]
        more = [F.col(f"q{i}"), F.col(f"lo{i}"), F.col(f"hi{i}")] if numeric else [F.lit(None).cast("binary"), F.lit(None).cast("double"), F.lit(None).cast("double")]
        parts.append(F.struct(F.lit(c).alias("column"), *(x.alias(n) for x, n in zip(
            (F.col(f"n{i}"), F.col(f"z{i}"), F.col(f"h{i}"), *more), ("n", "nulls", "hll", "kll", "least", "greatest"), strict=True))))
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*parts)))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stored rows of :func:`sketch_profile` added up per ``by`` key and column."""
    return sketches.groupBy(*by, "column").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.hll_union_agg("hll").alias("hll"),
        F.when(F.count("kll") > 0, F.kll_merge_agg_double("kll", KLL_K)).alias("kll"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def read_sketches(sketches: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Estimates: n, nulls, distinct, least, greatest and the quantiles asked
    for (array; NULL where a column is not numeric or has no value)."""
    keep = [c for c in sketches.columns if c not in ("hll", "kll")]
    asked = F.array(*[F.lit(float(p)) for p in probs])
    quantiles = F.when(F.col("kll").isNotNull() & (F.col("n") > 0), F.kll_sketch_get_quantile_double("kll", asked))
    return sketches.select(*keep, F.hll_sketch_estimate("hll").alias("distinct"), quantiles.alias("quantiles"))

"""Feature encoding and scaling.

Fitting collects only bounded constants (medians, ≤ 100 categories per
column, means / deviations / ranges per column); applying them is one
``select`` of built-in expressions. Category discovery runs in long form
and checks the cap *before* any value list is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equisel.functions.exprs import melt, nan_to_null
from equisel.operators.profile import ONEHOT_CAP, ORDINAL_CAP, exact_quantiles, is_numeric_type

MISSING = "missing"


def _q(c: str) -> F.Column:
    return F.col(f"`{c}`")


def bool_to_double(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Boolean → 0.0 / 1.0."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({c: _q(c).cast("double") for c in cols})


def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact medians (linear interpolation, as pandas) of numeric columns."""
    if not cols:
        return {}
    q = exact_quantiles(df.select(*[_q(c).cast("double").alias(c) for c in cols]), [0.5], cols).collect()
    got = {r["column"]: r["value"] for r in q}
    return {c: got.get(c) for c in cols}


def impute_median(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, dict]:
    """Numeric NULL/NaN → exact column median. Returns the frame and
    ``{column: (median, n_imputed)}``."""
    cols = cols or [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
    med = fit_medians(df, cols)
    miss = df.agg(*[F.count_if(_q(c).isNull() | F.isnan(_q(c).cast("double"))).alias(c) for c in cols]).first()
    out = df.withColumns({c: F.coalesce(F.nanvl(_q(c).cast("double"), F.lit(None)), F.lit(med[c])) for c in cols})
    return out, {c: (med[c], int(miss[c])) for c in cols}


def impute_missing_category(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-numeric → string; NULL → ``missing`` (a category of its own)."""
    return df.withColumns({c: F.coalesce(_q(c).cast("string"), F.lit(MISSING)) for c in cols})


def fit_categories(df: DataFrame, cols: Sequence[str], cap: int, method: str) -> dict[str, list[str]]:
    """Sorted categories per column (after E3). More than ``cap`` categories
    is an error naming the column; the check runs before values are
    gathered, so nothing unbounded reaches the driver."""
    if not cols:
        return {}
    long = melt(df, [(c, F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING))) for c in cols]).distinct()
    n = {r["column"]: r["n"] for r in long.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    for c in cols:
        if n.get(c, 0) > cap:
            if method == "onehot":
                raise ValueError(f"{c!r}: {n[c]} categories, one-hot columns are limited to {cap}; try ordinal codes")
            raise ValueError(f"{c!r}: {n[c]} categories, ordinal codes are limited to {cap}; is it a key?")
    cats: dict[str, list[str]] = {c: [] for c in cols}
    for r in long.collect():  # ≤ cap × columns rows, checked above
        cats[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in cats.items()}


def ordinal_expr(c: str, categories: list[str]) -> F.Column:
    """code/(K−1) over sorted categories, denominator ≥ 1."""
    denom = float(max(len(categories) - 1, 1))
    m = F.create_map(*[x for i, k in enumerate(categories) for x in (F.lit(k), F.lit(i / denom))])
    return m[F.coalesce(_q(c).cast("string"), F.lit(MISSING))]


def onehot_exprs(c: str, categories: list[str]) -> list[F.Column]:
    """E5: one 0/1 double column ``<col>_<category>`` per category."""
    v = F.coalesce(_q(c).cast("string"), F.lit(MISSING))
    return [(v == F.lit(k)).cast("double").alias(f"{c}_{k}") for k in categories]


def encode_features(df: DataFrame, method: str = "ordinal", keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """E6 (+E7): make every feature numeric, keeping row count and column
    order. Returns ``(encoded, metadata)`` where metadata is the table
    ``(column, kind, categories, imputed, out_columns)``. Columns in
    ``keep`` (keys, target, split) pass through untouched."""
    if method not in ("ordinal", "onehot"):
        raise ValueError(f"method is 'ordinal' or 'onehot', not {method!r}")
    fields = [f for f in df.schema.fields if f.name not in keep]
    bools = [f.name for f in fields if isinstance(f.dataType, T.BooleanType)]
    nums = [f.name for f in fields if is_numeric_type(f.dataType) and f.name not in bools]
    cats_cols = [f.name for f in fields if not is_numeric_type(f.dataType)]
    cap = ONEHOT_CAP if method == "onehot" else ORDINAL_CAP
    cats = fit_categories(df, cats_cols, cap, method)
    med = fit_medians(df, nums)
    miss = df.agg(F.lit(0).alias("__z"), *[
        F.count_if(_q(c).isNull() | (F.isnan(_q(c).cast("double")) if c in nums else F.lit(False))).alias(c)
        for c in nums + cats_cols + bools]).first()
    exprs, meta = [], []
    for f in df.schema.fields:
        c = f.name
        if c in keep:
            exprs.append(_q(c))
        elif c in bools:
            exprs.append(F.coalesce(_q(c).cast("double"), F.lit(0.0)).alias(c))
            meta.append((c, "numeric", None, int(miss[c]), [c]))
        elif c in nums:
            exprs.append(F.coalesce(F.nanvl(_q(c).cast("double"), F.lit(None)), F.lit(med[c])).alias(c))
            meta.append((c, "numeric", None, int(miss[c]), [c]))
        elif method == "onehot":
            oh = onehot_exprs(c, cats[c])
            exprs.extend(oh)
            meta.append((c, "onehot", cats[c], int(miss[c]), [f"{c}_{k}" for k in cats[c]]))
        else:
            exprs.append(ordinal_expr(c, cats[c]).alias(c))
            meta.append((c, "ordinal", cats[c], int(miss[c]), [c]))
    spark = df.sparkSession
    mdf = spark.createDataFrame(meta, "column string, kind string, categories array<string>, imputed long, "
                                      "out_columns array<string>")
    return df.select(*exprs), mdf


def passthrough_columns(metadata: DataFrame) -> DataFrame:
    """Encoded output columns (already in [0, 1]) that skip scaling."""
    return metadata.where(F.col("kind").isin("ordinal", "onehot")).select(
        "column", F.explode("out_columns").alias("out_column"))


def fit_moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    st = df.agg(*[F.avg(nan_to_null(_q(c))).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(nan_to_null(_q(c))).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: (st[f"m{i}"], st[f"s{i}"]) for i, c in enumerate(cols)}


def zscore(df: DataFrame, cols: Sequence[str], passthrough: Sequence[str] = (), fit_on: str = "all",
           split: str = "split", scaling: float = 1.0) -> DataFrame:
    """(x − mean) / population std, a constant column divides by 1.
    ``fit_on="all"`` fits on every row (the reference fits before the split);
    ``"train"`` fits on ``split = 'train'`` rows only. Then × ``scaling``."""
    cols = [c for c in cols if c not in passthrough]
    fit = df if fit_on == "all" else df.where(F.col(split) == "train")
    mo = fit_moments(fit, cols)
    def z(c):
        m, s = mo[c]
        s = 1.0 if (s is None or s == 0 or math.isnan(s)) else s
        return ((nan_to_null(_q(c)) - F.lit(m)) / F.lit(s) * F.lit(scaling)).alias(c)
    return df.withColumns({c: z(c) for c in cols})


def minmax_scale(df: DataFrame, cols: Sequence[str], lo: float = -math.pi / 2, hi: float = math.pi / 2,
                 fit_on: str = "train", split: str = "split", scaling: float = 1.0) -> DataFrame:
    """Fit min/max on the train rows, map to [lo, hi], a constant
    column maps to lo; then × ``scaling``."""
    fit = df if fit_on == "all" else df.where(F.col(split) == "train")
    st = fit.agg(*[F.min(nan_to_null(_q(c))).alias(f"a{i}") for i, c in enumerate(cols)],
                 *[F.max(nan_to_null(_q(c))).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    def s(i, c):
        mn, mx = st[f"a{i}"], st[f"b{i}"]
        rng = (mx - mn) if (mx is not None and mn is not None and mx != mn) else 1.0
        scale = (hi - lo) / rng
        return ((nan_to_null(_q(c)) * F.lit(scale) + F.lit(lo - (mn or 0.0) * scale)) * F.lit(scaling)).alias(c)
    return df.withColumns({c: s(i, c) for i, c in enumerate(cols)})


def assemble_array(df: DataFrame, cols: Sequence[str], out: str = "x") -> DataFrame:
    return df.withColumn(out, F.array(*[_q(c).cast("double") for c in cols]))


def amplitude_encode(df: DataFrame, arr: str = "x", scaling: float = 1.0, out: str | None = None) -> DataFrame:
    """× scaling, pad to the next power of two with 1/width, divide by
    the L2 norm (array expressions, no UDF)."""
    out = out or arr
    x = F.transform(F.col(arr), lambda v: v * F.lit(scaling))
    d = F.size(F.col(arr))
    width = F.pow(F.lit(2.0), F.ceil(F.log2(d.cast("double")))).cast("int")
    padded = F.concat(x, F.array_repeat(F.lit(1.0) / width.cast("double"), width - d))
    norm = F.sqrt(F.aggregate(padded, F.lit(0.0), lambda acc, v: acc + v * v))
    return df.withColumn(out, F.transform(padded, lambda v: v / norm))


def pad_multiple_of_3(df: DataFrame, arr: str = "x", out: str | None = None) -> DataFrame:
    """Append (3 − d) mod 3 zeros (non-negative modulo)."""
    out = out or arr
    n = F.pmod(F.lit(3) - F.size(F.col(arr)), F.lit(3))
    return df.withColumn(out, F.concat(F.col(arr), F.array_repeat(F.lit(0.0), n)))


def pca_project(df: DataFrame, cols: Sequence[str], k: int, split: str = "split", out: str = "pca") -> DataFrame:
    """StandardScaler fitted on train applied to all rows, then PCA
    fitted on train and applied to all rows (``pyspark.ml``). Spark scales by
    the sample deviation; the result is rescaled to the population one."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    va = VectorAssembler(inputCols=list(cols), outputCol="__v", handleInvalid="keep").transform(df)
    train = va.where(F.col(split) == "train")
    sc = StandardScaler(inputCol="__v", outputCol="__s", withMean=True, withStd=True).fit(train)
    scaled = sc.transform(va)
    pca = PCA(k=k, inputCol="__s", outputCol="__p").fit(scaled.where(F.col(split) == "train"))
    n = max(2, train.count())
    wider = math.sqrt(n / (n - 1))
    return pca.transform(scaled).withColumn(out, F.transform(vector_to_array("__p"), lambda v: v * F.lit(wider))).drop("__v", "__s", "__p")

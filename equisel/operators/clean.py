"""Projection, filtering and cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equisel.functions.exprs import nan_to_null, safe_div


def select_features(df: DataFrame, x_cols: Sequence[str] | None = None, y_col: str | None = None) -> DataFrame:
    """Projection with checks; default target = last column, default
    features = all other columns."""
    cols = df.columns
    y_col = y_col or cols[-1]
    if y_col not in cols:
        raise ValueError(f"target column {y_col!r} not found")
    x_cols = list(x_cols) if x_cols is not None else [c for c in cols if c != y_col]
    if not x_cols:
        raise ValueError("no feature columns selected")
    missing = [c for c in x_cols if c not in cols]
    if missing:
        raise ValueError(f"feature columns not found: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in x_cols], F.col(f"`{y_col}`"))


def safe_column_names(df: DataFrame) -> DataFrame:
    """One-character column names become ``feat: <name>``."""
    return df.withColumnsRenamed({c: f"feat: {c}" for c in df.columns if len(c) == 1})


def nan_to_null_all(df: DataFrame) -> DataFrame:
    """NaN → NULL in every float column (pandas treats both as missing)."""
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in fl else F.col(f"`{c}`") for c in df.columns])


def drop_missing_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any NULL (NaN counts as NULL)."""
    return nan_to_null_all(df).dropna(how="any", subset=list(subset) if subset else None)


def recode(df: DataFrame, col: str, mapping: Mapping, out: str | None = None, literal_limit: int = 1000) -> DataFrame:
    """C4: value replacement, many-to-one allowed; unmapped values stay.

    Short maps become a literal map lookup (codegen'd); longer ones are
    joined as a table, which Spark broadcasts where its size allows. The
    result is the same."""
    out = out or col
    if not mapping:
        return df
    keys = list(mapping)
    if len(keys) <= literal_limit:
        m = F.create_map(*[x for k in keys for x in (F.lit(k), F.lit(mapping[k]))])
        return df.withColumn(out, F.coalesce(m[F.col(col)], F.col(col)))
    spark = df.sparkSession
    mdf = spark.createDataFrame([(k, mapping[k]) for k in keys], ["__k", "__v"])
    return df.join(mdf, F.col(col) == F.col("__k"), "left").withColumn(
        out, F.coalesce(F.col("__v"), F.col(col))).drop("__k", "__v")


def standardise_target_name(df: DataFrame, col: str, name: str = "target") -> DataFrame:
    """Derive ``target`` from a named column and drop the original."""
    return df.withColumnRenamed(col, name) if col != name else df


def two_class_filter(df: DataFrame, a, b, label: str = "label", out: str = "y") -> DataFrame:
    """Keep rows of classes a and b; a → −1, b → +1."""
    return df.where(F.col(label).isin(a, b)).withColumn(out, F.when(F.col(label) == F.lit(a), -1).otherwise(1))


def minmax_normalise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x − min)/(max − min) per column in one aggregate pass; a
    constant column maps to 0."""
    st = df.agg(*[F.min(nan_to_null(c)).alias(f"mn_{i}") for i, c in enumerate(cols)],
                *[F.max(nan_to_null(c)).alias(f"mx_{i}") for i, c in enumerate(cols)]).first()
    return df.withColumns({
        c: safe_div(nan_to_null(c) - F.lit(st[f"mn_{i}"]), F.lit(st[f"mx_{i}"]) - F.lit(st[f"mn_{i}"]))
        for i, c in enumerate(cols)
    })

"""Table access: parquet tables of a data folder, CSV/parquet I/O."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equisel.functions.exprs import nan_to_null


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder. Column pruning and filter
    pushdown reach the scan because every caller selects what it uses."""
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")


def read_table(
    spark: SparkSession,
    path: str,
    x_cols: Sequence[str] | None = None,
    y_col: str | None = None,
    fmt: str | None = None,
    schema=None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Header table → features + target in one DataFrame.

    ``y_col`` defaults to the last column, ``x_cols`` to all other columns;
    ``drop`` removes columns first (the fixed-target variant drops one).
    An explicit ``schema`` avoids the extra pass of CSV inference.
    """
    fmt = fmt or ("parquet" if path.endswith(".parquet") else "csv")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.load(path)
    if drop:
        df = df.drop(*drop)
    cols = df.columns
    if not cols:
        raise ValueError("table has no columns")
    y_col = y_col or cols[-1]
    if y_col not in cols:
        raise ValueError(f"target column {y_col!r} not in table")
    x_cols = list(x_cols) if x_cols else [c for c in cols if c != y_col]
    missing = [c for c in x_cols if c not in cols]
    if missing:
        raise ValueError(f"feature columns not in table: {missing}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    # NaN is a missing value
    cell = lambda c: nan_to_null(F.col(f"`{c}`")).alias(c) if isinstance(kinds[c], (T.FloatType, T.DoubleType)) else F.col(f"`{c}`")
    return df.select(*(cell(c) for c in (*x_cols, y_col)))


def read_headerless_xy(spark: SparkSession, path: str, sep: str = ",", schema=None) -> DataFrame:
    """No header; the last column is the label, the rest are features.
    An explicit ``schema`` avoids the inference pass."""
    reader = spark.read.option("header", False).option("sep", sep)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    cols = df.columns
    return df.select(*[F.col(c).alias(f"x{i}") for i, c in enumerate(cols[:-1])], F.col(cols[-1]).alias("y"))


def attach_target(features: DataFrame, targets: DataFrame | None, key: str = "row_id") -> DataFrame:
    """S3: features and targets side by side — an equi-join on the row key
    replaces the positional concat. ``targets`` is optional."""
    if targets is None:
        return features
    return features.join(targets, on=key, how="inner")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by=()) -> None:
    """Write without index (Spark has none); CSV gets a header."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)

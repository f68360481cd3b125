"""Splitting, sampling and alignment.

Row order is defined by ``hash32(key, seed)`` (ties by key), never by
``rand()``: the same rows land in the same split on every recomputation,
and a DuckDB oracle can reproduce it. Positions within a class come from
the bucketed prefix count (``dense_position``), so a class holding a third
of all rows is spread over many tasks instead of one window partition.
Split sizes are computed on the small per-class count table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equisel.functions.exprs import hash32, join_on, refuse
from equisel.functions.prefix import add_range_bucket, dense_position

_H = "__h"
_POS = "__pos"


def _class_counts(df: DataFrame, label: str) -> DataFrame:
    """``(label, n_c)``; a missing label is an error, never a row left out."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    return refuse(counts, F.col(label).isNull(), f"NULL in label column {label!r}")


def _quota(counts: DataFrame, label: str, frac: float, rounding: str = "floor") -> DataFrame:
    """Largest-remainder allocation on the class table: ``(label, n_c, quota)``.

    Total = floor (or ceil) of frac · n; each class gets floor(frac · n_c)
    and the classes with the largest remainders one more, ties to the
    smaller label. The class table is tiny (labels are capped at 20)."""
    w_all = Window.partitionBy()
    n = F.sum("n_c").over(w_all)
    total = F.floor(n * F.lit(float(frac))) if rounding == "floor" else F.ceil(n * F.lit(float(frac)))
    c = counts.withColumn("__share", F.col("n_c") * F.lit(float(frac))).withColumn("__base", F.floor("__share"))
    c = c.withColumn("__left", total - F.sum("__base").over(w_all))
    rk = F.row_number().over(Window.orderBy((F.col("__share") - F.col("__base")).desc(), F.col(label)))
    return c.withColumn("__rk", rk).select(
        label, "n_c", (F.col("__base") + F.when(F.col("__rk") <= F.col("__left"), 1).otherwise(0)).cast("long").alias("quota")
    )


def stratified_split(df: DataFrame, key: str = "row_id", label: str = "y", frac: float = 0.75, seed: int = 42,
                     out: str = "split", names=("train", "test")) -> DataFrame:
    """X1 (+X2): add ``split`` with exact sizes.

    n_train = floor(frac · n); per class floor(frac · n_c) plus one for the
    classes with the largest remainders until the total is reached. Rows
    of a class are taken in hash order. If any class has fewer than 2 rows
    the split is unstratified (X2): first floor(frac · n) rows in hash order.
    A row without a label is an error.
    The class table is tiny (labels are capped), it is the only thing
    windowed globally."""
    counts = _class_counts(df, label)
    min_c = counts.agg(F.min("n_c").alias("m")).first()["m"]
    base = df.withColumn(_H, hash32(key, seed))
    if min_c is None:
        return base.withColumn(out, F.lit(names[0])).drop(_H)
    if min_c < 2:
        n = counts.agg(F.sum("n_c")).first()[0]
        k = int(frac * n)
        pos = dense_position(base, [_H, key], name=_POS)
        return pos.withColumn(out, F.when(F.col(_POS) <= k, names[0]).otherwise(names[1])).drop(_H, _POS)
    q = _quota(counts, label, frac, "floor")
    pos = dense_position(base, [_H, key], by=[label], name=_POS)
    j = pos.join(q.select(label, "quota"), on=label, how="inner")  # Spark broadcasts the quotas where their size allows
    return j.withColumn(out, F.when(F.col(_POS) <= F.col("quota"), names[0]).otherwise(names[1])).drop(_H, _POS, "quota")


def validation_split(df: DataFrame, key: str = "row_id", label: str = "y", frac: float = 0.2, seed: int = 42,
                     split: str = "split", min_train: int = 10) -> DataFrame:
    """Carve ceil(frac · n_train) validation rows out of ``train``,
    stratified, in hash order. With fewer than ``min_train`` train rows no
    rows are carved (the test rows serve as validation). Idempotent: an
    existing ``val`` split is returned unchanged."""
    if df.where(F.col(split) == "val").limit(1).count() > 0:
        return df
    train = df.where(F.col(split) == "train")
    counts = _class_counts(train, label)
    n_train = counts.agg(F.sum("n_c")).first()[0] or 0
    if n_train < min_train:
        return df
    q = _quota(counts, label, frac, "ceil")
    base = df.withColumn(_H, hash32(key, seed))
    pos = dense_position(base.where(F.col(split) == "train"), [_H, key], by=[label], name=_POS)
    j = pos.join(q.select(label, "quota"), on=label, how="inner")
    carved = j.withColumn(split, F.when(F.col(_POS) <= F.col("quota"), "val").otherwise("train")).drop(_POS, "quota")
    return carved.drop(_H).unionByName(df.where(F.col(split) != "train"))


def align_sensitive(split_df: DataFrame, raw: DataFrame, column: str, key: str = "row_id",
                    max_groups: int = 20, out: str = "sensitive") -> DataFrame:
    """Attach the raw protected column to split rows by key (the equi
    join replaces positional alignment). Checks: column exists, every split
    row finds its raw row, at most ``max_groups`` distinct values."""
    if column not in raw.columns:
        raise ValueError(f"sensitive column {column!r} not found")
    j = split_df.join(raw.select(key, F.col(column).alias(out)), on=key, how="left")
    stats = j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(out).isNull()).alias("unmatched")).first()
    if stats["unmatched"]:
        raise ValueError(f"{stats['unmatched']} rows have no sensitive value (row counts differ)")
    if j.select(out).distinct().limit(max_groups + 1).count() > max_groups:
        raise ValueError(f"sensitive column {column!r} has more than {max_groups} groups")
    return j


def _drawn(df: DataFrame, batch: int, key: str, seeds: dict, by: str | None, draw: str, n_buckets: int | None) -> DataFrame:
    """``batch`` rows with replacement from every group of ``seeds`` (group →
    seed), without positions for all rows: rows are counted per range bucket of
    the key, a draw's position falls into one bucket by the counts, and only
    the rows of buckets that were drawn from are ranked."""
    group = F.col(by) if by else F.lit(0)
    spark = df.sparkSession
    b = add_range_bucket(df.withColumn("__g", group), key, n_buckets)
    counts: dict = {}
    for r in b.groupBy("__g", "__bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("__g", "__bucket").collect():  # groups x buckets rows
        counts.setdefault(r["__g"], []).append((float(r["__bucket"]), r["n"]))
    table = []
    for g, seed in seeds.items():
        start = 0
        for bucket, n in counts.get(g, []):
            table.append((g, seed, bucket, start, start + n))
            start += n
    kind = b.schema["__g"].dataType.simpleString()
    parts = spark.createDataFrame(table, f"`__g` {kind}, __seed int, __bucket double, __from long, __to long")
    ends = parts.groupBy("__g", "__seed").agg(F.max("__to").alias("__n"), F.array_sort(F.collect_list(F.struct("__to", "__from", "__bucket"))).alias("__parts"))
    draws = ends.withColumn(draw, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batch - 1).cast("long"))))
    draws = draws.withColumn(_POS, hash32(draw, F.col("__seed")) % F.col("__n") + 1)
    part = F.element_at("__parts", F.size(F.filter("__parts", lambda p: p["__to"] < F.col(_POS))) + 1)
    draws = draws.withColumn("__part", part).select(draw, "__g", _POS, "__part.__bucket", "__part.__from")
    wanted = draws.select("__g", "__bucket", "__from").distinct()  # at most groups x buckets rows
    own = b.join(F.broadcast(wanted), ["__g", "__bucket"])
    rank = F.row_number().over(Window.partitionBy("__g", "__bucket").orderBy(key))
    own = own.withColumn(_POS, F.col("__from") + rank).drop("__from", "__bucket")
    return own.join(draws.select("__g", _POS, draw), ["__g", _POS]).drop("__g", _POS)


def minibatch(df: DataFrame, batch: int, seed: int, key: str = "row_id", draw: str = "draw", n_buckets: int | None = None) -> DataFrame:
    """``batch`` rows drawn uniformly **with replacement**: draw j picks
    position hash32(j, seed) mod n of the rows in the order of the numeric key."""
    if batch <= 0 or df.isEmpty():
        return df.withColumn(draw, F.lit(None).cast("long")).limit(0)
    return _drawn(df, batch, key, {0: seed}, None, draw, n_buckets).select(*df.columns, draw)


def prefix_subset(df: DataFrame, n: int, key: str = "row_id") -> DataFrame:
    """First ``n`` rows by key (the limit is the feature)."""
    return df.orderBy(key).limit(n)


def even_downsample(df: DataFrame, order_col: str, by: Sequence[str] = (), max_points: int = 500,
                    descending: bool = False) -> DataFrame:
    """Per group keep positions unique(round_half_even(linspace(0, n−1, m)))
    of the rows ordered by ``order_col``; groups with n ≤ m are kept whole.

    Membership is tested with the two nearest grid indices — no join with
    the grid and no collect."""
    by = list(by)
    m = max_points
    pos = dense_position(df, order_col, by=by, name=_POS, descending=descending)
    if by:  # group sizes by partial aggregation, not a window over the whole group
        pos = join_on(pos, df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), by)
    else:
        total = df.count()
        pos = pos.withColumn("__n", F.lit(total))
    p0 = F.col(_POS) - 1
    span = (F.col("__n") - 1).cast("double")
    i0 = F.floor(p0 * F.lit(m - 1) / span)
    hit = F.lit(False)
    for d in (0, 1):
        i = F.least(F.greatest(i0 + d, F.lit(0)), F.lit(m - 1))
        hit = hit | (F.bround(i * (F.col("__n") - 1) / F.lit(float(m - 1)), 0) == p0)
    keep = (F.col("__n") <= m) | hit
    return pos.where(keep).drop(_POS, "__n")


def balanced_take(df: DataFrame, n: int, label: str = "y", key: str = "row_id") -> DataFrame:
    """First n/2 rows (by key) of each of two classes. A row without a
    label is an error."""
    df = refuse(df, F.col(label).isNull(), f"NULL in label column {label!r}")
    pos = dense_position(df, key, by=[label], name=_POS)
    return pos.where(F.col(_POS) <= n // 2).drop(_POS)


MAX_SPLITS = 20


def bootstrap_rows(df: DataFrame, n: int, seed: int, split: str = "split", key: str = "row_id") -> DataFrame:
    """``n`` rows with replacement from each split value separately, in one
    pass for all of them. More than ``MAX_SPLITS`` values are an error."""
    parts = [r[0] for r in df.where(F.col(split).isNotNull()).select(split).distinct().limit(MAX_SPLITS + 1).collect()]
    if len(parts) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} values in {split!r}")
    if n <= 0 or not parts:
        return df.withColumn("draw", F.lit(None).cast("long")).limit(0)
    seeds = {s: seed + i for i, s in enumerate(sorted(parts))}
    return _drawn(df.where(F.col(split).isNotNull()), n, key, seeds, split, "draw", None).select(*df.columns, "draw")

"""Target handling."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CLASSES = 20
BINARY_N_CLASSES = 2


@dataclass(frozen=True)
class TaskSpec:
    kind: str
    n_classes: int
    class_labels: list = field(default_factory=list)
    favorable_class: str | None = None
    favorable_code: int | None = None

    def as_row(self) -> tuple:
        return (self.kind, self.n_classes, list(self.class_labels), self.favorable_class, self.favorable_code)


TASK_SCHEMA = "kind string, n_classes int, class_labels array<string>, favorable_class string, favorable_code int"


def derive_task_spec(df: DataFrame, y: str = "y", label_mapping: dict | None = None,
                     favorable=None) -> TaskSpec:
    """Distinct target values as sorted strings (at most 21 reach the
    driver). <2 or >20 → error; 2 → binary [negative, positive] (a mapping
    ``{label: ±1}`` or ``{"neg": label, "pos": label}`` decides the order); >2 → multiclass, the favorable
    class must exist."""
    vals = [r[0] for r in df.select(F.col(y).cast("string")).distinct().limit(MAX_CLASSES + 2).collect()]
    if None in vals:
        raise ValueError(f"Column {y!r} has rows without a label; fill or drop them first")
    labels = sorted(vals)
    if len(labels) < 2:
        raise ValueError(f"Target column needs at least 2 classes, found {len(labels)}: {labels}")
    if len(labels) > MAX_CLASSES:
        raise ValueError(f"Target column has more than {MAX_CLASSES} classes")
    if len(labels) == BINARY_N_CLASSES:
        if label_mapping:
            if set(label_mapping) == {"neg", "pos"}:
                labels = [str(label_mapping["neg"]), str(label_mapping["pos"])]
            else:
                by_code = {int(v): str(k) for k, v in label_mapping.items()}
                if by_code.keys() >= {-1, 1}:
                    labels = [by_code[-1], by_code[1]]
            if sorted(labels) != sorted(vals):
                raise ValueError(f"Label mapping names {labels}, the column holds {sorted(vals)}")
        return TaskSpec("binary", 2, labels, labels[1], 1)
    fav = None if favorable is None else str(favorable)
    if fav is not None and fav not in labels:
        raise ValueError(f"Favorable class {fav!r} not among classes {labels}")
    return TaskSpec("multiclass", len(labels), labels, fav, labels.index(fav) if fav is not None else None)


def task_spec_frame(df: DataFrame, y: str = "y", **kw) -> DataFrame:
    spec = derive_task_spec(df, y, **kw)
    return df.sparkSession.createDataFrame([spec.as_row()], TASK_SCHEMA)


def encode_binary(df: DataFrame, spec: TaskSpec, y: str = "y", out: str = "y") -> DataFrame:
    """Positive label → +1, negative label → −1 (compared as text). A NULL
    or any other value is an error."""
    v = F.col(y).cast("string")
    other = F.raise_error(F.concat(F.lit(f"neither of the two labels {spec.class_labels}: "), F.coalesce(v, F.lit("NULL")))).cast("int")
    return df.withColumn(out, F.when(v == F.lit(spec.class_labels[1]), 1).when(v == F.lit(spec.class_labels[0]), -1).otherwise(other))


def encode_multiclass(df: DataFrame, spec: TaskSpec, y: str = "y", out: str = "y") -> DataFrame:
    """code = index in the sorted labels; an unseen value raises an
    error listing the known classes (``raise_error`` inside the plan)."""
    labels = F.array(*[F.lit(v) for v in spec.class_labels])
    pos = F.array_position(labels, F.col(y).cast("string"))
    msg = F.concat(F.lit("Unknown class "), F.col(y).cast("string"), F.lit(f"; known classes: {spec.class_labels}"))
    return df.withColumn(out, F.when(pos > 0, (pos - 1).cast("int")).otherwise(F.raise_error(msg).cast("int")))


def encode_target(df: DataFrame, spec: TaskSpec, y: str = "y", out: str = "y") -> DataFrame:
    return encode_binary(df, spec, y, out) if spec.kind == "binary" else encode_multiclass(df, spec, y, out)


def decode_labels(df: DataFrame, spec: TaskSpec, code: str = "y_pred", out: str = "label") -> DataFrame:
    """T4: −1/+1 (binary) or 0..K−1 → original name; out of range → its text."""
    c = F.col(code)
    codes = [-1, 1] if spec.kind == "binary" else list(range(spec.n_classes))
    # a map lookup yields NULL for an unknown code (element_at with a NULL
    # index on a literal array is not safe to rely on)
    m = F.create_map(*[x for k, v in zip(codes, spec.class_labels) for x in (F.lit(k), F.lit(v))])
    return df.withColumn(out, F.coalesce(m[c], c.cast("string")))


def pass_through_if_encoded(df: DataFrame, y: str = "y", out: str = "y") -> tuple[DataFrame, TaskSpec]:
    """T5: a target already ⊆ {−1, 1} (binary) or 0..K−1 (multiclass) is
    left as is; any other two-class target is mapped with T2."""
    spec = derive_task_spec(df, y)
    as_int = sorted(int(v) for v in spec.class_labels if _is_int(v)) if all(_is_int(v) for v in spec.class_labels) else None
    if as_int == [-1, 1] or (as_int is not None and spec.kind == "multiclass" and as_int == list(range(spec.n_classes))):
        return df.withColumn(out, F.col(y).cast("int")), spec
    if spec.kind == "binary":
        return encode_binary(df, spec, y, out), spec
    return encode_multiclass(df, spec, y, out), spec


def _is_int(v: str) -> bool:
    try:
        return float(v) == int(float(v))
    except ValueError:
        return False


def validate_codes(df: DataFrame, n_classes: int, y: str = "y") -> DataFrame:
    """Codes seen (train ∪ test) that are not in 0..K−1 (binary: ±1).
    Returns the offending codes; an empty result means valid."""
    spark = df.sparkSession
    valid = [-1, 1] if n_classes == 2 else list(range(n_classes))
    v = spark.createDataFrame([(c,) for c in valid], "code int")
    seen = df.select(F.col(y).cast("int").alias("code")).distinct()
    return seen.join(F.broadcast(v), "code", "left_anti")


def ovr_indicators(df: DataFrame, n_classes: int, y: str = "y") -> DataFrame:
    """K rows per row: ``(class_code, y_k)`` with +1 for the class, −1 otherwise."""
    return df.withColumn("class_code", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1)))).withColumn(
        "y_k", F.when(F.col(y) == F.col("class_code"), 1).otherwise(-1))


def balanced_class_weights(df: DataFrame, y: str = "y", out: str = "weight") -> DataFrame:
    """Weight n / (K · n_c) as a column (for ``weightCol``). The class
    table is bounded by the class cap."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("__nc"))
    tot = counts.agg(F.sum("__nc").alias("__n"), F.count(F.lit(1)).alias("__k"))
    w = counts.crossJoin(tot).select(y, (F.col("__n") / (F.col("__k") * F.col("__nc"))).alias(out))
    return df.join(w, y, "left")  # Spark broadcasts the class table where its size allows

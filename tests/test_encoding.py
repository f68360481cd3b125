import pytest
from pyspark.sql import functions as F

from equisel.operators import encode as E


def test_impute_median_and_onehot_missing(spark):
    df = spark.createDataFrame([(1.0, "a", True), (None, "b", False), (3.0, None, True), (5.0, "a", False)],
                               "num double, cat string, flag boolean")
    out, meta = E.encode_features(df, "onehot")
    rows = out.collect()
    assert [r["num"] for r in rows] == [1.0, 3.0, 3.0, 5.0]  # median 3.0 imputed
    assert set(out.columns) >= {"cat_a", "cat_b", "cat_missing", "flag"}
    assert [r["cat_missing"] for r in rows] == [0.0, 0.0, 1.0, 0.0]
    assert [r["flag"] for r in rows] == [1.0, 0.0, 1.0, 0.0]
    m = {r["column"]: r for r in meta.collect()}
    assert m["num"]["imputed"] == 1 and m["cat"]["kind"] == "onehot"


def test_ordinal_codes(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), (None, 3.0), ("c", 4.0), ("a", 5.0)], "cat string, num double")
    out, _ = E.encode_features(df, "ordinal")
    codes = [r["cat"] for r in out.collect()]
    assert codes == pytest.approx([1 / 3, 0.0, 1.0, 2 / 3, 0.0])


def test_cardinality_caps(spark):
    d15 = spark.createDataFrame([(str(i),) for i in range(15)], "id string")
    with pytest.raises(ValueError, match="one-hot"):
        E.encode_features(d15, "onehot")
    E.encode_features(d15, "ordinal")  # fine below 100
    d101 = spark.createDataFrame([(str(i),) for i in range(101)], "id string")
    with pytest.raises(ValueError, match="ordinal"):
        E.encode_features(d101, "ordinal")
    with pytest.raises(ValueError):
        E.encode_features(d15, "bogus")


def test_zscore_passthrough(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(v), float(c)) for v, c in zip(rng.normal(50, 10, 60), rng.integers(0, 2, 60))],
                               "num double, cat double")
    out = E.zscore(df, ["num", "cat"], passthrough=["cat"])
    r = out.agg(F.avg("num").alias("m"), F.stddev_pop("num").alias("s")).first()
    assert abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9
    assert [x["cat"] for x in out.collect()] == [x["cat"] for x in df.collect()]


def test_amplitude_and_padding(spark):
    df = spark.createDataFrame([([3.0, 4.0, 0.0],), ([1.0, 1.0, 1.0, 1.0, 1.0],)], "x array<double>")
    a = E.amplitude_encode(df, "x").collect()
    assert len(a[0]["x"]) == 4 and abs(sum(v * v for v in a[0]["x"]) - 1) < 1e-12
    p = E.pad_multiple_of_3(df, "x").collect()
    assert [len(r["x"]) for r in p] == [3, 6]

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from (doc_id, text) rows."""

    def make(rows, parts=3):
        full = [(i, t, None if i is None else "en", "src0", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts) if full else spark.createDataFrame([], DOCS)

    return make


@pytest.fixture(scope="session")
def words():
    """Seeded invented sentences."""

    def make(n, seed, vocabulary=400):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" + r.choice(["", "", ".", ","]) for _ in range(n))

    return make


#: Rows that every operator must take: nulls, empty, blank, repeated, very long, odd characters.
@pytest.fixture(scope="session")
def odd_rows(words):
    long = words(60_000, 9)
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "two words"), (6, words(90, 1)), (7, words(90, 1)), (7, words(90, 1)),
            (8, long), (9, "été ñandú 中文 İx \x00 \x1c end"), (None, "no id here at all"), (None, None), (10, words(90, 1).upper()),
            (11, "x" * 70_000), (12, words(120, 2))]


@pytest.fixture(scope="session")
def clashing(frame):
    """The table with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    def make(rows):
        out = frame(rows)
        for c in ("rk", "mz", "n", "fp", "h", "p", "tail", "label", "score", "word", "_rk", "_ranges", "kept", "component_id", "ids"):
            out = out.withColumn(c, F.lit(c))
        return out

    return make

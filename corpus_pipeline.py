"""Cleaning pipeline over ``documents``.

Five stages, each on all rows that the stage before kept, written as Parquet
and read again: toxic documents go; one document of each near-duplicate group
stays; passages that repeat are cut from the texts; documents contaminated with
benchmark items go; what is left is packed into training windows. All but the
last return the columns of ``documents``, with ``n_chars`` true to ``text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from equisel.llm import decontam, neardup, packing, substring, toxicity
from equisel.llm.store import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity score below 0.7, unchanged."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each component, unchanged."""
    return neardup.dedup(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row; words inside a window of 35 that occurs elsewhere are cut,
    and a text that loses words has the others joined by one space."""
    out = substring.dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than 5 % of the words lie in benchmark windows."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a training window, with its ids."""
    return packing.pack(docs, keep_words=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Trained scores and tokenizer ids have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Flagship plan: fairness audit of scored predictions.

predictions view → favorable indicators → one grouped count pass →
per-group rates + overall row + disparities → one long report table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from equisel.operators.fairness import audit
from equisel.sources.views import predictions


def audit_report(spark: SparkSession, data_dir: str, group: str = "sensitive", favorable: int = 1) -> DataFrame:
    return audit(predictions(spark, data_dir), group=group, favorable=favorable)

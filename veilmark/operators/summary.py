"""Counts over findings and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def findings(spans: DataFrame, group: str, key: str) -> DataFrame:
    """Spans, distinct values and documents per (group, type), with subtotals."""
    return (
        spans.rollup(group, "etype")
        .agg(
            F.count(F.lit(1)).alias("spans"),
            F.count_distinct("value").alias("distinct_values"),
            F.count_distinct(key).alias("documents"),
        )
    )


def batch_outcome(files: DataFrame) -> DataFrame:
    """``processed, succeeded, failed`` over rows with an ``error`` column."""
    return files.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("error").isNull()).alias("succeeded"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )

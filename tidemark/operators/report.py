"""Long-format reports and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_metrics(df: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """(key, metric, value): one row per metric that is not null."""
    wide = df.select(*key, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(key, metrics, "metric", "value").where(F.col("value").isNotNull())


def outcome_counters(df: DataFrame, key: list[str], outcome: str, at: str) -> DataFrame:
    """Per key and outcome: how many, and when last."""
    return df.groupBy(*key, outcome).agg(F.count("*").alias("count"), F.max(at).alias("last_at"))


def set_difference(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Expected rows that are not there."""
    return expected.select(*key).distinct().join(actual.select(*key).distinct(), key, "left_anti")

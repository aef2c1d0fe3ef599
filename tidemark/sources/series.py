"""Demand series from event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import SERIES

CLUSTER = "main"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def observations(events: DataFrame) -> DataFrame:
    """One sample per event, at its own time: series by event type."""
    return events.where(F.col("ts").isNotNull() & F.col("event_type").isNotNull()).select(
        F.lit(CLUSTER).alias("cluster_id"),
        F.col("event_type").alias("workload_id"),
        F.sha2(F.concat(F.lit("demand:"), "event_type"), 256).alias("source_fingerprint"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.col("value").alias("observed_value"),
        F.col("event_id").alias("sequence"),
    )


def hourly(events: DataFrame) -> DataFrame:
    """Demand per hour that has events, summed in whole cents so that the order of rows is no matter."""
    rows = observations(events).withColumn("observed_at", F.date_trunc("hour", "observed_at"))
    cents = F.sum(F.round(F.col("observed_value") * 100).cast("long"))
    return rows.groupBy("cluster_id", *SERIES, "observed_at").agg((cents / 100).alias("observed_value"))


def dense(samples: DataFrame, start: str, end: str, interval_s: int = 3600) -> DataFrame:
    """``samples`` on every slot from ``start`` up to ``end``, 0 where nothing was counted.

    For sums an empty slot is a true zero, not a gap. The grid is made where
    the series are, and joined to the samples by series and time.
    """
    series = samples.select("cluster_id", *SERIES).distinct()
    steps = F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp") - F.make_dt_interval(secs=F.lit(interval_s)), F.make_dt_interval(secs=F.lit(interval_s)))
    grid = series.withColumn("observed_at", F.explode(steps))
    return grid.join(samples, ["cluster_id", *SERIES, "observed_at"], "left").withColumn("observed_value", F.coalesce("observed_value", F.lit(0.0)))


def build_samples(readings: DataFrame, contracts: DataFrame, at: str) -> DataFrame:
    """Samples of (workload_id, value) readings taken at one time, for workloads with an active contract."""
    active = contracts.where("status = 'active'").select("cluster_id", *SERIES)
    rows = readings.select("workload_id", "value").join(active, "workload_id")
    return rows.select("cluster_id", *SERIES, F.lit(at).cast("timestamp").alias("observed_at"), F.col("value").alias("observed_value"))

"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: Demand per event type and hour, in whole cents; and on every hour of the month, 0 where nothing was counted.
SERIES_SQL = """
raw AS (
  SELECT event_type AS workload_id, sha256('demand:' || event_type) AS source_fingerprint, ts AS observed_at, value AS observed_value, event_id AS sequence
  FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL
), hourly AS (
  SELECT workload_id, source_fingerprint, date_trunc('hour', observed_at) AS observed_at, CAST(sum(CAST(round(observed_value * 100) AS BIGINT)) AS DOUBLE) / 100 AS observed_value
  FROM raw GROUP BY 1, 2, 3
), dense AS (
  SELECT s.workload_id, s.source_fingerprint, g.observed_at, coalesce(h.observed_value, 0) AS observed_value
  FROM (SELECT DISTINCT workload_id, source_fingerprint FROM hourly) s
  CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS observed_at) g
  LEFT JOIN hourly h ON h.workload_id = s.workload_id AND h.observed_at = g.observed_at
)"""
START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
HOUR, SEASON, STEPS = 3600, 24, 3

"""Small series for tests."""

from __future__ import annotations

import datetime as dt

START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def series(spark, points, workload="w"):
    """``points``: values a minute apart, or (minute, value) pairs; minutes may be fractions."""
    rows = []
    for k, p in enumerate(points):
        minute, value = p if isinstance(p, tuple) else (k, p)
        rows.append(("main", workload, "f", START + dt.timedelta(minutes=minute), None if value is None else float(value)))
    return spark.createDataFrame(rows, "cluster_id string, workload_id string, source_fingerprint string, observed_at timestamp, observed_value double")


def at(minute):
    return (START + dt.timedelta(minutes=minute)).replace(tzinfo=None)


def minutes(rows):
    return [(r.observed_at - START.replace(tzinfo=None)).total_seconds() / 60 for r in sorted(rows, key=lambda r: r.observed_at)]

"""Slots, gaps and validity of series.

All operators partition by series and order by time; a series of one
contract is bounded by its training window and sampling interval, so a
window's partition does not grow with the number of series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import seconds_between, slot
from tidemark.schema import SERIES, finite


def ordered(*more: str):
    return Window.partitionBy(*SERIES, *more).orderBy("observed_at")


def slot_dedup(samples: DataFrame, interval_s: int) -> DataFrame:
    """The latest sample of each slot. An aggregate, so rows are combined before they are shuffled."""
    others = [c for c in samples.columns if c not in SERIES]
    latest = F.max_by(F.struct(*others), F.struct("observed_at", *[c for c in others if c == "sequence"]))
    return samples.withColumn("slot", slot(F.col("observed_at"), interval_s)).groupBy(*SERIES, "slot").agg(latest.alias("row")).select(*SERIES, "slot", *[F.col(f"row.{c}").alias(c) for c in others])


def order_faults(samples: DataFrame) -> DataFrame:
    """(series, observed_at, rows): times that a series has more than once. Order itself is implied by sorting."""
    return samples.groupBy(*SERIES, "observed_at").agg(F.count("*").alias("rows")).where("rows > 1")


def series_quality(samples: DataFrame, interval_s: int, min_samples: int, max_gap_intervals: int = 2) -> DataFrame:
    """Per series: rows, worst gap, and the first reason against it ('ok' if none).

    Reasons in order: too few rows; then, at the first row that has a fault, a
    value that is not finite, a repeated time, or a gap over the tolerance.
    """
    w = ordered()
    allowed = (max_gap_intervals if max_gap_intervals > 0 else 2) * interval_s
    rows = samples.withColumn("gap_s", seconds_between(F.col("observed_at"), F.lag("observed_at").over(w))).withColumn("place", F.row_number().over(w))
    fault = F.when(~finite(F.col("observed_value")), F.lit("not_finite")).when(F.col("gap_s") <= 0, F.lit("not_ordered")).when(F.col("gap_s") > allowed, F.lit("gap"))
    first = F.min_by(F.col("fault"), F.when(F.col("fault").isNotNull(), F.col("place")))
    out = rows.withColumn("fault", fault).groupBy(*SERIES).agg(F.count("*").alias("rows"), F.max("gap_s").alias("worst_gap_s"), first.alias("fault"), F.min(F.when(F.col("fault").isNotNull(), F.col("place"))).alias("at"))
    reason = F.when(F.col("rows") < min_samples, F.lit("too_few")).otherwise(F.coalesce("fault", F.lit("ok")))
    return out.select(*SERIES, "rows", F.round("worst_gap_s", 6).alias("worst_gap_s"), reason.alias("reason"), F.when((F.col("rows") >= min_samples), F.col("at")).alias("first_fault"))


def freshness(samples: DataFrame, now: Column, interval_s: int, max_gap_intervals: int = 2) -> DataFrame:
    """Per series: age of the latest sample, and whether that lies in [0, tolerance]."""
    out = samples.groupBy(*SERIES).agg(F.max("observed_at").alias("latest"))
    age = seconds_between(now, F.col("latest"))
    return out.select(*SERIES, "latest", age.alias("age_s"), F.when(age < 0, "future").when(age > max_gap_intervals * interval_s, "stale").otherwise("fresh").alias("state"))


def segments(samples: DataFrame, breaks: Column, name: str = "segment") -> DataFrame:
    """Numbers the runs of a series: a row for which ``breaks`` holds begins the next."""
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(w))


def _last_segment(rows: DataFrame) -> DataFrame:
    return rows.withColumn("last_segment", F.max("segment").over(Window.partitionBy(*SERIES))).where("segment = last_segment").drop("segment", "last_segment")


def recent_contiguous(samples: DataFrame, interval_s: int, max_gap_intervals: int = 2) -> DataFrame:
    """The rows after each series' latest gap that is over the tolerance."""
    rows = samples.withColumn("gap_s", seconds_between(F.col("observed_at"), F.lag("observed_at").over(ordered())))
    return _last_segment(segments(rows, F.col("gap_s") > max_gap_intervals * interval_s)).drop("gap_s")


def training_segment(samples: DataFrame, interval_s: int, minimum: int) -> DataFrame:
    """The newest run of slots without a hole that has ``minimum`` rows or more; series without one give no rows.

    A series with a value that is negative or not finite, or a repeated time,
    is not usable at all.
    """
    whole = Window.partitionBy(*SERIES)
    bad = ~finite(F.col("observed_value")) | (F.col("observed_value") < 0) | (F.col("observed_at") == F.lag("observed_at").over(ordered()))
    usable = samples.withColumn("bad", bad).withColumn("any_bad", F.max(F.coalesce("bad", F.lit(False))).over(whole)).where(~F.col("any_bad")).drop("bad", "any_bad")
    kept = slot_dedup(usable, interval_s)
    runs = kept.withColumn("run", F.col("slot") - F.row_number().over(Window.partitionBy(*SERIES).orderBy("slot")))
    sized = runs.withColumn("size", F.count("*").over(Window.partitionBy(*SERIES, "run"))).where(F.col("size") >= minimum)
    return sized.withColumn("newest", F.max("run").over(whole)).where("run = newest").drop("run", "size", "newest")


def real_suffix(samples: DataFrame, interval_s: int) -> DataFrame:
    """The latest run of real slots, one row each: a run ends where the next slot's first row is 1.5 intervals or more behind the last row of the slot before."""
    others = [c for c in samples.columns if c not in SERIES]
    per = samples.withColumn("slot", slot(F.col("observed_at"), interval_s)).groupBy(*SERIES, "slot").agg(F.min("observed_at").alias("first_at"), F.max_by(F.struct(*others), F.struct("observed_at", *[c for c in others if c == "sequence"])).alias("row"))
    rows = per.select(*SERIES, "slot", "first_at", *[F.col(f"row.{c}").alias(c) for c in others])
    gap = seconds_between(F.col("first_at"), F.lag("observed_at").over(Window.partitionBy(*SERIES).orderBy("slot")))
    return _last_segment(segments(rows.withColumn("gap_s", gap), F.col("gap_s") >= 1.5 * interval_s)).drop("gap_s", "first_at")


def coverage(samples: DataFrame) -> DataFrame:
    """Per series: oldest, newest and number of samples."""
    return samples.groupBy(*SERIES).agg(F.min("observed_at").alias("oldest"), F.max("observed_at").alias("newest"), F.count("*").alias("samples"))


def sufficient_history(samples: DataFrame, series: DataFrame, start: Column, end: Column, interval_s: int) -> DataFrame:
    """Per row of ``series``: coverage within [start, end] (epoch and 0 where there is none), and whether it spares a backfill."""
    inside = coverage(samples.where(F.col("observed_at").between(start, end)))
    epoch = F.timestamp_seconds(F.lit(0))
    rows = series.select(*SERIES).join(inside, SERIES, "left").select(*SERIES, F.coalesce("oldest", epoch).alias("oldest"), F.coalesce("newest", epoch).alias("newest"), F.coalesce("samples", F.lit(0)).alias("samples"))
    step = F.make_dt_interval(secs=F.lit(interval_s))
    expected = (seconds_between(end, start) / interval_s).cast("long")
    enough = (F.col("samples") >= expected - 2) & (F.col("oldest") <= start + step) & (F.col("newest") >= end - step - step)
    return rows.withColumn("expected", expected).withColumn("sufficient", enough)

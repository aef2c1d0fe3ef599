"""Scores of forecasts against what happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import low_rank, pinball
from tidemark.functions.time import seconds_between, slot
from tidemark.operators.features import evenly, horizon_label
from tidemark.operators.quality import ordered
from tidemark.schema import SERIES

METRICS = ["windows", "coverage", "underprediction_rate", "mean_absolute_error", "pinball", "mean_underprediction", "max_relative_underprediction", "peak_mean_underprediction", "excess_replica_minutes"]


def scores(rows: DataFrame, key: list[str], q: Column | float, threshold: Column | float, horizon_minutes: Column | float) -> DataFrame:
    """Per key, the nine metrics of rows with ``actual``, ``upper`` and ``is_peak``. One aggregate, combined before the shuffle."""
    one = lambda x: F.lit(float(x)) if isinstance(x, int | float) else x
    actual, upper = F.col("actual"), F.col("upper")
    short = F.greatest(F.lit(0.0), actual - upper)
    excess = F.greatest(F.lit(0.0), F.ceil(upper / one(threshold)) - F.ceil(actual / one(threshold))) * one(horizon_minutes)
    return rows.where(actual.isNotNull() & upper.isNotNull()).groupBy(*key).agg(
        F.count("*").alias("windows"),
        F.avg(F.when(short > 0, 0.0).otherwise(1.0)).alias("coverage"),
        F.avg(F.when(short > 0, 1.0).otherwise(0.0)).alias("underprediction_rate"),
        F.avg(F.abs(actual - upper)).alias("mean_absolute_error"),
        F.avg(pinball(actual, upper, q)).alias("pinball"),
        F.avg(short).alias("mean_underprediction"),
        F.max(short / F.greatest(F.lit(1.0), actual)).alias("max_relative_underprediction"),
        F.coalesce(F.avg(F.when(F.col("is_peak"), short)), F.lit(0.0)).alias("peak_mean_underprediction"),
        F.sum(excess).cast("double").alias("excess_replica_minutes"),
    )


def window_scores(rows: DataFrame, q: Column | float) -> DataFrame:
    """Per series of (series, actual, upper): windows, coverage, under rate, mean error and loss."""
    hit = F.col("upper") >= F.col("actual")
    return rows.groupBy(*SERIES).agg(
        F.count("*").alias("windows"),
        F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("coverage"),
        F.avg(F.when(hit, 0.0).otherwise(1.0)).alias("underprediction_rate"),
        F.avg(F.abs(F.col("upper") - F.col("actual"))).alias("mean_absolute_error"),
        F.avg(pinball(F.col("actual"), F.col("upper"), q)).alias("pinball"),
    )


def walk_forward(forecasts: DataFrame, steps: int, season: int, q: float, most: int = 0) -> DataFrame:
    """Per series: windows, coverage, under rate, mean error and loss of per-row forecasts (``upper`` at each row).

    Cuts run from one season on; with ``most`` the last ``most`` count.
    """
    rows = horizon_label(forecasts, steps, "actual").withColumn("place", F.row_number().over(ordered()))
    rows = rows.where((F.col("place") >= season) & F.col("actual").isNotNull() & F.col("upper").isNotNull())
    if most:
        rows = rows.withColumn("back", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.col("observed_at").desc()))).where(F.col("back") <= most)
    return window_scores(rows, q)


def _column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def paired_origins(samples: DataFrame, interval_s: Column | int, steps: Column | int, history: Column | int, after: Column | str | None = None, afters: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Disjoint evaluation origins per series, with the horizon's maximum: the same for all models.

    ``samples`` has one row per slot. A cut needs ``history`` rows before it
    and ``steps`` behind it without a missing slot, and an origin not before
    ``after``, or before the series' own in ``afters`` (series, after); within
    a segment the first such cut and every ``steps``-th after it are taken, so
    that no targets overlap. Interval, steps and history may be columns of
    ``samples`` that are equal within a series, as may those to ``carry``.

    As targets lie end to end behind a segment's first cut, each row belongs
    to one target by its place, whatever the series' steps are.
    """
    runs = samples if afters is None else samples.join(afters.select(*SERIES, "after"), SERIES)
    bound = F.col("after") if afters is not None else F.lit(after).cast("timestamp") if isinstance(after, str) else after
    runs = runs.withColumn("segment", slot(F.col("observed_at"), interval_s) - F.row_number().over(ordered()))
    w = ordered("segment")
    rows = runs.withColumns({"place": F.row_number().over(w), "before_at": F.lag("observed_at").over(w), "steps_": _column(steps).cast("long")})
    fits = F.col("place") >= _column(history)
    if bound is not None:
        fits = fits & (F.col("observed_at") >= bound)
    ahead = F.col("place") - F.min(F.when(fits, F.col("place"))).over(Window.partitionBy(*SERIES, "segment"))
    targets = rows.withColumn("ahead", ahead).where("ahead > 0").withColumn("target", F.expr("(ahead - 1) div steps_"))
    held = targets.groupBy(*SERIES, "segment", "target", *carry).agg(
        F.min("before_at").alias("origin"), F.max("observed_at").alias("target_end"), F.greatest(F.max("observed_value"), F.lit(0.0)).alias("actual"), F.count("*").alias("rows"), F.max("steps_").alias("steps_")
    )
    return held.where("rows = steps_").select(*SERIES, "origin", "segment", "target_end", "actual", *carry)


def comparison_status(origins: DataFrame, steps: Column | int, interval_s: Column | int, min_windows: int, min_duration_s: int) -> DataFrame:
    """Per series of ``origins``: windows, first origin, last target, and whether they suffice."""
    out = origins.groupBy(*SERIES).agg(F.count("*").alias("eligible_windows"), F.min("origin").alias("start"), F.max("target_end").alias("end"), F.max(_column(steps) * _column(interval_s)).alias("horizon"))
    span = seconds_between(F.col("end"), F.col("start"))
    reason = F.when(F.col("eligible_windows") < min_windows, "insufficient_complete_windows").when((span < min_duration_s) | (F.col("eligible_windows") * F.col("horizon") < 0.9 * min_duration_s), "insufficient_evaluation_duration").otherwise("ok")
    return out.withColumn("reason", reason).drop("horizon")


def compared(origins: DataFrame, forecasts: DataFrame, q: Column | float, threshold: Column | float, horizon_minutes: Column | float, most: int) -> DataFrame:
    """(series, model, nine metrics): ``forecasts`` (series, origin, model, upper) on identical origins, ``most`` of them spread evenly.

    A peak is a horizon whose maximum is at or above the element at nine
    tenths of the sorted maxima, whatever the models say.
    """
    chosen = evenly(origins, most, SERIES, "origin")
    cutoff = low_rank(F.collect_list("actual").over(Window.partitionBy(*SERIES)), 0.9)
    peaks = chosen.withColumn("is_peak", F.col("actual") >= cutoff)
    rows = peaks.join(forecasts.select(*SERIES, "origin", "model", "upper"), [*SERIES, "origin"])
    return scores(rows, [*SERIES, "model"], q, threshold, horizon_minutes)


def matured(snapshots: DataFrame, samples: DataFrame, now: Column, interval_s: Column | int) -> DataFrame:
    """Snapshots whose horizon is over and that are not evaluated yet, with what happened in (observed, observed + horizon].

    The range join is an equality on the series and on day buckets that the
    horizon touches, so a series' samples only meet the snapshots near them.
    ``complete`` tells whether each slot of the horizon has a sample; a
    snapshot without any sample gives no row. The interval may be a column of
    ``snapshots``.
    """
    day = 86_400
    end = F.col("observed_at") + F.make_dt_interval(secs=F.col("horizon_s"))
    bucket = lambda t: F.floor(F.unix_micros(t) / (day * 1_000_000)).cast("long")
    due = snapshots.where(F.col("evaluated_at").isNull()).withColumns({"target_end": end, "step_s": _column(interval_s).cast("long")}).where(F.col("target_end") <= now)
    near = due.select("snapshot_id", *SERIES, "observed_at", "target_end", "horizon_s", "step_s", "upper").withColumn("bucket", F.explode(F.sequence(bucket(F.col("observed_at")), bucket(F.col("target_end")))))
    points = samples.select(*SERIES, F.col("observed_at").alias("point_at"), "observed_value").withColumn("bucket", bucket(F.col("point_at")))
    hits = near.join(points, [*SERIES, "bucket"]).where((F.col("point_at") > F.col("observed_at")) & (F.col("point_at") <= F.col("target_end")))
    out = hits.groupBy("snapshot_id", *SERIES, "upper", "horizon_s", "step_s").agg(F.max("observed_value").alias("realized"), F.countDistinct(slot(F.col("point_at"), F.col("step_s"))).alias("slots"))
    covered = F.col("upper") >= F.col("realized")
    return out.select("snapshot_id", *SERIES, "upper", "realized", covered.alias("covered"), (~covered).alias("underpredicted"), F.abs(F.col("upper") - F.col("realized")).alias("absolute_error"), (F.col("slots") >= F.col("horizon_s") / F.col("step_s")).alias("complete"))


def with_evaluations(snapshots: DataFrame, evaluated: DataFrame, now: Column) -> DataFrame:
    """Snapshots with what ``matured`` found filled in."""
    filled = ["realized", "covered", "underpredicted", "absolute_error"]
    e = evaluated.select("snapshot_id", *[F.col(c).alias(f"new_{c}") for c in filled], F.lit(True).alias("hit"))
    both = snapshots.join(e, "snapshot_id", "left")
    out = [F.coalesce(f"new_{c}", c).alias(c) if c in filled else F.when(F.col("hit"), now).otherwise(F.col(c)).alias(c) if c == "evaluated_at" else F.col(c) for c in snapshots.columns]
    return both.select(*out)


def holdout_diagnostics(forecasts: DataFrame, steps: int, q: float, most: int = 288) -> DataFrame:
    """Scores at every ``steps``-th row with a known label, of the last ``most`` of them."""
    rows = horizon_label(forecasts, steps, "actual").where(F.col("actual").isNotNull() & F.col("upper").isNotNull())
    rows = rows.withColumn("back", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.col("observed_at").desc())) - 1)
    kept = rows.where((F.col("back") % steps == 0) & (F.col("back") < most * steps))
    hit = F.col("upper") >= F.col("actual")
    return kept.groupBy(*SERIES).agg(F.count("*").alias("windows"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("coverage"), F.avg(pinball(F.col("actual"), F.col("upper"), q)).alias("pinball"))


def dataset_fingerprint(samples: DataFrame) -> DataFrame:
    """Per series a SHA-256 over its times (microseconds) and values (millionths), in order."""
    row = F.concat_ws(":", F.unix_micros("observed_at").cast("string"), F.round(F.col("observed_value") * 1_000_000).cast("long").cast("string"))
    rows = samples.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct(F.col("observed_at").alias("t"), row.alias("r")))).alias("rows"))
    return rows.select(*SERIES, F.sha2(F.array_join(F.transform("rows", lambda x: x["r"]), "\n"), 256).alias("fingerprint"))


def comparison_fingerprint(origins: DataFrame, forecasts: DataFrame, most: int) -> DataFrame:
    """Per series a SHA-256 over what a comparison rests on: its origins, their maxima and each model's forecast, in order."""
    chosen = evenly(origins, most, SERIES, "origin").select(*SERIES, "origin", "actual")
    rows = chosen.join(forecasts.select(*SERIES, "origin", "model", "upper"), [*SERIES, "origin"])
    micro = lambda c: F.round(F.col(c) * 1_000_000).cast("long").cast("string")
    row = F.concat_ws(":", F.unix_micros("origin").cast("string"), micro("actual"), "model", micro("upper"))
    lists = rows.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("origin", "model", row.alias("r")))).alias("rows"))
    return lists.select(*SERIES, F.sha2(F.array_join(F.transform("rows", lambda x: x["r"]), "\n"), 256).alias("fingerprint"))

"""Bounded interpolation of short gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import seconds_between
from tidemark.operators.quality import ordered, segments, slot_dedup
from tidemark.schema import SERIES, finite

#: What a bridge may span, and how much of an input may be estimated.
MOST_STEPS, MOST_CHANGE, MOST_SHARE, RECENT, REAL_TAIL = 6, 0.25, 0.05, 60, 2


def bounded_fill(samples: DataFrame, interval_s: int, max_gap_s: int = 300, lookback: int = 0) -> DataFrame:
    """Model input per series: real rows, and estimated ones on short, aligned, stable gaps.

    A gap of 1.5 intervals or more is bridged on straight lines if it is at
    most ``max_gap_s`` plus a quarter interval, a whole number of at most six
    intervals to within a quarter, and the values beside it differ by at most
    a quarter of the larger (of 1 at least). Any other such gap drops all
    before it. With ``lookback`` only the last rows count, and older rows are
    not looked at.

    All rows of a series carry its ``status``: 'ok', or what makes the input
    unusable ('not_ordered', 'invalid_value', 'too_many_estimated',
    'too_many_recent', 'short_real_tail'); ``used_suffix`` tells of dropped rows.
    """
    whole, w = Window.partitionBy(*SERIES), ordered()
    rows = samples
    if lookback > 0:
        last = F.max("observed_at").over(whole)
        rows = rows.withColumn("last_at", last).where(seconds_between(F.col("last_at"), F.col("observed_at")) <= (lookback + MOST_STEPS) * interval_s).drop("last_at")
    twice = rows.groupBy(*SERIES, "observed_at").agg(F.count("*").alias("n")).groupBy(*SERIES).agg((F.max("n") > 1).alias("repeated"))
    kept = slot_dedup(rows, interval_s).drop("slot").join(twice, SERIES)
    invalid = ~finite(F.col("observed_value")) | (F.col("observed_value") < 0)
    kept = kept.withColumn("invalid", F.max(invalid).over(whole))
    before_at, before = F.lag("observed_at").over(w), F.lag("observed_value").over(w)
    gapped = kept.withColumns({"before_at": before_at, "before": before}).withColumn("gap_s", seconds_between(F.col("observed_at"), F.col("before_at"))).withColumn("steps", F.round(F.col("gap_s") / interval_s))
    wide = F.col("gap_s") >= 1.5 * interval_s
    aligned = F.abs(F.col("gap_s") - F.col("steps") * interval_s) <= interval_s / 4
    stable = F.abs(F.col("observed_value") - F.col("before")) / F.greatest(F.lit(1.0), "before", "observed_value") <= MOST_CHANGE
    bridged = (F.col("gap_s") <= max_gap_s + interval_s / 4) & aligned & stable & (F.col("steps") <= MOST_STEPS)
    marked = segments(gapped.withColumn("bridge", F.coalesce(wide & bridged, F.lit(False))), F.coalesce(wide & ~F.col("bridge"), F.lit(False)))
    current = marked.withColumn("last_segment", F.max("segment").over(whole)).where("segment = last_segment")

    def point(k):
        at = F.timestamp_micros(F.unix_micros("before_at") + k.cast("long") * (interval_s * 1_000_000))
        weight = k * interval_s / F.col("gap_s")
        return F.struct(at.alias("observed_at"), ((1 - weight) * F.col("before") + weight * F.col("observed_value")).alias("observed_value"), F.lit(True).alias("is_estimated"))

    own = F.array(F.struct("observed_at", "observed_value", F.lit(False).alias("is_estimated")))
    made = F.when(F.col("bridge"), F.concat(F.transform(F.sequence(F.lit(1), F.col("steps").cast("int") - 1), point), own)).otherwise(own)
    used = F.col("last_segment") > 0
    out = current.select(*SERIES, "repeated", "invalid", used.alias("used_suffix"), F.explode(made).alias("p")).select(*SERIES, "repeated", "invalid", "used_suffix", "p.*")
    out = out.withColumn("from_end", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.col("observed_at").desc())))
    if lookback > 0:
        out = out.where(F.col("from_end") <= lookback)
    estimated = F.when(F.col("is_estimated"), 1).otherwise(0)
    recent = F.col("from_end") <= RECENT
    out = out.withColumns({
        "estimated_count": F.sum(estimated).over(whole),
        "size": F.count("*").over(whole),
        "recent_estimated": F.sum(F.when(recent, estimated)).over(whole),
        "recent_size": F.sum(F.when(recent, 1)).over(whole),
        "nearest_estimate": F.min(F.when(F.col("is_estimated"), F.col("from_end"))).over(whole),
    })
    some = F.col("estimated_count") > 0
    status = (
        F.when(F.col("repeated"), "not_ordered")
        .when(F.col("invalid"), "invalid_value")
        .when(some & (F.col("estimated_count") / F.col("size") > MOST_SHARE), "too_many_estimated")
        .when(some & (F.col("recent_estimated") / F.col("recent_size") > MOST_SHARE), "too_many_recent")
        .when(some & (F.col("nearest_estimate") <= REAL_TAIL), "short_real_tail")
        .otherwise("ok")
    )
    return out.select(*SERIES, "observed_at", "observed_value", "is_estimated", "used_suffix", "estimated_count", status.alias("status"))

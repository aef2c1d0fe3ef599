"""Finding, planning and applying repairs of stored history."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import GRID_ORIGIN_S, slot, slot_start
from tidemark.operators.store import insert_missing
from tidemark.schema import SERIES
from tidemark.session import cut

#: Points of a query, and runs beyond which a plan is made of whole shards.
POINTS, MOST_RUNS = 10_000, 128


@dataclass(frozen=True)
class RepairLimits:
    timeout_s: int = 120
    query_timeout_s: int = 15
    points: int = 1_000_000
    requests: int = 256
    tries: int = 2
    runs: int = MOST_RUNS

    def __post_init__(self):
        if not 0 < self.timeout_s <= 1800 or not 0 < self.query_timeout_s <= min(self.timeout_s, 120):
            raise ValueError("timeouts must be positive, the whole's half an hour at most, a query's two minutes and no longer than the whole")
        if not 0 < self.points <= 2_000_000:
            raise ValueError("the point limit must lie in 1 to 2,000,000")


def chunks(start: int, end: int, step: int, points: int = POINTS) -> list[tuple[int, int]]:
    """Inclusive ranges of at most ``points`` points that cover [start, end]; each begins where the one before ended."""
    span, out = step * (points - 1), []
    while True:
        last = min(end, start + span)
        out.append((start, last))
        if last >= end:
            return out
        start = last


def query_chunks(windows: DataFrame, points: int = POINTS) -> DataFrame:
    """The same as rows, for windows with start_s, end_s and interval_s: chunk, first_s, last_s."""
    span = F.col("interval_s") * (points - 1)
    number = F.greatest(F.ceil((F.col("end_s") - F.col("start_s")) / span), F.lit(1))
    rows = windows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), number.cast("long") - 1)))
    first = F.col("start_s") + F.col("chunk") * span
    return rows.withColumn("first_s", first).withColumn("last_s", F.least(F.col("end_s"), first + span))


def missing_slots(samples: DataFrame, series: DataFrame, start: str, end: str, interval_s: int) -> DataFrame:
    """(series, slot, place): slots of [start, end) without a sample, leading and trailing ones too; place counts from 0."""
    at = lambda t: slot(F.lit(t).cast("timestamp"), interval_s)
    every = series.select(*SERIES).distinct().withColumn("slot", F.explode(F.sequence(at(start), at(end) - 1)))
    there = samples.where((F.col("observed_at") >= F.lit(start).cast("timestamp")) & (F.col("observed_at") < F.lit(end).cast("timestamp"))).select(*SERIES, slot(F.col("observed_at"), interval_s).alias("slot")).distinct()
    return every.join(there, [*SERIES, "slot"], "left_anti").withColumn("place", F.col("slot") - at(start))


def repair_plan(missing: DataFrame, points: int = POINTS, most_runs: int = MOST_RUNS) -> DataFrame:
    """(series, first, last, points): query ranges over the missing places.

    Contiguous runs, cut at ``points``; a series with more than ``most_runs``
    of these is asked for in shards of ``points`` places, each trimmed to its
    first and last missing one.
    """
    w = Window.partitionBy(*SERIES).orderBy("place")
    runs = missing.withColumn("run", F.col("place") - F.row_number().over(w))
    runs = runs.withColumn("head", F.min("place").over(Window.partitionBy(*SERIES, "run"))).withColumn("part", F.floor((F.col("place") - F.col("head")) / points))
    spans = runs.groupBy(*SERIES, "run", "part").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    counted = spans.withColumn("runs", F.count("*").over(Window.partitionBy(*SERIES)))
    shards = missing.join(counted.where(F.col("runs") > most_runs).select(*SERIES).distinct(), SERIES, "left_semi").groupBy(*SERIES, F.floor(F.col("place") / points).alias("shard")).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    out = counted.where(F.col("runs") <= most_runs).select(*SERIES, "first", "last").unionByName(shards.select(*SERIES, "first", "last"))
    return out.withColumn("points", F.col("last") - F.col("first") + 1)


def repair_points(points: DataFrame, missing: DataFrame, interval_s: int, tolerance_ms: int = 1) -> DataFrame:
    """Answers (series, observed_at, value) at a slot's start to within the tolerance, of missing slots, with their ``fault`` if they have one."""
    step = interval_s * 1_000_000
    micros = F.unix_micros("observed_at")
    rest = F.pmod(micros + F.lit(62_135_596_800 * 1_000_000), F.lit(step))
    off = F.least(rest, step - rest)
    snapped = F.timestamp_micros(micros + F.when(rest < step / 2, -rest).otherwise(step - rest))
    rows = points.withColumn("off_us", off).withColumn("observed_at", snapped).withColumn("slot", slot(snapped, interval_s))
    twice = F.count("*").over(Window.partitionBy(*SERIES, "slot")) > 1
    fault = F.when(F.col("off_us") > tolerance_ms * 1000, "not_aligned").when(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")) | (F.col("value") < 0), "invalid_value").when(twice, "repeated_slot")
    return rows.withColumn("fault", fault).join(missing.select(*SERIES, "slot"), [*SERIES, "slot"], "left_semi").drop("off_us")


#: Fixed value: the longest range of a repair, in seconds.
LONGEST_S = 90 * 86_400


def _range(start: str, end: str, interval_s: int) -> None:
    """ValueError for a range that no repair is for."""
    at = [dt.datetime.fromisoformat(str(t)).replace(tzinfo=dt.timezone.utc).timestamp() for t in (start, end)]
    if interval_s < 1 or not 0 < at[1] - at[0] <= LONGEST_S or any((t + GRID_ORIGIN_S) % interval_s for t in at):
        raise ValueError("a repair is of a range of 90 days at most, with both ends on the grid")


def repair(samples: DataFrame, contracts: DataFrame, start: str, end: str, interval_s: int, ask: Callable[[DataFrame], DataFrame], limits: RepairLimits = RepairLimits()) -> tuple[DataFrame, DataFrame]:
    """Samples with the missing slots of [start, end) filled by what ``ask`` answers to the plan, and a report per series.

    ``ask`` gets (series, part, first, last, points, timeout_s, deadline_s)
    and returns (series, observed_at, value); with ``part`` and ``fault``
    columns it may say of a part that it could not be had. A series' parts are
    ordered, and the first ``limits.requests`` of them are asked for; parts
    that could not be had are asked for again, up to ``limits.tries`` times,
    from what is left of the budget and while the repair is within
    ``limits.timeout_s``. A series with more than ``limits.runs`` runs is
    asked for in shards. A slot that a source answers without is not asked
    for again. Each part stands for itself: one with an answer that has a
    fault, or with none, gives nothing and takes nothing from the others.

    A series of more slots than ``limits.points`` is not asked for; a range
    off the grid or longer than 90 days is a ValueError. The plan is over all
    series at once; nothing passes the driver. The report has, per series,
    expected, missing_before, missing_after, requests, inserted and the
    number of parts that gave nothing.
    """
    _range(start, end, interval_s)
    began = time.time()
    first, last = (slot(F.lit(t).cast("timestamp"), interval_s) for t in (start, end))
    before = cut(missing_slots(samples, contracts, start, end, interval_s))
    cluster = contracts.select(*SERIES, F.col("cluster_id") if "cluster_id" in contracts.columns else F.lit("main").alias("cluster_id")).dropDuplicates(SERIES)
    numbered = repair_plan(before, most_runs=limits.runs).where(last - first <= limits.points).withColumn("part", F.row_number().over(Window.partitionBy(*SERIES).orderBy("first")))
    plan = cut(numbered.withColumns({"timeout_s": F.lit(limits.query_timeout_s), "deadline_s": F.lit(began + limits.timeout_s)}))
    # Which part a missing slot is asked for in.
    places = plan.select(*SERIES, "part", F.explode(F.sequence("first", "last")).alias("place"))
    wanted = cut(before.join(places, [*SERIES, "place"]).select(*SERIES, "slot", "part"))
    spent, open_, made, lost = cluster.select(*SERIES, F.lit(0).cast("long").alias("requests")), plan, [], []
    for turn in range(limits.tries):
        if turn and time.time() - began > limits.timeout_s:
            break
        order = F.row_number().over(Window.partitionBy(*SERIES).orderBy("part"))
        asked = cut(open_.join(spent, SERIES).withColumn("order", order).where(F.col("requests") + F.col("order") <= limits.requests).select(*plan.columns))
        # Kept, so that no source is asked twice for one answer.
        got = ask(asked)
        got = cut(got.select(*SERIES, "observed_at", "value", *[F.col(c) if c in got.columns else F.lit(None).cast(t).alias(c) for c, t in (("part", "int"), ("fault", "string"))]))
        unanswered = got.where("fault is not null").select(*SERIES, "part").distinct()
        points = repair_points(got.where("fault is null").select(*SERIES, "observed_at", "value"), wanted, interval_s).join(wanted, [*SERIES, "slot"])
        bad = points.where("fault is not null").select(*SERIES, "part").distinct().unionByName(unanswered).distinct()
        good = points.where("fault is null").join(asked.select(*SERIES, "part"), [*SERIES, "part"], "left_semi").join(bad, [*SERIES, "part"], "left_anti")
        made.append(cut(good.select(*SERIES, "slot", "observed_at", "value")))
        lost.append((unanswered, bad))
        spent = cut(spent.join(asked.groupBy(*SERIES).agg(F.count("*").alias("cost")), SERIES, "left").select(*SERIES, (F.col("requests") + F.coalesce("cost", F.lit(0))).alias("requests")))
        answered = asked.join(unanswered, [*SERIES, "part"], "left_anti").select(*SERIES, "part")
        open_ = cut((open_ if turn else asked).join(answered, [*SERIES, "part"], "left_anti"))
    found = reduce(DataFrame.unionByName, made)
    after = insert_missing(samples, found.join(cluster, SERIES).select("cluster_id", *SERIES, "observed_at", F.col("value").alias("observed_value")), interval_s)
    left = before.join(found.select(*SERIES, "slot"), [*SERIES, "slot"], "left_anti")
    # A part that could not be had counts if it never could; one with a wrong answer counts at once.
    failed = reduce(DataFrame.unionByName, [b.join(u, [*SERIES, "part"], "left_anti") for u, b in lost]).unionByName(open_.select(*SERIES, "part"))
    count = lambda df, name: df.groupBy(*SERIES).agg(F.count("*").alias(name))
    report = contracts.select(*SERIES).distinct().withColumn("expected", last - first)
    for df, name in ((before, "missing_before"), (left, "missing_after")):
        report = report.join(count(df, name), SERIES, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    report = report.join(spent, SERIES, "left").withColumn("inserted", F.col("missing_before") - F.col("missing_after"))
    return after, report.join(count(failed.distinct(), "failed_parts"), SERIES, "left").withColumn("failed_parts", F.coalesce("failed_parts", F.lit(0)))


def repair_faults(asked: DataFrame, contracts: DataFrame, now: Column) -> DataFrame:
    """(workload_id, fault) of the repairs (workload_id, policy_revision, end) that must not run: for a contract that is not active or has changed, or up to an end that is not closed yet, not on the grid, or too long ago."""
    own = contracts.where("status = 'active'").select("workload_id", F.col("policy_revision").alias("current_revision"), "interval_s")
    rows = asked.join(own, "workload_id", "left")
    step = F.col("interval_s")
    closed = slot_start(slot(now, step), step)
    age = F.unix_seconds(now) - F.unix_seconds("end")
    fault = (
        F.when(F.col("current_revision").isNull(), "not_active")
        .when(F.coalesce(F.col("policy_revision"), F.lit("")) != F.col("current_revision"), "policy_changed")
        .when(F.col("end").isNull() | (F.col("end") > closed) | (slot_start(slot(F.col("end"), step), step) != F.col("end")) | (age > F.greatest(F.lit(600), step + 60)), "invalid_end")
    )
    return rows.withColumn("fault", fault).where("fault is not null").select("workload_id", "fault")


def recovery_range(series: DataFrame, end: Column, window_s: int, interval_s: int) -> DataFrame:
    """For series with ``newest``: the range to read again after an outage, from the next slot on, ``window_s`` back at most; no row where nothing is due."""
    earliest = end - F.make_dt_interval(secs=F.lit(window_s))
    start = F.greatest(earliest, F.coalesce(F.col("newest") + F.make_dt_interval(secs=F.lit(interval_s)), earliest))
    return series.withColumn("recover_from", start).withColumn("recover_to", end).where(F.col("recover_from") <= F.col("recover_to"))

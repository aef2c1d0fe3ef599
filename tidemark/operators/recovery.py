"""Watching that scalers have their predictive metrics, and asking for those that are missing, with growing pauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The longest pause in seconds, and the tries after which it no longer grows.
MOST_PAUSE_S, MOST_TRIES = 300, 10


def owned(objects: DataFrame, scalers: DataFrame) -> DataFrame:
    """Objects (namespace, name, uid, expected) with the scaler that is theirs: one that lives, and is controlled by that very object."""
    s = scalers.where("not deleting").select("namespace", "owner_kind", F.col("owner_name").alias("name"), "owner_uid", F.col("uid").alias("scaler_uid"), "present")
    rows = objects.where("not deleting and not paused and size(expected) > 0").join(s, ["namespace", "name"])
    return rows.where((F.col("owner_kind") == "ScaledObject") & (F.col("uid") != "") & (F.col("owner_uid") == F.col("uid"))).select("namespace", "name", "scaler_uid", "expected", "present")


def pause_s(tries: Column, interval_s: int) -> Column:
    """The interval, doubled with each try, up to five minutes or the interval if that is longer."""
    return F.least(interval_s * F.pow(F.lit(2.0), F.greatest(tries, F.lit(1)) - 1), F.lit(float(max(MOST_PAUSE_S, interval_s)))).cast("long")


def recovery_step(watched: DataFrame, states: DataFrame, probes: DataFrame, now: Column, interval_s: int = 30) -> DataFrame:
    """Per watched object what is missing, what is done about it, and its state for the next step.

    ``watched`` comes from ``owned``; ``states`` (namespace, name, scaler_uid,
    tries, next_at) from the last step; ``probes`` (namespace, name, answers)
    tell whether the metric's source answers. A replaced scaler starts anew,
    and an object that is no longer watched loses its state. Outcomes:
    complete, restored, waiting, probe_failed, requested.
    """
    before = states.select("namespace", "name", F.col("scaler_uid").alias("old_uid"), F.col("tries").alias("old_tries"), F.col("next_at").alias("old_next"))
    rows = watched.join(before, ["namespace", "name"], "left").join(probes.select("namespace", "name", "answers"), ["namespace", "name"], "left")
    same = F.coalesce(F.col("old_uid") == F.col("scaler_uid"), F.lit(False))
    tries = F.when(same, F.col("old_tries")).otherwise(0)
    missing = F.array_except("expected", "present")
    waits = same & F.coalesce(now < F.col("old_next"), F.lit(False))
    none = F.size(missing) == 0
    more = F.least(tries + 1, F.lit(MOST_TRIES))
    outcome = F.when(none, F.when(tries > 0, "restored").otherwise("complete")).when(waits, "waiting").when(F.coalesce("answers", F.lit(False)), "requested").otherwise("probe_failed")
    next_at = F.when(none, F.lit(None).cast("timestamp")).when(waits, F.col("old_next")).otherwise(now + F.make_dt_interval(secs=pause_s(more, interval_s)))
    return rows.select("namespace", "name", "scaler_uid", missing.alias("missing"), outcome.alias("outcome"), F.when(none, 0).when(waits, tries).otherwise(more).cast("int").alias("tries"), next_at.alias("next_at"))

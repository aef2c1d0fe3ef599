"""Which training runs are to be claimed now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import jitter_s
from tidemark.functions.time import slot, slot_start

#: The year from which slots of immediate runs are taken, and for how many seconds on.
RESERVED, CENTURY_S = "2500-01-01 00:00:00", 100 * 365 * 86_400


def immediate_slot(policy_revision: Column) -> Column:
    """A slot of its own, far ahead, for each revision, so that one asks for no more than one immediate run."""
    number = F.conv(F.substring(F.sha2(policy_revision, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.timestamp_seconds(F.unix_seconds(F.lit(RESERVED).cast("timestamp")) + F.pmod(number, F.lit(CENTURY_S).cast("decimal(20,0)")).cast("long"))


def wanted_claims(contracts: DataFrame, now: Column, every_s: int = 86_400) -> DataFrame:
    """(cluster_id, workload_id, kind, slot, engine, window_start, window_end, exclusive_since): a run for each active contract that asks for one at once, and for each whose delay within the current slot is over.

    Put the scheduled ones through ``store.claims`` and the immediate ones
    through ``store.immediate_claims``, which leave those that are taken.
    """
    active = contracts.where("status = 'active'")
    back = lambda t: t - F.make_dt_interval(secs=F.col("training_window_s"))
    keep = ["cluster_id", "workload_id", "policy_revision"]
    closed = slot_start(slot(now, F.col("interval_s")), F.col("interval_s"))
    at_once = active.where("immediate_training").select(*keep, F.lit("immediate").alias("kind"), immediate_slot(F.col("policy_revision")).alias("slot"), "engine", back(closed).alias("window_start"), closed.alias("window_end"), F.lit(None).cast("timestamp").alias("exclusive_since"))
    start = slot_start(slot(now, every_s), every_s)
    late = F.unix_seconds(now) - F.unix_seconds(start) >= jitter_s(F.col("workload_id"), every_s)
    scheduled = active.where(late).select(*keep, F.lit("scheduled").alias("kind"), start.alias("slot"), "engine", back(now).alias("window_start"), now.alias("window_end"), start.alias("exclusive_since"))
    return at_once.unionByName(scheduled)

"""Changes of stored tables, as new tables: upserts, guarded inserts, reconciliation, claims, audit.

Parquet has no rows to update, so each operator returns the table as it is
afterwards; the caller writes it with one writer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import slot
from tidemark.schema import SERIES, finite

SAMPLE_KEY = ["cluster_id", *SERIES, "observed_at"]


def upsert_latest(existing: DataFrame, incoming: DataFrame, key: list[str] = SAMPLE_KEY, order: str | None = None) -> DataFrame:
    """All rows, one per key: an incoming one before an existing one, among incoming ones the last by ``order``."""
    marked = existing.withColumn("batch", F.lit(0)).unionByName(incoming.withColumn("batch", F.lit(1)), allowMissingColumns=True)
    values = [c for c in marked.columns if c not in (*key, "batch")]
    newest = F.max_by(F.struct(*values), F.struct("batch", *([order] if order else []), *[c for c in values if c != order]))
    return marked.groupBy(*key).agg(newest.alias("row")).select(*key, *[F.col(f"row.{c}").alias(c) for c in values])


def missing_inserts(existing: DataFrame, incoming: DataFrame, interval_s: int) -> DataFrame:
    """Incoming samples at a slot's start, with a valid value, whose slot has no sample yet; one per slot."""
    at = slot(F.col("observed_at"), interval_s)
    aligned = F.pmod(F.unix_micros("observed_at"), F.lit(interval_s * 1_000_000)) == F.pmod(F.lit(-62_135_596_800 * 1_000_000), F.lit(interval_s * 1_000_000))
    valid = incoming.where(finite(F.col("observed_value")) & (F.col("observed_value") >= 0) & aligned).withColumn("slot", at)
    taken = existing.select("cluster_id", *SERIES, at.alias("slot")).distinct()
    return valid.join(taken, ["cluster_id", *SERIES, "slot"], "left_anti").drop("slot").dropDuplicates(SAMPLE_KEY)


def insert_missing(existing: DataFrame, incoming: DataFrame, interval_s: int, contracts: DataFrame | None = None) -> DataFrame:
    """``existing`` and what it lacks. With ``contracts`` only for series whose contract is active and at the revision that ``incoming`` was read under."""
    if contracts is not None:
        fence = contracts.where("status = 'active'").select(*SERIES, "policy_revision")
        incoming = incoming.join(fence, [*SERIES, "policy_revision"], "left_semi").drop("policy_revision")
    return existing.unionByName(missing_inserts(existing, incoming, interval_s), allowMissingColumns=True)


def reconcile(stored: DataFrame, desired: DataFrame, now: Column, key: list[str]) -> DataFrame:
    """Contracts afterwards: desired ones active and as desired, others inactive since ``now`` or since before."""
    values = [c for c in desired.columns if c not in key]
    s, d = stored.alias("s"), desired.withColumn("wanted", F.lit(True)).alias("d")
    both = s.join(d, [F.col(f"s.{k}").eqNullSafe(F.col(f"d.{k}")) for k in key], "full")
    wanted = F.coalesce(F.col("d.wanted"), F.lit(False))
    picked = [F.when(wanted, F.col(f"d.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in [*key, *values]]
    return both.select(
        *picked,
        F.when(wanted, "active").otherwise("inactive").alias("status"),
        F.when(~wanted, F.coalesce(F.col("s.deactivated_at"), now)).alias("deactivated_at"),
    )


def deactivate_parent(stored: DataFrame, parent: Column, now: Column) -> DataFrame:
    """Contracts of a parent that went, inactive."""
    return stored.withColumn("deactivated_at", F.when(parent, F.coalesce("deactivated_at", now)).otherwise(F.col("deactivated_at"))).withColumn("status", F.when(parent, "inactive").otherwise(F.col("status")))


def clear_models(models: DataFrame, runs: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Models without those of the ``changed`` workloads, and runs that no longer point to these."""
    gone = models.join(changed, "workload_id", "left_semi").select(F.col("model_id").alias("gone_id"))
    kept = models.join(changed, "workload_id", "left_anti")
    freed = runs.join(gone, runs["model_id"] == gone["gone_id"], "left").withColumn("model_id", F.when(F.col("gone_id").isNull(), F.col("model_id"))).drop("gone_id")
    return kept, freed


CLAIM_KEY = ["cluster_id", "workload_id", "slot"]


def claims(runs: DataFrame, wanted: DataFrame, exclusive_since: Column | None = None) -> DataFrame:
    """Wanted claims that may be inserted: their slot is free and, if asked for, their workload has no run since."""
    out = wanted.dropDuplicates(CLAIM_KEY).join(runs.select(*CLAIM_KEY).distinct(), CLAIM_KEY, "left_anti")
    if exclusive_since is not None:
        recent = runs.where(F.col("created_at") >= exclusive_since).select("cluster_id", "workload_id").distinct()
        out = out.join(recent, ["cluster_id", "workload_id"], "left_anti")
    return out


def immediate_claims(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Claims with ``is_new``: those inserted, and those whose run is claimed but not begun. Run ids of new ones are null."""
    new = claims(runs, wanted).select(*CLAIM_KEY, F.lit(None).cast("long").alias("run_id"), F.lit(True).alias("is_new"))
    pending = runs.where("status = 'claimed'").join(wanted.select(*CLAIM_KEY).distinct(), CLAIM_KEY, "left_semi").select(*CLAIM_KEY, "run_id", F.lit(False).alias("is_new"))
    return new.unionByName(pending)


def transition(runs: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Runs after one event each (run_id, event, reason, model_id): start of claimed, success of running, failure of any."""
    e = events.select("run_id", "event", F.col("reason").alias("event_reason"), F.col("model_id").alias("event_model"))
    both = runs.join(e, "run_id", "left")
    starts = (F.col("event") == "start") & (F.col("status") == "claimed")
    wins = (F.col("event") == "succeed") & (F.col("status") == "running")
    fails = F.col("event") == "fail"
    status = F.when(starts, "running").when(wins, "succeeded").when(fails, "failed").otherwise(F.col("status"))
    return both.select(
        *[c for c in runs.columns if c not in ("status", "failure_reason", "model_id", "started_at", "finished_at")],
        status.alias("status"),
        F.when(starts, F.lit(None).cast("string")).when(fails, F.col("event_reason")).otherwise(F.col("failure_reason")).alias("failure_reason"),
        F.when(wins, F.col("event_model")).otherwise(F.col("model_id")).alias("model_id"),
        F.when(starts, now).otherwise(F.col("started_at")).alias("started_at"),
        F.when(wins | fails, now).otherwise(F.col("finished_at")).alias("finished_at"),
    )


def append_audit(history: Column, entry: Column, kept: int = 20) -> Column:
    """An audit array with ``entry`` behind it, its last ``kept`` entries."""
    longer = F.concat(F.coalesce(history, F.array().cast("array<string>")), F.array(entry))
    return F.slice(longer, F.greatest(F.size(longer) - kept + 1, F.lit(1)), F.lit(kept))


def latest_per(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``, which should end with a tie-breaker."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def append_unique(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """``existing`` and the incoming rows whose key it lacks, one per key: a repeated append changes nothing."""
    new = incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")
    return existing.unionByName(new, allowMissingColumns=True)

"""From demand to a bounded number of replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.store import latest_per
from tidemark.schema import SERIES

#: Steps and percentages of one scale-up, normally and on estimated inputs.
STEP, PERCENT, STEP_ESTIMATED, PERCENT_ESTIMATED = 3.0, 100.0, 1.0, 25.0
#: Reasons of a decision.
UNHEALTHY, NO_CAPACITY, NO_SCALE_UP, LIMITED = "cluster_unhealthy", "capacity_unavailable", "no_predictive_scale_up", "rate_limited"
BASELINE, AFTER_GAP, SURGE = "baseline_replicas", "recovered_after_source_gap", "sustained_abnormal_slope_and_baseline"
INTERPOLATED, CONSERVATIVE = "inference_interpolated_points", "conservative_gap_recovery"


def guarded(desired: Column, current: Column, most: Column, step: Column, percent: Column, healthy: Column, allowed: Column) -> Column:
    """struct(safe, reason): the replicas that may be asked for. May be a fraction, and pays no heed to the minimum."""
    wanted = F.least(desired, most.cast("double"))
    limit = F.least(wanted, F.when(step > 0, current + step), F.when((percent > 0) & (current > 0), current * (1 + percent / 100)))
    return (
        F.when(~healthy, F.struct(current.alias("safe"), F.lit(UNHEALTHY).alias("reason")))
        .when(~allowed, F.struct(current.alias("safe"), F.lit(NO_CAPACITY).alias("reason")))
        .when(wanted <= current, F.struct(wanted.alias("safe"), F.lit(NO_SCALE_UP).alias("reason")))
        .otherwise(F.struct(limit.alias("safe"), F.lit(LIMITED).alias("reason")))
    )


def decide(inputs: DataFrame) -> DataFrame:
    """Adds desired, safe and reason to rows with upper, surge_demand, surge_triggered, threshold, current, max_replicas, used_suffix, estimated_count, healthy and allowed."""
    surging = F.col("surge_triggered") & (F.col("surge_demand") > F.col("upper"))
    raw = F.when(surging, F.col("surge_demand")).otherwise(F.col("upper"))
    estimated = F.col("estimated_count") > 0
    desired = F.ceil(raw / F.col("threshold")).cast("double")
    desired = F.when(estimated, F.greatest(desired, "current")).otherwise(desired)
    step, percent = F.when(estimated, STEP_ESTIMATED).otherwise(STEP), F.when(estimated, PERCENT_ESTIMATED).otherwise(PERCENT)
    out = inputs.withColumn("desired", desired)
    out = out.withColumn("guard", guarded(F.col("desired"), F.col("current"), F.col("max_replicas"), step, percent, F.col("healthy"), F.col("allowed")))
    base = F.when(surging, F.lit(SURGE)).when(F.col("used_suffix"), F.lit(f"{BASELINE};{AFTER_GAP}")).otherwise(BASELINE)
    note = F.when(estimated, F.concat(F.lit(f"{INTERPOLATED}="), F.col("estimated_count").cast("string"), F.lit(f";{CONSERVATIVE}")))
    return out.select(*inputs.columns, "desired", F.when(surging, F.col("surge_demand")).otherwise(0.0).alias("surge"), F.col("guard.safe").alias("safe"), F.concat_ws(";", base, note, F.col("guard.reason")).alias("reason"))


def decision_horizon(horizon_s: Column, startup_s: Column, buffer_s: Column) -> Column:
    return horizon_s + startup_s + buffer_s


def speculative_replicas(contracts: DataFrame, snapshots: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """Per cluster, the replicas beyond the minimum that the latest snapshots of current sources ask for.

    Workloads without a snapshot count nothing. With ``proposals``
    (workload_id, desired, min_replicas) there is a row per proposal, in
    which that workload's demand is the proposal's.
    """
    newest = latest_per(snapshots.select(*SERIES, "generated_at", "snapshot_id", "safe"), SERIES, F.col("generated_at").desc(), F.col("snapshot_id").desc())
    rows = contracts.where("status = 'active'").select("cluster_id", *SERIES, "min_replicas").join(newest, SERIES)
    rows = rows.withColumn("extra", F.greatest(F.lit(0.0), F.col("safe") - F.col("min_replicas")))
    total = rows.groupBy("cluster_id").agg(F.sum("extra").alias("speculative"), F.count("*").alias("workloads"))
    if proposals is None:
        return total
    own = rows.join(proposals.select("workload_id", "desired", F.col("min_replicas").alias("proposed_min")), "workload_id")
    changed = own.withColumn("proposed", F.greatest(F.lit(0.0), F.col("desired") - F.col("proposed_min"))).select("cluster_id", "workload_id", (F.col("proposed") - F.col("extra")).alias("change"))
    return changed.join(total, "cluster_id").select("cluster_id", "workload_id", (F.col("speculative") + F.col("change")).alias("speculative"), "workloads")


def eligible_models(contracts: DataFrame, models: DataFrame, now: Column, max_age_s: int = 72 * 3600) -> DataFrame:
    """Per contract: the active model that may serve it, or the reason why the engine itself must."""
    m = models.where("status = 'active'").select(*SERIES, "model_id", F.col("engine").alias("model_engine"), F.col("quantile").alias("model_quantile"), "valid_from")
    rows = contracts.where("status = 'active'").join(m, SERIES, "left")
    reason = (
        F.when(F.col("model_id").isNull(), "no_model")
        .when(F.col("valid_from").isNull() | (F.unix_micros(now) - F.unix_micros("valid_from") > max_age_s * 1_000_000), "too_old")
        .when((F.coalesce("engine", F.lit("")) != "") & (F.col("engine") != F.col("model_engine")), "other_engine")
        .when((F.col("quantile") > 0) & (F.col("quantile") < 1) & F.col("model_quantile").isNotNull() & (F.abs(F.col("model_quantile") - F.col("quantile")) > 1e-9), "other_quantile")
        .otherwise("eligible")
    )
    return rows.select(*SERIES, reason.alias("reason"), F.when(reason == "eligible", F.col("model_id")).alias("model_id"))


def served(snapshots: DataFrame, now: Column, snapshot_age_s: int, source_intervals: int = 3, interval_s: int = 60) -> DataFrame:
    """Latest snapshots with the demand that is served: 0 where the snapshot or its source is too old, or lies ahead."""
    age = lambda c: (F.unix_micros(now) - F.unix_micros(c)) / 1_000_000
    fresh = age("generated_at").between(0, snapshot_age_s) & age("observed_at").between(0, source_intervals * interval_s)
    return snapshots.withColumn("fresh", fresh).withColumn("served", F.when(fresh, F.col("safe")).otherwise(0.0))

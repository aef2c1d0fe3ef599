"""Tables of the domain, and the integrity rules that a store would enforce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A series is what one contract's source query gives; a changed query starts another series. Workload ids are unique across clusters.
SERIES = ["workload_id", "source_fingerprint"]

#: Tables as DDL.
SAMPLES = "cluster_id string, workload_id string, source_fingerprint string, observed_at timestamp, observed_value double"
CONTRACTS = (
    "workload_id string, cluster_id string, namespace string, scaled_name string, trigger_name string, source_trigger string, "
    "server_address string, query string, source_fingerprint string, policy_revision string, threshold double, quantile double, "
    "horizon_s bigint, training_window_s bigint, interval_s bigint, startup_s bigint, buffer_s bigint, engine string, timezone string, "
    "min_replicas int, max_replicas int, status string"
)
SNAPSHOTS = (
    "snapshot_id bigint, cluster_id string, workload_id string, source_fingerprint string, generated_at timestamp, observed_at timestamp, engine string, "
    "horizon_s bigint, p50 double, upper double, surge double, safe double, reason string, realized double, evaluated_at timestamp, covered boolean, underpredicted boolean, absolute_error double"
)
MODELS = (
    "model_id string, cluster_id string, workload_id string, source_fingerprint string, engine string, status string, created_at timestamp, activated_at timestamp, "
    "trained_from timestamp, trained_until timestamp, quantile double, feature_schema string, dataset_fingerprint string, hyperparameters string, validation_metrics string, artifact binary, artifact_sha256 string"
)
RUNS = (
    "run_id bigint, cluster_id string, workload_id string, slot timestamp, status string, engine string, window_start timestamp, window_end timestamp, created_at timestamp, model_id string, failure_reason string"
)


def apart(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own, for a join or cogroup with a table that it was made from."""
    return df.toDF(*df.columns)


def finite(value: Column) -> Column:
    """Neither null, NaN nor infinite; NaN compares as the largest number, so order alone can't tell."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def sample_faults(samples: DataFrame) -> DataFrame:
    """Keys and reasons of the samples that break a rule: not finite, or a repeated key."""
    key = [*SERIES, "observed_at"]
    bad = samples.where(~finite(F.col("observed_value"))).select(*key, F.lit("not_finite").alias("fault"))
    twice = samples.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("repeated_key").alias("fault"))
    return bad.unionByName(twice)


def contract_faults(contracts: DataFrame) -> DataFrame:
    """(workload_id, fault) for each rule that a contract breaks."""
    rules = {
        "replica_bounds": (F.col("min_replicas") >= 0) & (F.col("max_replicas") > 0) & (F.col("min_replicas") <= F.col("max_replicas")),
        "durations": (F.col("horizon_s") > 0) & (F.col("interval_s") > 0) & (F.col("training_window_s") > 0),
        "decision_horizon": F.expr("interval_s > 0 and pmod(horizon_s + startup_s + buffer_s, interval_s) = 0"),
        "quantile": (F.col("quantile") > 0) & (F.col("quantile") < 1),
        "status": F.col("status").isin("active", "inactive"),
        "fingerprint": F.col("source_fingerprint").rlike("^[0-9a-f]{64}$"),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return contracts.select("workload_id", F.explode(broken).alias("fault"))


def active_model_faults(models: DataFrame) -> DataFrame:
    """Series with more than one active model."""
    return models.where("status = 'active'").groupBy(*SERIES).agg(F.count("*").alias("active_models")).where("active_models > 1")

"""Queries on the processes around the engine: sampling, recovery, claims, repairs and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import recovery, repair, sampling, schedule
from tidemark.plans.registry import query
from tidemark.plans.series import shown, ts
from tidemark.schema import SERIES
from tidemark.sources.series import table

NOW = "2024-02-01 10:00:07"


def fnv_sql(text: str, modulo: str) -> str:
    """The 64-bit FNV-1a hash of ASCII text, modulo a number."""
    return f"CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length({text}) + 1), lambda i: ord(substr({text}, CAST(i AS INTEGER), 1))::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) % CAST({modulo} AS UHUGEINT) AS BIGINT)"


def workloads(spark, sf_dir) -> DataFrame:
    """A contract per customer, with intervals and revisions of several kinds."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.lit("main").alias("cluster_id"), F.concat(F.lit("w"), k.cast("string")).alias("workload_id"), F.lit("f").alias("source_fingerprint"), F.concat(F.lit("r"), (k % 50).cast("string")).alias("policy_revision"), F.when(k % 10 == 0, "inactive").otherwise("active").alias("status"),
        F.when(k % 3 == 0, 10).otherwise(60).cast("long").alias("interval_s"), (86400 * (1 + k % 30)).cast("long").alias("training_window_s"), F.when(k % 2 == 0, "xgboost").otherwise("gru").alias("engine"), (k % 4 == 0).alias("immediate_training"), k.alias("k"),
    )


_WORKLOADS_SQL = "workloads AS (SELECT 'w' || c_custkey AS workload_id, 'r' || (c_custkey % 50) AS policy_revision, c_custkey % 10 <> 0 AS active, CASE WHEN c_custkey % 3 = 0 THEN 10 ELSE 60 END AS interval_s, 86400 * (1 + c_custkey % 30) AS window_s, CASE WHEN c_custkey % 2 = 0 THEN 'xgboost' ELSE 'gru' END AS engine, c_custkey % 4 = 0 AS at_once, c_custkey AS k FROM customer)"


@query(f"""WITH {_WORKLOADS_SQL}, d AS (SELECT *, {fnv_sql('workload_id', 'least(interval_s, 15)')} AS delay_s FROM workloads WHERE active)
SELECT workload_id, delay_s FROM d WHERE CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT) % interval_s = delay_s""")
def sampling_due(spark, sf_dir):
    return sampling.due(workloads(spark, sf_dir), ts(NOW)).select("workload_id", "delay_s")


def answers(rows: DataFrame) -> DataFrame:
    """A source that answers some at the first try, some later, and some not at all."""
    k = F.substring("workload_id", 2, 20).cast("long")
    good = (k + F.col("attempt")) % 4 == 0
    return rows.where(k % 9 != 0).select(*SERIES, F.when(good, k * 1.5).alias("value"), F.when(~good, F.concat(F.lit("timeout_"), F.col("attempt").cast("string"))).alias("fault"))


@query(f"""WITH {_WORKLOADS_SQL}, t AS (SELECT *, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 4 = 0 THEN 0 WHEN k % 4 = 3 THEN 1 WHEN k % 4 = 2 THEN 2 END AS hit FROM workloads)
SELECT workload_id, CASE WHEN hit IS NULL THEN 'failed' WHEN k % 8 < 4 THEN 'recovered' ELSE 'sampled' END AS status, CASE WHEN hit IS NULL THEN CASE WHEN k % 9 = 0 THEN 'no_answer' ELSE 'timeout_2' END END AS fault, CAST(coalesce(hit, 2) + 1 AS INTEGER) AS tries,
  0.5::DOUBLE * (CASE coalesce(hit, 2) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END) AS waited_s, CASE WHEN hit IS NOT NULL THEN k * 1.5::DOUBLE END AS value, hit IS NOT NULL AS stored FROM t""")
def sampling_cycle(spark, sf_dir):
    rows = workloads(spark, sf_dir)
    samples, outcomes = sampling.sample_cycle(rows, ts(NOW), answers, rows.where("k % 8 < 4"))
    return outcomes.join(samples.select(*SERIES, F.lit(True).alias("stored")), SERIES, "left").withColumn("stored", F.coalesce("stored", F.lit(False))).drop("source_fingerprint")


def _scalers(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    k, s = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    place = [F.concat(F.lit("ns"), (k % 7).cast("string")).alias("namespace"), F.col("s_name").alias("name")]
    uid = F.concat(F.lit("u"), k.cast("string"))
    objects = s.select(*place, uid.alias("uid"), F.array(F.lit("s0-demand"), F.lit("s2-demand")).alias("expected"), (k % 17 == 0).alias("deleting"), (k % 13 == 0).alias("paused"))
    scalers = s.select(place[0], F.lit("ScaledObject").alias("owner_kind"), F.col("s_name").alias("owner_name"), F.when(k % 11 == 0, "other").otherwise(uid).alias("owner_uid"), F.concat(F.lit("h"), k.cast("string")).alias("uid"), F.when(k % 3 == 0, F.array(F.lit("s2-demand"), F.lit("s0-demand"))).otherwise(F.array(F.lit("s0-demand"))).alias("present"), F.lit(False).alias("deleting"))
    states = s.where("s_suppkey % 2 = 0").select(*place, F.when(k % 10 == 0, "old").otherwise(F.concat(F.lit("h"), k.cast("string"))).alias("scaler_uid"), (k % 12).cast("int").alias("tries"), F.timestamp_seconds(F.unix_seconds(ts(NOW)) + k % 9 - 4).alias("next_at"))
    return objects, scalers, states, s.where("s_suppkey % 5 <> 0").select(*place, (k % 4 != 0).alias("answers"))


@query(f"""WITH s AS (SELECT s_suppkey AS k, s_name AS name, 'ns' || (s_suppkey % 7) AS namespace, s_suppkey % 3 = 0 AS whole, s_suppkey % 2 = 0 AND s_suppkey % 10 <> 0 AS same FROM supplier WHERE s_suppkey % 17 <> 0 AND s_suppkey % 13 <> 0 AND s_suppkey % 11 <> 0
), t AS (SELECT *, CASE WHEN same THEN k % 12 ELSE 0 END AS tries, same AND k % 9 - 4 > 0 AS waits FROM s
), u AS (SELECT *, least(tries + 1, 10) AS more FROM t)
SELECT namespace, name, CASE WHEN whole THEN '' ELSE 's2-demand' END AS missing, CASE WHEN whole THEN CASE WHEN tries > 0 THEN 'restored' ELSE 'complete' END WHEN waits THEN 'waiting' WHEN k % 5 <> 0 AND k % 4 <> 0 THEN 'requested' ELSE 'probe_failed' END AS outcome,
  CAST(CASE WHEN whole THEN 0 WHEN waits THEN tries ELSE more END AS INTEGER) AS tries, CASE WHEN NOT whole THEN TIMESTAMP '{NOW}' + CASE WHEN waits THEN k % 9 - 4 ELSE CAST(least(30 * 2 ** (more - 1), 300) AS BIGINT) END * INTERVAL 1 SECOND END AS next_at FROM u""")
def metric_recovery(spark, sf_dir):
    objects, scalers, states, probes = _scalers(spark, sf_dir)
    out = recovery.recovery_step(recovery.owned(objects, scalers), states, probes, ts(NOW))
    return shown(out.withColumn("missing", F.array_join("missing", ",")).drop("scaler_uid"))


@query(f"""WITH {_WORKLOADS_SQL}, a AS (SELECT * FROM workloads WHERE active
), c AS (SELECT workload_id, policy_revision, 'immediate' AS kind, TIMESTAMP '2500-01-01' + to_seconds(CAST(CAST('0x' || substr(sha256(policy_revision), 1, 16) AS UBIGINT) % 3153600000 AS BIGINT)) AS slot, engine, window_s, to_timestamp(CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT) // interval_s * interval_s) AT TIME ZONE 'UTC' AS window_end, CAST(NULL AS TIMESTAMP) AS exclusive_since FROM a WHERE at_once
  UNION ALL SELECT workload_id, policy_revision, 'scheduled', date_trunc('day', TIMESTAMP '{NOW}'), engine, window_s, TIMESTAMP '{NOW}', date_trunc('day', TIMESTAMP '{NOW}') FROM a WHERE {fnv_sql('workload_id', '86400')} <= 36007)
SELECT workload_id, policy_revision, kind, slot, engine, window_end - window_s * INTERVAL 1 SECOND AS window_start, window_end, exclusive_since FROM c""")
def wanted_claims(spark, sf_dir):
    return shown(schedule.wanted_claims(workloads(spark, sf_dir), ts(NOW)).drop("cluster_id"))


@query(f"""WITH {_WORKLOADS_SQL}, r AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'r99' ELSE policy_revision END AS asked, CASE WHEN k % 5 = 0 THEN TIMESTAMP '2024-02-01 10:01:00' WHEN k % 6 = 0 THEN TIMESTAMP '2024-02-01 09:59:33' WHEN k % 11 = 0 THEN TIMESTAMP '2024-02-01 09:00:00' ELSE TIMESTAMP '2024-02-01 10:00:00' END AS end_ FROM workloads)
SELECT workload_id, CASE WHEN NOT active THEN 'not_active' WHEN asked <> policy_revision THEN 'policy_changed' ELSE 'invalid_end' END AS fault FROM r WHERE NOT active OR asked <> policy_revision OR end_ <> TIMESTAMP '2024-02-01 10:00:00'""")
def repair_policy(spark, sf_dir):
    rows, k = workloads(spark, sf_dir), F.col("k")
    end = F.when(k % 5 == 0, ts("2024-02-01 10:01:00")).when(k % 6 == 0, ts("2024-02-01 09:59:33")).when(k % 11 == 0, ts("2024-02-01 09:00:00")).otherwise(ts("2024-02-01 10:00:00"))
    asked = rows.select("workload_id", F.when(k % 7 == 0, "r99").otherwise(F.col("policy_revision")).alias("policy_revision"), end.alias("end"))
    return repair.repair_faults(asked, rows, ts(NOW))

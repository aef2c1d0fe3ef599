"""Queries on stored tables: upserts, guarded inserts, contracts, claims, models, promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import guard, promote, store
from tidemark.plans.forecasts import SNAPSHOT_SQL, contracts, snapshots
from tidemark.plans.registry import END, HOUR, SERIES_SQL, query
from tidemark.plans.series import full, shown, sparse, ts
from tidemark.schema import SERIES
from tidemark.sources.series import build_samples, table


@query(f"""WITH {SERIES_SQL}, inc AS (SELECT workload_id, observed_at, observed_value * 2 AS observed_value, 1 AS b FROM hourly WHERE hour(observed_at) % 4 = 0
  UNION ALL SELECT workload_id, observed_at + INTERVAL 30 MINUTE, observed_value, 1 FROM hourly WHERE hour(observed_at) = 7
), u AS (SELECT workload_id, observed_at, observed_value, 0 AS b FROM hourly UNION ALL SELECT * FROM inc), k AS (SELECT *, row_number() OVER (PARTITION BY workload_id, observed_at ORDER BY b DESC) AS n FROM u)
SELECT workload_id, observed_at, observed_value FROM k WHERE n = 1""")
def upsert_latest(spark, sf_dir):
    rows = sparse(spark, sf_dir)
    changed = rows.where(F.hour("observed_at") % 4 == 0).withColumn("observed_value", F.col("observed_value") * 2)
    new = rows.where(F.hour("observed_at") == 7).withColumn("observed_at", F.timestamp_seconds(F.unix_seconds("observed_at") + 1800))
    return shown(store.upsert_latest(rows, changed.unionByName(new)))


@query(f"""WITH {SERIES_SQL}
SELECT workload_id, count(*) AS rows, round(sum(observed_value), 4) AS total FROM (
  SELECT workload_id, observed_value FROM hourly UNION ALL
  SELECT d.workload_id, 1.0 FROM dense d LEFT JOIN hourly h ON h.workload_id = d.workload_id AND h.observed_at = d.observed_at WHERE h.workload_id IS NULL AND d.workload_id <> 'error') GROUP BY 1""")
def insert_missing(spark, sf_dir):
    rows = sparse(spark, sf_dir)
    fence = contracts(rows).withColumn("policy_revision", F.when(F.col("workload_id") == "error", "new").otherwise("r1"))
    incoming = full(spark, sf_dir).withColumn("observed_value", F.lit(1.0)).withColumn("policy_revision", F.lit("r1"))
    out = store.insert_missing(rows, incoming, HOUR, fence)
    return out.groupBy("workload_id").agg(F.count("*").alias("rows"), F.round(F.sum("observed_value"), 4).alias("total"))


#: Contracts by customer: a namespace per nation, a scaled object per customer, a trigger per market segment.
def stored_contracts(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("ns"), F.col("c_nationkey").cast("string")).alias("namespace"), F.col("c_name").alias("scaled_name"), F.lower("c_mktsegment").alias("trigger_name"),
        F.round("c_acctbal", 2).alias("threshold"), F.when(F.col("c_custkey") % 5 == 0, ts("2024-01-01 00:00:00")).alias("deactivated_at"),
    )


_STORED_SQL = "stored AS (SELECT 'ns' || c_nationkey AS namespace, c_name AS scaled_name, lower(c_mktsegment) AS trigger_name, round(c_acctbal, 2) AS threshold, CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2024-01-01' END AS deactivated_at FROM customer)"
_KEY = ["namespace", "scaled_name", "trigger_name"]


@query(f"""WITH {_STORED_SQL}, desired AS (SELECT 'ns' || c_nationkey AS namespace, c_name AS scaled_name, lower(c_mktsegment) AS trigger_name, 100.0::DOUBLE AS threshold FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT 'ns' || s_nationkey, s_name, 'new', round(s_acctbal, 2) FROM supplier)
SELECT coalesce(d.namespace, s.namespace) AS namespace, coalesce(d.scaled_name, s.scaled_name) AS scaled_name, coalesce(d.trigger_name, s.trigger_name) AS trigger_name, CASE WHEN d.namespace IS NOT NULL THEN d.threshold ELSE s.threshold END AS threshold,
  CASE WHEN d.namespace IS NOT NULL THEN 'active' ELSE 'inactive' END AS status, CASE WHEN d.namespace IS NULL THEN coalesce(s.deactivated_at, TIMESTAMP '2024-02-01') END AS deactivated_at
FROM stored s FULL JOIN desired d ON d.namespace = s.namespace AND d.scaled_name = s.scaled_name AND d.trigger_name = s.trigger_name""")
def contract_reconcile(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    name = lambda n: F.concat(F.lit("ns"), F.col(n).cast("string")).alias("namespace")
    desired = c.where("c_custkey % 3 = 0").select(name("c_nationkey"), F.col("c_name").alias("scaled_name"), F.lower("c_mktsegment").alias("trigger_name"), F.lit(100.0).alias("threshold"))
    desired = desired.unionByName(s.select(name("s_nationkey"), F.col("s_name").alias("scaled_name"), F.lit("new").alias("trigger_name"), F.round("s_acctbal", 2).alias("threshold")))
    return shown(store.reconcile(stored_contracts(spark, sf_dir), desired, ts("2024-02-01 00:00:00"), _KEY))


@query(f"""WITH {_STORED_SQL}
SELECT namespace, scaled_name, trigger_name, threshold, CASE WHEN namespace = 'ns3' THEN 'inactive' ELSE 'active' END AS status, CASE WHEN namespace = 'ns3' THEN coalesce(deactivated_at, TIMESTAMP '2024-02-01') ELSE deactivated_at END AS deactivated_at FROM stored""")
def deactivate_parent(spark, sf_dir):
    rows = stored_contracts(spark, sf_dir).withColumn("status", F.lit("active"))
    return shown(store.deactivate_parent(rows, F.col("namespace") == "ns3", ts("2024-02-01 00:00:00")))


#: Models and runs by order: a workload per customer, a status by the order's.
def models(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    status = F.when(F.col("o_orderstatus") == "F", "candidate").when(F.col("o_orderstatus") == "O", "active").otherwise("retired")
    action = F.when(F.col("o_orderkey") % 9 == 0, "rejected").otherwise("withheld")
    reason = F.when(F.col("o_orderkey") % 10 == 0, "candidate_expired").otherwise("insufficient_loss_improvement")
    document = F.to_json(F.struct(F.struct(action.alias("action"), reason.alias("reason")).alias("promotion"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format(F.date_add(at.cast("date"), 3), "yyyy-MM-dd"), F.lit("T00:00:00Z"))).alias("validated_at")))
    return o.select(
        F.col("o_orderkey").cast("string").alias("model_id"), F.concat(F.lit("w"), (F.col("o_custkey") % 200).cast("string")).alias("workload_id"), F.lit("f").alias("source_fingerprint"), F.lit("main").alias("cluster_id"),
        status.alias("status"), at.alias("created_at"), at.alias("trained_until"), F.when(status == "active", at).alias("activated_at"), document.alias("validation_metrics"), F.lit("xgboost").alias("engine"), F.lit(0.95).alias("quantile"),
    )


MODELS_SQL = """models AS (SELECT CAST(o_orderkey AS VARCHAR) AS model_id, 'w' || (o_custkey % 200) AS workload_id, CASE o_orderstatus WHEN 'F' THEN 'candidate' WHEN 'O' THEN 'active' ELSE 'retired' END AS status,
  o_orderdate + (o_orderkey % 86400) * INTERVAL 1 SECOND AS created_at, CASE WHEN o_orderkey % 9 = 0 THEN 'rejected' ELSE 'withheld' END AS action, CASE WHEN o_orderkey % 10 = 0 THEN 'candidate_expired' ELSE 'insufficient_loss_improvement' END AS report_reason,
  CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('day', o_orderdate + (o_orderkey % 86400) * INTERVAL 1 SECOND) + INTERVAL 3 DAY END AS validated_at, o_orderkey FROM orders)"""


@query(f"""WITH {MODELS_SQL}, n AS (SELECT workload_id, max(created_at) AS active_at FROM models WHERE status = 'active' GROUP BY 1
), o AS (SELECT m.* FROM models m LEFT JOIN n USING (workload_id) WHERE status <> 'candidate' OR (created_at > coalesce(active_at, TIMESTAMP '1970-01-01') AND action <> 'rejected' AND report_reason NOT IN ('incompatible_contract', 'candidate_expired', 'invalid_artifact', 'invalid_training_boundary'))
), r AS (SELECT *, row_number() OVER (PARTITION BY workload_id, status ORDER BY CASE WHEN status = 'candidate' THEN epoch_us(created_at) ELSE -epoch_us(created_at) END, model_id) AS k FROM o)
SELECT workload_id, status, model_id, created_at FROM r WHERE k = 1""")
def evaluation_candidates(spark, sf_dir):
    return shown(promote.evaluation_candidates(models(spark, sf_dir)).select("workload_id", "status", "model_id", "created_at"))


@query(f"WITH {MODELS_SQL} SELECT model_id, workload_id, greatest(created_at, validated_at) AS valid_from FROM models WHERE status = 'active'")
def model_validity(spark, sf_dir):
    return shown(promote.model_validity(models(spark, sf_dir)).select("model_id", "workload_id", "valid_from"))


def runs(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    status = F.when(F.col("o_orderkey") % 4 == 0, "claimed").when(F.col("o_orderkey") % 4 == 1, "running").when(F.col("o_orderkey") % 4 == 2, "succeeded").otherwise("failed")
    return o.where("o_orderkey % 2 = 0 or o_orderkey % 3 = 0").select(
        F.col("o_orderkey").alias("run_id"), F.lit("main").alias("cluster_id"), F.concat(F.lit("w"), (F.col("o_custkey") % 200).cast("string")).alias("workload_id"), F.date_trunc("day", at).alias("slot"), status.alias("status"), at.alias("created_at"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey").cast("string")).alias("model_id"), F.lit(None).cast("string").alias("failure_reason"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"),
    )


RUNS_SQL = """runs AS (SELECT o_orderkey AS run_id, 'w' || (o_custkey % 200) AS workload_id, date_trunc('day', o_orderdate) AS slot, CASE o_orderkey % 4 WHEN 0 THEN 'claimed' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' ELSE 'failed' END AS status, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS model_id, o_orderkey FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)"""
WANTED_SQL = "wanted AS (SELECT DISTINCT 'w' || (o_custkey % 200) AS workload_id, date_trunc('day', o_orderdate) AS slot FROM orders)"


def wanted(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.lit("main").alias("cluster_id"), F.concat(F.lit("w"), (F.col("o_custkey") % 200).cast("string")).alias("workload_id"), F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("slot"))


@query(f"""WITH {MODELS_SQL}, {RUNS_SQL}
SELECT 'models' AS kind, count(*) AS rows, CAST(0 AS BIGINT) AS freed FROM models WHERE workload_id NOT IN ('w7', 'w8')
UNION ALL SELECT 'runs', count(*), count(*) FILTER (model_id IS NOT NULL AND model_id IN (SELECT model_id FROM models WHERE workload_id IN ('w7', 'w8'))) FROM runs""")
def clear_models(spark, sf_dir):
    r = runs(spark, sf_dir)
    changed = spark.createDataFrame([("w7",), ("w8",)], "workload_id string")
    kept, freed = store.clear_models(models(spark, sf_dir), r, changed)
    before = r.select("run_id", F.col("model_id").isNotNull().alias("had"))
    lost = freed.join(before, "run_id").agg(F.lit("runs").alias("kind"), F.count("*").alias("rows"), F.count_if(F.col("had") & F.col("model_id").isNull()).alias("freed"))
    return kept.agg(F.lit("models").alias("kind"), F.count("*").alias("rows"), F.lit(0).cast("long").alias("freed")).unionByName(lost)


@query(f"""WITH {RUNS_SQL}, {WANTED_SQL}
SELECT w.workload_id, w.slot FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.workload_id = w.workload_id AND r.slot = w.slot) AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.workload_id = w.workload_id AND r.created_at >= TIMESTAMP '2001-07-15')""")
def slot_claim(spark, sf_dir):
    return shown(store.claims(runs(spark, sf_dir), wanted(spark, sf_dir), ts("2001-07-15 00:00:00")).select("workload_id", "slot"))


@query(f"""WITH {RUNS_SQL}, {WANTED_SQL}
SELECT w.workload_id, w.slot, CAST(NULL AS BIGINT) AS run_id, true AS is_new FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.workload_id = w.workload_id AND r.slot = w.slot)
UNION ALL SELECT r.workload_id, r.slot, run_id, false FROM runs r JOIN wanted w ON w.workload_id = r.workload_id AND w.slot = r.slot WHERE status = 'claimed'""")
def immediate_claim(spark, sf_dir):
    return shown(store.immediate_claims(runs(spark, sf_dir), wanted(spark, sf_dir)))


@query(f"""WITH {RUNS_SQL}, e AS (SELECT *, CASE run_id % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'succeed' ELSE 'fail' END AS event FROM runs WHERE run_id % 7 <> 0
), j AS (SELECT r.run_id, r.workload_id, r.status, r.model_id, e.event FROM runs r LEFT JOIN e USING (run_id))
SELECT run_id, workload_id, CASE WHEN event = 'start' AND status = 'claimed' THEN 'running' WHEN event = 'succeed' AND status = 'running' THEN 'succeeded' WHEN event = 'fail' THEN 'failed' ELSE status END AS status,
  CASE WHEN event = 'fail' THEN 'timeout' END AS failure_reason, CASE WHEN event = 'succeed' AND status = 'running' THEN 'm' || run_id ELSE model_id END AS model_id FROM j""")
def run_transitions(spark, sf_dir):
    r = runs(spark, sf_dir)
    kind = F.when(F.col("run_id") % 3 == 0, "start").when(F.col("run_id") % 3 == 1, "succeed").otherwise("fail")
    events = r.where("run_id % 7 <> 0").select("run_id", kind.alias("event"), F.lit("timeout").alias("reason"), F.concat(F.lit("m"), F.col("run_id").cast("string")).alias("model_id"))
    return store.transition(r, events, ts(END)).select("run_id", "workload_id", "status", "failure_reason", "model_id")


@query("""WITH h AS (SELECT user_id, list(CAST(event_id AS VARCHAR) ORDER BY event_id) AS entries FROM events GROUP BY 1), a AS (SELECT user_id, list_append(entries, 'new') AS entries FROM h)
SELECT user_id, CAST(len(entries[greatest(1, len(entries) - 19):]) AS INTEGER) AS kept, array_to_string(entries[greatest(1, len(entries) - 19):], ',') AS history FROM a""")
def audit_tail(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).cast("array<string>").alias("entries"))
    out = rows.select("user_id", store.append_audit(F.col("entries"), F.lit("new")).alias("entries"))
    return out.select("user_id", F.size("entries").alias("kept"), F.array_join("entries", ",").alias("history"))


@query(f"""WITH {SERIES_SQL}, {SNAPSHOT_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY workload_id ORDER BY generated_at DESC) AS n FROM snaps) SELECT workload_id, generated_at, observed_at, upper, safe FROM k WHERE n = 1""")
def latest_snapshot(spark, sf_dir):
    return shown(store.latest_per(snapshots(spark, sf_dir), SERIES, F.col("generated_at").desc(), F.col("snapshot_id").desc()).select("workload_id", "generated_at", "observed_at", "upper", "safe"))


@query(f"""WITH {SERIES_SQL}, {SNAPSHOT_SQL}, w AS (SELECT DISTINCT workload_id FROM hourly)
SELECT w.workload_id, f.generated_at, f.safe FROM w JOIN LATERAL (SELECT generated_at, safe FROM snaps s WHERE s.workload_id = w.workload_id ORDER BY generated_at DESC LIMIT 1) f ON true""")
def lateral_latest(spark, sf_dir):
    contracts(sparse(spark, sf_dir)).select("workload_id").createOrReplaceTempView("lateral_contracts")
    snapshots(spark, sf_dir).select("workload_id", "generated_at", "safe").createOrReplaceTempView("lateral_snapshots")
    out = spark.sql("""SELECT w.workload_id, f.generated_at, f.safe FROM lateral_contracts w JOIN LATERAL (
        SELECT max_by(generated_at, generated_at) AS generated_at, max_by(safe, generated_at) AS safe FROM lateral_snapshots s WHERE s.workload_id = w.workload_id) f""")
    return shown(out)


@query(f"""WITH {SERIES_SQL}, {SNAPSHOT_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY workload_id ORDER BY generated_at DESC) AS n FROM snaps), l AS (SELECT workload_id, safe FROM k WHERE n = 1), t AS (SELECT sum(greatest(0, safe - 1)) AS total, count(*) AS c FROM l)
SELECT 'main' AS cluster, l.workload_id, t.total - greatest(0, l.safe - 1) + 9.0 AS speculative, t.c AS workloads FROM l, t""")
def budget_projection(spark, sf_dir):
    rows = contracts(sparse(spark, sf_dir))
    proposals = rows.select("workload_id", F.lit(10.0).alias("desired"), F.lit(1).alias("min_replicas"))
    out = guard.speculative_replicas(rows, snapshots(spark, sf_dir), proposals)
    return out.select(F.col("cluster_id").alias("cluster"), "workload_id", "speculative", "workloads")


@query(f"""WITH {MODELS_SQL}, act AS (SELECT *, greatest(created_at, validated_at) AS valid_from, row_number() OVER (PARTITION BY workload_id ORDER BY created_at DESC, model_id DESC) AS k FROM models WHERE status = 'active'
), c AS (SELECT DISTINCT 'w' || (c_custkey % 200) AS workload_id, CASE WHEN c_custkey % 200 % 5 = 0 THEN 'gru' ELSE 'xgboost' END AS engine, CASE WHEN c_custkey % 200 % 7 = 0 THEN 0.99 ELSE 0.95 END AS q FROM customer)
SELECT c.workload_id, CASE WHEN a.model_id IS NULL THEN 'no_model' WHEN epoch_us(TIMESTAMP '2001-08-01') - epoch_us(a.valid_from) > 60 * 86400 * 1000000::BIGINT THEN 'too_old' WHEN c.engine <> 'xgboost' THEN 'other_engine' WHEN c.q <> 0.95 THEN 'other_quantile' ELSE 'eligible' END AS reason FROM c LEFT JOIN act a ON a.workload_id = c.workload_id AND a.k = 1""")
def model_eligibility(spark, sf_dir):
    active = store.latest_per(promote.model_validity(models(spark, sf_dir)), SERIES, F.col("created_at").desc(), F.col("model_id").desc())
    k = F.col("c_custkey") % 200
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("w"), k.cast("string")).alias("workload_id"), F.lit("f").alias("source_fingerprint"), F.lit("active").alias("status"), F.when(k % 5 == 0, "gru").otherwise("xgboost").alias("engine"), F.when(k % 7 == 0, 0.99).otherwise(0.95).alias("quantile")).distinct()
    return guard.eligible_models(c, active, ts("2001-08-01 00:00:00"), 60 * 86400).select("workload_id", "reason")


def metrics(prefix: str, key) -> list:
    """Nine scores that follow from a number; a seventh of them can't hold."""
    k = F.col(key)
    bad = k % 7 == 0
    out = {
        "windows": F.when(k % 13 == 0, 60).otherwise(100), "coverage": 0.90 + (k % 11) / 100, "underprediction_rate": (k % 5) / 100, "mean_absolute_error": 1.0 + (k % 17), "pinball": F.when(k % 29 == 0, 0.0).otherwise(0.5 + (k % 19) / 10),
        "mean_underprediction": (k % 3) / 10, "max_relative_underprediction": F.when(bad, 0.7).otherwise((k % 6) / 20), "peak_mean_underprediction": (k % 4) / 10, "excess_replica_minutes": (k % 23) * 3.0,
    }
    return [F.struct(*[(c if hasattr(c, "alias") else F.lit(c)).cast("long" if n == "windows" else "double").alias(n) for n, c in out.items()]).alias(prefix)]


def _metrics_sql(p: str, k: str) -> str:
    return (
        f"CASE WHEN {k} % 13 = 0 THEN 60 ELSE 100 END AS {p}_w, 0.90::DOUBLE + ({k} % 11) / 100.0::DOUBLE AS {p}_c, ({k} % 5) / 100.0::DOUBLE AS {p}_u, CASE WHEN {k} % 29 = 0 THEN 0.0 ELSE 0.5::DOUBLE + ({k} % 19) / 10.0::DOUBLE END AS {p}_p, "
        f"({k} % 3) / 10.0::DOUBLE AS {p}_m, CASE WHEN {k} % 7 = 0 THEN 0.7 ELSE ({k} % 6) / 20.0::DOUBLE END AS {p}_x, ({k} % 4) / 10.0::DOUBLE AS {p}_k"
    )


_SCORED_SQL = f"scored AS (SELECT l_orderkey, l_linenumber, l_orderkey % 2 = 0 AS has_champion, {_metrics_sql('a', 'l_partkey')}, {_metrics_sql('b', 'l_suppkey')}, {_metrics_sql('d', 'l_orderkey')} FROM lineitem)"


def scored(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 2 == 0).alias("has_champion"), *metrics("candidate", "l_partkey"), *metrics("other", "l_suppkey"), *metrics("baseline", "l_orderkey"))


_SAFE = "({p}_w >= 72 AND {p}_c >= 0.95::DOUBLE - 0.03::DOUBLE AND {p}_c <= 1 AND {p}_x <= 0.5)"


@query(f"WITH {_SCORED_SQL} SELECT l_orderkey, l_linenumber, a_c <= 1 AS valid, {_SAFE.format(p='a')} AS safe FROM scored")
def metric_gate(spark, sf_dir):
    c, p = F.col("candidate"), promote.EvaluationPolicy()
    return scored(spark, sf_dir).select("l_orderkey", "l_linenumber", promote.valid_metrics(c).alias("valid"), promote.safe_metrics(c, F.lit(0.95), p).alias("safe"))


@query(f"""WITH {_SCORED_SQL}, r AS (SELECT *, CASE WHEN has_champion THEN b_w ELSE d_w END AS r_w, CASE WHEN has_champion THEN b_c ELSE d_c END AS r_c, CASE WHEN has_champion THEN b_u ELSE d_u END AS r_u, CASE WHEN has_champion THEN b_p ELSE d_p END AS r_p,
  CASE WHEN has_champion THEN b_m ELSE d_m END AS r_m, CASE WHEN has_champion THEN b_k ELSE d_k END AS r_k FROM scored
), v AS (SELECT *, CASE WHEN NOT {_SAFE.format(p='a')} THEN 'candidate_safety_gate_failed' WHEN NOT (r_c <= 1) OR r_w <> a_w THEN 'incomparable_reference' WHEN a_m > r_m + 1e-9 OR a_k > r_k + 1e-9 OR a_u > r_u + 1e-9 THEN 'underprediction_regression'
  WHEN NOT has_champion AND a_p <= 1e-9 AND r_p <= 1e-9 THEN 'safe_baseline_equivalent' WHEN a_p >= r_p * (1 - 0.03::DOUBLE) - 1e-9 THEN 'insufficient_loss_improvement' ELSE 'paired_evaluation_passed' END AS reason FROM r)
SELECT l_orderkey, l_linenumber, reason IN ('safe_baseline_equivalent', 'paired_evaluation_passed') AS promote, reason, CASE WHEN reason IN ('candidate_safety_gate_failed', 'incomparable_reference') THEN NULL WHEN has_champion THEN 'active_champion' ELSE 'deterministic_baseline' END AS reference FROM v""")
def promotion_verdict(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("champion", F.when(F.col("has_champion"), F.col("other")))
    out = promote.promotion(F.col("candidate"), F.col("champion"), F.col("baseline"), F.lit(0.95))
    return rows.select("l_orderkey", "l_linenumber", out.alias("v")).select("l_orderkey", "l_linenumber", "v.promote", "v.reason", "v.reference")


@query(f"WITH {_SCORED_SQL} SELECT l_orderkey, l_linenumber, {_SAFE.format(p='a')} AND d_c <= 1 AND a_w = d_w AND a_p <= d_p * 1.1::DOUBLE + 1e-9 AS renewed FROM scored")
def revalidation(spark, sf_dir):
    return scored(spark, sf_dir).select("l_orderkey", "l_linenumber", promote.may_revalidate(F.col("candidate"), F.col("baseline"), F.lit(0.95)).alias("renewed"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey % 9 <> 0 AND len_s >= 86400 AND late_s >= 0 AND late_s <= 10800 + 3 * 3600 AND ago_s <= 600 AND ago_s >= -60 AS fresh
FROM (SELECT l_orderkey, l_linenumber, l_suppkey, 43200 * (1 + l_partkey % 4) AS len_s, (l_partkey % 12) * 3600 - 3600 AS late_s, (l_orderkey % 15) * 60 - 120 AS ago_s FROM lineitem)""")
def evidence_freshness(spark, sf_dir):
    now = ts(END)
    back = lambda t, s: F.timestamp_seconds(F.unix_seconds(t) - s)
    at = back(now, (F.col("l_orderkey") % 15) * 60 - 120)
    end = back(at, (F.col("l_partkey") % 12) * 3600 - 3600)
    start = back(end, 43200 * (1 + F.col("l_partkey") % 4))
    print_ = F.when(F.col("l_suppkey") % 9 != 0, "x")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", promote.fresh_evidence(start, end, at, now, F.lit(10800), F.lit(3600), print_).alias("fresh"))


@query("SELECT l_orderkey, l_linenumber, l_quantity % 5 = 0 AS comparable FROM lineitem")
def contract_match(spark, sf_dir):
    a = F.struct(F.lit("q").alias("query"), F.lit(1.0).alias("threshold"), F.col("l_partkey").cast("string").alias("policy_revision"))
    b = F.struct(F.when(F.col("l_quantity") % 5 == 0, "q").otherwise("p").alias("query"), F.lit(1.0).alias("threshold"), F.col("l_suppkey").cast("string").alias("policy_revision"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", promote.comparable_contract(a, b).alias("comparable"))


@query(f"""WITH {SERIES_SQL}, {SNAPSHOT_SQL} SELECT workload_id, observed_at, upper, safe FROM snaps""")
def snapshot_append(spark, sf_dir):
    rows = snapshots(spark, sf_dir)
    old = rows.where("hour(observed_at) < 12")
    out = store.append_unique(old, rows.unionByName(rows), ["snapshot_id"])
    return shown(out.select("workload_id", "observed_at", "upper", "safe"))


@query("""SELECT workload_id, TIMESTAMP '2024-01-31 00:00:00' AS observed_at, observed_value FROM (SELECT event_type AS workload_id, round(max(value), 6) AS observed_value FROM events GROUP BY 1) WHERE workload_id <> 'view'""")
def canonical_samples(spark, sf_dir):
    readings = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("workload_id")).agg(F.round(F.max("value"), 6).alias("value"))
    active = contracts(sparse(spark, sf_dir)).withColumn("status", F.when(F.col("workload_id") == "view", "inactive").otherwise("active"))
    return shown(build_samples(readings, active, END))


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 <> 0""")
def active_contracts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("status", F.when(F.col("c_custkey") % 5 == 0, "inactive").otherwise("active"))
    return rows.where("status = 'active'").select("c_custkey", "c_name").orderBy("c_name", "c_custkey")

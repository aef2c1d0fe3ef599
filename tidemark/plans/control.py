"""Queries on capacity, health, declared contracts, schedules and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text, time
from tidemark.operators import capacity, guard, report
from tidemark.plans.forecasts import THRESHOLD_SQL, snapshots
from tidemark.plans.operations import fnv_sql
from tidemark.plans.registry import END, HOUR, SEASON, SERIES_SQL, STEPS, query
from tidemark.plans.series import events, shown, sparse, ts
from tidemark.schema import contract_faults as faults_of
from tidemark.sources import contracts as declared
from tidemark.sources import payloads
from tidemark.sources.series import table

NODES_SQL = "nodes AS (SELECT s_nationkey AS cluster, 1000 * (1 + s_suppkey % 64) AS cpu_milli, 1073741824 * (1 + s_suppkey % 128) AS memory, s_suppkey % 50 <> 0 AS ready FROM supplier)"
PODS_SQL = """pods AS (SELECT c_nationkey AS cluster, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Succeeded' ELSE 'Failed' END WHEN 'O' THEN 'Running' ELSE 'Pending' END AS phase, o_orderkey % 41 = 0 AS unschedulable,
  greatest(100 * (1 + o_orderkey % 3) + 50, 100 * (o_custkey % 6)) + 10 AS cpu_milli, greatest(1048576 * (64 + o_orderkey % 64) + 1048576, 1048576 * (o_custkey % 300)) + 1048576 AS memory FROM orders JOIN customer ON o_custkey = c_custkey)"""


def nodes(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("cluster"), (1000 * (1 + k % 64)).alias("cpu_milli"), (1073741824 * (1 + k % 128)).alias("memory"), (k % 50 != 0).alias("ready"))


def pods(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    own = F.array(F.struct((100 * (1 + k % 3)).alias("cpu_milli"), (1048576 * (64 + k % 64)).alias("memory")), F.struct(F.lit(50).cast("long").alias("cpu_milli"), F.lit(1048576).cast("long").alias("memory")))
    init = F.array(F.struct((100 * (c % 6)).alias("cpu_milli"), (1048576 * (c % 300)).alias("memory")))
    over = F.struct(F.lit(10).cast("long").alias("cpu_milli"), F.lit(1048576).cast("long").alias("memory"))
    phase = F.when(F.col("o_orderstatus") == "F", F.when(k % 2 == 0, "Succeeded").otherwise("Failed")).when(F.col("o_orderstatus") == "O", "Running").otherwise("Pending")
    return o.select(F.col("c_nationkey").alias("cluster"), phase.alias("phase"), (k % 41 == 0).alias("unschedulable"), capacity.pod_request(own, init, over, "cpu_milli").alias("cpu_milli"), capacity.pod_request(own, init, over, "memory").alias("memory"))


_CAPACITY_SQL = f"""{NODES_SQL}, {PODS_SQL}, h AS (SELECT cluster, sum(cpu_milli) AS ac, sum(memory) AS am, count(*) AS nodes FROM nodes GROUP BY 1
), u AS (SELECT cluster, sum(cpu_milli) AS rc, sum(memory) AS rm FROM pods WHERE phase NOT IN ('Succeeded', 'Failed') GROUP BY 1
), cap AS (SELECT h.cluster, CAST(ac AS BIGINT) AS allocatable_cpu, CAST(am AS BIGINT) AS allocatable_memory, nodes, CAST(coalesce(rc, 0) AS BIGINT) AS requested_cpu, CAST(coalesce(rm, 0) AS BIGINT) AS requested_memory FROM h LEFT JOIN u USING (cluster))"""


@query(f"""WITH {_CAPACITY_SQL} SELECT *, allocatable_cpu - requested_cpu AS available_cpu, allocatable_memory - requested_memory AS available_memory,
  CAST(floor((allocatable_cpu - requested_cpu)::HUGEINT * 250 / 1000.0) AS BIGINT) AS budget_cpu, CAST(((allocatable_memory - requested_memory)::HUGEINT * 250 - (((allocatable_memory - requested_memory)::HUGEINT * 250 % 1000) + 1000) % 1000) // 1000 AS BIGINT) AS budget_memory FROM cap""")
def cluster_capacity(spark, sf_dir):
    return capacity.capacity(nodes(spark, sf_dir), pods(spark, sf_dir), ["cluster"])


@query(f"""WITH {_CAPACITY_SQL}, p AS (SELECT c_custkey, c_nationkey AS cluster, CAST(c_custkey % 9 AS DOUBLE) AS current, CAST(c_custkey % 31 AS DOUBLE) AS desired, CAST(CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 500 * (c_custkey % 10) END AS BIGINT) AS cpu_milli, CAST(1073741824 AS BIGINT) AS memory FROM customer)
SELECT c_custkey, desired - current <= 0 OR coalesce(cpu_milli > 0 AND ceil(desired - current) * cpu_milli * 1000 <= (allocatable_cpu - requested_cpu) * 250 AND ceil(desired - current) * memory * 1000 <= (allocatable_memory - requested_memory)::DOUBLE * 250, false) AS allowed FROM p LEFT JOIN cap USING (cluster)""")
def capacity_headroom(spark, sf_dir):
    k = F.col("c_custkey")
    proposals = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("cluster"), (k % 9).cast("double").alias("current"), (k % 31).cast("double").alias("desired"), F.when(k % 10 == 0, 0).otherwise(500 * (k % 10)).alias("cpu_milli"), F.lit(1073741824).cast("long").alias("memory"))
    out = capacity.capacity_allows(proposals, capacity.capacity(nodes(spark, sf_dir), pods(spark, sf_dir), ["cluster"]), ["cluster"])
    return out.select("c_custkey", "allowed")


@query(f"""WITH {NODES_SQL}, {PODS_SQL}, n AS (SELECT cluster, bool_and(ready) AS nodes_ready, count(*) AS nodes FROM nodes GROUP BY 1), w AS (SELECT cluster, count(*) FILTER (phase = 'Pending' AND unschedulable) AS unschedulable FROM pods GROUP BY 1)
SELECT cluster, nodes_ready, nodes, coalesce(unschedulable, 0) AS unschedulable, nodes_ready AND coalesce(unschedulable, 0) <= 5 AS healthy FROM n LEFT JOIN w USING (cluster)""")
def cluster_health(spark, sf_dir):
    return capacity.health(nodes(spark, sf_dir), pods(spark, sf_dir), ["cluster"], 5)


_DURATION_TEXT = "CASE o_orderkey % 6 WHEN 0 THEN (o_orderkey % 90) || 'd' WHEN 1 THEN (o_orderkey % 9) || 'h' || (o_orderkey % 60) || 'm' WHEN 2 THEN (o_orderkey % 300) || 's' WHEN 3 THEN '1.5h' WHEN 4 THEN 'soon' ELSE (o_orderkey % 1000) || 'ms' END"
_DURATION_S = "CASE o_orderkey % 6 WHEN 0 THEN 86400.0 * (o_orderkey % 90) WHEN 1 THEN 3600.0 * (o_orderkey % 9) + 60 * (o_orderkey % 60) WHEN 2 THEN o_orderkey % 300 WHEN 3 THEN 5400.0 WHEN 4 THEN NULL ELSE (o_orderkey % 1000) / 1000.0 END"


@query(f"""SELECT o_orderkey, round(CAST({_DURATION_S} AS DOUBLE), 6) AS seconds, CASE WHEN s IS NULL THEN NULL WHEN s = 0 THEN '0s' WHEN s % 86400 = 0 THEN (s // 86400) || 'd' WHEN s % 3600 = 0 THEN (s // 3600) || 'h' WHEN s % 60 = 0 THEN (s // 60) || 'm' ELSE s || 's' END AS shown
FROM (SELECT o_orderkey, CAST(floor({_DURATION_S}) AS BIGINT) AS s FROM orders)""")
def duration_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    s = lambda n: (k % n).cast("string")
    written = F.when(k % 6 == 0, F.concat(s(90), F.lit("d"))).when(k % 6 == 1, F.concat(s(9), F.lit("h"), s(60), F.lit("m"))).when(k % 6 == 2, F.concat(s(300), F.lit("s"))).when(k % 6 == 3, "1.5h").when(k % 6 == 4, "soon").otherwise(F.concat(s(1000), F.lit("ms")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", time.parse_duration(written).alias("seconds"))
    return rows.select("o_orderkey", F.round("seconds", 6).alias("seconds"), time.format_duration(F.floor("seconds")).alias("shown"))


def declared_objects(spark, sf_dir) -> DataFrame:
    """A scaling object per supplier with two or three triggers, some of them with a fault."""
    k = F.col("s_suppkey")
    predictive = F.struct(
        F.lit("external").alias("type"), F.lit("ahead").alias("name"),
        F.create_map(F.lit("scalerAddress"), F.lit("scaler:9090"), F.lit("sourceTrigger"), F.when(k % 11 == 0, "nowhere").otherwise("load"), F.lit("forecastHorizon"), F.when(k % 5 == 0, "12m").otherwise("10m"), F.lit("trainingWindow"), F.when(k % 6 == 0, "1d").otherwise("14d"), F.lit("quantile"), F.when(k % 7 == 0, "1.5").otherwise("0.97"), F.lit("modelEngine"), F.when(k % 4 == 0, "holt-winters").otherwise("")).alias("metadata"),
    )
    source = F.struct(F.lit("prometheus").alias("type"), F.lit("load").alias("name"), F.create_map(F.lit("serverAddress"), F.when(k % 9 == 0, "http://user@metrics").otherwise("http://metrics:9090"), F.lit("query"), F.concat(F.lit("sum(load{s=\""), k.cast("string"), F.lit("\"})")), F.lit("threshold"), F.when(k % 8 == 0, "0").otherwise("500")).alias("metadata"))
    other = F.struct(F.lit("cpu").alias("type"), F.lit("").alias("name"), F.create_map(F.lit("value"), F.lit("80")).alias("metadata"))
    body = F.to_json(F.struct(F.concat(F.lit("ns"), F.col("s_nationkey").cast("string")).alias("namespace"), F.col("s_name").alias("name"), F.lit("u").alias("uid"), F.lit(1).alias("generation"), F.lit("deploy").alias("target"), F.when(k % 10 == 0, 60).otherwise(2).alias("min_replicas"), F.lit(50).alias("max_replicas"), F.array(predictive, source, other).alias("triggers")))
    return declared.objects(table(spark, sf_dir, "supplier").select(k.alias("object_id"), body.alias("body")))


OPTIONS = declared.ParseOptions(scaler_addresses=("scaler:9090",))


@query("""WITH v AS (SELECT s_suppkey AS k, CAST(s_suppkey % 11 = 0 AS INT) AS no_source, CASE WHEN s_suppkey % 11 <> 0 THEN CAST(s_suppkey % 9 = 0 AS INT) + CAST(s_suppkey % 8 = 0 AS INT) ELSE 0 END + CAST(s_suppkey % 6 = 0 AS INT) + CAST(s_suppkey % 7 = 0 AS INT) + CAST(s_suppkey % 10 = 0 AS INT) AS others FROM supplier)
SELECT k AS object_id, CAST(no_source + others AS INTEGER) AS violations, CAST(CASE WHEN k % 5 = 0 THEN 720 ELSE 600 END AS DOUBLE) AS horizon_s, CAST(CASE WHEN k % 6 = 0 THEN 86400 ELSE 1209600 END AS DOUBLE) AS training_window_s, CASE WHEN k % 7 = 0 THEN 0.95 ELSE 0.97 END::DOUBLE AS quantile,
  CASE WHEN k % 4 = 0 THEN 'holt-winters' ELSE 'xgboost' END AS engine, no_source + others = 0 AS has_fingerprint FROM v""")
def contract_parse(spark, sf_dir):
    out = declared.contracts(declared_objects(spark, sf_dir), OPTIONS)
    return out.select("object_id", F.size("violations").alias("violations"), "horizon_s", "training_window_s", "quantile", "engine", F.col("policy_revision").isNotNull().alias("has_fingerprint"))


@query("""SELECT s_suppkey AS object_id, t.place AS place, t.role AS role, CASE WHEN t.place = 0 THEN CASE WHEN s_suppkey % 5 = 0 THEN '12m' ELSE '10m' END END AS horizon, CASE WHEN t.place = 0 THEN CASE WHEN s_suppkey % 6 = 0 THEN '1d' ELSE '14d' END END AS training_window
FROM supplier CROSS JOIN LATERAL (SELECT 0 AS place, 'predictive' AS role UNION ALL SELECT 1, CASE WHEN s_suppkey % 11 = 0 THEN 'other' ELSE 'reactive_source' END UNION ALL SELECT 2, 'other') t""")
def trigger_report(spark, sf_dir):
    return declared.trigger_report(declared_objects(spark, sf_dir), OPTIONS).select("object_id", "place", "role", "horizon", "training_window")


@query("SELECT p_brand AS name, count(*) AS rows FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("rows")).where("rows > 1")


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_custkey % 60 > 50 THEN 'replica_bounds' END, CASE WHEN o_orderkey % 13 = 0 THEN 'durations' END, CASE WHEN (600 + o_custkey % 7 * 10) % 60 <> 0 THEN 'decision_horizon' END, CASE WHEN o_orderkey % 17 = 0 THEN 'quantile' END) AS faults FROM orders
WHERE o_custkey % 60 > 50 OR o_orderkey % 13 = 0 OR (600 + o_custkey % 7 * 10) % 60 <> 0 OR o_orderkey % 17 = 0""")
def contract_faults(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("workload_id"), (c % 60).alias("min_replicas"), F.lit(50).alias("max_replicas"), F.lit(600).alias("horizon_s"), F.lit(60).alias("interval_s"), F.when(k % 13 == 0, 0).otherwise(86400).alias("training_window_s"), (c % 7 * 10).alias("startup_s"), F.lit(0).alias("buffer_s"),
        F.when(k % 17 == 0, 1.0).otherwise(0.95).alias("quantile"), F.lit("active").alias("status"), F.lit("a" * 64).alias("source_fingerprint"),
    )
    order = F.array(*[F.lit(x) for x in ("replica_bounds", "durations", "decision_horizon", "quantile")])
    found = faults_of(rows).groupBy(F.col("workload_id").alias("o_orderkey")).agg(F.collect_set("fault").alias("f"))
    return found.select("o_orderkey", F.array_join(F.array_intersect(order, "f"), ",").alias("faults"))


@query("SELECT n_nationkey AS k FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def missing_metrics(spark, sf_dir):
    have = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return report.set_difference(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), have, ["k"])


@query("""SELECT event_type AS method, CASE WHEN value > 25 THEN 'success' ELSE 'failure' END AS outcome, count(*) AS "count", max(ts) AS last_at FROM events GROUP BY 1, 2""")
def outcome_counters(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("event_type").alias("method"), F.when(F.col("value") > 25, "success").otherwise("failure").alias("outcome"), F.col("ts").alias("at"))
    return report.outcome_counters(rows, ["method"], "outcome", "at")


@query(f"""WITH {SERIES_SQL}, s AS (SELECT workload_id, max(observed_value) AS peak, avg(observed_value) AS mean, CAST(count(*) AS DOUBLE) AS samples FROM hourly GROUP BY 1)
SELECT workload_id, 'peak' AS metric, round(peak, 6) AS value FROM s UNION ALL SELECT workload_id, 'mean', round(mean, 6) FROM s UNION ALL SELECT workload_id, 'samples', samples FROM s""")
def metric_report(spark, sf_dir):
    rows = sparse(spark, sf_dir).groupBy("workload_id").agg(F.round(F.max("observed_value"), 6).alias("peak"), F.round(F.avg("observed_value"), 6).alias("mean"), F.count("*").alias("samples"))
    return report.long_metrics(rows, ["workload_id"], ["peak", "mean", "samples"])


@query(f"""WITH {SERIES_SQL}, f AS (SELECT workload_id, observed_at, max(observed_value) OVER (PARTITION BY workload_id ORDER BY observed_at ROWS BETWEEN {SEASON - 1} PRECEDING AND {SEASON - STEPS} PRECEDING) AS upper, row_number() OVER (PARTITION BY workload_id ORDER BY observed_at) AS place FROM dense
), k AS (SELECT * FROM f WHERE place >= {SEASON})
SELECT workload_id, observed_at, epoch(TIMESTAMP '2024-01-20 01:00:00') - epoch(observed_at + INTERVAL 30 SECOND) BETWEEN 0 AND 7200 AND epoch(TIMESTAMP '2024-01-20 01:00:00') - epoch(observed_at) BETWEEN 0 AND 10800 AS fresh, CASE WHEN fresh THEN ceil(upper / ({THRESHOLD_SQL})) ELSE 0 END AS served FROM k""")
def served_value(spark, sf_dir):
    out = guard.served(snapshots(spark, sf_dir), ts("2024-01-20 01:00:00"), 7200, 3, HOUR)
    return shown(out.select("workload_id", "observed_at", "fresh", "served"))


@query(f"""SELECT c_name, TIMESTAMP '{END}' AS slot, {fnv_sql('c_name', '14400')} AS offset_s, 0 >= {fnv_sql('c_name', '14400')} AS is_due FROM customer""")
def training_schedule(spark, sf_dir):
    """Per workload: its slot's start at a time, its offset within the slot, and whether it is due."""
    now = ts(END)
    rows = table(spark, sf_dir, "customer").select("c_name")
    start = time.slot_start(time.slot(now, 24 * HOUR), 24 * HOUR)
    offset = text.jitter_s(F.col("c_name"), 4 * HOUR)
    out = rows.select("c_name", start.alias("slot"), offset.alias("offset_s"))
    return shown(out.withColumn("is_due", F.unix_seconds(now) - F.unix_seconds("slot") >= F.col("offset_s")))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN value END AS value, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'not_one_series' WHEN 2 THEN 'not_finite' ELSE 'not_successful' END AS fault FROM events""")
def instant_payloads(spark, sf_dir):
    k, v = F.col("event_id"), F.col("value").cast("string")
    one = lambda x: F.concat(F.lit('{"metric":{"a":"b"},"value":[1704067200.0,"'), x, F.lit('"]}'))
    good = lambda rows: F.concat(F.lit('{"status":"success","data":{"resultType":"vector","result":['), rows, F.lit("]}}"))
    body = F.when(k % 4 == 0, good(one(v))).when(k % 4 == 1, good(F.concat(one(v), F.lit(","), one(v)))).when(k % 4 == 2, good(one(F.lit("NaN")))).otherwise(F.lit(json.dumps({"status": "error", "errorType": "bad_data", "error": "no"})))
    return payloads.instant_values(events(spark, sf_dir).select("event_id", body.alias("body"))).select("event_id", "value", "fault")


@query("""SELECT user_id, ts AS observed_at, value FROM (SELECT user_id, date_trunc('millisecond', ts) AS ts, value FROM events)""")
def range_payloads(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")) / 1000)
    point = F.concat(F.lit("["), F.col("at").cast("decimal(20,3)").cast("string"), F.lit(',"'), F.col("value").cast("string"), F.lit('"]'))
    bodies = rows.groupBy("user_id").agg(F.concat(F.lit('{"status":"success","data":{"resultType":"matrix","result":[{"metric":{},"values":['), F.array_join(F.collect_list(point), ","), F.lit("]}]}}")).alias("body"))
    return shown(payloads.range_values(bodies))


@query()
def contract_cycle(spark, sf_dir):
    """Declared objects to valid contracts, their keys and revisions."""
    out = declared.contracts(declared_objects(spark, sf_dir), OPTIONS).where("policy_revision is not null")
    return out.select("object_id", "namespace", "scaled_name", "trigger_name", "source_fingerprint", "policy_revision", time.format_duration(F.col("training_window_s")).alias("training_window"))


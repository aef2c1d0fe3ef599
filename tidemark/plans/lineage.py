"""Queries on evaluation plans, and on what may be written of their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import promote
from tidemark.operators.store import latest_per
from tidemark.plans.registry import query
from tidemark.plans.series import shown, ts
from tidemark.plans.stores import MODELS_SQL, _metrics_sql, metrics, models
from tidemark.schema import SERIES

NOW, DAY = "2001-06-20 00:00:00", 86_400
POLICY = promote.EvaluationPolicy(window_s=400 * DAY, min_duration_s=100 * DAY)
HORIZON, INTERVAL, SEASON_S = 10_800, 3_600, DAY


def versions(spark, sf_dir) -> DataFrame:
    """Models with contracts, reports and artifacts, a part of each kind with something amiss."""
    k, rows = F.col("o"), models(spark, sf_dir).withColumn("o", F.col("model_id").cast("long"))
    retired = latest_per(rows.where("status = 'retired'"), SERIES, F.col("created_at").desc(), F.col("model_id")).select(*SERIES, F.col("model_id").alias("before"))
    rows = rows.join(retired, SERIES, "left")
    contract = F.struct(
        F.lit(promote.CONTRACT_VERSION).alias("version"), F.when(k % 7 == 3, "r0").otherwise("r1").alias("policy_revision"), F.lit(HORIZON).alias("horizon_s"), F.lit(INTERVAL).alias("interval_s"), F.lit(SEASON_S).alias("season_s"),
        F.when(k % 6 == 1, 0.9).otherwise(0.95).alias("quantile"), F.lit("UTC").alias("timezone"),
    )
    hyper = F.to_json(F.struct(F.when(k % 6 != 0, contract).alias("evaluation_contract")))
    report = F.struct(
        F.get_json_object("validation_metrics", "$.promotion.action").alias("action"), F.get_json_object("validation_metrics", "$.promotion.reason").alias("reason"),
        F.when(k % 3 == 0, F.date_format(F.timestamp_seconds(F.unix_seconds("created_at") + DAY), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("at"), F.when((k % 4 != 0) & (F.col("status") == "active"), F.col("before")).alias("previous_id"),
    )
    artifact = F.concat(F.lit('{"quantile":'), F.when(k % 19 == 0, "0.9").otherwise("0.95"), F.lit("}")).cast("binary")
    return rows.withColumns({
        "trained_until": F.when(k % 11 == 0, F.lit(None).cast("timestamp")).when(k % 13 == 0, ts("2030-01-01 00:00:00")).otherwise(F.col("created_at")),
        "hyperparameters": hyper,
        "validation_metrics": F.to_json(F.struct(report.alias("promotion"))),
        "artifact": artifact,
        "artifact_sha256": F.when(k % 17 == 0, "other").otherwise(F.sha2(artifact, 256)),
        "engine": F.when(k % 23 == 0, "gru").otherwise("xgboost"),
    }).drop("before", "o")


def declared(spark) -> DataFrame:
    rows = spark.range(200).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("workload_id"), F.lit("f").alias("source_fingerprint"), F.when(F.col("id") % 20 == 0, "inactive").otherwise("active").alias("status"))
    return rows.select("*", F.lit("xgboost").alias("engine"), F.lit("r1").alias("policy_revision"), F.lit(HORIZON).alias("horizon_s"), F.lit(INTERVAL).alias("interval_s"), F.lit(0).alias("startup_s"), F.lit(0).alias("buffer_s"), F.lit(0.95).alias("quantile"), F.lit("UTC").alias("timezone"))


_VERSIONS_SQL = f"""{MODELS_SQL}, ret AS (SELECT workload_id, model_id AS before FROM (SELECT *, row_number() OVER (PARTITION BY workload_id ORDER BY created_at DESC, model_id) AS n FROM models WHERE status = 'retired') WHERE n = 1
), versions AS (SELECT m.workload_id, model_id, status, created_at, action, report_reason, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN TIMESTAMP '2030-01-01' ELSE created_at END AS trained_until, o_orderkey % 6 = 0 AS bare,
  CASE WHEN o_orderkey % 7 = 3 THEN 'r0' ELSE 'r1' END AS rev, o_orderkey % 6 = 1 AS other_q, o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AS intact, CASE WHEN o_orderkey % 23 = 0 THEN 'gru' ELSE 'xgboost' END AS engine,
  CASE WHEN o_orderkey % 3 = 0 THEN created_at + INTERVAL 1 DAY ELSE TIMESTAMP '1970-01-01' END AS report_at, CASE WHEN o_orderkey % 4 <> 0 AND status = 'active' THEN before END AS followed, CASE WHEN status = 'active' THEN created_at END AS activated_at, NOT bare AND NOT other_q AND rev = 'r1' AS same, bare OR NOT other_q AS comparable
  FROM models m LEFT JOIN ret USING (workload_id))"""
_PLAN_SQL = f"""{_VERSIONS_SQL}, n AS (SELECT workload_id, max(created_at) AS active_at FROM versions WHERE status = 'active' GROUP BY 1
), o AS (SELECT v.* FROM versions v LEFT JOIN n USING (workload_id) WHERE status <> 'candidate' OR (created_at > coalesce(active_at, TIMESTAMP '1970-01-01') AND action <> 'rejected' AND report_reason NOT IN ('incompatible_contract', 'candidate_expired', 'invalid_artifact', 'invalid_training_boundary'))
), r AS (SELECT *, row_number() OVER (PARTITION BY workload_id, status ORDER BY CASE WHEN status = 'candidate' THEN epoch_us(created_at) ELSE -epoch_us(created_at) END, model_id) AS nth FROM o
), one AS (SELECT * FROM r WHERE nth = 1), w AS (SELECT 'w' || i AS workload_id FROM range(200) t(i) WHERE i % 20 <> 0
), j AS (SELECT w.workload_id, a AS act, p AS prev, CASE WHEN NOT coalesce(c.report_at > a.report_at, false) THEN c END AS cand FROM w LEFT JOIN one c ON c.workload_id = w.workload_id AND c.status = 'candidate' LEFT JOIN one a ON a.workload_id = w.workload_id AND a.status = 'active' LEFT JOIN one p ON p.workload_id = w.workload_id AND p.status = 'retired'
), t AS (SELECT *, coalesce(cand.model_id IS NOT NULL, false) AS has, coalesce(act.model_id IS NOT NULL, false) AS serving, CASE WHEN coalesce(cand.model_id IS NOT NULL, false) THEN cand ELSE act END AS tgt FROM j
), u AS (SELECT *, coalesce(has AND serving AND act.engine = tgt.engine AND act.comparable AND act.intact, false) AS champ, coalesce(NOT has AND serving AND prev.model_id = act.followed AND prev.same, false) AS back FROM t
), plan AS (SELECT *, CASE WHEN tgt.model_id IS NULL THEN 'no_model' WHEN NOT tgt.same AND NOT (NOT has AND tgt.bare AND tgt.engine = 'xgboost') THEN 'incompatible_contract' WHEN tgt.trained_until IS NULL OR tgt.trained_until > TIMESTAMP '{NOW}' THEN 'invalid_training_boundary'
  WHEN has AND epoch(TIMESTAMP '{NOW}') - epoch(cand.created_at) > 500 * 86400 THEN 'candidate_expired' WHEN NOT tgt.intact THEN 'invalid_artifact' WHEN back AND NOT prev.intact THEN 'invalid_rollback_artifact' END AS reason FROM u
), planned AS (SELECT workload_id, CASE WHEN reason IS NOT NULL THEN 'withheld' WHEN has THEN 'evaluate_candidate' ELSE 'revalidate' END AS action, reason, tgt.model_id AS target_id, act.model_id AS expected_active_id, CASE WHEN champ THEN act.model_id END AS champion_id, CASE WHEN back THEN prev.model_id END AS previous_id,
  CASE WHEN reason IS NULL THEN greatest(tgt.trained_until, CASE WHEN champ THEN act.trained_until END, CASE WHEN back THEN prev.trained_until END, CASE WHEN back THEN act.activated_at END, TIMESTAMP '{NOW}' - INTERVAL 400 DAY) END AS evidence_after,
  CASE WHEN has THEN act.model_id ELSE act.followed END AS follows_id, act, tgt, prev FROM plan)"""


@query(f"WITH {_PLAN_SQL} SELECT workload_id, action, reason, target_id, expected_active_id, champion_id, previous_id, evidence_after, follows_id FROM planned")
def evaluation_plan(spark, sf_dir):
    out = promote.evaluation_plan(versions(spark, sf_dir), declared(spark), ts(NOW), SEASON_S, POLICY)
    return shown(out.drop("policy_revision", "contract", "history"))


def reports(spark, sf_dir) -> DataFrame:
    """A report for each plan that has a target, with evidence that follows from numbers; some of it out of date."""
    plan = promote.evaluation_plan(versions(spark, sf_dir), declared(spark), ts(NOW), SEASON_S, POLICY).where("target_id is not null")
    k = F.col("k")
    rows = plan.withColumn("k", F.col("target_id").cast("long")).withColumns({"k1": k + 1, "k2": k + 2, "k3": k + 3})
    scored = rows.select("*", *metrics("candidate", "k"), *metrics("other", "k1"), *metrics("baseline", "k2"), *metrics("earlier", "k3"))
    shift = lambda t, s: F.timestamp_seconds(F.unix_seconds(t) + s)
    action = F.when(F.col("action") == "evaluate_candidate", F.when(k % 5 == 0, "rejected").otherwise("promote")).when(F.col("action") == "revalidate", F.when(F.col("previous_id").isNotNull(), "rollback").otherwise("revalidated")).otherwise("withheld")
    scored = scored.withColumns({"action": action, "champion": F.when(F.col("champion_id").isNotNull(), F.col("other")), "previous": F.when(F.col("previous_id").isNotNull(), F.col("earlier"))})
    return scored.withColumns({
        "at": shift(ts(NOW), -60 * (k % 12)),
        "start": shift(F.coalesce("evidence_after", ts("2001-01-01 00:00:00")), F.when(k % 8 == 0, -10 * DAY).otherwise(0)),
        "end": shift(ts(NOW), -INTERVAL),
        "fingerprint": F.when(k % 31 != 0, "x"),
        "expected_active_id": F.when(k % 37 == 0, "gone").otherwise(F.col("expected_active_id")),
        "policy_revision": F.when(k % 29 == 0, "r0").otherwise(F.col("policy_revision")),
    })


_SAFE = "({p}_w >= 72 AND {p}_c >= 0.95::DOUBLE - 0.03::DOUBLE AND {p}_c <= 1 AND {p}_x <= 0.5)"


def _passes(c: str, r: str, champion: str, gain: str) -> str:
    return f"({_SAFE.format(p=c)} AND {r}_c <= 1 AND {r}_w = {c}_w AND {c}_m <= {r}_m + 1e-9 AND {c}_k <= {r}_k + 1e-9 AND {c}_u <= {r}_u + 1e-9 AND ((NOT ({champion}) AND {c}_p <= 1e-9 AND {r}_p <= 1e-9) OR {c}_p < {r}_p * (1 - {gain}::DOUBLE) - 1e-9))"


@query(f"""WITH {_PLAN_SQL}, p AS (SELECT *, CAST(target_id AS BIGINT) AS k, CASE WHEN action = 'evaluate_candidate' THEN CASE WHEN CAST(target_id AS BIGINT) % 5 = 0 THEN 'rejected' ELSE 'promote' END WHEN action = 'revalidate' THEN CASE WHEN previous_id IS NOT NULL THEN 'rollback' ELSE 'revalidated' END ELSE 'withheld' END AS act_
  FROM planned WHERE target_id IS NOT NULL
), s AS (SELECT *, {_metrics_sql('a', 'k')}, {_metrics_sql('b', '(k + 1)')}, {_metrics_sql('d', '(k + 2)')}, {_metrics_sql('e', '(k + 3)')}, TIMESTAMP '{NOW}' - (k % 12) * INTERVAL 1 MINUTE AS at_, coalesce(evidence_after, TIMESTAMP '2001-01-01') - CASE WHEN k % 8 = 0 THEN INTERVAL 10 DAY ELSE INTERVAL 0 DAY END AS start_, TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AS end_ FROM p
), x AS (SELECT *, k % 31 <> 0 AND end_ <= at_ AND epoch(end_) - epoch(start_) >= 100 * 86400 AND epoch(at_) - epoch(end_) <= {HORIZON + 3 * INTERVAL} AND epoch(TIMESTAMP '{NOW}') - epoch(at_) <= 600 AS fresh, CASE WHEN act_ = 'rollback' THEN prev ELSE tgt END AS won FROM s
), y AS (SELECT *, coalesce(won.same AND start_ >= coalesce(won.trained_until, TIMESTAMP '1970-01-01') AND (champion_id IS NULL OR start_ >= coalesce(act.trained_until, TIMESTAMP '1970-01-01')) AND (act_ <> 'rollback' OR (start_ >= coalesce(act.activated_at, TIMESTAMP '1970-01-01') AND start_ >= coalesce(act.trained_until, TIMESTAMP '1970-01-01'))), false) AS fits,
  CASE WHEN champion_id IS NOT NULL THEN {_passes('a', 'b', 'true', '0.03')} ELSE {_passes('a', 'd', 'false', '0.03')} END AS passes, {_passes('e', 'a', 'true', '0.1')} AS returns, coalesce(won.status = 'active' AND start_ >= coalesce(won.trained_until, TIMESTAMP '1970-01-01') AND {_SAFE.format(p='a')} AND d_c <= 1 AND a_w = d_w AND a_p <= d_p * 1.1::DOUBLE + 1e-9, false) AS renews FROM x
), f AS (SELECT workload_id, target_id, CASE WHEN k % 29 = 0 THEN 'policy_changed' WHEN k % 37 = 0 THEN 'active_model_changed' WHEN won.engine IS DISTINCT FROM 'xgboost' THEN 'unknown_target' WHEN act_ IN ('promote', 'rollback', 'revalidated') AND NOT fresh THEN 'evidence_not_current'
  WHEN act_ = 'revalidated' AND NOT renews THEN 'renewal_refused' WHEN act_ IN ('promote', 'rollback') AND NOT fits THEN 'incompatible_evidence' WHEN act_ = 'promote' AND NOT passes THEN 'evidence_refuses' WHEN act_ = 'rollback' AND NOT returns THEN 'evidence_refuses'
  WHEN act_ = 'promote' AND won.status <> 'candidate' THEN 'unexpected_status' WHEN act_ = 'rollback' AND won.status <> 'retired' THEN 'unexpected_status' WHEN act_ = 'rollback' AND act.followed IS DISTINCT FROM previous_id THEN 'not_the_previous_champion' END AS fault FROM y)
SELECT workload_id, target_id, fault FROM f WHERE fault IS NOT NULL""")
def commit_faults(spark, sf_dir):
    out = promote.commit_faults(reports(spark, sf_dir), declared(spark), versions(spark, sf_dir), ts(NOW), SEASON_S, POLICY)
    return out.select("workload_id", "target_id", "fault")

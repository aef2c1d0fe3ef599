"""Stored models from training to service: scored as of each origin, committed, and what may go wrong."""

import datetime as dt
import json
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import START, at, series
from tests.test_queries import SF, plain
from tidemark.operators import evaluate, features, learned, promote, scoring, training
from tidemark.plans import ORACLES, QUERIES
from tidemark.schema import MODELS, SERIES

SHAPE = {"length": 30, "hidden": 4, "epochs": 1, "batch": 64, "rate": 0.01, "clip": 1.0, "decay": 0.0, "examples": 64}
POLICY = promote.EvaluationPolicy(window_s=6 * 3600, min_duration_s=4 * 3600, min_windows=6, max_windows=24, coverage_tolerance=0.5, max_relative_underprediction=1.0)
NOW = 12 * 60


def values(n, seed=1):
    rng = np.random.default_rng(seed)
    return [round(20 + 10 * (k % 60 >= 30) + 4 * float(rng.random()), 3) for k in range(n)]


def contracts(spark, rows):
    """Rows (workload, engine, interval_s, horizon_s, quantile, timezone)."""
    wide = [(w, "f", "main", "r1", 5.0, q, h, 30 * 86400, i, 0, 0, e, z, 0, 50, "active") for w, e, i, h, q, z in rows]
    ddl = "workload_id string, source_fingerprint string, cluster_id string, policy_revision string, threshold double, quantile double, horizon_s long, training_window_s long, interval_s long, startup_s long, buffer_s long, engine string, timezone string, min_replicas int, max_replicas int, status string"
    return spark.createDataFrame(wide, ddl)


def now(minute=NOW):
    return F.lit(at(minute))


@pytest.fixture(scope="module")
def trained(spark):
    """Two learned series and a plain one, with models trained at minute 480."""
    points = values(NOW)
    samples = series(spark, points, "t").unionByName(series(spark, points, "n")).unionByName(series(spark, points, "p"))
    declared = contracts(spark, [("t", "xgboost", 60, 600, 0.9, "Asia/Tokyo"), ("n", "gru", 60, 600, 0.9, "Asia/Tokyo"), ("p", "rolling-quantile", 60, 600, 0.9, "UTC")])
    models, outcomes = training.train_by_contract(samples, declared, now(480), 3600, shape=SHAPE)
    return samples, declared, models, outcomes


def test_candidates_are_rows_of_the_models_table(spark, trained):
    samples, declared, models, outcomes = trained
    stored = spark.createDataFrame([], MODELS).unionByName(models.drop("rows"))
    rows = {r.workload_id: r for r in stored.collect()}
    assert set(rows) == {"t", "n", "p"} and {r.status for r in outcomes.collect()} == {"succeeded"}
    for r in rows.values():
        made_for = json.loads(r.hyperparameters)["evaluation_contract"]
        assert (made_for["horizon_s"], made_for["interval_s"], made_for["season_s"], made_for["quantile"]) == (600, 60, 3600, 0.9)
        assert r.trained_until == at(480 - 1 - 96) and r.created_at == at(480) and r.cluster_id == "main"
    assert rows["t"].feature_schema == features.FEATURE_SCHEMA and rows["p"].feature_schema == "v1"
    plan = promote.evaluation_plan(stored, declared, now(), 3600, POLICY).collect()
    assert {(r.workload_id, r.action, r.history) for r in plan} == {("t", "evaluate_candidate", 61), ("n", "evaluate_candidate", 60), ("p", "evaluate_candidate", 60)}


def test_forecasts_see_only_what_lies_before_their_origin(spark, trained):
    """Each model at each origin against its forecast on the series cut off there."""
    samples, declared, models, _ = trained
    seen = {}
    predict = scoring.predict_at
    try:
        scoring.predict_at = lambda rows, known, names: seen.setdefault("out", predict(rows, known, names))
        reports = training.evaluate_models(samples, declared, models, now(), 3600, POLICY).collect()
    finally:
        scoring.predict_at = predict
    assert {r.action for r in reports} <= {"promote", "rejected"} and all(r.windows == 33 for r in reports)
    got = {(r.workload_id, r.model, r.origin): (r.p50, r.upper) for r in seen["out"].collect()}
    assert len(got) == 3 * 2 * 24
    points = values(NOW)
    artifacts = {r.workload_id: bytes(r.artifact) for r in models.collect()}
    origins = sorted({o for _, _, o in got})
    for origin in origins[::6]:
        n = int((origin - START.replace(tzinfo=None)).total_seconds() / 60) + 1
        for w in "tnp":
            base = max(points[n - 60 : n - 50])
            assert got[w, "baseline", origin] == (base, base)
        known = series(spark, points[:n], "t")
        row = features.feature_rows(known.withColumn("timezone", F.lit("Asia/Tokyo")), [*features.PROVIDERS[:-1], lambda x: features.calendar_features(x, "Asia/Tokyo")]).orderBy(F.col("observed_at").desc()).first()
        spec = learned.decoded(artifacts["t"])
        x = np.array([[np.float32(row[f]) for f in spec["features"]]], float)
        low = max(0.0, spec["model"]["p50"].predict(x)[0])
        assert np.allclose(got["t", "candidate", origin], (low, max(low, spec["model"]["upper"].predict(x)[0])))
        pdf = known.toPandas().assign(clock=lambda d: d["observed_at"] + dt.timedelta(hours=9))
        assert np.allclose(got["n", "candidate", origin], learned.predict_sequence(learned.decoded(artifacts["n"]), pdf))
        peaks = sorted(max(points[k : k + 10]) for k in range(n - 9))
        rank = lambda q: peaks[int(np.ceil(round(q * len(peaks), 9))) - 1]  # noqa: B023, E731
        assert got["p", "candidate", origin] == (rank(0.5), rank(0.9))


def served(models, status="active", minute=481):
    return models.withColumns({"status": F.lit(status), "activated_at": F.lit(at(minute))})


def changed(models, workload, **columns):
    return models.withColumns({c: F.when(F.col("workload_id") == workload, v).otherwise(F.col(c)) for c, v in columns.items()})


def junk():
    """An artifact that is what its digest says, and no model."""
    raw = bytearray(b'{"quantile":0.9,"format":"quantile-trees","length":61}')
    return {"artifact": F.lit(raw), "artifact_sha256": F.sha2(F.lit(raw), 256)}


def test_what_can_be_wrong_with_artifacts(spark, trained):
    samples, declared, models, _ = trained
    one = models.where("workload_id = 't'")
    # A candidate that can't be read is taken out for good; as a champion it gives way to the baseline.
    r = training.evaluate_models(samples, declared, changed(one, "t", **junk()), now(), 3600, POLICY).where("workload_id = 't'").first()
    assert (r.action, r.reason) == ("withheld", "invalid_artifact")
    champion = changed(served(one), "t", model_id=F.lit("old"), **junk())
    newer = one.withColumn("created_at", F.lit(at(482)))
    r = training.evaluate_models(samples, declared, champion.unionByName(newer), now(), 3600, POLICY).where("workload_id = 't'").first()
    assert r.action in ("promote", "rejected") and r.champion is None and r.baseline.windows == r.candidate.windows == 24
    r = training.evaluate_models(samples, declared, changed(one, "t", artifact=F.lit(bytearray(b"\xff\xfe"))), now(), 3600, POLICY).where("workload_id = 't'").first()
    assert r.reason == "invalid_artifact"


def test_return_to_the_model_before(spark, trained):
    """An active model that fails its renewal gives way to the one it followed; the commit links them."""
    samples, declared, models, _ = trained
    good = models.where("workload_id = 'p'")
    before = served(good.withColumn("model_id", F.lit("before")), "retired", 470)
    poor = learned.encoded({"format": "quantile-trees", "schema": features.FEATURE_SCHEMA, "features": ["current_value"], "quantile": 0.9, "trees": {k: {"q": 0.5, "base": 1.0, "edges": [[]], "trees": []} for k in ("p50", "upper")}})
    report = json.dumps({"promotion": {"action": "promote", "at": "2026-01-01T08:01:00Z", "previous_id": "before"}})
    now_active = served(good.withColumn("model_id", F.lit("after")), minute=400).withColumns({"engine": F.lit("xgboost"), "artifact": F.lit(bytearray(poor[0])), "artifact_sha256": F.lit(poor[1]), "validation_metrics": F.lit(report)})
    own = declared.where("workload_id = 'p'")
    stored = before.unionByName(now_active)
    reports = training.evaluate_models(samples, own, stored, now(), 3600, POLICY).cache()
    r = reports.first()
    assert (r.action, r.previous_id, r.target_id) == ("rollback", "before", "after") and r.start >= at(400)
    # The commit wants the returning model to be of the contract's engine, as it is.
    after = {m.model_id: m for m in promote.committed(stored, reports, own, now(), 3600, POLICY).collect()}
    assert (after["before"].status, after["after"].status) == ("active", "retired") and after["before"].activated_at == at(NOW)
    written = json.loads(after["before"].validation_metrics)
    assert written["promotion"]["previous_id"] == "after" and len(written["history"]) == 1
    # A second commit of the same reports is refused: another model serves by now.
    again = promote.committed(promote.committed(stored, reports, own, now(), 3600, POLICY), reports, own, now(), 3600, POLICY)
    assert {m.model_id: m.status for m in again.collect()} == {"before": "active", "after": "retired"}


def test_audit_keeps_its_last_entries(spark, trained):
    models = trained[2].where("workload_id = 'p'")
    target = models.first().model_id
    for k in range(23):
        report = spark.createDataFrame([("p", "f", "rejected", f"r{k}", target, None, None, None, at(k))], "workload_id string, source_fingerprint string, action string, reason string, target_id string, expected_active_id string, previous_id string, follows_id string, at timestamp")
        models = promote.audited(models, report)
        if k % 6 == 5:
            models = spark.createDataFrame(models.collect(), models.schema)
    metrics = json.loads(models.first().validation_metrics)
    reasons = [json.loads(x)["reason"] if isinstance(x, str) else x["reason"] for x in metrics["history"]]
    assert reasons == [f"r{k}" for k in range(3, 23)] and metrics["promotion"]["reason"] == "r22"


def test_intervals_side_by_side(spark):
    """Contracts of 10 seconds, a minute and an hour in one run, and those that can't be trained for."""
    points = {w: series(spark, [(k * step, 5 + k % 6) for k in range(n)], w) for w, step, n in (("s", 1 / 6, 1200), ("m", 1, 1200), ("h", 60, 200), ("u", 1, 400), ("g", 1, 400), ("x", 1, 400), ("short", 1, 20))}
    samples = points["s"]
    for w in list(points)[1:]:
        samples = samples.unionByName(points[w])
    plain = "seasonal-baseline"
    declared = contracts(spark, [("s", plain, 10, 60, 0.9, "UTC"), ("m", plain, 60, 600, 0.9, "UTC"), ("h", plain, 3600, 7200, 0.9, "UTC"), ("u", plain, 60, 90, 0.9, "UTC"), ("g", plain, 60, 600, 0.9, "Mars/Base"), ("x", "none", 60, 600, 0.9, "UTC"), ("short", plain, 60, 600, 0.9, "UTC"), ("gone", plain, 60, 600, 0.9, "UTC")])
    models, outcomes = training.train_by_contract(samples, declared, now(60 * 201), 3600)
    assert {r.workload_id: r.rows for r in models.collect()} == {"s": 960, "m": 960, "h": 160}
    reasons = {r.workload_id: r.failure_reason for r in outcomes.collect()}
    assert reasons == {"s": None, "m": None, "h": None, "u": "invalid_contract", "g": "unknown_timezone", "x": "unknown_engine", "short": "insufficient_contiguous_history", "gone": "insufficient_contiguous_history"}
    origins = evaluate.paired_origins(samples.join(declared.select(*SERIES, "interval_s", (F.col("horizon_s") / F.col("interval_s")).alias("steps")), SERIES).where("workload_id in ('s', 'm', 'h')"), F.col("interval_s"), F.col("steps"), 6)
    count = {r.workload_id: r.n for r in origins.groupBy("workload_id").agg(F.count("*").alias("n")).collect()}
    assert count == {"s": (1200 - 6) // 6, "m": (1200 - 6) // 10, "h": (200 - 6) // 2}
    # Every target is one horizon behind the one before.
    hours = sorted((r.origin, r.target_end) for r in origins.where("workload_id = 'h'").collect())
    assert all(a[1] == b[0] for a, b in zip(hours, hours[1:], strict=False))


def test_no_models_and_no_samples(spark, trained):
    samples, declared, models, _ = trained
    empty = spark.createDataFrame([], MODELS)
    got = {r.workload_id: (r.action, r.reason) for r in training.evaluate_models(samples, declared, empty, now(), 3600, POLICY).collect()}
    assert got == dict.fromkeys("tnp", ("withheld", "no_model"))
    got = {r.workload_id: (r.action, r.reason) for r in training.evaluate_models(samples.limit(0), declared, models.drop("rows"), now(), 3600, POLICY).collect()}
    assert got == dict.fromkeys("tnp", ("withheld", "stale_source"))
    off = promote.EvaluationPolicy("off")
    assert training.evaluate_models(samples, declared, models, now(), 3600, off).count() == 0


@pytest.mark.parametrize("name", ["interval_decision", "model_lifecycle", "stream_forecasts"])
def test_last_half_second_before_a_slot(spark, tmp_path, name):
    """An event within half a second of the next slot counts there, as in the SQL, which rounds to whole seconds, half to even."""
    c = duckdb.connect()
    extra = [(10**6 + k, dt.datetime(2024, 1, day, hour, 59, 59, micro), k % 8, kind, 400.0 + k) for k, (kind, day, hour, micro) in enumerate(product(("click", "view", "purchase", "signup", "error"), (10, 20, 28, 29, 30), (2, 9, 16, 22), (499_999, 500_000, 500_001)))]
    c.execute(f"CREATE TABLE events AS SELECT event_id, ts, user_id, event_type, value FROM '{SF}/events.parquet'")
    c.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?)", extra)
    c.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    cursor = c.execute(ORACLES[name])
    places = [[d[0] for d in cursor.description].index(k) for k in columns]
    assert sorted(str([plain(r[k]) for k in columns]) for r in df.collect()) == sorted(str([plain(r[p]) for p in places]) for r in cursor.fetchall())

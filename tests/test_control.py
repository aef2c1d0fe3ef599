import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tests.helpers import START, at, series
from tidemark.functions.text import FNV_OFFSET, FNV_PRIME, fnv1a_64, is_plain_address, jitter_s
from tidemark.operators import capacity, promote, store, training
from tidemark.schema import SERIES, active_model_faults, sample_faults
from tidemark.sources import contracts as declared
from tidemark.sources import payloads


def test_fnv(spark):
    def plain(text):
        h = FNV_OFFSET
        for b in text.encode():
            h = (h ^ b) * FNV_PRIME % 2**64
        return h

    texts = ["", "a", "workload-1", "é漢", "x" * 300]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    assert "Python" not in df.select(fnv1a_64("t"))._jdf.queryExecution().executedPlan().toString()
    assert [int(r[0]) if r[0] is not None else None for r in df.select(fnv1a_64("t")).collect()] == [plain(t) for t in texts] + [None]
    assert [r[0] for r in df.where("t is not null").select(jitter_s(F.col("t"), 15)).collect()] == [plain(t) % 15 for t in texts]


@pytest.mark.parametrize("address,ok", [("http://m:9090", True), ("https://m/path?x=1", True), ("ftp://m", False), ("http://u@m", False), ("http://m/#f", False), ("http://", False), ("m:9090", False), (None, False)])
def test_addresses(spark, address, ok):
    assert spark.createDataFrame([(address,)], "a string").select(is_plain_address(F.col("a"))).first()[0] is ok


OPTIONS = declared.ParseOptions(scaler_addresses=("s:1",))


def declare(spark, triggers=None, **more):
    source = {"type": "prometheus", "name": "load", "metadata": {"serverAddress": "http://m:9090", "query": "sum(x)", "threshold": "500"}}
    ahead = {"type": "external", "name": "ahead", "metadata": {"scalerAddress": "s:1", "sourceTrigger": "load"}}
    spec = {"namespace": "ns", "name": "o", "uid": "u", "generation": 1, "target": "t", "min_replicas": 3, "max_replicas": 50, "triggers": triggers([source, ahead]) if triggers else [source, ahead]} | more
    rows = declared.objects(spark.createDataFrame([(1, json.dumps(spec))], "object_id int, body string"))
    return declared.contracts(rows, OPTIONS).collect(), declared.trigger_report(rows, OPTIONS).collect()


def changed(place, **metadata):
    def change(triggers):
        triggers[place]["metadata"] |= metadata
        return triggers

    return change


def test_valid_contract(spark):
    (c,), report = declare(spark)
    assert not c.violations and (c.horizon_s, c.training_window_s, c.interval_s, c.quantile, c.engine, c.timezone) == (600, 30 * 86400, 60, 0.95, "xgboost", "UTC")
    assert (c.min_replicas, c.max_replicas, c.threshold, c.query) == (3, 50, 500, "sum(x)") and len(c.policy_revision) == 64
    assert sorted(r.role for r in report) == ["predictive", "reactive_source"]
    (d,), _ = declare(spark, changed(1, safetyBuffer="1m"))
    assert d.source_fingerprint == c.source_fingerprint and d.policy_revision != c.policy_revision


@pytest.mark.parametrize(
    "place,metadata,word",
    [
        (0, {"threshold": "0"}, "threshold"), (0, {"threshold": "NaN"}, "threshold"), (0, {"serverAddress": "http://u:p@m"}, "serverAddress"), (0, {"query": " "}, "query"),
        (1, {"sourceTrigger": "none"}, "no trigger"), (1, {"sourceTrigger": ""}, "missing"), (1, {"forecastHorizon": "90s"}, "multiple"), (1, {"forecastHorizon": "-1m"}, "no duration"), (1, {"trainingWindow": "1d"}, "trainingWindow"),
        (1, {"trainingWindow": "91d"}, "trainingWindow"), (1, {"quantile": "1"}, "quantile"), (1, {"modelEngine": "magic"}, "modelEngine"), (1, {"immediateTraining": "maybe"}, "immediateTraining"), (1, {"samplingInterval": "7s"}, "sampling"), (1, {"businessTimezone": "not a zone"}, "Timezone"),
    ],
)
def test_invalid_contracts(spark, place, metadata, word):
    (c,), _ = declare(spark, changed(place, **metadata))
    assert c.violations and any(word in v for v in c.violations) and c.policy_revision is None


def test_bounds_names_and_sources(spark):
    (c,), _ = declare(spark, min_replicas=60)
    assert any("minReplicaCount" in v for v in c.violations)
    (c,), _ = declare(spark, lambda t: [t[0] | {"type": "cpu"}, t[1]])
    assert any("prometheus" in v for v in c.violations)
    rows, _ = declare(spark, lambda t: [*t, t[1]])
    assert len(rows) == 2 and all(any("shared" in v for v in r.violations) and any("serves" in v for v in r.violations) for r in rows)
    rows, report = declare(spark, changed(1, scalerAddress="elsewhere"))
    assert not rows and {r.role for r in report} == {"other"}


def test_payloads(spark):
    one = {"metric": {"a": "b"}, "value": [1.5, "2.5"]}
    bodies = [
        ({"status": "success", "data": {"resultType": "vector", "result": [one]}}, 2.5, None), ({"status": "success", "data": {"resultType": "scalar", "result": [1, "7"]}}, 7.0, None), ({"status": "success", "data": {"resultType": "vector", "result": []}}, None, "not_one_series"),
        ({"status": "success", "data": {"resultType": "vector", "result": [one | {"value": [1, "+Inf"]}]}}, None, "not_finite"), ({"status": "success", "data": {"resultType": "matrix", "result": []}}, None, "unsupported_type"), ({"status": "error"}, None, "not_successful"),
    ]
    df = spark.createDataFrame([(k, json.dumps(b)) for k, (b, _, _) in enumerate(bodies)] + [(9, "nonsense")], "k int, body string")
    got = {r.k: (r.value, r.fault) for r in payloads.instant_values(df).collect()}
    assert got == {k: (v, f) for k, (_, v, f) in enumerate(bodies)} | {9: (None, "not_successful")}
    series_ = {"metric": {}, "values": [[60.25, "1"], [120, "NaN"], [180, "3"]]}
    good = json.dumps({"status": "success", "data": {"resultType": "matrix", "result": [series_]}})
    two = json.dumps({"status": "success", "data": {"resultType": "matrix", "result": [series_, series_]}})
    rows = payloads.range_values(spark.createDataFrame([(1, good), (2, two)], "k int, body string")).collect()
    assert [(r.k, r.observed_at.timestamp() % 86400, r.value) for r in rows] == [(1, rows[0].observed_at.timestamp() % 86400, 1.0), (1, rows[1].observed_at.timestamp() % 86400, 3.0)] and rows[0].observed_at.microsecond == 250000


def test_range_source(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            from urllib.parse import parse_qs, urlparse

            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items() if k != "query"}
            body = json.dumps({"status": "success", "data": {"resultType": "matrix", "result": [{"metric": {}, "values": [[t, str(t * 2)] for t in range(q["start"], q["end"] + 1, q["step"])]}]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(payloads.MetricRange)
        df = spark.read.format("metric_range").options(address=f"http://127.0.0.1:{server.server_port}", query="x", start="0", end="100", step="10", points="4").load()
        rows = sorted({(r.seconds, r.value) for r in df.collect()})
        assert rows == [(float(t), str(2 * t)) for t in range(0, 101, 10)] and df.rdd.getNumPartitions() == 4
    finally:
        server.shutdown()


def test_capacity_rules(spark):
    q = lambda t: spark.range(1).select(capacity.quantity(F.lit(t))).first()[0]
    assert (q("250m"), q("1.5"), q("512Mi"), q("2G"), q("x")) == (0.25, 1.5, 512 * 2**20, 2e9, None)
    fits = lambda extra: spark.range(1).select(capacity.fits(F.lit(extra), F.lit(500).cast("long"), F.lit(4000).cast("long"))).first()[0]
    assert fits(2) and not fits(3)
    parts = "array<struct<cpu:bigint>>"
    pods = spark.createDataFrame([([(100,), (200,)], [(250,)], (10,)), ([(100,)], [(250,), (50,)], (0,)), (None, None, None)], f"c {parts}, i {parts}, o struct<cpu:bigint>")
    assert [r[0] for r in pods.select(capacity.pod_request(F.col("c"), F.col("i"), F.col("o"), "cpu")).collect()] == [310, 250, 0]


def run_evaluation(spark, upper, policy=None, age_h=1, reason=None, points=None, champion=None):
    points = points or [10] * 481
    df = series(spark, points)
    policy = policy or promote.EvaluationPolicy(window_s=6 * 3600, min_duration_s=4 * 3600, min_windows=12, max_windows=24)
    plan = spark.createDataFrame([("w", "f", "evaluate_candidate", reason, "c", "a" if champion else None, None, at(120))], "workload_id string, source_fingerprint string, action string, reason string, target_id string, expected_active_id string, previous_id string, evidence_after timestamp")
    ups = {"candidate": upper, "baseline": 12.0} | ({"champion": champion} if champion else {})
    forecasts = df.select(*SERIES, F.col("observed_at").alias("origin"), F.explode(F.create_map(*[F.lit(x) for kv in ups.items() for x in kv])).alias("model", "upper"))
    return training.evaluation_reports(df, plan, forecasts, F.lit(at(480)), 60, 10, 60, 0.97, 5.0, policy).first()


def test_evaluation_reports(spark):
    assert run_evaluation(spark, 10.0).action == "promote"
    assert run_evaluation(spark, 10.0, promote.EvaluationPolicy("shadow", 6 * 3600, 4 * 3600, 12, 24)).action == "shadow"
    r = run_evaluation(spark, 9.0)
    assert (r.action, r.reason) == ("rejected", "candidate_safety_gate_failed")
    assert run_evaluation(spark, 10.0, champion=10.0).reason == "insufficient_loss_improvement"
    assert run_evaluation(spark, 10.0, reason="candidate_expired")[2:4] == ("withheld", "candidate_expired")
    assert run_evaluation(spark, 10.0, points=[10] * 470).reason == "stale_source"
    assert run_evaluation(spark, 10.0, points=[(k, 10) for k in range(481) if k % 15]).reason == "insufficient_or_invalid_evidence"


def test_training_run(spark):
    values = [50 + 10 * (k % 24) for k in range(24 * 20)]
    df = series(spark, [(60 * k, v) for k, v in enumerate(values)]).unionByName(series(spark, [(0, 1), (60, 2)], "short"))
    for engine in ("seasonal-baseline", "xgboost", "gru"):
        shape = {"length": 24, "hidden": 3, "epochs": 1, "batch": 32, "rate": 0.01, "clip": 1.0, "decay": 0.0, "examples": 64}
        models, outcomes = training.train_candidates(df, engine, 3600, 24, 3, 0.95, F.lit(START.replace(tzinfo=None)), shape)
        m = models.collect()
        assert len(m) == 1 and m[0].status == "candidate" and m[0].rows == 480 - 48 and len(m[0].artifact_sha256) == 64
        assert {r.workload_id: r.status for r in outcomes.collect()} == {"w": "succeeded", "short": "failed"}


def test_integrity(spark):
    rows = series(spark, [1, float("inf"), (0, 2)])
    assert sorted(r.fault for r in sample_faults(rows).collect()) == ["not_finite", "repeated_key"]
    models = spark.createDataFrame([("w", "f", "active")] * 2 + [("v", "f", "active")], "workload_id string, source_fingerprint string, status string")
    assert [r.workload_id for r in active_model_faults(models).collect()] == ["w"]
    once = spark.createDataFrame([(1, "a")], "k int, v string")
    assert sorted(map(tuple, store.append_unique(once, spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "c")]

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import START, at, series
from tidemark.operators import cycle, evaluate, features, forecast, gated, guard, learned, promote, surge
from tidemark.schema import SERIES


def test_features_of_a_ramp(spark):
    rows = features.feature_rows(series(spark, list(range(61))))
    r = rows.first()
    assert rows.count() == 1 and len(rows.columns) == 55 and rows.columns[3:] == sorted(rows.columns[3:])
    assert (r.current_value, r.lag_60m, r.delta_5m, r.slope_5m, r.acceleration_1m, r.slope_ratio_1m_5m) == (60, 0, 5, 1, 0, 1)
    assert r.rolling_mean_5m == 58 and abs(r.rolling_std_5m - 2**0.5) < 1e-9


@pytest.mark.parametrize("f,acceleration,ratio", [(lambda k: 7, 0, 0), (lambda k: k, 0, 1), (lambda k: k * k, 1, 119 / 115), (lambda k: -k, 0, 1)])
def test_trend_shapes(spark, f, acceleration, ratio):
    r = features.feature_rows(series(spark, [f(k) for k in range(61)])).first()
    assert abs(r.acceleration_1m - acceleration) < 1e-9 and abs(r.slope_ratio_1m_5m - ratio) < 1e-9
    assert all(np.isfinite(v) for v in r[3:])


def test_calendar_is_the_business_zones(spark):
    df = spark.createDataFrame([("w", "f", pd.Timestamp("2026-09-04T21:30Z").to_pydatetime(), 1.0)], "workload_id string, source_fingerprint string, observed_at timestamp, observed_value double")
    r = features.calendar_features(df, "Europe/Istanbul").first()
    assert (r.hour, r.minute, r.day_of_week, r.is_weekend, r.utc_offset_minutes) == (0, 30, 6, 1, 180) and r.hour_sin > 0 and r.hour_cos > 0


def test_features_do_not_see_ahead(spark):
    rng = np.random.default_rng(1)
    values = rng.random(80).tolist()
    a = features.feature_rows(series(spark, values)).where(F.col("observed_at") <= F.lit(at(70)))
    b = features.feature_rows(series(spark, values[:71] + [1e9] * 9)).where(F.col("observed_at") <= F.lit(at(70)))
    assert a.orderBy("observed_at").collect() == b.orderBy("observed_at").collect()


def test_evenly_takes_the_formulas_places(spark):
    for n, most in ((10, 4), (100, 7), (5, 9), (7, 1), (1, 1), (50, 2)):
        got = sorted(r.observed_value for r in features.evenly(series(spark, list(range(n))), most).collect())
        want = list(range(n)) if n <= most else sorted({i * (n - 1) // max(1, most - 1) for i in range(most)})
        assert got == want


def test_statistical_engines(spark):
    assert forecast.seasonal_peak(series(spark, [1, 2, 3, 4, 10, 20, 30, 40]), 4, 3).first().upper == 30
    assert forecast.seasonal_peak(series(spark, [1, 2, 10, 20]), 2, 1).first().upper == 10
    assert forecast.seasonal_peak(series(spark, [1]), 2, 1).first().upper is None
    r = forecast.rolling_quantile_peak(series(spark, [1, 1, 2, 2, 10]), 1, 0.95).first()
    assert (r.p50, r.upper) == (2, 10)
    r = forecast.holt_winters_peak(series(spark, [1, 4, 2, 5, 2, 5, 3, 6]), 2, 2).first()
    assert r.upper > 4 and r.p50 == r.upper
    assert forecast.holt_winters_peak(series(spark, [1, 4, 2]), 2, 2).first().upper is None
    with pytest.raises(ValueError):
        forecast.engine("none of these")


def test_walk_forward(spark):
    perfect = forecast.seasonal_at_rows(series(spark, [1, 2] * 5), 2, 1)
    r = evaluate.walk_forward(perfect, 1, 2, 0.95).first()
    assert (r.coverage, r.underprediction_rate, r.pinball) == (1, 0, 0)
    constant = series(spark, [1, 1, 2, 2]).withColumn("upper", F.lit(1.0))
    assert abs(evaluate.walk_forward(constant, 1, 1, 0.99, 1).first().pinball - 0.99) < 1e-9


def paired(spark, points, **more):
    origins = evaluate.paired_origins(series(spark, points), 60, 10, 60, more.get("after", str(at(120))))
    status = evaluate.comparison_status(origins, 10, 60, 12, more.get("duration", 4 * 3600))
    both = origins.select(*SERIES, "origin", F.explode(F.array(F.struct(F.lit("a").alias("model"), F.lit(10.0).alias("upper")), F.struct(F.lit("b").alias("model"), F.lit(12.0).alias("upper")))).alias("m")).select(*SERIES, "origin", "m.*")
    return origins, status, evaluate.compared(origins, both, 0.97, 5.0, 10.0, 24)


def test_paired_comparison(spark):
    origins, status, scores = paired(spark, [10] * 481)
    rows = sorted(origins.collect(), key=lambda r: r.origin)
    assert all(a.target_end <= b.origin for a, b in zip(rows, rows[1:], strict=False))
    assert status.first().reason == "ok" and status.first().eligible_windows == 36
    a, b = scores.orderBy("model").collect()
    assert (a.windows, a.pinball, b.windows) == (24, 0, 24)
    assert abs(b.pinball - 0.06) < 1e-9 and b.excess_replica_minutes == 240


def test_paired_comparison_refused(spark):
    _, status, _ = paired(spark, [(k, 10) for k in range(481) if k % 15])
    assert status.count() == 0
    _, status, _ = paired(spark, [10] * 481, duration=24 * 3600)
    assert status.first().reason == "insufficient_evaluation_duration"
    _, status, _ = paired(spark, [10] * 130)
    assert status.count() == 0 or status.first().reason == "insufficient_complete_windows"


def test_surges(spark):
    lead = lambda m: spark.createDataFrame([("w", "f", float(m))], "workload_id string, source_fingerprint string, lead_minutes double")
    for minutes_ahead, demand in ((0.5, 15), (2, 18), (5, 18)):
        r = surge.surges(series(spark, [1, 1, 1, 1, 2, 6, 12]), 60, lead(minutes_ahead)).first()
        assert r.triggered and r.demand == demand
    assert not surge.surges(series(spark, [1] * 6 + [5]), 60, lead(2)).first().triggered
    assert surge.surges(series(spark, [1] * 5 + [5]), 60, lead(2), surge.SurgePolicy(confirmations=1)).first().triggered
    one = lambda v, b, s, p: spark.range(1).select(surge.is_candidate(F.lit(v), F.lit(b), F.lit(s), F.lit(p), surge.SurgePolicy())).first()[0]
    assert one(10.0, 1.0, 9.0, 0.0) and not one(20.0, 10.0, 10.0, 10.0) and not one(11.0, 10.0, 50.0, 10.0)
    assert surge.SurgePolicy(slope_multiplier=0, confirmations=0) == surge.SurgePolicy()


def test_guardrails(spark):
    def ask(desired, current, healthy=True, allowed=True):
        lits = [F.lit(float(desired)), F.lit(float(current)), F.lit(50), F.lit(3.0), F.lit(100.0), F.lit(healthy), F.lit(allowed)]
        return tuple(spark.range(1).select(guard.guarded(*lits).alias("g")).first().g)

    assert ask(15, 2) == (4, "rate_limited") and ask(15, 2, healthy=False) == (2, "cluster_unhealthy")
    assert ask(15, 2, allowed=False) == (2, "capacity_unavailable") and ask(1, 2) == (1, "no_predictive_scale_up") and ask(99, 60) == (50, "no_predictive_scale_up")


def run_cycle(spark, points, now, current=0.0, allowed=True, threshold=1.0, most=3, **more):
    contracts = spark.createDataFrame([("w", "f", threshold, 0.95, 60, 60, 0, most, "active")], "workload_id string, source_fingerprint string, threshold double, quantile double, startup_s long, buffer_s long, min_replicas int, max_replicas int, status string")
    state = spark.createDataFrame([("w", "f", current, True, allowed)], "workload_id string, source_fingerprint string, current double, healthy boolean, allowed boolean")
    return cycle.forecast_cycle(series(spark, points), contracts, state, F.lit(at(now)), 60, 2, 2, **more).first()


def test_cycle(spark):
    assert run_cycle(spark, [1, 2, 3, 4], 3).safe == 3
    r = run_cycle(spark, [(0, 1), (1, 2), (2, 3), (10, 1), (11, 2), (12, 1), (13, 2)], 13)
    assert r.rows == 4 and r.reason == "baseline_replicas;recovered_after_source_gap;rate_limited"
    r = run_cycle(spark, [1, 2, 3, 4], 3, current=2.0, allowed=False)
    assert (r.safe, r.reason) == (2, "baseline_replicas;capacity_unavailable")
    r = run_cycle(spark, [1, 1, 1, 1, 2, 6, 12], 6, most=50)
    assert (r.surge, r.reason) == (18, "sustained_abnormal_slope_and_baseline;rate_limited") and r.upper == 12
    assert run_cycle(spark, [1, 2, 3], 9).status == "stale_source"
    assert run_cycle(spark, [1, -2, 3], 2).status == "unreliable_inputs"
    assert run_cycle(spark, [1], 0).status == "insufficient_history"
    assert run_cycle(spark, [1, 2, 3], 2, engine="holt-winters").status == "model_error"
    assert run_cycle(spark, [1, 2, 3], 2, threshold=0.0).status == "invalid_configuration"


def test_trees_beat_the_season(spark):
    rng = np.random.default_rng(2)
    day = 50 + 40 * np.sin(np.arange(96) * 2 * np.pi / 96)
    values = (np.tile(day, 14) * (1 + 0.3 * (np.arange(96 * 14) // 96 % 7 == 3)) + rng.normal(0, 3, 96 * 14)).clip(0).tolist()
    df = series(spark, [(15 * k, v) for k, v in enumerate(values)])
    rows = features.tree_rows(df, 4, 96)
    cut = F.lit(at(15 * 96 * 11))
    fitted = learned.train_tree_models(rows.where(F.col("observed_at") < cut), 0.95)
    got = learned.predict_rows(rows.where(F.col("observed_at") >= cut), fitted).join(rows.select("observed_at", F.col("label").cast("double").alias("actual")), "observed_at")
    seasonal = forecast.seasonal_at_rows(df, 96, 4, "season").select("observed_at", "season")
    loss = lambda c: F.avg(F.greatest(0.95 * (F.col("actual") - F.col(c)), -0.05 * (F.col("actual") - F.col(c))))
    r = got.join(seasonal, "observed_at").agg(loss("upper").alias("own"), loss("season").alias("season"), F.avg((F.col("upper") >= F.col("actual")).cast("double")).alias("coverage")).first()
    assert r.own < r.season and r.coverage >= 0.9


@pytest.mark.parametrize("reset_first", [True, False])
def test_network_gradients(reset_first):
    rng = np.random.default_rng(3)
    net, x, y = learned.GatedNetwork(3, 4, reset_first, 5), rng.normal(size=(5, 6, 3)), rng.normal(size=(5, 2))
    g = net.gradients(x, lambda out: 2 * (out - y))
    for name, weights in net.p.items():
        place = tuple(rng.integers(0, s) for s in weights.shape)
        before, step = weights[place], 1e-6
        losses = []
        for sign in (1, -1):
            weights[place] = before + sign * step
            losses.append(((net.forward(x) - y) ** 2).sum() / len(x))
        weights[place] = before
        assert abs((losses[0] - losses[1]) / (2 * step) - g[name][place]) < 1e-4


SMALL = {"length": 8, "hidden": 3, "epochs": 2, "batch": 8, "rate": 0.01, "clip": 0.5, "decay": 0.001, "examples": 40}


def _waves(n, k):
    return pd.DataFrame({"observed_at": pd.date_range("2026-01-01", periods=n, freq="h"), "observed_value": 5 + np.sin(np.arange(n) / (3.0 + k)) * (k + 1)})


@pytest.mark.parametrize("reset_first", [True, False])
def test_networks_are_the_same_alone_and_in_stacks(reset_first):
    frames = [_waves(n, k) for k, n in enumerate([90, 120, 90, 30, 20, 90, 200])]
    alone = [learned.train_sequence(f, 3, 0.9 + k / 100, SMALL, reset_first, not reset_first) for k, f in enumerate(frames)]
    assert [a is None for a in alone] == [False, False, False, False, True, False, False]
    for high in (2, 3, 32):
        stacks, done = learned.Stacks(SMALL, reset_first, not reset_first), []
        stacks.high = high
        for k, f in enumerate(frames):
            done += stacks.add(k, f["observed_value"].to_numpy(float), learned._calendar(f["observed_at"]), 3, 0.9 + k / 100)
        done += stacks.rest()
        assert sorted(k for k, _ in done) == [0, 1, 2, 3, 5, 6] and not stacks.waiting and not stacks.rows
        for k, got in done:
            assert {x: v for x, v in got.items() if x != "network"} == {x: v for x, v in alone[k].items() if x != "network"}
            assert abs(got["network"]["offset"] - alone[k]["network"]["offset"]) < 1e-9
            for name, weights in alone[k]["network"]["weights"].items():
                assert np.allclose(got["network"]["weights"][name], weights, atol=1e-10, rtol=0)


def test_stacks_wait_with_few_rows(monkeypatch):
    monkeypatch.setattr(learned, "WAITING", 150)
    stacks, f = learned.Stacks(SMALL, True, False), _waves(100, 0)
    add = lambda k: stacks.add(k, f["observed_value"].to_numpy(float), learned._calendar(f["observed_at"]), 3, 0.9)
    assert add(0) == [] and [k for k, _ in add(1)] == [0, 1] and not stacks.rows
    f.loc[50, "observed_value"] = np.nan
    assert add(2) == [] and stacks.rest() == []


def test_clipping_is_by_entry_or_by_norm():
    g = {"a": np.array([[[3.0, -4.0]], [[0.3, 0.4]]])}
    assert np.allclose(gated._clipped(g, 1.0, True)["a"], [[[1, -1]], [[0.3, 0.4]]])
    assert np.allclose(gated._clipped(g, 1.0, False)["a"], [[[0.6, -0.8]], [[0.3, 0.4]]])


def test_series_over_batches_are_put_together():
    rows = pd.DataFrame({"workload_id": ["a"] * 5 + ["b"] * 2 + ["b"], "source_fingerprint": ["f"] * 7 + [None], "observed_value": range(8)})
    for size in (1, 2, 3, 8):
        got = [(key, pdf["observed_value"].tolist()) for key, pdf in learned._each_series(rows.iloc[k : k + size] for k in range(0, 8, size))]
        assert got == [(("a", "f"), [0, 1, 2, 3, 4]), (("b", "f"), [5, 6]), (("b", None), [7])]
    assert list(learned._each_series(iter([]))) == []


@pytest.mark.parametrize("kind", ["native", "conformal"])
def test_networks_by_series(spark, kind):
    frames = {"w": _waves(90, 0), "v": _waves(120, 1), "short": _waves(20, 2)}
    rows = pd.concat([f.assign(workload_id=w, source_fingerprint="f") for w, f in frames.items()])
    df = spark.createDataFrame(rows.sample(frac=1, random_state=1))
    got = {r.workload_id: r for r in learned.train_networks(df, 3, 0.9, kind, SMALL).collect()}
    assert sorted(got) == ["v", "w"] and (got["w"].rows, got["v"].rows) == (90, 120)
    for w in got:
        want = learned.train_sequence(frames[w], 3, 0.9, SMALL, kind == "native", kind != "native")["network"]["weights"]
        have = learned.decoded(bytes(got[w].artifact), got[w].artifact_sha256, 0.9)["network"]["weights"]
        assert all(np.allclose(have[k], want[k], atol=1e-10, rtol=0) for k in want)
    assert learned.train_networks(df.where("false"), 3, 0.9, kind, SMALL).count() == 0


def test_refit_networks_see_nothing_behind_a_cut(spark):
    frames = {"w": _waves(90, 0), "v": _waves(70, 1), "short": _waves(14, 2)}
    rows = pd.concat([f.assign(workload_id=w, source_fingerprint="f") for w, f in frames.items()])
    got = learned.refit_networks(spark.createDataFrame(rows), 3, 0.9, 5, "native", SMALL).orderBy("workload_id", "cut").collect()
    assert [(r.workload_id, r.cut) for r in got] == [(w, c) for w, n in (("v", 70), ("w", 90)) for c in range(n - 7, n - 2)]
    for r in got:
        past, ahead = frames[r.workload_id][: r.cut], frames[r.workload_id]["observed_value"][r.cut : r.cut + 3]
        want = learned.predict_sequence(learned.decoded(learned.encoded(learned.train_sequence(past, 3, 0.9, SMALL, True, False))[0]), past)
        assert r.actual == ahead.max() and np.allclose((r.p50, r.upper), want, atol=1e-8)
    scored = {r.workload_id: r for r in evaluate.window_scores(spark.createDataFrame(got), 0.9).collect()}
    own = [r for r in got if r.workload_id == "w"]
    assert scored["w"].windows == 5 and scored["w"].coverage == sum(r.upper >= r.actual for r in own) / 5
    assert abs(scored["w"].pinball - sum(max(0.9 * (r.actual - r.upper), 0.1 * (r.upper - r.actual)) for r in own) / 5) < 1e-12


@pytest.mark.parametrize("reset_first", [True, False])
def test_constant_network(reset_first):
    net = learned.GatedNetwork(10, 1, reset_first)
    for v in net.p.values():
        v[...] = 0
    net.p["bo"][:] = (0.5, 0.0)
    spec = learned.decoded(learned.encoded({"format": "gated-network", "length": 3, "minimum": 10.0, "scale": 4.0, "quantile": 0.95, "network": net.dump()})[0])
    pdf = pd.DataFrame({"observed_at": pd.date_range("2026-01-01", periods=5, freq="min"), "observed_value": range(5)})
    assert learned.predict_sequence(spec, pdf) == (12.0, 12.0) and learned.predict_sequence(spec, pdf.head(2)) is None


def test_holdout_does_not_move_the_scale():
    n = 600
    pdf = pd.DataFrame({"observed_at": pd.date_range("2026-01-01", periods=n, freq="min"), "observed_value": [float(k % 100) for k in range(n)]})
    shape = {"length": 20, "hidden": 2, "epochs": 1, "batch": 64, "rate": 0.01, "clip": 1.0, "decay": 0.0, "examples": 64}
    a = learned.train_sequence(pdf, 12, 0.95, shape, False, True)
    changed = pdf.copy()
    changed.loc[n - 60 :, "observed_value"] = 1e12
    b = learned.train_sequence(changed, 12, 0.95, shape, False, True)
    assert (a["minimum"], a["scale"]) == (b["minimum"], b["scale"])
    train, calibration, holdout = learned.time_split(1000, 12)
    assert train.stop + 12 <= calibration.start and calibration.stop + 12 <= holdout.start
    assert learned.residual_quantile(np.arange(-5.0, 5.0), 0.9) == 4.0 and learned.residual_quantile(np.array([-3.0]), 0.9) == 0.0


def test_artifacts_are_checked():
    raw, sha = learned.encoded(learned.train_trees(np.random.default_rng(1).random((60, 2)), np.arange(60.0), ["a", "b"], 0.95))
    assert learned.decoded(raw, sha, 0.95)["model"]["upper"].predict(np.ones((1, 2))).shape == (1,)
    for change in ({"quantile": 0.9}, {"schema": "other"}, {"format": "pickle"}, {"features": ["b", "a"]}):
        with pytest.raises(ValueError):
            learned.decoded(json.dumps(json.loads(raw) | change).encode(), None, 0.95)
    with pytest.raises(ValueError):
        learned.decoded(raw, "0" * 64)


GOOD = {"windows": 100, "coverage": 0.97, "underprediction_rate": 0.03, "mean_absolute_error": 5.0, "pinball": 1.0, "mean_underprediction": 0.1, "max_relative_underprediction": 0.1, "peak_mean_underprediction": 0.2, "excess_replica_minutes": 10.0}


@pytest.mark.parametrize(
    "candidate,champion,baseline,verdict",
    [
        ({}, None, {"pinball": 2.0}, (True, "paired_evaluation_passed", "deterministic_baseline")),
        ({}, {"pinball": 1.02}, {}, (False, "insufficient_loss_improvement", "active_champion")),
        ({}, {"pinball": 2.0, "windows": 90}, {}, (False, "incomparable_reference", None)),
        ({"coverage": 0.5}, None, {}, (False, "candidate_safety_gate_failed", None)),
        ({"pinball": float("nan")}, None, {}, (False, "candidate_safety_gate_failed", None)),
        ({"mean_underprediction": 0.3}, None, {"pinball": 9.0}, (False, "underprediction_regression", "deterministic_baseline")),
        ({"pinball": 0.0}, None, {"pinball": 0.0}, (True, "safe_baseline_equivalent", "deterministic_baseline")),
        ({"pinball": 0.0}, {"pinball": 0.0}, {}, (False, "insufficient_loss_improvement", "active_champion")),
    ],
)
def test_promotion_ladder(spark, candidate, champion, baseline, verdict):
    kind = "struct<windows:bigint," + ",".join(f"{k}:double" for k in list(GOOD)[1:]) + ">"
    one = lambda m: None if m is None else tuple((GOOD | m).values())
    df = spark.createDataFrame([(one(candidate), one(champion), one(baseline))], f"candidate {kind}, champion {kind}, baseline {kind}")
    out = promote.promotion(F.col("candidate"), F.col("champion"), F.col("baseline"), F.lit(0.95)).alias("v")
    assert tuple(df.select(out).first().v) == verdict


def test_switch_retires_the_active(spark):
    models = spark.createDataFrame([("a", "active"), ("b", "candidate"), ("c", "retired")], "model_id string, status string").withColumns({"workload_id": F.lit("w"), "source_fingerprint": F.lit("f"), "activated_at": F.lit(None).cast("timestamp")})
    reports = spark.createDataFrame([("w", "f", "b", "promote", None)], "workload_id string, source_fingerprint string, target_id string, action string, previous_id string")
    back = reports.selectExpr("workload_id", "source_fingerprint", "'a' AS target_id", "'rollback' AS action", "'c' AS previous_id")
    assert {r.model_id: r.status for r in promote.switched(models, back, F.lit(START.replace(tzinfo=None))).collect()} == {"a": "retired", "b": "candidate", "c": "active"}
    out = {r.model_id: r.status for r in promote.switched(models, reports, F.lit(START.replace(tzinfo=None))).collect()}
    assert out == {"a": "retired", "b": "active", "c": "retired"}
    with pytest.raises(ValueError):
        promote.EvaluationPolicy(min_windows=1)


import datetime as dt
import time as clock

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import START, at, minutes, series
from tidemark import config
from tidemark.functions import time
from tidemark.functions.stats import nearest_rank
from tidemark.operators import quality, repair, store
from tidemark.operators.fill import bounded_fill
from tidemark.schema import SERIES


def test_slots_begin_in_year_one(spark):
    week = 7 * 86400
    row = spark.range(1).select(time.slot_start(time.slot(F.lit("2026-01-01").cast("timestamp"), week), week).alias("t")).first()
    assert row.t.weekday() == 0  # a Monday, as 0001-01-01 was
    assert spark.range(1).select(time.slot(F.lit("1970-01-01 00:01:59.999999").cast("timestamp"), 60) - time.slot(F.lit("1970-01-01").cast("timestamp"), 60)).first()[0] == 1


def test_nearest_rank(spark):
    values = F.array(*[F.lit(float(k)) for k in range(20)])
    assert spark.range(1).select(nearest_rank(values, 0.95), nearest_rank(values, 0.0), nearest_rank(values, 1.0)).first()[:] == (18.0, 0.0, 19.0)


@pytest.mark.parametrize("points,reason,rows", [([1, 2, 3], "ok", 3), ([(0, 1), (1, 2), (10, 3)], "gap", 3), ([1, float("nan"), 3], "not_finite", 3), ([(0, 1), (0, 2), (1, 3)], "not_ordered", 3), ([1], "too_few", 1)])
def test_quality(spark, points, reason, rows):
    out = quality.series_quality(series(spark, points), 60, 2).first()
    assert (out.reason, out.rows) == (reason, rows)


def test_recent_contiguous(spark):
    assert minutes(quality.recent_contiguous(series(spark, [(0, 1), (1, 1), (10, 1), (11, 1)]), 60).collect()) == [10, 11]


@pytest.mark.parametrize("age,state", [(2, "fresh"), (3, "stale"), (-1, "future")])
def test_freshness(spark, age, state):
    assert quality.freshness(series(spark, [1, 2]), F.lit(at(1 + age)), 60).first().state == state


def test_training_segment(spark):
    points = [(k, 10) for k in range(100)] + [(200 + k, 20) for k in range(10)]
    rows = quality.training_segment(series(spark, points), 60, 60).collect()
    assert minutes(rows) == list(range(100))
    assert quality.training_segment(series(spark, points), 60, 110).count() == 0
    assert quality.training_segment(series(spark, [(k / 2, 1) for k in range(100)]), 60, 60).count() == 0


def ramp(missing, n=70):
    return [(k, 100 + k / 10) for k in range(n) if k not in missing]


def test_bridge(spark):
    out = bounded_fill(series(spark, ramp({64, 65})), 60, lookback=61).collect()
    made = [r for r in out if r.is_estimated]
    assert len(out) == 61 and {r.status for r in out} == {"ok"} and minutes(made) == [64, 65]
    assert all(abs(r.observed_value - (100 + m / 10)) < 1e-9 for r, m in zip(sorted(made, key=lambda r: r.observed_at), (64, 65), strict=True))


@pytest.mark.parametrize("points,n", [(ramp({64, 65}, 67), 61), (ramp({60, 61, 62, 63}), 61), (ramp({60, 70, 80, 90}, 100), 61)])
def test_bridge_refused(spark, points, n):
    assert {r.status for r in bounded_fill(series(spark, points), 60, lookback=n).collect()} != {"ok"}


@pytest.mark.parametrize("points", [ramp(set(range(60, 67)), 80), [(k, v if k < 62 else 1000) for k, v in ramp({60, 61})]])
def test_gap_drops_what_is_before(spark, points):
    out = bounded_fill(series(spark, points), 60, lookback=61).collect()
    assert out[0].used_suffix and out[0].estimated_count == 0 and len(out) < 61


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), -1.0])
def test_invalid_rows(spark, bad):
    assert {r.status for r in bounded_fill(series(spark, [1, 2, bad, 3]), 60).collect()} == {"invalid_value"}
    assert {r.status for r in bounded_fill(series(spark, [(0, 1), (0, 2), (1, 2)]), 60).collect()} == {"not_ordered"}


def test_jitter_and_old_bad_rows(spark):
    points = [(k + (1 / 60 if k % 2 else 0), float("nan") if k == 0 else 100 + k / 10) for k in range(100) if k not in (85, 86)]
    out = bounded_fill(series(spark, points), 60, lookback=61).collect()
    assert len(out) == 61 and out[0].estimated_count == 2 and out[0].status == "ok"


def test_estimates_age_out(spark):
    df = series(spark, ramp({60, 61}, 140))
    assert bounded_fill(df, 60, lookback=61).first().estimated_count == 0
    assert quality.real_suffix(df, 60).count() == 78


def test_overlapping_writes(spark):
    points = sorted([p for k, v in ramp({64, 65}) for p in ((k, v), (k + 1 / 6, v))])
    df = series(spark, points)
    out = bounded_fill(df, 60, lookback=61).collect()
    assert len(out) == 61 and out[0].estimated_count == 2
    assert quality.real_suffix(df, 60).count() == 4


def loop_suffix(points):
    kept = []
    for m, _ in points:
        if kept and m // 1 == kept[-1] // 1:
            kept[-1] = m
            continue
        if kept and m - kept[-1] >= 1.5:
            kept = []
        kept.append(m)
    return kept


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 80), min_size=1, max_size=25, unique=True))
def test_real_suffix_is_the_loops(spark, quarters):
    points = [(q / 4, 1.0) for q in sorted(quarters)]
    assert minutes(quality.real_suffix(series(spark, points), 60).collect()) == loop_suffix(points)


@settings(max_examples=15, deadline=None)
@given(st.sets(st.integers(0, 39)), st.integers(1, 7), st.integers(1, 6))
def test_plan_covers_what_is_missing(spark, there, points, runs):
    df = series(spark, [(k, 1.0) for k in sorted(there)] + [(500, 1.0)])
    missing = repair.missing_slots(df, df, "2026-01-01 00:00:00", "2026-01-01 00:40:00", 60)
    places = {r.place for r in missing.collect()}
    assert places == set(range(40)) - there
    plan = [(r.first, r.last) for r in repair.repair_plan(missing, points, runs).collect()]
    assert places <= {k for a, b in plan for k in range(a, b + 1)}
    assert all(b - a < points and {a, b} <= places for a, b in plan)


def test_repair_fills_and_is_idempotent(spark):
    df = series(spark, [(k, k) for k in range(60) if k not in (3, 4, 30)])
    args = ("2026-01-01 00:00:00", "2026-01-01 01:00:00", 60)

    def ask(plan):
        return plan.withColumn("place", F.explode(F.sequence("first", "last"))).select(*SERIES, F.timestamp_seconds(F.lit(int(START.timestamp())) + F.col("place") * 60).alias("observed_at"), F.lit(123.0).alias("value"))

    after, report = repair.repair(df, df, *args, ask)
    assert report.first()[2:] == (60, 3, 0, 2, 3, 0)
    values = {m: r.observed_value for m, r in zip(minutes(after.collect()), sorted(after.collect(), key=lambda r: r.observed_at), strict=True)}
    assert values[3] == values[4] == values[30] == 123 and values[5] == 5
    again, report = repair.repair(after, df, *args, ask)
    assert report.first().inserted == 0 and again.count() == 60


def test_repair_asks_by_runs_up_to_the_number_that_is_set(spark):
    df = series(spark, [(k, k) for k in range(12) if k % 3 != 1])
    ask = lambda plan: plan.select(*SERIES, F.timestamp_seconds(F.lit(int(START.timestamp())) + F.col("first") * 60).alias("observed_at"), F.lit(1.0).alias("value"))
    asked = lambda runs: repair.repair(df, df, "2026-01-01 00:00:00", "2026-01-01 00:12:00", 60, ask, repair.RepairLimits(runs=runs))[1].first().requests
    assert (asked(4), asked(3)) == (4, 1)


def test_repair_refuses_points_off_the_grid(spark):
    df = series(spark, [(k, k) for k in range(10) if k != 4])
    ask = lambda plan: plan.select(*SERIES, F.timestamp_micros(F.lit(int(START.timestamp()) * 1_000_000 + 4 * 60_000_000 + 5000)).alias("observed_at"), F.lit(1.0).alias("value"))
    _, report = repair.repair(df, df, "2026-01-01 00:00:00", "2026-01-01 00:10:00", 60, ask)
    assert report.first().missing_after == 1


def test_repair_keeps_good_parts_and_its_budget(spark):
    """Parts at places 2, 5, 8, ...: one is never to be had, one only at the second try, one has a wrong value, one lacks its slot."""
    holes = list(range(2, 60, 3))
    df = series(spark, [(k, k) for k in range(60) if k not in holes])
    asked, tries = [], {}

    def ask(plan):
        out = []
        for r in plan.orderBy("part").collect():
            asked.append((r.first, r.deadline_s > 0))
            tries[r.first] = tries.get(r.first, 0) + 1
            where = (START + dt.timedelta(minutes=r.first)).replace(tzinfo=None)
            if r.first == 5 or (r.first == 8 and tries[8] == 1):
                out.append((r.workload_id, r.source_fingerprint, None, None, r.part, "timeout"))
            elif r.first != 14:
                out.append((r.workload_id, r.source_fingerprint, where, -1.0 if r.first == 11 else 7.0, r.part, None))
        return spark.createDataFrame(out, "workload_id string, source_fingerprint string, observed_at timestamp, value double, part int, fault string")

    args = df, df, "2026-01-01 00:00:00", "2026-01-01 01:00:00", 60, ask
    after, report = repair.repair(*args, repair.RepairLimits(requests=12))
    r = report.first()
    # Of 20 parts eight are beyond the budget, and there is none left for second tries.
    assert [a for a, _ in asked] == holes[:12] and (r.requests, r.failed_parts, r.inserted, r.missing_after) == (12, 3, 8, 12)
    asked.clear(), tries.clear()
    after, report = repair.repair(*args)
    r = report.first()
    assert [a for a, _ in asked] == [*holes, 5, 8] and (r.requests, r.failed_parts, r.inserted, r.missing_after) == (22, 2, 17, 3)
    assert {m for m in range(60)} - set(minutes(after.collect())) == {5, 11, 14}
    asked.clear(), tries.clear()
    slow = lambda plan: clock.sleep(1.1) or ask(plan)
    _, report = repair.repair(*args[:5], slow, repair.RepairLimits(timeout_s=1, query_timeout_s=1))
    assert len(asked) == 20 and report.first().failed_parts == 3  # no second try behind the deadline
    for start, end in (("2026-01-01 00:00:30", "2026-01-01 01:00:00"), ("2026-01-01 00:00:00", "2026-06-01 00:00:00"), ("2026-01-01 01:00:00", "2026-01-01 01:00:00")):
        with pytest.raises(ValueError):
            repair.repair(df, df, start, end, 60, ask)


def test_limits_and_policies_from_settings():
    env = {"REPAIR_TIMEOUT": "5m", "REPAIR_MAX_POINTS": "500", "PROMOTION_MODE": "shadow", "EVALUATION_WINDOW": "72h", "ROLLBACK_ENABLED": "false"}
    lookup = lambda name: env.get(name.removeprefix(config.PREFIX))
    assert config.repair_limits(lookup) == repair.RepairLimits(timeout_s=300, points=500)
    policy = config.evaluation_policy(lookup)
    assert (policy.mode, policy.window_s, policy.rollback, policy.min_windows) == ("shadow", 72 * 3600, False, 72)
    for name, text in (("REPAIR_TIMEOUT", "2h"), ("EVALUATION_WINDOW", "1h"), ("PROMOTION_MODE", "maybe"), ("REPAIR_MAX_POINTS", "x")):
        with pytest.raises(ValueError):
            (config.repair_limits if "REPAIR" in name else config.evaluation_policy)(lambda n, name=name, text=text: text if n == config.PREFIX + name else None)


def test_chunks_overlap_by_an_end():
    assert repair.chunks(0, 25, 1, 11) == [(0, 10), (10, 20), (20, 25)]
    assert repair.chunks(0, 0, 60) == [(0, 0)]
    with pytest.raises(ValueError):
        repair.RepairLimits(query_timeout_s=999)


def test_insert_missing_never_updates(spark):
    df = series(spark, [(0.5, 1.0), (2, 5.0)])
    out = store.insert_missing(df, series(spark, [(0, 9), (1, 9), (2, 9), (3.5, 9), (4, -1)]), 60).collect()
    assert sorted((m, v) for m, v in zip(minutes(out), [r.observed_value for r in sorted(out, key=lambda r: r.observed_at)], strict=True)) == [(0.5, 1.0), (1, 9.0), (2, 5.0)]


def test_audit_keeps_the_last(spark):
    rows = spark.createDataFrame([([str(k) for k in range(n)],) for n in (0, 5, 19, 20, 40)] + [(None,)], "h array<string>")
    got = [r[0] for r in rows.select(store.append_audit(F.col("h"), F.lit("x"))).collect()]
    assert [len(g) for g in got] == [1, 6, 20, 20, 20, 1] and all(g[-1] == "x" for g in got) and got[4][0] == "21"


@pytest.mark.parametrize("text,seconds", [("30d", 2592000), ("1h30m", 5400), ("45s", 45), ("1.5h", 5400), ("0", 0), ("100ms", 0.1), ("-5m", -300), ("d", None), ("1d2h", None), ("", None), ("5", None)])
def test_durations(spark, text, seconds):
    got = spark.range(1).select(time.parse_duration(F.lit(text))).first()[0]
    assert got is None if seconds is None else abs(got - seconds) < 1e-9


def test_empty_series(spark):
    none = series(spark, [1]).limit(0)
    for out in (quality.series_quality(none, 60, 1), quality.slot_dedup(none, 60), quality.training_segment(none, 60, 2), quality.real_suffix(none, 60), bounded_fill(none, 60), quality.recent_contiguous(none, 60)):
        assert out.count() == 0

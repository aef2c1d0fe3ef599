"""The forecast loop and the cycle with stored models."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.helpers import at, series
from tests.test_lifecycle import SHAPE, contracts, junk, values
from tidemark.operators import cycle, training
from tidemark.operators.fill import bounded_fill
from tidemark.schema import SAMPLES
from tidemark.streaming import loops

STATE = "workload_id string, source_fingerprint string, current double, healthy boolean, allowed boolean"


def state(spark, *workloads):
    return spark.createDataFrame([(w, "f", 1.0, True, True) for w in workloads], STATE)


def fixed(spark, tmp_path, name, df):
    return loops.LastGood(spark, lambda: df, str(tmp_path / name))


def test_loop_replays_batches_and_scores_what_came_due(spark, tmp_path):
    declared = contracts(spark, [("w", "seasonal-baseline", 60, 120, 0.9, "UTC"), ("v", "gru", 60, 120, 0.9, "UTC")])
    points = values(200)
    for k in range(3):
        series(spark, list(enumerate(points))[:180] if k == 0 else list(enumerate(points))[180 + 4 * (k - 1) : 180 + 4 * k]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    forecaster = loops.Forecaster(str(tmp_path / "store"), fixed(spark, tmp_path, "c", declared), fixed(spark, tmp_path, "s", state(spark, "w", "v")), settings={"season_s": 3600})
    source = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    loops.run(source, forecaster, str(tmp_path / "checkpoint")).awaitTermination()

    def stores():
        return [sorted(map(str, f(spark).collect())) for f in (forecaster.samples, forecaster.snapshots, forecaster.evaluated)] + [sorted(map(str, loops.stored(spark, forecaster.folder, "unavailable", loops.UNAVAILABLE).collect()))]

    before = stores()
    snaps = {r.batch: r for r in forecaster.snapshots(spark).collect()}
    assert len(before[0]) == 188 and {b: r.observed_at for b, r in snaps.items()} == {0: at(179), 1: at(183), 2: at(187)} and len(before[3]) == 3
    for number, last in ((0, 180), (1, 184), (2, 188)):
        assert snaps[number].upper == max(points[last - 60 : last - 58])
    scored = {r.snapshot_id: r for r in forecaster.evaluated(spark).collect()}
    assert set(scored) == {snaps[0].snapshot_id, snaps[1].snapshot_id}
    r = scored[snaps[0].snapshot_id]
    assert r.batch == 1 and r.complete and r.realized == max(points[180:182]) and r.covered == (snaps[0].upper >= r.realized)
    # Batches that are run again, in any order behind a crash, leave what they left.
    for number in (1, 2):
        forecaster(spark.read.parquet(f"{forecaster.folder}/samples/batch={number}"), number)
    assert stores() == before
    # A loop that starts again from its checkpoint has nothing to do.
    loops.run(source, forecaster, str(tmp_path / "checkpoint")).awaitTermination()
    assert stores() == before
    forecaster(series(spark, []).select("cluster_id", "workload_id", "source_fingerprint", "observed_at", "observed_value"), 3)
    assert stores()[1] == before[1]


def test_side_table_keeps_its_last_good_version(spark, tmp_path):
    source = [spark.range(3)]

    def load():
        if source[0] is None:
            return spark.read.parquet(str(tmp_path / "nowhere"))
        return source[0]

    table = loops.LastGood(spark, load, str(tmp_path / "t"))
    assert table.refresh().count() == 3
    source[0] = None
    assert table.refresh().count() == 3 and table.fault and table.version == 1
    # A table that fails while it is read, not when it is named.
    source[0] = spark.range(2).select(F.when(F.col("id") == 1, F.raise_error(F.lit("torn"))).otherwise(F.col("id")).cast("long").alias("id"))
    assert table.refresh().count() == 3 and "torn" in table.fault
    source[0] = spark.range(5)
    assert table.refresh().count() == 5 and table.fault is None and table.version == 2
    with pytest.raises(PySparkException):
        loops.LastGood(spark, lambda: spark.read.parquet(str(tmp_path / "nowhere")), str(tmp_path / "u")).refresh()


@pytest.fixture(scope="module")
def stocked(spark):
    points = values(480)
    samples = series(spark, points, "t").unionByName(series(spark, points, "n")).unionByName(series(spark, points, "p"))
    declared = contracts(spark, [("t", "xgboost", 60, 600, 0.9, "Asia/Tokyo"), ("n", "gru", 60, 600, 0.9, "UTC"), ("p", "", 60, 600, 0.9, "UTC")])
    models, _ = training.train_by_contract(samples, declared, F.lit(at(480)), 3600, shape=SHAPE)
    return samples, declared, models.withColumns({"status": F.lit("active"), "activated_at": F.lit(at(470))})


def run(spark, stocked, models, samples=None, minute=479, **more):
    out = cycle.forecast_cycle(samples if samples is not None else stocked[0], more.pop("declared", stocked[1]), more.pop("state", state(spark, "t", "n", "p")), F.lit(at(minute)), models=models, season_s=3600, **more)
    return {r.workload_id: r for r in out.collect()}


def test_artifacts_serve_from_their_own_rows(spark, stocked):
    rows = run(spark, stocked, stocked[2])
    assert {w: (r.status, r.engine, r.rows) for w, r in rows.items()} == {"t": ("ok", "xgboost", 61), "n": ("ok", "gru", SHAPE["length"]), "p": ("ok", "seasonal-baseline", 480)}
    assert all(0 <= r.p50 <= r.upper for r in rows.values())
    # A corrupt artifact leaves the others served; its own contract has no model.
    broken = stocked[2].withColumn("artifact", F.when(F.col("workload_id") == "t", F.lit(bytearray(b"x"))).otherwise(F.col("artifact")))
    rows = run(spark, stocked, broken)
    assert (rows["t"].status, rows["n"].status, rows["p"].status) == ("model_unavailable", "ok", "ok")
    # One that is what its digest says and can't be read fails alone, too.
    named = junk()
    unreadable = stocked[2].withColumns({c: F.when(F.col("workload_id") == "t", v).otherwise(F.col(c)) for c, v in named.items()})
    rows = run(spark, stocked, unreadable)
    assert (rows["t"].status, rows["n"].status) == ("model_error", "ok")
    # Too old.
    assert run(spark, stocked, stocked[2], max_age_s=60)["t"].status == "model_unavailable"


def test_only_gaps_that_the_artifact_looks_at_count(spark, stocked):
    old, new = [k for k in range(480) if k != 300], [k for k in range(480) if k != 440]
    points = [20.0] * 480
    make = lambda places: series(spark, [(k, points[k]) for k in places], "t")
    assert "interpolated" not in run(spark, stocked, stocked[2], make(old))["t"].reason
    r = run(spark, stocked, stocked[2], make(new))["t"]
    assert "inference_interpolated_points=1;conservative_gap_recovery" in r.reason and r.rows == 61
    # The same hole counts for an engine that looks at the whole window.
    plain = stocked[1].withColumn("engine", F.lit("seasonal-baseline"))
    assert "inference_interpolated_points=1" in run(spark, stocked, None, make(old), declared=plain)["t"].reason
    # Estimated input without a known number of replicas decides nothing.
    assert run(spark, stocked, stocked[2], make(new), state=state(spark, "n"))["t"].status == "cluster_error"
    assert run(spark, stocked, stocked[2], state=state(spark, "n"))["t"].status == "ok"


def test_input_is_that_of_bounded_fill(spark):
    """The one-exchange input against the table operator, with gaps of many kinds."""
    import random

    rng = random.Random(3)
    for trial in range(6):
        places = sorted(rng.sample(range(120), rng.choice([20, 90, 110, 117])))
        df = series(spark, [(k + rng.choice([0, 0, 0.2, 0.4]), rng.choice([10, 10.5, 11, 20]) if trial % 2 else 10) for k in places])
        for look in (0, 30):
            want = bounded_fill(df, 60, 300, look).orderBy("observed_at").collect()
            got = cycle._inputs(df.withColumns({"interval_s": F.lit(60).cast("long"), "lookback": F.lit(look)}), 300).first()
            assert [(p["at"], round(p["value"], 9), p["estimated"]) for p in got.points] == [(r.observed_at, round(r.observed_value, 9), r.is_estimated) for r in want]
            assert (got.input_status, got.estimated_count, got.used_suffix) == (want[0].status, want[0].estimated_count, want[0].used_suffix)


def test_intervals_and_refusals(spark):
    rows = [("a", "", 60, 600, 0.9, "UTC"), ("b", "", 3600, 7200, 0.9, "UTC"), ("z", "", 60, 600, 0.9, "UTC")]
    declared = contracts(spark, rows).withColumn("training_window_s", F.when(F.col("workload_id") == "z", 91 * 86400).otherwise(30 * 86400))
    samples = series(spark, [5.0] * 1500, "a").unionByName(series(spark, [(60 * k, 7.0) for k in range(25)], "b"))
    args = samples, declared, state(spark), F.lit(at(1499))
    got = {r.workload_id: (r.status, r.steps, r.rows, r.upper) for r in cycle.forecast_cycle(*args).collect()}
    assert got == {"a": ("ok", 10, 1500, 5.0), "b": ("ok", 2, 25, 7.0), "z": ("refused_window", 10, None, None)}
    assert {r.workload_id for r in cycle.forecast_cycle(*args, 60, 1440).collect()} == {"a", "z"}
    assert cycle.forecast_cycle(samples.limit(0), declared.where("workload_id = 'a'"), state(spark), F.lit(at(9))).first().status == "stale_source"

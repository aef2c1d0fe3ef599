"""The forecast cycle: from samples of all series to one bounded decision each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import nearest_rank
from tidemark.functions.time import seconds_between, slot
from tidemark.operators.fill import MOST_CHANGE, MOST_SHARE, MOST_STEPS, REAL_TAIL, RECENT, bounded_fill
from tidemark.operators.forecast import resolved_engine, smoothed_peak
from tidemark.operators.forecast import engine as engine_of
from tidemark.operators.guard import decide, eligible_models
from tidemark.operators.promote import artifact_lookback, model_validity
from tidemark.operators.quality import recent_contiguous
from tidemark.operators.scoring import predict_at, wall_clock, with_features
from tidemark.operators.surge import SurgePolicy, lead_minutes, surge_of
from tidemark.schema import SERIES, apart, finite
from tidemark.session import cut, ship


def model_input(samples: DataFrame, interval_s: int, max_gap_s: int, lookback: int = 0, interpolate: bool = True) -> DataFrame:
    """Rows for the models with used_suffix, estimated_count and status; without interpolation the rows after the last gap."""
    if interpolate:
        return bounded_fill(samples, interval_s, max_gap_s, lookback)
    kept = recent_contiguous(samples, interval_s)
    all_rows = samples.groupBy(*SERIES).agg(F.count("*").alias("n_all"))
    some = kept.groupBy(*SERIES).agg(F.count("*").alias("n_kept"))
    flags = all_rows.join(some, SERIES).select(*SERIES, (F.col("n_all") > F.col("n_kept")).alias("used_suffix"))
    return kept.join(flags, SERIES).select(*SERIES, "observed_at", "observed_value", F.lit(False).alias("is_estimated"), "used_suffix", F.lit(0).cast("long").alias("estimated_count"), F.lit("ok").alias("status"))


#: Fixed value: the longest training window, in seconds; older samples are never read.
MOST_WINDOW_S = 90 * 86_400


def settings_of(contracts: DataFrame, interval_s: int | None, steps: int | None, engine: str | None, season: int | None = None, season_s: int = 86_400) -> DataFrame:
    """The active contracts with all that a cycle needs of them: what is not a column takes its default, ``steps`` and ``engine`` hold for all.

    With ``interval_s`` only contracts of that interval count; without one
    each has its own, and ``season`` follows from ``season_s``.
    """
    have = set(contracts.columns)
    own = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    interval = own("interval_s", interval_s)
    rows = contracts.where("status = 'active'").withColumn("own_interval", interval.cast("long"))
    if interval_s is not None:
        rows = rows.where(F.col("own_interval") == interval_s)
    fits = F.when(F.col("own_interval") > 0, F.col("own_interval"))
    ahead = F.floor(F.try_divide(own("horizon_s", interval_s) + own("startup_s", 0) + own("buffer_s", 0), fits))
    asked = F.lit(engine) if engine else F.trim(own("engine", ""))
    q, window = own("quantile", 0.95), own("training_window_s", MOST_WINDOW_S)
    return rows.select(
        *SERIES, "threshold", "min_replicas", "max_replicas", own("startup_s", 0).alias("startup_s"), own("buffer_s", 0).alias("buffer_s"), F.when((q > 0) & (q < 1), q).otherwise(0.95).alias("quantile"), fits.alias("interval_s"),
        F.greatest(F.lit(steps) if steps else ahead, F.lit(1)).cast("int").alias("steps"), (F.lit(season) if season else F.try_divide(F.lit(season_s), fits)).cast("int").alias("season"),
        F.least(window, F.lit(MOST_WINDOW_S)).alias("window_s"), F.coalesce((window > 0) & (window <= MOST_WINDOW_S), F.lit(False)).alias("window_fits"), asked.alias("engine"), own("timezone", "UTC").alias("timezone"), F.lit("active").alias("status"),
    )


def _inputs(own: DataFrame, max_gap_s: int) -> DataFrame:
    """One row per series from its samples with ``interval_s`` and ``lookback``: the model input as ``points``, the latest real run as ``suffix``, and what is wrong.

    What ``bounded_fill`` and ``real_suffix`` do, in windows that share one
    exchange and one order, and one aggregate behind them. A series'
    arrays are bounded by its training window.
    """
    w = Window.partitionBy(*SERIES).orderBy("observed_at", *[c for c in ("sequence",) if c in own.columns])
    up_to, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*SERIES)
    interval = F.col("interval_s")
    age = seconds_between(F.max("observed_at").over(whole), F.col("observed_at"))
    near = (F.col("lookback") == 0) | (age <= (F.col("lookback") + MOST_STEPS) * interval)
    rows = own.withColumns({"slot": slot(F.col("observed_at"), interval), "near": near})
    before, is_near = F.lag("observed_at").over(w), F.lag("near").over(w)
    rows = rows.withColumns({
        "opens": F.coalesce(F.lag("slot").over(w) != F.col("slot"), F.lit(True)), "closes": F.coalesce(F.lead("slot").over(w) != F.col("slot"), F.lit(True)), "since": seconds_between(F.col("observed_at"), before),
        "again": F.coalesce(F.col("near") & is_near & (before == F.col("observed_at")), F.lit(False)),
    })
    # A run of real slots ends where a slot's first row is too far behind the row before it.
    cuts = F.coalesce(F.col("opens") & (F.col("since") >= 1.5 * interval), F.lit(False))
    rows = rows.withColumns({"run": F.sum(cuts.cast("int")).over(up_to), "repeated": F.max("again").over(whole)}).where("closes")
    value = F.col("observed_value")
    rows = rows.withColumns({"before_at": F.lag(F.when(F.col("near"), F.col("observed_at"))).over(w), "before": F.lag("observed_value").over(w), "in_suffix": F.col("run") == F.max("run").over(whole)})
    rows = rows.withColumn("gap_s", seconds_between(F.col("observed_at"), F.col("before_at"))).withColumn("steps_", F.round(F.col("gap_s") / interval))
    aligned = F.abs(F.col("gap_s") - F.col("steps_") * interval) <= interval / 4
    stable = F.abs(value - F.col("before")) / F.greatest(F.lit(1.0), "before", value) <= MOST_CHANGE
    wide = F.col("gap_s") >= 1.5 * interval
    rows = rows.withColumn("bridge", F.coalesce(wide & (F.col("gap_s") <= max_gap_s + interval / 4) & aligned & stable & (F.col("steps_") <= MOST_STEPS), F.lit(False)))
    real = F.when(F.col("in_suffix"), value)
    rows = rows.withColumns({"segment": F.sum(F.coalesce(wide & ~F.col("bridge"), F.lit(False)).cast("int")).over(up_to), "slope": (value - F.lag(real).over(w)) / (interval / 60), "baseline": F.avg(real).over(w.rowsBetween(-5, -1))})
    rows = rows.withColumn("last_segment", F.max("segment").over(whole))
    invalid = F.col("near") & (~finite(value) | (value < 0))
    kept = F.when(F.col("near") & (F.col("segment") == F.col("last_segment")), F.struct("observed_at", "observed_value", "before_at", "before", "gap_s", F.col("steps_").cast("int").alias("steps"), "bridge"))
    out = rows.groupBy(*SERIES).agg(
        F.max("observed_at").alias("latest"), F.max("repeated").alias("repeated"), F.max(invalid).alias("invalid"), F.max(F.col("last_segment") > 0).alias("used_suffix"), F.first("interval_s").alias("interval"), F.first("lookback").alias("look"),
        F.array_sort(F.collect_list(kept)).alias("kept"), F.array_sort(F.collect_list(F.when(F.col("in_suffix"), F.struct("observed_at", "observed_value", "slope", "baseline")))).alias("suffix"),
    )

    def point(x: Column, k: Column) -> Column:
        at = F.timestamp_micros(F.unix_micros(x["before_at"]) + k.cast("long") * F.col("interval") * 1_000_000)
        weight = k * F.col("interval") / x["gap_s"]
        return F.struct(at.alias("at"), ((1 - weight) * x["before"] + weight * x["observed_value"]).alias("value"), F.lit(True).alias("estimated"))

    def points(x: Column) -> Column:
        own = F.array(F.struct(x["observed_at"].alias("at"), x["observed_value"].alias("value"), F.lit(False).alias("estimated")))
        return F.when(x["bridge"], F.concat(F.transform(F.sequence(F.lit(1), F.greatest(x["steps"] - 1, F.lit(1))), lambda k: point(x, k)), own)).otherwise(own)

    made = F.flatten(F.transform("kept", points))
    out = out.withColumn("points", made)
    last = lambda n: F.slice("points", F.greatest(F.size("points") - n + 1, F.lit(1)), n)
    return _checked(out.withColumn("points", F.when(F.col("look") > 0, last(F.col("look"))).otherwise(F.col("points")))).drop("kept", "interval", "look", "repeated", "invalid")


def _checked(rows: DataFrame) -> DataFrame:
    """Rows with ``points`` and their number, ``estimated_count`` and ``input_status``."""
    estimated = lambda a: F.size(F.filter(a, lambda p: p["estimated"]))
    last = lambda n: F.slice("points", F.greatest(F.size("points") - n + 1, F.lit(1)), n)
    out = rows.withColumns({"rows": F.size("points").cast("long"), "estimated_count": estimated(F.col("points")).cast("long")})
    some = F.col("estimated_count") > 0
    status = (
        F.when(F.col("repeated"), "not_ordered")
        .when(F.col("invalid"), "invalid_value")
        .when(some & (F.col("estimated_count") / F.col("rows") > MOST_SHARE), "too_many_estimated")
        .when(some & (estimated(last(RECENT)) / F.least(F.col("rows"), F.lit(RECENT)) > MOST_SHARE), "too_many_recent")
        .when(some & (estimated(last(REAL_TAIL)) > 0), "short_real_tail")
        .otherwise("ok")
    )
    return out.withColumn("input_status", status)


def _without_bridges(own: DataFrame) -> DataFrame:
    """As ``_inputs``, with the rows behind the last gap of more than two intervals as points, and none estimated."""
    w = Window.partitionBy(*SERIES).orderBy("observed_at")
    gap = seconds_between(F.col("observed_at"), F.lag("observed_at").over(w))
    rows = own.withColumn("segment", F.sum(F.coalesce(gap > 2 * F.col("interval_s"), F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("newest", F.col("segment") == F.max("segment").over(Window.partitionBy(*SERIES)))
    point = F.struct(F.col("observed_at").alias("at"), F.col("observed_value").alias("value"), F.lit(False).alias("estimated"))
    out = rows.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.when(F.col("newest"), point))).alias("points"), (F.count_if("newest") < F.count("*")).alias("used_suffix"), F.first("lookback").alias("look"))
    cut_ = F.slice("points", F.greatest(F.size("points") - F.col("look") + 1, F.lit(1)), F.greatest(F.col("look"), F.lit(1)))
    return out.withColumn("points", F.when(F.col("look") > 0, cut_).otherwise(F.col("points"))).select(*SERIES, "points", "used_suffix")


def _smoothed(values: Column, season: Column, steps: Column) -> Column:
    """The smoothed peak of arrays of values: smoothing goes through a series in order, so it is Python on Arrow batches of series."""

    @F.pandas_udf("double")
    def peak(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, s, a in batches:
            fits = [x is not None and len(x) >= 2 * n and bool(np.isfinite(x).all()) for x, n in zip(v, s, strict=True)]
            yield pd.Series([smoothed_peak(np.array(x, float), int(n), int(k)) if ok else None for x, n, k, ok in zip(v, s, a, fits, strict=True)], dtype="float64")

    return peak(values, season, steps)


def _predicted() -> Column:
    """struct(p50, upper) of the engines without an artifact, from the values of a series' points."""
    values, season, steps = F.col("values"), F.col("season"), F.col("steps")
    n = F.size(values)
    both = lambda x: F.struct(x.alias("p50"), x.alias("upper"))
    seasonal = F.when(n >= season, F.array_max(F.slice(values, F.greatest(n - season + 1, F.lit(1)), F.least(steps, season))))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n - steps + 1, F.lit(1))), lambda k: F.array_max(F.slice(values, k, steps)))
    peaks = F.when(n > steps, windows)
    ranked = F.transform(F.array(F.array_sort(peaks)), lambda p: F.struct(nearest_rank(p, 0.5).alias("p50"), nearest_rank(p, F.col("quantile")).alias("upper")))[0]
    smooth = _smoothed(F.when(F.col("served") == "holt-winters", values), season, steps)
    return F.when(F.col("served") == "seasonal-baseline", both(seasonal)).when(F.col("served") == "rolling-quantile", ranked).when(F.col("served") == "holt-winters", both(smooth))


def _learned(rows: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(series, p50, upper) of the series that an artifact serves, at the last of their points."""
    own = rows.where(F.col("served").isin("xgboost", "gru") & (F.col("input_status") == "ok")).select(*SERIES, "served", "season", "steps", "quantile", "timezone", F.size("points").alias("n"), F.posexplode("points").alias("place", "p"))
    own = own.select(*SERIES, F.col("p.at").alias("observed_at"), F.col("p.value").alias("observed_value"), "served", "season", "steps", "quantile", "timezone", (F.col("place") == F.col("n") - 1).alias("is_origin"), "place")
    marked = own.withColumns({"clock": wall_clock(F.col("timezone")), "segment_at": F.lit(0), "window": F.lit(1 << 30)})
    featured, names = with_features(marked, F.col("is_origin") & (F.col("served") == "xgboost") & (F.col("place") >= 60))
    found = predict_at(featured, artifacts.withColumn("model", F.lit("served")), names)
    return found.where("fault is null").select(*SERIES, F.struct("p50", "upper").alias("learned"))


def forecast_cycle(
    samples: DataFrame, contracts: DataFrame, state: DataFrame, now: Column, interval_s: int | None = None, season: int | None = None, steps: int | None = None, engine: str | None = None,
    max_gap_s: int = 300, min_samples: int | None = None, policy: SurgePolicy | None = SurgePolicy(), interpolate: bool = True, models: DataFrame | None = None, max_age_s: int = 72 * 3600, season_s: int = 86_400,
) -> DataFrame:
    """One row per active contract: a decision, or the ``status`` that prevents one.

    Each contract has its interval, quantile, decision horizon, training
    window, engine and time zone; with ``interval_s`` only contracts of that
    interval count, ``steps`` and ``engine``, if given, hold for all. A
    contract whose series has an active model that may serve it, and whose
    artifact is intact, is forecast by that, from no more rows than the
    artifact looks at; any other by its engine, if that needs no artifact.
    ``state`` has the series' current replicas, healthy and allowed. No
    ``policy`` means no surges.

    Samples are read from the longest window on and dealt by series once; gaps,
    model input, statistical forecasts and surges are windows and one
    aggregate on that, a row a series. With ``models`` these rows go to the
    shared folder, from which the learned ones are forecast. A series that
    fails carries its reason and no other is touched. Statuses in order:
    refused_window (none, or longer than 90 days), model_unavailable,
    stale_source, unreliable_inputs, insufficient_history, model_error,
    invalid_configuration, cluster_error (estimated input, and no row of
    ``state``), ok.
    """
    ship(samples.sparkSession)
    if engine and engine_of(engine).needs_artifact and models is None:
        raise ValueError(f"{engine} needs models")
    active = settings_of(contracts, interval_s, steps, engine, season, season_s)
    artifacts = None
    if models is not None:
        whole = apart(model_validity(models.where(F.sha2("artifact", 256) == F.col("artifact_sha256"))))
        fit = eligible_models(active, whole, now, max_age_s).where("model_id is not null").select(*SERIES, "model_id")
        artifacts = whole.join(fit, [*SERIES, "model_id"], "left_semi").select(*SERIES, "engine", "artifact", "artifact_sha256", artifact_lookback().alias("lookback"))
        active = active.join(apart(artifacts.select(*SERIES, F.col("engine").alias("model_engine"), "lookback")), SERIES, "left")
        active = active.withColumns({"served": F.coalesce("model_engine", resolved_engine(F.col("engine"), F.lit(False))), "lookback": F.coalesce("lookback", F.lit(0))}).drop("model_engine")
    else:
        active = active.withColumns({"served": resolved_engine(F.col("engine"), F.lit(False)), "lookback": F.lit(0)})
    least = F.lit(min_samples) if min_samples else F.when(F.col("lookback") > 0, F.col("lookback")).otherwise(F.col("season"))
    active = active.withColumn("least", least).withColumn("lookback", F.when(F.col("lookback") > 0, F.greatest("lookback", "least")).otherwise(0))
    end = F.timestamp_micros(F.unix_micros(now) - F.pmod(F.unix_micros(now), F.col("interval_s") * 1_000_000))
    recent = samples.where(F.col("observed_at").between(now - F.make_dt_interval(secs=F.lit(MOST_WINDOW_S + 86_400)), now))
    own = recent.join(active.where("window_fits and interval_s is not null").select(*SERIES, "interval_s", "window_s", "lookback"), SERIES)
    own = own.where(F.col("observed_at").between(end - F.make_dt_interval(secs=F.col("window_s")), end))
    own = own.select(*SERIES, "observed_at", "observed_value", *[c for c in ("sequence",) if c in samples.columns], "interval_s", "lookback")
    inputs = _inputs(own, max_gap_s)
    if not interpolate:
        plain = _without_bridges(own).withColumns({"repeated": F.lit(False), "invalid": F.lit(False)})
        inputs = inputs.select(*SERIES, "latest", "suffix").join(_checked(plain).drop("repeated", "invalid"), SERIES)
    rows = apart(active).join(inputs, SERIES, "left")
    if artifacts is not None:
        rows = cut(rows)
    values = F.when(F.col("input_status") == "ok", F.transform("points", lambda p: p["value"]))
    rows = rows.withColumn("values", values).withColumn("predicted", _predicted())
    if artifacts is not None:
        rows = rows.join(_learned(rows, artifacts), SERIES, "left").withColumn("predicted", F.coalesce("learned", "predicted"))
    rows = rows.select("*", "predicted.p50", "predicted.upper").join(state.select(*SERIES, "current", "healthy", "allowed", F.lit(True).alias("known")), SERIES, "left")
    if policy is not None:
        found = surge_of(F.col("suffix"), lead_minutes(F.col("startup_s"), F.col("buffer_s")), policy)
        rows = rows.withColumn("surging", found).withColumns({"surge_triggered": F.col("surging.triggered"), "surge_demand": F.col("surging.demand")})
    else:
        rows = rows.withColumns({"surge_triggered": F.lit(False), "surge_demand": F.lit(0.0)})
    age = seconds_between(end, F.col("latest"))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) | (F.col(c) < 0)
    unsound = F.exists("values", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0))
    status = (
        F.when(~F.col("window_fits") | F.col("interval_s").isNull(), "refused_window")
        .when(F.col("served").isNull(), "model_unavailable")
        .when(F.col("latest").isNull() | (age < 0) | (age > 2 * F.col("interval_s")), "stale_source")
        .when(F.col("input_status") != "ok", "unreliable_inputs")
        .when((F.col("rows") < F.col("least")) | F.coalesce(unsound, F.lit(False)), "insufficient_history")
        .when(bad("p50") | bad("upper"), "model_error")
        .when(~F.coalesce(F.col("threshold") > 0, F.lit(False)), "invalid_configuration")
        .when((F.col("estimated_count") > 0) & F.col("known").isNull(), "cluster_error")
        .otherwise("ok")
    )
    rows = rows.withColumn("status", status).drop("points", "suffix", "values", "predicted", "surging", "learned")
    safe = rows.na.fill({"current": 0.0, "healthy": True, "allowed": True, "surge_triggered": False, "surge_demand": 0.0, "used_suffix": False, "estimated_count": 0})
    decided = decide(safe.withColumn("upper", F.coalesce("upper", F.lit(0.0))).withColumn("threshold", F.when(F.col("threshold") > 0, F.col("threshold")).otherwise(1.0)))
    ok = F.col("status") == "ok"
    only = lambda c: F.when(ok, F.col(c)).alias(c)
    return decided.select(*SERIES, "status", F.col("served").alias("engine"), F.col("steps").cast("long").alias("steps"), "latest", "rows", *[only(c) for c in ("p50", "upper", "surge", "desired", "safe", "reason")])

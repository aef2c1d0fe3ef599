"""Causal features and labels of a series; a row looks back for features and forward for its label only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import ratio_or_zero
from tidemark.functions.time import local
from tidemark.operators.quality import ordered
from tidemark.schema import SERIES

#: The rows that lags and windows reach back, and the name of this set of features.
LAGS, WINDOWS, WARM_UP = (1, 2, 5, 10, 15, 30, 60), (5, 15, 30, 60), 60
FEATURE_SCHEMA = "demand-calendar-lag-v3"


def lag_features(df: DataFrame) -> DataFrame:
    """Lags by rows, not by time: regularity is checked before."""
    v, w = F.col("observed_value"), ordered()
    out: dict[str, Column] = {"current_value": v}
    for k in LAGS:
        past = F.lag(v, k).over(w)
        out |= {f"lag_{k}m": past, f"delta_{k}m": v - past, f"slope_{k}m": (v - past) / k}
    return df.withColumns(out)


def trend_features(df: DataFrame) -> DataFrame:
    """Accelerations and slope ratios, from the slopes of ``lag_features``."""
    s = lambda k: F.col(f"slope_{k}m")
    return df.withColumns({
        "acceleration_1m": s(1) - s(2),
        "acceleration_2m": s(2) - s(5),
        "slope_ratio_1m_5m": ratio_or_zero(s(1), s(5)),
        "slope_ratio_2m_10m": ratio_or_zero(s(2), s(10)),
    })


def rolling_features(df: DataFrame) -> DataFrame:
    """Mean, maximum and population deviation of the last rows; null while there are fewer."""
    v, place = F.col("observed_value"), F.row_number().over(ordered())
    out: dict[str, Column] = {}
    for n in WINDOWS:
        w = ordered().rowsBetween(-(n - 1), 0)
        for name, f in (("mean", F.avg), ("max", F.max), ("std", F.stddev_pop)):
            out[f"rolling_{name}_{n}m"] = F.when(place >= n, f(v).over(w))
    return df.withColumns(out)


def calendar_features(df: DataFrame, timezone: Column | str = "UTC") -> DataFrame:
    """Wall-clock fields of the business time zone; weeks begin on Sunday with 0."""
    at = local(F.col("observed_at"), timezone)
    day = F.dayofweek(at) - 1
    hour = F.hour(at) + F.minute(at) / 60
    angle = {"hour": 2 * math.pi * hour / 24, "weekday": 2 * math.pi * (day + hour / 24) / 7, "month": 2 * math.pi * (F.month(at) - 1) / 12}
    fields = {
        "minute": F.minute(at), "hour": F.hour(at), "day_of_week": day, "day_of_month": F.dayofmonth(at), "iso_week": F.weekofyear(at), "month": F.month(at),
        "is_weekend": F.when(day.isin(0, 6), 1).otherwise(0),
        "utc_offset_minutes": F.timestamp_diff("MINUTE", F.col("observed_at").cast("timestamp_ntz"), at),
    }
    waves = {f"{name}_{f.__name__}": f(a) for name, a in angle.items() for f in (F.sin, F.cos)}
    return df.withColumns({k: c.cast("double") for k, c in (fields | waves).items()})


def warm(df: DataFrame, rows: int = WARM_UP) -> DataFrame:
    """Rows with ``rows`` rows before them."""
    return df.withColumn("place", F.row_number().over(ordered())).where(F.col("place") > rows).drop("place")


PROVIDERS: list[Callable[[DataFrame], DataFrame]] = [lag_features, trend_features, rolling_features, calendar_features]


def feature_rows(samples: DataFrame, providers: list[Callable[[DataFrame], DataFrame]] | None = None, warm_up: int = WARM_UP) -> DataFrame:
    """Keys, time and all features in the order of their names, for rows past the warm-up. All windows share one sort of the series."""
    out = samples
    for provider in providers if providers is not None else PROVIDERS:
        out = provider(out)
    names = sorted(c for c in out.columns if c not in samples.columns)
    return warm(out, warm_up).select(*SERIES, "observed_at", *names)


def horizon_label(df: DataFrame, steps: int, name: str = "label") -> DataFrame:
    """The largest of the next ``steps`` values; null where there are fewer."""
    w = ordered().rowsBetween(1, steps)
    return df.withColumn(name, F.when(F.count("observed_value").over(w) == steps, F.max("observed_value").over(w)))


def tree_rows(samples: DataFrame, steps: int, season: int, providers=None) -> DataFrame:
    """Training rows: features, all of them single precision, and the label, from row max(season, warm-up) on."""
    labelled = horizon_label(samples, steps).select(*SERIES, "observed_at", "label")
    rows = feature_rows(samples, providers, max(season, WARM_UP)).join(labelled, [*SERIES, "observed_at"])
    names = [c for c in rows.columns if c not in (*SERIES, "observed_at", "label")]
    return rows.where("label is not null").select(*SERIES, "observed_at", *[F.col(c).cast("float").alias(c) for c in names], F.col("label").cast("float").alias("label"))


def normaliser(samples: DataFrame, floor: float = 1e-9) -> DataFrame:
    """Per series its minimum and its range, 1 where the range is below ``floor``."""
    out = samples.groupBy(*SERIES).agg(F.min("observed_value").alias("minimum"), (F.max("observed_value") - F.min("observed_value")).alias("scale"))
    return out.withColumn("scale", F.when(F.col("scale") < floor, 1.0).otherwise(F.col("scale")))


#: Names of the recurrent models' ten inputs, in their order.
SEQUENCE = ("value", "minute_sin", "minute_cos", "weekday_sin", "weekday_cos", "day_sin", "day_cos", "month_sin", "month_cos", "weekend")


def sequence_inputs(samples: DataFrame, scales: DataFrame, timezone: str = "UTC") -> DataFrame:
    """Per row the ten inputs: the value scaled by its series' minimum and range, and the wall clock on circles."""
    at = local(F.col("observed_at"), timezone)
    minute = F.hour(at) * 60 + F.minute(at)
    day = F.dayofweek(at) - 1
    turn = {"minute": minute / 1440, "weekday": day / 7, "day": (F.dayofmonth(at) - 1) / F.day(F.last_day(at)), "month": (F.month(at) - 1) / 12}
    out = samples.join(scales, SERIES).withColumn("value", (F.col("observed_value") - F.col("minimum")) / F.col("scale"))
    waves = {f"{k}_{f.__name__}": f(2 * math.pi * t) for k, t in turn.items() for f in (F.sin, F.cos)}
    return out.withColumns(waves | {"weekend": F.when(day.isin(0, 6), 1.0).otherwise(0.0)}).drop("minimum", "scale")


def sequence_examples(inputs: DataFrame, length: int, steps: int | None = None) -> DataFrame:
    """Rows with the last ``length`` inputs as an array, oldest first, and with ``steps`` their label; windows that are not full are no examples."""
    w = ordered().rowsBetween(-(length - 1), 0)
    rows = horizon_label(inputs, steps) if steps else inputs.withColumn("label", F.lit(None).cast("double"))
    rows = rows.withColumn("inputs", F.collect_list(F.array(*SEQUENCE)).over(w)).where(F.size("inputs") == length)
    return (rows.where("label is not null") if steps else rows).select(*SERIES, "observed_at", "inputs", "label")


def evenly(df: DataFrame, most: int, key: list[str] = SERIES, order: str = "observed_at") -> DataFrame:
    """At most ``most`` rows per key, at the places i*(n-1)/(most-1) in whole numbers: all rows where there are no more."""
    rows = df.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*key)))
    m = max(most - 1, 1)
    # Place p is taken if some i < most has floor(i*(n-1)/m) = p: the first i that reaches p.
    gaps = F.greatest(F.col("n") - 1, F.lit(1))
    i = F.floor((F.col("place") * m + gaps - 1) / gaps).cast("long")
    hit = F.floor(i * gaps / m) == F.col("place")
    few = F.col("n") <= most
    chosen = few | (F.lit(most) > 1) & F.when(F.col("n") > 1, hit).otherwise(True) | (F.lit(most) == 1) & (F.col("place") == 0)
    return rows.where(chosen).drop("place", "n")

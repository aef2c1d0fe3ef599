"""Queries on features, labels and examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features
from tidemark.operators.features import LAGS, WINDOWS
from tidemark.plans.registry import SEASON, SERIES_SQL, STEPS, query
from tidemark.plans.series import full, shown, sparse


def rounded(df):
    return shown(df.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]))


_LAG_SQL = ", ".join(
    f"lag(observed_value, {k}) OVER w AS lag_{k}m, observed_value - lag(observed_value, {k}) OVER w AS delta_{k}m, (observed_value - lag(observed_value, {k}) OVER w) / {k} AS slope_{k}m" for k in LAGS
)
_ROLL_SQL = ", ".join(
    f"CASE WHEN row_number() OVER w >= {n} THEN {f}(observed_value) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS rolling_{name}_{n}m" for n in WINDOWS for name, f in (("mean", "avg"), ("max", "max"), ("std", "stddev_pop"))
)
#: Istanbul keeps three hours ahead of UTC all year.
_LOCAL_SQL = "observed_at + INTERVAL 3 HOUR"
_CAL = {
    "minute": "minute(t)", "hour": "hour(t)", "day_of_week": "dayofweek(t)", "day_of_month": "day(t)", "iso_week": "weekofyear(t)", "month": "month(t)",
    "is_weekend": "CASE WHEN dayofweek(t) IN (0, 6) THEN 1 ELSE 0 END", "utc_offset_minutes": "180",
    "hour_sin": "sin(2 * pi() * (hour(t) + minute(t) / 60.0) / 24)", "hour_cos": "cos(2 * pi() * (hour(t) + minute(t) / 60.0) / 24)",
    "weekday_sin": "sin(2 * pi() * (dayofweek(t) + (hour(t) + minute(t) / 60.0) / 24) / 7)", "weekday_cos": "cos(2 * pi() * (dayofweek(t) + (hour(t) + minute(t) / 60.0) / 24) / 7)",
    "month_sin": "sin(2 * pi() * (month(t) - 1) / 12)", "month_cos": "cos(2 * pi() * (month(t) - 1) / 12)",
}
_TREND = {
    "acceleration_1m": "slope_1m - slope_2m", "acceleration_2m": "slope_2m - slope_5m",
    "slope_ratio_1m_5m": "CASE WHEN slope_5m = 0 OR NOT isfinite(slope_1m / slope_5m) THEN 0 ELSE slope_1m / slope_5m END",
    "slope_ratio_2m_10m": "CASE WHEN slope_10m = 0 OR NOT isfinite(slope_2m / slope_10m) THEN 0 ELSE slope_2m / slope_10m END",
}
_W = "WINDOW w AS (PARTITION BY workload_id ORDER BY observed_at)"
_ALL_NAMES = sorted(["current_value", *[f"{p}_{k}m" for k in LAGS for p in ("lag", "delta", "slope")], *_TREND, *[f"rolling_{n}_{k}m" for k in WINDOWS for n in ("mean", "max", "std")], *_CAL])
FEATURES_SQL = f"""WITH {SERIES_SQL}, a AS (
  SELECT workload_id, observed_at, observed_value AS current_value, row_number() OVER w AS place, {_LAG_SQL}, {_ROLL_SQL} FROM dense {_W}
), b AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _TREND.items())}, {_LOCAL_SQL} AS t FROM a
), feats AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _CAL.items())} FROM b WHERE place > 60)
"""


def providers():
    return [*features.PROVIDERS[:-1], lambda df: features.calendar_features(df, "Europe/Istanbul")]


@query(f"""WITH {SERIES_SQL}, a AS (SELECT workload_id, observed_at, {_LAG_SQL} FROM dense {_W})
SELECT workload_id, observed_at, {", ".join(f"round({p}_{k}m, 6) AS {p}_{k}m" for k in LAGS for p in ("lag", "delta", "slope"))} FROM a""")
def lag_features(spark, sf_dir):
    return rounded(features.lag_features(full(spark, sf_dir)).drop("observed_value", "current_value"))


@query(f"""WITH {SERIES_SQL}, a AS (SELECT workload_id, observed_at, row_number() OVER w AS place, {_LAG_SQL} FROM dense {_W})
SELECT workload_id, observed_at, {", ".join(f"round({v}, 6) AS {k}" for k, v in _TREND.items())} FROM a WHERE place > 60""")
def trend_features(spark, sf_dir):
    rows = features.warm(features.trend_features(features.lag_features(full(spark, sf_dir))))
    return rounded(rows.select("workload_id", "observed_at", *_TREND))


@query(f"""WITH {SERIES_SQL}, a AS (SELECT workload_id, observed_at, {_ROLL_SQL} FROM dense {_W})
SELECT workload_id, observed_at, {", ".join(f"round(rolling_{n}_{k}m, 6) AS rolling_{n}_{k}m" for k in WINDOWS for n in ("mean", "max", "std"))} FROM a""")
def rolling_features(spark, sf_dir):
    return rounded(features.rolling_features(full(spark, sf_dir)).drop("observed_value"))


@query(f"""WITH {SERIES_SQL}, a AS (SELECT workload_id, observed_at, {_LOCAL_SQL} AS t FROM hourly)
SELECT workload_id, observed_at, {", ".join(f"round(CAST({v} AS DOUBLE), 6) + 0.0 AS {k}" for k, v in _CAL.items())} FROM a""")
def calendar_features(spark, sf_dir):
    rows = features.calendar_features(sparse(spark, sf_dir), "Europe/Istanbul").drop("observed_value", "cluster_id")
    return shown(rows.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]))


@query(FEATURES_SQL + f"""SELECT workload_id, observed_at, {", ".join(f"round(CAST({n} AS DOUBLE), 6) + 0.0 AS {n}" for n in _ALL_NAMES)} FROM feats""")
def feature_rows(spark, sf_dir):
    rows = features.feature_rows(full(spark, sf_dir), providers())
    return shown(rows.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]))


@query(f"""WITH {SERIES_SQL}
SELECT workload_id, observed_at, CASE WHEN count(*) OVER f = {STEPS} THEN max(observed_value) OVER f END AS label FROM dense
WINDOW f AS (PARTITION BY workload_id ORDER BY observed_at ROWS BETWEEN 1 FOLLOWING AND {STEPS} FOLLOWING)""")
def horizon_label(spark, sf_dir):
    return shown(features.horizon_label(full(spark, sf_dir), STEPS).drop("observed_value"))


@query(FEATURES_SQL + f""", l AS (SELECT workload_id, observed_at, CASE WHEN count(*) OVER f = {STEPS} THEN max(observed_value) OVER f END AS label FROM dense
  WINDOW f AS (PARTITION BY workload_id ORDER BY observed_at ROWS BETWEEN 1 FOLLOWING AND {STEPS} FOLLOWING))
SELECT f.workload_id, f.observed_at, round(CAST(CAST(current_value AS FLOAT) AS DOUBLE), 3) AS current_value, round(CAST(CAST(lag_60m AS FLOAT) AS DOUBLE), 3) AS lag_60m, round(CAST(CAST(label AS FLOAT) AS DOUBLE), 3) AS label
FROM feats f JOIN l ON l.workload_id = f.workload_id AND l.observed_at = f.observed_at WHERE label IS NOT NULL""")
def tree_dataset(spark, sf_dir):
    rows = features.tree_rows(full(spark, sf_dir), STEPS, SEASON, providers())
    return shown(rows.select("workload_id", "observed_at", *[F.round(F.col(c).cast("double"), 3).alias(c) for c in ("current_value", "lag_60m", "label")]))


@query(f"""WITH {SERIES_SQL}
SELECT workload_id, round(min(observed_value), 6) AS minimum, round(CASE WHEN max(observed_value) - min(observed_value) < 1e-9 THEN 1 ELSE max(observed_value) - min(observed_value) END, 6) AS scale FROM hourly GROUP BY 1""")
def normaliser(spark, sf_dir):
    return rounded(features.normaliser(sparse(spark, sf_dir)))


@query(f"""WITH {SERIES_SQL}, n AS (SELECT workload_id, min(observed_value) AS lo, max(observed_value) - min(observed_value) AS sc FROM dense GROUP BY 1
), a AS (SELECT d.workload_id, observed_at, observed_at AS t, (observed_value - lo) / sc AS value FROM dense d JOIN n USING (workload_id))
SELECT workload_id, observed_at, round(value, 6) AS value,
  round(sin(2 * pi() * (hour(t) * 60 + minute(t)) / 1440), 6) + 0.0 AS minute_sin, round(cos(2 * pi() * (hour(t) * 60 + minute(t)) / 1440), 6) + 0.0 AS minute_cos,
  round(sin(2 * pi() * dayofweek(t) / 7), 6) + 0.0 AS weekday_sin, round(cos(2 * pi() * dayofweek(t) / 7), 6) + 0.0 AS weekday_cos,
  round(sin(2 * pi() * (day(t) - 1) / day(last_day(t))), 6) + 0.0 AS day_sin, round(cos(2 * pi() * (day(t) - 1) / day(last_day(t))), 6) + 0.0 AS day_cos,
  round(sin(2 * pi() * (month(t) - 1) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * (month(t) - 1) / 12), 6) + 0.0 AS month_cos,
  CASE WHEN dayofweek(t) IN (0, 6) THEN 1.0 ELSE 0.0 END::DOUBLE AS weekend FROM a""")
def sequence_features(spark, sf_dir):
    rows = full(spark, sf_dir)
    out = features.sequence_inputs(rows, features.normaliser(rows)).drop("observed_value", "cluster_id")
    return shown(out.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes]))


@query(f"""WITH {SERIES_SQL}, n AS (SELECT workload_id, min(observed_value) AS lo, max(observed_value) - min(observed_value) AS sc FROM dense GROUP BY 1
), a AS (SELECT d.workload_id, observed_at, (observed_value - lo) / sc AS v FROM dense d JOIN n USING (workload_id)
), e AS (SELECT workload_id, observed_at, count(*) OVER b AS c, sum(v) OVER b AS total, CASE WHEN count(*) OVER f = {STEPS} THEN max(v) OVER f END AS label FROM a
  WINDOW b AS (PARTITION BY workload_id ORDER BY observed_at ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), f AS (PARTITION BY workload_id ORDER BY observed_at ROWS BETWEEN 1 FOLLOWING AND {STEPS} FOLLOWING))
SELECT workload_id, observed_at, CAST(60 AS INTEGER) AS length, round(total, 4) AS input_sum, round(label, 6) AS label FROM e WHERE c = 60 AND label IS NOT NULL""")
def sequence_examples(spark, sf_dir):
    rows = full(spark, sf_dir)
    inputs = features.sequence_inputs(rows, features.normaliser(rows)).withColumn("observed_value", F.col("value"))
    out = features.sequence_examples(inputs, 60, STEPS)
    total = F.aggregate("inputs", F.lit(0.0), lambda s, x: s + x[0])
    return shown(out.select("workload_id", "observed_at", F.size("inputs").alias("length"), F.round(total, 4).alias("input_sum"), F.round("label", 6).alias("label")))


@query(f"""WITH {SERIES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY workload_id ORDER BY observed_at) - 1 AS place, count(*) OVER (PARTITION BY workload_id) AS n FROM hourly
), p AS (SELECT DISTINCT workload_id, i * (n - 1) // 99 AS place FROM n CROSS JOIN generate_series(0, 99) g(i) WHERE n > 100)
SELECT n.workload_id, n.observed_at, n.observed_value FROM n JOIN p ON p.workload_id = n.workload_id AND p.place = n.place UNION ALL SELECT workload_id, observed_at, observed_value FROM n WHERE n <= 100""")
def even_subsample(spark, sf_dir):
    return shown(features.evenly(sparse(spark, sf_dir), 100))



"""Queries on forecasts, their evaluation, surges and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import pinball as pinball_loss
from tidemark.operators import cycle, evaluate, forecast, guard, learned, promote, surge, training
from tidemark.operators.features import horizon_label, tree_rows
from tidemark.operators.quality import real_suffix as suffix_of
from tidemark.plans.features import providers, rounded
from tidemark.plans.registry import END, HOUR, SEASON, SERIES_SQL, STEPS, query
from tidemark.plans.series import FILL_SQL, SUFFIX_SQL, full, raw, shown, sparse, ts
from tidemark.schema import SERIES
from tidemark.sources.series import table

Q = 0.95
THRESHOLDS = {"click": 500.0, "error": 120.0, "purchase": 700.0, "signup": 250.0, "view": 900.0}
THRESHOLD_SQL = "CASE workload_id " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in THRESHOLDS.items()) + " ELSE 400.0 END"


def threshold():
    out = F.lit(400.0)
    for k, v in THRESHOLDS.items():
        out = F.when(F.col("workload_id") == k, v).otherwise(out)
    return out


def contracts(samples: DataFrame) -> DataFrame:
    """One contract per series: its threshold, and the same horizon and bounds for all."""
    return samples.select("cluster_id", *SERIES).distinct().select(
        "cluster_id", *SERIES, threshold().alias("threshold"), F.lit(Q).alias("quantile"), F.lit(3 * HOUR).cast("long").alias("horizon_s"), F.lit(HOUR).cast("long").alias("interval_s"),
        F.lit(600).cast("long").alias("startup_s"), F.lit(300).cast("long").alias("buffer_s"), F.lit(1).alias("min_replicas"), F.lit(50).alias("max_replicas"), F.lit("active").alias("status"),
    )


_BACK = "row_number() OVER (PARTITION BY workload_id ORDER BY observed_at DESC) AS back"
SEASONAL_SQL = f"""seasonal AS (SELECT workload_id, max(observed_value) AS upper FROM (SELECT *, {_BACK} FROM dense) WHERE back <= {SEASON} AND back > {SEASON} - {STEPS} GROUP BY 1)"""


@query(f"WITH {SERIES_SQL}, {SEASONAL_SQL} SELECT workload_id, upper AS p50, upper FROM seasonal")
def seasonal_peak(spark, sf_dir):
    return shown(forecast.seasonal_peak(full(spark, sf_dir), SEASON, STEPS))


_PEAKS_SQL = f"""peaks AS (SELECT workload_id, peak FROM (SELECT workload_id, count(*) OVER f AS c, max(observed_value) OVER f AS peak FROM dense
  WINDOW f AS (PARTITION BY workload_id ORDER BY observed_at ROWS BETWEEN CURRENT ROW AND {STEPS - 1} FOLLOWING)) WHERE c = {STEPS}
), ranked AS (SELECT workload_id, peak, row_number() OVER (PARTITION BY workload_id ORDER BY peak) AS r, count(*) OVER (PARTITION BY workload_id) AS n FROM peaks)"""


@query(f"""WITH {SERIES_SQL}, {_PEAKS_SQL}
SELECT workload_id, max(CASE WHEN r = ceil(0.5::DOUBLE * n) THEN peak END) AS p50, max(CASE WHEN r = ceil({Q}::DOUBLE * n) THEN peak END) AS upper FROM ranked GROUP BY 1""")
def rolling_quantile_peak(spark, sf_dir):
    return shown(forecast.rolling_quantile_peak(full(spark, sf_dir), STEPS, Q))


@query(f"""WITH RECURSIVE {SERIES_SQL}, v AS (
  SELECT workload_id, list(observed_value ORDER BY observed_at) AS x FROM dense GROUP BY 1
), seed AS (
  SELECT workload_id, x, list_avg(x[1:{SEASON}]) AS l0, (list_avg(x[{SEASON + 1}:{2 * SEASON}]) - list_avg(x[1:{SEASON}])) / {SEASON} AS t0 FROM v
), go(workload_id, x, k, lvl, trd, sea) AS (
  SELECT workload_id, x, {SEASON}, l0, t0, list_transform(x[1:{SEASON}], lambda y: y - l0) FROM seed
  UNION ALL
  SELECT workload_id, x, k + 1, nl, 0.1 * (nl - lvl) + 0.9 * trd, sea[2:{SEASON}] || [0.2 * (x[k + 1] - nl) + 0.8 * sea[1]]
  FROM (SELECT *, 0.3 * (x[k + 1] - sea[1]) + 0.7 * (lvl + trd) AS nl FROM go WHERE k < len(x))
), last AS (SELECT workload_id, len(x) AS n, lvl, trd, sea FROM go WHERE k = len(x))
SELECT workload_id, round(greatest(0, {", ".join(f"lvl + {h} * trd + sea[{h}]" for h in range(1, STEPS + 1))}), 6) AS p50, round(greatest(0, {", ".join(f"lvl + {h} * trd + sea[{h}]" for h in range(1, STEPS + 1))}), 6) AS upper FROM last""")
def holt_winters_peak(spark, sf_dir):
    return rounded(forecast.holt_winters_peak(full(spark, sf_dir), SEASON, STEPS))


_SEASONAL_ROWS_SQL = f"""fc AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY workload_id ORDER BY observed_at) >= {SEASON} THEN max(observed_value) OVER (PARTITION BY workload_id ORDER BY observed_at ROWS BETWEEN {SEASON - 1} PRECEDING AND {SEASON - STEPS} PRECEDING) END AS upper,
  CASE WHEN count(*) OVER f = {STEPS} THEN max(observed_value) OVER f END AS actual, row_number() OVER (PARTITION BY workload_id ORDER BY observed_at) AS place FROM dense
  WINDOW f AS (PARTITION BY workload_id ORDER BY observed_at ROWS BETWEEN 1 FOLLOWING AND {STEPS} FOLLOWING))"""


def seasonal_rows(spark, sf_dir):
    return forecast.seasonal_at_rows(full(spark, sf_dir), SEASON, STEPS)


@query(f"""WITH {SERIES_SQL}, {_SEASONAL_ROWS_SQL}
SELECT workload_id, count(*) AS windows, round(avg(CASE WHEN upper >= actual THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(CASE WHEN upper >= actual THEN 0.0 ELSE 1.0 END), 6) AS underprediction_rate,
  round(avg(abs(upper - actual)), 6) AS mean_absolute_error, round(avg(greatest({Q}::DOUBLE * (actual - upper), ({Q}::DOUBLE - 1) * (actual - upper))), 6) AS pinball
FROM fc WHERE place >= {SEASON} AND actual IS NOT NULL GROUP BY 1""")
def walk_forward_score(spark, sf_dir):
    return rounded(evaluate.walk_forward(seasonal_rows(spark, sf_dir), STEPS, SEASON, Q))


@query(f"""WITH {SERIES_SQL}, {_SEASONAL_ROWS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY workload_id ORDER BY observed_at DESC) - 1 AS back FROM fc WHERE actual IS NOT NULL AND upper IS NOT NULL)
SELECT workload_id, count(*) AS windows, round(avg(CASE WHEN upper >= actual THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(greatest({Q}::DOUBLE * (actual - upper), ({Q}::DOUBLE - 1) * (actual - upper))), 6) AS pinball
FROM b WHERE back % {STEPS} = 0 AND back < {100 * STEPS} GROUP BY 1""")
def holdout_diagnostics(spark, sf_dir):
    return rounded(evaluate.holdout_diagnostics(seasonal_rows(spark, sf_dir), STEPS, Q, 100))


@query(f"""WITH {SERIES_SQL}, {_SEASONAL_ROWS_SQL}
SELECT workload_id, observed_at, actual, upper, round(greatest({Q}::DOUBLE * (actual - upper), ({Q}::DOUBLE - 1) * (actual - upper)), 6) AS loss FROM fc WHERE actual IS NOT NULL AND upper IS NOT NULL""")
def pinball_rows(spark, sf_dir):
    rows = horizon_label(seasonal_rows(spark, sf_dir), STEPS, "actual").where("actual is not null and upper is not null")
    return rounded(rows.select("workload_id", "observed_at", "actual", "upper", pinball_loss(F.col("actual"), F.col("upper"), Q).alias("loss")))


AFTER = "2024-01-05 00:00:00"
ORIGINS_SQL = f"""runs AS (
  SELECT *, CAST(epoch_us(observed_at) // 3600000000 AS BIGINT) - row_number() OVER (PARTITION BY workload_id ORDER BY observed_at) AS segment FROM SOURCE
), places AS (
  SELECT *, row_number() OVER (PARTITION BY workload_id, segment ORDER BY observed_at) AS place, CASE WHEN count(*) OVER f = {STEPS} THEN greatest(max(observed_value) OVER f, 0) END AS actual, max(observed_at) OVER f AS target_end FROM runs
  WINDOW f AS (PARTITION BY workload_id, segment ORDER BY observed_at ROWS BETWEEN 1 FOLLOWING AND {STEPS} FOLLOWING)
), elig AS (SELECT *, row_number() OVER (PARTITION BY workload_id, segment ORDER BY observed_at) AS k FROM places WHERE place >= HISTORY AND actual IS NOT NULL AND observed_at >= TIMESTAMP '{AFTER}'
), origins AS (SELECT workload_id, observed_at AS origin, target_end, actual FROM elig WHERE (k - 1) % {STEPS} = 0)"""


def _origins_sql(source: str, history: int) -> str:
    return ORIGINS_SQL.replace("SOURCE", source).replace("HISTORY", str(history))


@query(f"WITH {SERIES_SQL}, {_origins_sql('hourly', 6)} SELECT workload_id, origin, target_end, actual FROM origins")
def paired_origins(spark, sf_dir):
    return shown(evaluate.paired_origins(sparse(spark, sf_dir), HOUR, STEPS, 6, AFTER).drop("segment"))


@query(f"""WITH {SERIES_SQL}, {_origins_sql('hourly', 6)}, a AS (SELECT workload_id, count(*) AS eligible_windows, min(origin) AS start, max(target_end) AS "end" FROM origins GROUP BY 1)
SELECT workload_id, eligible_windows, start, "end", CASE WHEN eligible_windows < 24 THEN 'insufficient_complete_windows' WHEN epoch("end") - epoch(start) < 172800 OR eligible_windows * 10800 < 0.9 * 172800 THEN 'insufficient_evaluation_duration' ELSE 'ok' END AS reason FROM a""")
def comparison_status(spark, sf_dir):
    origins = evaluate.paired_origins(sparse(spark, sf_dir), HOUR, STEPS, 6, AFTER)
    return shown(evaluate.comparison_status(origins, STEPS, HOUR, 24, 48 * HOUR))


def model_rows(spark, sf_dir) -> DataFrame:
    """Forecasts of three models at each row: seasonal, the last day's maximum, and the last value."""
    rows = seasonal_rows(spark, sf_dir)
    w = Window.partitionBy(*SERIES).orderBy("observed_at")
    wide = rows.withColumn("day_peak", F.max("observed_value").over(w.rowsBetween(-(SEASON - 1), 0))).withColumnRenamed("observed_at", "origin")
    return wide.select(*SERIES, "origin", F.col("upper").alias("seasonal"), "day_peak", F.col("observed_value").alias("last_value")).unpivot([*SERIES, "origin"], ["seasonal", "day_peak", "last_value"], "model", "upper")


@query(f"""WITH {SERIES_SQL}, {_origins_sql('dense', SEASON)}, n AS (SELECT *, row_number() OVER (PARTITION BY workload_id ORDER BY origin) - 1 AS place, count(*) OVER (PARTITION BY workload_id) AS n FROM origins
), pick AS (SELECT DISTINCT workload_id, i * (n - 1) // 71 AS place FROM n CROSS JOIN generate_series(0, 71) g(i) WHERE n > 72
), chosen AS (SELECT n.* FROM n JOIN pick p ON p.workload_id = n.workload_id AND p.place = n.place UNION ALL SELECT * FROM n WHERE n <= 72
), cut AS (SELECT workload_id, list_sort(list(actual))[CAST(floor((count(*) - 1) * 0.9::DOUBLE) AS INTEGER) + 1] AS peak FROM chosen GROUP BY 1
), m AS (SELECT workload_id, observed_at AS origin, max(observed_value) OVER (w ROWS BETWEEN {SEASON - 1} PRECEDING AND {SEASON - STEPS} PRECEDING) AS seasonal, max(observed_value) OVER (w ROWS BETWEEN {SEASON - 1} PRECEDING AND CURRENT ROW) AS day_peak, observed_value AS last_value FROM dense WINDOW w AS (PARTITION BY workload_id ORDER BY observed_at)
), u AS (SELECT workload_id, origin, 'seasonal' AS model, seasonal AS upper FROM m UNION ALL SELECT workload_id, origin, 'day_peak', day_peak FROM m UNION ALL SELECT workload_id, origin, 'last_value', last_value FROM m
), s AS (SELECT c.workload_id, u.model, c.actual, u.upper, c.actual >= k.peak AS is_peak, greatest(0, c.actual - u.upper) AS short FROM chosen c JOIN u ON u.workload_id = c.workload_id AND u.origin = c.origin JOIN cut k ON k.workload_id = c.workload_id)
SELECT workload_id, model, count(*) AS windows, round(avg(CASE WHEN short > 0 THEN 0.0 ELSE 1.0 END), 6) AS coverage, round(avg(CASE WHEN short > 0 THEN 1.0 ELSE 0.0 END), 6) AS underprediction_rate, round(avg(abs(actual - upper)), 6) AS mean_absolute_error,
  round(avg(greatest({Q}::DOUBLE * (actual - upper), ({Q}::DOUBLE - 1) * (actual - upper))), 6) AS pinball, round(avg(short), 6) AS mean_underprediction, round(max(short / greatest(1, actual)), 6) AS max_relative_underprediction,
  round(coalesce(avg(CASE WHEN is_peak THEN short END), 0), 6) AS peak_mean_underprediction, round(sum(greatest(0, ceil(upper / 100) - ceil(actual / 100)) * 180), 6) AS excess_replica_minutes FROM s GROUP BY 1, 2""")
def paired_comparison(spark, sf_dir):
    origins = evaluate.paired_origins(full(spark, sf_dir), HOUR, STEPS, SEASON, AFTER)
    return rounded(evaluate.compared(origins, model_rows(spark, sf_dir), Q, 100.0, 60.0 * STEPS, 72))


def snapshots(spark, sf_dir) -> DataFrame:
    """A stored forecast per series and row of the month: the seasonal one, with its decision."""
    rows = seasonal_rows(spark, sf_dir).where("upper is not null")
    number = F.row_number().over(Window.partitionBy(*SERIES).orderBy("observed_at"))
    return rows.select(
        (F.xxhash64("workload_id") % 1000 * 100_000 + number).alias("snapshot_id"), "cluster_id", *SERIES, F.timestamp_seconds(F.unix_seconds("observed_at") + 30).alias("generated_at"), "observed_at", F.lit("seasonal-baseline").alias("engine"),
        F.lit(3 * HOUR).cast("long").alias("horizon_s"), F.col("upper").alias("p50"), "upper", F.ceil(F.col("upper") / threshold()).cast("double").alias("safe"),
        F.lit(None).cast("double").alias("realized"), F.when(F.hour("observed_at") % 5 == 0, F.col("observed_at")).alias("evaluated_at"), F.lit(None).cast("boolean").alias("covered"), F.lit(None).cast("boolean").alias("underpredicted"), F.lit(None).cast("double").alias("absolute_error"),
    )


SNAPSHOT_SQL = f"""{_SEASONAL_ROWS_SQL}, snaps AS (SELECT workload_id, source_fingerprint, observed_at, observed_at + INTERVAL 30 SECOND AS generated_at, upper, ceil(upper / ({THRESHOLD_SQL})) AS safe, hour(observed_at) % 5 = 0 AS evaluated FROM fc WHERE upper IS NOT NULL)"""


@query(f"""WITH {SERIES_SQL}, {SNAPSHOT_SQL}, due AS (SELECT * FROM snaps WHERE NOT evaluated AND observed_at + INTERVAL 3 HOUR <= TIMESTAMP '2024-01-30 12:00:00'
), r AS (SELECT d.workload_id, d.observed_at, d.upper, max(h.observed_value) AS realized, count(DISTINCT h.observed_at) AS slots FROM due d JOIN hourly h ON h.workload_id = d.workload_id AND h.observed_at > d.observed_at AND h.observed_at <= d.observed_at + INTERVAL 3 HOUR GROUP BY 1, 2, 3)
SELECT workload_id, count(*) AS evaluated, count(*) FILTER (upper >= realized) AS covered, count(*) FILTER (upper < realized) AS underpredicted, round(sum(abs(upper - realized)), 4) AS total_error, round(sum(realized), 4) AS realized, count(*) FILTER (slots >= 3) AS complete FROM r GROUP BY 1""")
def matured_error(spark, sf_dir):
    out = evaluate.matured(snapshots(spark, sf_dir), sparse(spark, sf_dir), ts("2024-01-30 12:00:00"), HOUR)
    return out.groupBy("workload_id").agg(
        F.count("*").alias("evaluated"), F.count_if("covered").alias("covered"), F.count_if("underpredicted").alias("underpredicted"), F.round(F.sum("absolute_error"), 4).alias("total_error"), F.round(F.sum("realized"), 4).alias("realized"), F.count_if("complete").alias("complete")
    )


@query(f"""WITH {SERIES_SQL}, {SNAPSHOT_SQL}, r AS (SELECT s.workload_id, s.observed_at, s.evaluated OR (s.observed_at + INTERVAL 3 HOUR <= TIMESTAMP '2024-01-30 12:00:00' AND count(h.observed_at) > 0) AS done
  FROM snaps s LEFT JOIN hourly h ON h.workload_id = s.workload_id AND h.observed_at > s.observed_at AND h.observed_at <= s.observed_at + INTERVAL 3 HOUR GROUP BY s.workload_id, s.observed_at, s.evaluated)
SELECT workload_id, count(*) AS snapshots, count(*) FILTER (done) AS evaluated FROM r GROUP BY 1""")
def error_update(spark, sf_dir):
    now, snaps = ts("2024-01-30 12:00:00"), snapshots(spark, sf_dir)
    after = evaluate.with_evaluations(snaps, evaluate.matured(snaps, sparse(spark, sf_dir), now, HOUR), now)
    return after.groupBy("workload_id").agg(F.count("*").alias("snapshots"), F.count("evaluated_at").alias("evaluated"))


@query(f"""WITH {SERIES_SQL} SELECT workload_id, sha256(string_agg(CAST(epoch_us(observed_at) AS VARCHAR) || ':' || CAST(CAST(round(observed_value * 1000000) AS BIGINT) AS VARCHAR), chr(10) ORDER BY observed_at)) AS fingerprint FROM hourly GROUP BY 1""")
def dataset_fingerprint(spark, sf_dir):
    return shown(evaluate.dataset_fingerprint(sparse(spark, sf_dir)))


@query(f"""WITH {SERIES_SQL}, r AS (SELECT *, (observed_value - lag(observed_value) OVER (PARTITION BY workload_id ORDER BY observed_at)) / 60 AS slope, row_number() OVER (PARTITION BY workload_id ORDER BY observed_at DESC) AS back FROM dense
), k AS (SELECT workload_id, slope, row_number() OVER (PARTITION BY workload_id ORDER BY slope) AS r, count(*) OVER (PARTITION BY workload_id) AS n FROM r WHERE back > 2 AND slope IS NOT NULL)
SELECT workload_id, round(max(CASE WHEN r = ceil(0.95::DOUBLE * n) THEN slope END), 6) AS slope_p95 FROM k GROUP BY 1""")
def slope_quantile(spark, sf_dir):
    return rounded(surge.slope_quantile(full(spark, sf_dir), HOUR))


SURGE_SQL = """rows_ AS (
  SELECT workload_id, observed_at, observed_value, (observed_value - lag(observed_value) OVER w) / 60 AS slope, avg(observed_value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS baseline,
    row_number() OVER (PARTITION BY workload_id ORDER BY observed_at DESC) AS back, count(*) OVER (PARTITION BY workload_id) AS n FROM dense WINDOW w AS (PARTITION BY workload_id ORDER BY observed_at)
), sk AS (SELECT workload_id, slope, row_number() OVER (PARTITION BY workload_id ORDER BY slope) AS r, count(*) OVER (PARTITION BY workload_id) AS m FROM rows_ WHERE back > 2 AND slope IS NOT NULL
), p AS (SELECT workload_id, max(CASE WHEN r = ceil(0.95::DOUBLE * m) THEN slope END) AS slope_p95 FROM sk GROUP BY 1
), c AS (SELECT r.*, p.slope_p95, slope > 0 AND baseline > 0 AND (slope_p95 <= 0 OR slope >= slope_p95 * MULT) AND observed_value >= baseline * BASE AS candidate FROM rows_ r JOIN p USING (workload_id) WHERE back <= 2
), surges AS (SELECT workload_id, bool_and(candidate) AND max(n) >= 7 AS triggered, max(CASE WHEN back = 1 THEN observed_value END) AS value, max(CASE WHEN back = 1 THEN slope END) AS slope, max(CASE WHEN back = 1 THEN baseline END) AS baseline, max(slope_p95) AS slope_p95 FROM c GROUP BY 1)"""


@query(f"""WITH {SERIES_SQL}, {SURGE_SQL.replace('MULT', '3.0').replace('BASE', '1.5')}
SELECT workload_id, triggered, round(CASE WHEN triggered THEN least(value + greatest(0, slope) * 15, value * 1.5) ELSE 0 END, 6) AS demand, value, round(slope, 6) AS slope, round(baseline, 6) AS baseline, round(slope_p95, 6) AS slope_p95 FROM surges""")
def surge_projection(spark, sf_dir):
    rows = full(spark, sf_dir)
    leads = contracts(rows).select(*SERIES, surge.lead_minutes(F.col("startup_s"), F.col("buffer_s")).alias("lead_minutes"))
    return rounded(surge.surges(rows, HOUR, leads))


@query(f"""WITH {SERIES_SQL}, s AS (SELECT *, (observed_value - lag(observed_value) OVER w) / 60 AS slope, avg(observed_value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS baseline, row_number() OVER w AS place FROM dense WINDOW w AS (PARTITION BY workload_id ORDER BY observed_at))
SELECT workload_id, observed_at, round(baseline, 6) AS baseline, round(slope, 6) AS slope, coalesce(slope > 0 AND baseline > 0 AND slope >= 3.0 AND observed_value >= baseline * 1.5, false) AS candidate FROM s WHERE place > 5""")
def surge_candidates(spark, sf_dir):
    w = Window.partitionBy(*SERIES).orderBy("observed_at")
    rows = full(spark, sf_dir).withColumns({"slope": (F.col("observed_value") - F.lag("observed_value").over(w)) / 60, "baseline": F.avg("observed_value").over(w.rowsBetween(-5, -1)), "place": F.row_number().over(w)}).where("place > 5")
    hit = surge.is_candidate(F.col("observed_value"), F.col("baseline"), F.col("slope"), F.lit(1.0), surge.SurgePolicy())
    return rounded(rows.select("workload_id", "observed_at", "baseline", "slope", F.coalesce(hit, F.lit(False)).alias("candidate")))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN cur WHEN o_orderkey % 11 = 0 THEN cur WHEN wanted <= cur THEN wanted ELSE least(wanted, cur + 3, CASE WHEN cur > 0 THEN cur * 2 ELSE wanted END) END AS safe,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN 'cluster_unhealthy' WHEN o_orderkey % 11 = 0 THEN 'capacity_unavailable' WHEN wanted <= cur THEN 'no_predictive_scale_up' ELSE 'rate_limited' END AS reason
FROM (SELECT *, least(ceil(o_totalprice / 5000), 50) AS wanted, CAST(o_custkey % 20 AS DOUBLE) AS cur FROM orders)""")
def guarded_replicas(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    out = guard.guarded(F.ceil(F.col("o_totalprice") / 5000).cast("double"), (F.col("o_custkey") % 20).cast("double"), F.lit(50), F.lit(3.0), F.lit(100.0), ~((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 7 == 0)), F.col("o_orderkey") % 11 != 0)
    return rows.select("o_orderkey", out.alias("g")).select("o_orderkey", "g.safe", "g.reason")


@query("""SELECT o_orderkey, CASE WHEN eng = '' THEN 'seasonal-baseline' WHEN eng IN ('seasonal-baseline', 'rolling-quantile', 'holt-winters') THEN eng WHEN eng IN ('xgboost', 'gru') AND o_orderkey % 3 = 0 THEN eng END AS engine
FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'xgboost' WHEN '2-HIGH' THEN 'gru' WHEN '3-MEDIUM' THEN 'holt-winters' WHEN '5-LOW' THEN '' ELSE 'other' END AS eng FROM orders)""")
def engine_resolution(spark, sf_dir):
    p = F.col("o_orderpriority")
    name = F.when(p == "1-URGENT", "xgboost").when(p == "2-HIGH", "gru").when(p == "3-MEDIUM", "holt-winters").when(p == "5-LOW", "").otherwise("other")
    return table(spark, sf_dir, "orders").select("o_orderkey", forecast.resolved_engine(name, F.col("o_orderkey") % 3 == 0).alias("engine"))


@query("SELECT l_orderkey, l_linenumber, greatest(p, 0) AS p50, greatest(u, greatest(p, 0)) AS upper FROM (SELECT *, l_quantity - 10 AS p, l_quantity * l_discount * 10 AS u FROM lineitem)".replace("l_quantity * l_discount * 10 AS u", "round(l_quantity * l_discount * 10, 6) AS u"))
def prediction_clamp(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 10).alias("p50"), F.round(F.col("l_quantity") * F.col("l_discount") * 10, 6).alias("upper"))
    return forecast.clamped(rows)


def state(samples: DataFrame) -> DataFrame:
    return samples.select(*SERIES).distinct().select(*SERIES, F.length("workload_id").cast("double").alias("current"), F.lit(True).alias("healthy"), (F.col("workload_id") != "error").alias("allowed"))


def varied(samples: DataFrame) -> DataFrame:
    """Contracts that differ in engine, quantile, horizon and training window."""
    w = F.col("workload_id")
    return contracts(samples).withColumns({
        "engine": F.when(w.isin("click", "view"), "rolling-quantile").when(w == "signup", "gru").otherwise(""),
        "quantile": F.when(w == "view", 0.8).otherwise(0.97),
        "horizon_s": F.when(w.isin("click", "purchase"), 6 * HOUR).otherwise(3 * HOUR).cast("long"),
        "startup_s": F.lit(600).cast("long"),
        "buffer_s": F.lit(3000).cast("long"),
        "training_window_s": F.when(w.isin("view", "error"), 7 * 24 * HOUR).otherwise(20 * 24 * HOUR).cast("long"),
        "timezone": F.when(w == "view", "Europe/Istanbul").otherwise("UTC"),
    })


_VARIED_SQL = """varied AS (SELECT *, CASE WHEN workload_id IN ('click', 'view') THEN 'rolling-quantile' WHEN workload_id = 'signup' THEN NULL ELSE 'seasonal-baseline' END AS engine, CASE WHEN workload_id = 'view' THEN 0.8::DOUBLE ELSE 0.97::DOUBLE END AS q, CASE WHEN workload_id IN ('click', 'purchase') THEN 7 ELSE 4 END AS steps,
  CASE WHEN workload_id IN ('view', 'error') THEN 7 ELSE 20 END AS days FROM (SELECT DISTINCT workload_id FROM hourly))"""


def _cycle_sql(source: str, filled: str, rows: str, estimated: str, used: str, status: str) -> str:
    """The decisions from ``filled`` (workload_id, observed_at, observed_value), a series' model input."""
    return f"""{_VARIED_SQL}, suffix_ AS (SELECT workload_id, observed_at, observed_value FROM {source}
), rows_ AS (SELECT workload_id, observed_at, observed_value, (observed_value - lag(observed_value) OVER w) / 60 AS slope, avg(observed_value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS baseline, row_number() OVER (PARTITION BY workload_id ORDER BY observed_at DESC) AS back, count(*) OVER (PARTITION BY workload_id) AS n FROM suffix_ WINDOW w AS (PARTITION BY workload_id ORDER BY observed_at)
), sk AS (SELECT workload_id, slope, row_number() OVER (PARTITION BY workload_id ORDER BY slope) AS r, count(*) OVER (PARTITION BY workload_id) AS m FROM rows_ WHERE back > 2 AND slope IS NOT NULL
), p95 AS (SELECT workload_id, max(CASE WHEN r = ceil(0.95::DOUBLE * m) THEN slope END) AS slope_p95 FROM sk GROUP BY 1
), cand AS (SELECT r.*, coalesce(slope > 0 AND baseline > 0 AND (slope_p95 <= 0 OR slope >= slope_p95 * 3.0) AND observed_value >= baseline * 1.5, false) AS candidate FROM rows_ r LEFT JOIN p95 USING (workload_id) WHERE back <= 2
), surges AS (SELECT workload_id, bool_and(candidate) AND max(n) >= 7 AS triggered, max(CASE WHEN back = 1 THEN observed_value END) AS value, max(CASE WHEN back = 1 THEN slope END) AS slope FROM cand GROUP BY 1
), input_ AS ({filled}
), numbered AS (SELECT i.workload_id, i.observed_value, v.steps, v.engine, v.q, row_number() OVER (PARTITION BY i.workload_id ORDER BY i.observed_at) AS place, row_number() OVER (PARTITION BY i.workload_id ORDER BY i.observed_at DESC) AS back, count(*) OVER (PARTITION BY i.workload_id) AS n FROM input_ i JOIN varied v USING (workload_id)
), seasonal_ AS (SELECT workload_id, max(CASE WHEN back <= {SEASON} AND back > {SEASON} - least(steps, {SEASON}) AND n >= {SEASON} THEN observed_value END) AS p50 FROM numbered WHERE engine = 'seasonal-baseline' GROUP BY 1
), peaks_ AS (SELECT a.workload_id, a.place, a.q, max(b.observed_value) AS peak FROM numbered a JOIN numbered b ON a.workload_id = b.workload_id AND b.place BETWEEN a.place AND a.place + a.steps - 1 WHERE a.engine = 'rolling-quantile' AND a.n > a.steps AND a.place + a.steps - 1 <= a.n GROUP BY 1, 2, 3
), ranked_ AS (SELECT workload_id, q, peak, row_number() OVER (PARTITION BY workload_id ORDER BY peak) AS r, count(*) OVER (PARTITION BY workload_id) AS m FROM peaks_
), predicted AS (SELECT workload_id, p50, p50 AS upper FROM seasonal_ UNION ALL SELECT workload_id, max(CASE WHEN r = ceil(0.5::DOUBLE * m) THEN peak END), max(CASE WHEN r = ceil(q * m) THEN peak END) FROM ranked_ GROUP BY 1
), facts AS ({rows}
), j AS (SELECT v.workload_id, v.engine, v.steps, f.latest, f.rows, {estimated} AS estimated, {used} AS used, p.p50, p.upper, coalesce(s.triggered, false) AS triggered, CASE WHEN s.triggered THEN least(value + greatest(0, slope) * 60, value * 1.5) ELSE 0 END AS sd, CAST(length(v.workload_id) AS DOUBLE) AS cur, v.workload_id <> 'error' AS allowed, {THRESHOLD_SQL.replace('workload_id', 'v.workload_id')} AS thr, {status} AS status
  FROM varied v LEFT JOIN facts f USING (workload_id) LEFT JOIN predicted p USING (workload_id) LEFT JOIN surges s USING (workload_id)
), d AS (SELECT *, triggered AND sd > upper AS surging, ceil(CASE WHEN triggered AND sd > upper THEN sd ELSE upper END / thr) AS raw_desired FROM j
), e AS (SELECT *, CASE WHEN estimated > 0 THEN greatest(raw_desired, cur) ELSE raw_desired END AS desired, CASE WHEN estimated > 0 THEN 1 ELSE 3 END AS step, CASE WHEN estimated > 0 THEN 1.25::DOUBLE ELSE 2.0::DOUBLE END AS factor FROM d
), g AS (SELECT *, least(desired, 50) AS wanted FROM e)
SELECT workload_id, status, engine, CAST(steps AS BIGINT) AS steps, latest, rows, CASE WHEN status = 'ok' THEN round(p50, 6) END AS p50, CASE WHEN status = 'ok' THEN round(upper, 6) END AS upper, CASE WHEN status = 'ok' THEN round(CASE WHEN surging THEN sd ELSE 0 END, 6) END AS surge, CASE WHEN status = 'ok' THEN desired END AS desired,
  CASE WHEN status = 'ok' THEN CASE WHEN NOT allowed THEN cur WHEN wanted <= cur THEN wanted ELSE least(wanted, cur + step, cur * factor) END END AS safe,
  CASE WHEN status = 'ok' THEN CASE WHEN surging THEN 'sustained_abnormal_slope_and_baseline' WHEN used THEN 'baseline_replicas;recovered_after_source_gap' ELSE 'baseline_replicas' END || CASE WHEN estimated > 0 THEN ';inference_interpolated_points=' || estimated || ';conservative_gap_recovery' ELSE '' END || ';' || CASE WHEN NOT allowed THEN 'capacity_unavailable' WHEN wanted <= cur THEN 'no_predictive_scale_up' ELSE 'rate_limited' END END AS reason FROM g"""


_INSIDE = f"d.observed_at BETWEEN TIMESTAMP '{END}' - v.days * INTERVAL 1 DAY AND TIMESTAMP '{END}'"


@query(f"""WITH {SERIES_SQL}, {_cycle_sql(f"dense d JOIN (SELECT workload_id, CASE WHEN workload_id IN ('view', 'error') THEN 7 ELSE 20 END AS days FROM (SELECT DISTINCT workload_id FROM hourly)) v USING (workload_id) WHERE {_INSIDE}", "SELECT * FROM suffix_", "SELECT workload_id, max(observed_at) AS latest, count(*) AS rows FROM suffix_ GROUP BY 1", "0", "false", "CASE WHEN v.engine IS NULL THEN 'model_unavailable' ELSE 'ok' END")}""")
def replica_decision(spark, sf_dir):
    rows = full(spark, sf_dir)
    return rounded(cycle.forecast_cycle(rows, varied(rows), state(rows), ts(END), HOUR, SEASON))


_OWN_SQL = f"own_ AS (SELECT d.* FROM hourly d JOIN (SELECT workload_id, CASE WHEN workload_id IN ('view', 'error') THEN 7 ELSE 20 END AS days FROM (SELECT DISTINCT workload_id FROM hourly)) v USING (workload_id) WHERE {_INSIDE})"
_RUN_SQL = """(SELECT workload_id, observed_at, observed_value FROM (SELECT *, max(seg) OVER (PARTITION BY workload_id) AS last_seg FROM (SELECT *, sum(CASE WHEN gap >= 5400 THEN 1 ELSE 0 END) OVER (PARTITION BY workload_id ORDER BY observed_at ROWS UNBOUNDED PRECEDING) AS seg
  FROM (SELECT *, epoch(observed_at) - epoch(lag(observed_at) OVER (PARTITION BY workload_id ORDER BY observed_at)) AS gap FROM own_))) WHERE seg = last_seg)"""
_GAP_STATUS = """CASE WHEN v.engine IS NULL THEN 'model_unavailable' WHEN f.latest IS NULL OR f.latest < TIMESTAMP '2024-01-30 22:00:00' THEN 'stale_source' WHEN input_status <> 'ok' THEN 'unreliable_inputs' WHEN f.rows < 5 THEN 'insufficient_history' WHEN p.p50 IS NULL THEN 'model_error' ELSE 'ok' END"""


@query(f"""WITH {SERIES_SQL}, {_OWN_SQL}, filled_ AS ({FILL_SQL.replace('SOURCE', 'own_')}), {_cycle_sql(_RUN_SQL, "SELECT * FROM filled_ WHERE status = 'ok'", "SELECT o.workload_id, max(o.observed_at) AS latest, max(k.rows) AS rows, max(k.est) AS est, bool_or(k.used) AS used_, max(k.status) AS input_status FROM own_ o LEFT JOIN (SELECT workload_id, count(*) AS rows, max(estimated_count) AS est, bool_or(used_suffix) AS used, max(status) AS status FROM filled_ GROUP BY 1) k USING (workload_id) GROUP BY 1", "coalesce(f.est, 0)", "coalesce(f.used_, false)", _GAP_STATUS)}""")
def gap_tolerant_decision(spark, sf_dir):
    """The cycle on series with holes, of which the latest run counts."""
    rows = sparse(spark, sf_dir)
    return rounded(cycle.forecast_cycle(rows, varied(rows), state(rows), ts(END), HOUR, SEASON, max_gap_s=5 * HOUR, min_samples=5))


@query(f"""WITH {SERIES_SQL}, run_ AS ({SUFFIX_SQL}), {SURGE_SQL.replace('MULT', '3.0').replace('BASE', '1.5').replace('FROM dense', 'FROM run_').replace('p AS (', 'p95 AS (').replace('JOIN p USING', 'LEFT JOIN p95 USING').replace('p.slope_p95', 'p95.slope_p95').replace('slope > 0 AND baseline', 'coalesce(slope > 0 AND baseline').replace('baseline * 1.5 AS candidate', 'baseline * 1.5, false) AS candidate')}
SELECT workload_id, triggered, round(CASE WHEN triggered THEN least(value + greatest(0, slope) * 15, value * 1.5) ELSE 0 END, 6) AS demand, value, round(slope, 6) AS slope, round(baseline, 6) AS baseline, round(slope_p95, 6) AS slope_p95 FROM surges""")
def surge_on_raw(spark, sf_dir):
    rows = raw(spark, sf_dir)
    return rounded(surge.surges(suffix_of(rows, HOUR), HOUR, contracts(rows).select(*SERIES, F.lit(15.0).alias("lead_minutes"))))


@query("SELECT o_orderkey, CAST(600 * (1 + o_orderkey % 6) + o_custkey % 100 + 30 AS BIGINT) AS decision_horizon_s FROM orders")
def decision_horizon(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", guard.decision_horizon(600 * (1 + k % 6), F.col("o_custkey") % 100, F.lit(30)).cast("long").alias("decision_horizon_s"))


@query()
def quantile_trees(spark, sf_dir):
    """Tree forecasts after a fit on the month's first part: one row per later row."""
    rows = tree_rows(full(spark, sf_dir), STEPS, SEASON, providers())
    early, late = F.col("observed_at") < ts("2024-01-22 00:00:00"), F.col("observed_at") >= ts("2024-01-23 00:00:00")
    return rounded(learned.predict_rows(rows.where(late), learned.train_tree_models(rows.where(early), Q)))


@query()
def tree_walk_forward(spark, sf_dir):
    rows = tree_rows(full(spark, sf_dir), STEPS, SEASON, providers())
    return rounded(learned.refit_walk_forward(rows, Q, 4, STEPS))


@query()
def network_walk_forward(spark, sf_dir):
    """Scores of the native network, fitted anew before each of a series' last twelve cuts."""
    return rounded(evaluate.window_scores(learned.refit_networks(full(spark, sf_dir), STEPS, Q), F.col("q")))


@query()
def recurrent_native(spark, sf_dir):
    rows = full(spark, sf_dir)
    return rounded(learned.predict_last(rows, learned.train_networks(rows, STEPS, Q, "native")))


@query()
def recurrent_conformal(spark, sf_dir):
    rows = full(spark, sf_dir)
    shape = learned.CONFORMAL | {"length": 48, "epochs": 6, "examples": 512}
    return rounded(learned.predict_last(rows, learned.train_networks(rows, STEPS, Q, "conformal", shape)))


@query(f"""WITH {SERIES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY workload_id ORDER BY observed_at DESC) AS back, count(*) OVER (PARTITION BY workload_id) AS n FROM hourly)
SELECT workload_id, observed_at, observed_value, back <= least(48, n // 5) AS is_holdout FROM k""")
def holdout_split(spark, sf_dir):
    return shown(training.holdout_split(sparse(spark, sf_dir), HOUR))


@query(f"""WITH {SERIES_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY workload_id ORDER BY observed_at DESC) AS back FROM dense)
SELECT workload_id, sha256(concat_ws('|', workload_id, any_value(source_fingerprint), 'xgboost', sha256(string_agg(CAST(epoch_us(observed_at) AS VARCHAR) || ':' || CAST(CAST(round(observed_value * 1000000) AS BIGINT) AS VARCHAR), chr(10) ORDER BY observed_at)), CAST(epoch_us(TIMESTAMP '{END}') AS VARCHAR))) AS model_id,
  count(*) AS dataset_size, 'succeeded' AS status, CAST(NULL AS VARCHAR) AS failure_reason FROM f WHERE back > 48 GROUP BY 1""")
def training_run(spark, sf_dir):
    """Outcomes of a training run of the tree engine over all series."""
    _, outcomes = training.train_candidates(full(spark, sf_dir), "xgboost", HOUR, SEASON, STEPS, Q, ts(END))
    return shown(outcomes)


@query()
def evaluation_run(spark, sf_dir):
    """Reports on three candidates against the seasonal baseline, by series."""
    rows = full(spark, sf_dir)
    policy = promote.EvaluationPolicy(window_s=20 * 86400, min_duration_s=10 * 86400, max_relative_underprediction=1.0, coverage_tolerance=0.3)
    plan = rows.groupBy(*SERIES).agg(F.lit("evaluate_candidate").alias("action")).select(
        *SERIES, "action", F.when(F.col("workload_id") == "error", "candidate_expired").alias("reason"), F.lit("m1").alias("target_id"), F.lit(None).cast("string").alias("expected_active_id"), F.lit(None).cast("string").alias("previous_id"), ts("2024-01-10 00:00:00").alias("evidence_after")
    )
    named = F.when(F.col("model") == "day_peak", "candidate").when(F.col("model") == "last_value", "baseline")
    forecasts = model_rows(spark, sf_dir).withColumn("model", named).where("model is not null")
    return shown(training.evaluation_reports(rows, plan, forecasts, ts(END), HOUR, STEPS, SEASON, Q, 100.0, policy))

"""Streaming queries, run over what is there and then read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans import forecasts, lifecycle
from tidemark.plans.features import rounded
from tidemark.plans.registry import HOUR, SEASON, SERIES_SQL, STEPS, query
from tidemark.plans.series import full, shown
from tidemark.schema import SAMPLES, SERIES
from tidemark.session import shared_folder
from tidemark.sources.series import observations
from tidemark.streaming import loops, surge_state, twins

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def folder(spark) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


def stream(spark, sf_dir) -> DataFrame:
    return observations(spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parquet*"))


def ended(spark, sf_dir, at: str) -> DataFrame:
    """The stream, with one row three days behind its last that moves the watermark past all others; that row's own window stays open."""
    rows = stream(spark, sf_dir)
    last = observations(spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")).agg((F.max("observed_at") + F.expr("INTERVAL 3 DAYS")).alias("at"))
    given = {"workload_id": F.lit("end"), "source_fingerprint": F.lit("end"), "observed_at": F.col("at")}
    last.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema]).write.parquet(f"{at}/end")
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(f"{at}/end"))


@query(f"""WITH {SERIES_SQL}, k AS (SELECT *, date_trunc('hour', observed_at) AS slot_start, row_number() OVER (PARTITION BY workload_id, date_trunc('hour', observed_at) ORDER BY observed_at DESC, sequence DESC) AS n, count(*) OVER (PARTITION BY workload_id, date_trunc('hour', observed_at)) AS rows FROM raw)
SELECT workload_id, slot_start, observed_at, observed_value, rows FROM k WHERE n = 1""")
def stream_slots(spark, sf_dir):
    at = folder(spark)
    return shown(twins.drained(twins.slot_stream(ended(spark, sf_dir, at), HOUR), at))


@query(f"""WITH {SERIES_SQL} SELECT workload_id, count(*) AS rows FROM (SELECT DISTINCT workload_id, observed_at FROM raw) GROUP BY 1""")
def stream_once(spark, sf_dir):
    out = twins.drained(twins.once_stream(stream(spark, sf_dir)), folder(spark))
    return out.groupBy("workload_id").agg(F.count("*").alias("rows"))


@query(f"""WITH {SERIES_SQL}, g AS (SELECT *, epoch_us(observed_at) - epoch_us(lag(observed_at) OVER (PARTITION BY workload_id ORDER BY observed_at, sequence)) >= 5400000000 AS cut FROM raw
), s AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY workload_id ORDER BY observed_at, sequence ROWS UNBOUNDED PRECEDING) AS seg FROM g
), r AS (SELECT workload_id, seg, min(observed_at) AS started, count(*) AS rows, max(observed_value) AS peak FROM s GROUP BY 1, 2)
SELECT workload_id, started, rows, peak FROM r""")
def stream_sessions(spark, sf_dir):
    at = folder(spark)
    return shown(twins.drained(twins.session_stream(ended(spark, sf_dir, at), HOUR), at).select("workload_id", "started", "rows", "peak"))


@query()
def stream_smoothing(spark, sf_dir):
    """Smoothing over all events as they come, in the state of each series."""
    out = twins.drained(twins.smooth_stream(stream(spark, sf_dir).select(*SERIES, "observed_at", "observed_value"), SEASON, STEPS), folder(spark))
    return rounded(out)


@query(f"""WITH {SERIES_SQL}, r AS (SELECT *, observed_value >= 5 AS ok, lag(observed_value >= 5, 1, true) OVER (PARTITION BY workload_id ORDER BY observed_at, sequence) AS before FROM raw)
SELECT workload_id, CASE WHEN ok THEN 'recovered' ELSE 'failed' END AS event, count(*) AS rows FROM r WHERE ok <> before GROUP BY 1, 2""")
def stream_outcomes(spark, sf_dir):
    rows = stream(spark, sf_dir).select(*SERIES, "observed_at", (F.col("observed_value") >= 5).alias("ok"))
    out = twins.drained(twins.outcome_stream(rows), folder(spark))
    return out.groupBy("workload_id", "event").agg(F.count("*").alias("rows"))


@query(f"WITH {SERIES_SQL} SELECT workload_id, count(*) AS rows, round(sum(observed_value), 4) AS total FROM raw GROUP BY 1")
def stream_batches(spark, sf_dir):
    """A loop over micro-batches that appends each to a table."""
    at = folder(spark)
    loop = twins.each_batch(stream(spark, sf_dir), lambda batch, number: batch.write.mode("append").parquet(f"{at}/rows"), f"{at}/state")
    loop.awaitTermination()
    return spark.read.parquet(f"{at}/rows").groupBy("workload_id").agg(F.count("*").alias("rows"), F.round(F.sum("observed_value"), 4).alias("total"))


#: The batches of the forecast loop: what lies before each of these times, and behind the one before.
BATCHES = ("2024-01-29 00:00:00", "2024-01-30 00:00:00", "2024-01-31 00:00:00")
_AT = [f"{day} 23:00:00" for day in ("2024-01-28", "2024-01-29", "2024-01-30")]


def _forecasts_sql() -> str:
    """What the cycle decides at each batch's latest sample, from the samples up to then."""
    parts = []
    for number, at in enumerate(_AT):
        rows = lifecycle._cycle_sql(at, f"tm <= epoch(TIMESTAMP '{at}')")
        parts.append(f"SELECT CAST({number} AS BIGINT) AS batch, * FROM (WITH {rows})")
    return f"WITH {lifecycle._DECLARED_SQL} SELECT batch, workload_id, engine, latest AS observed_at, steps * CASE split_part(workload_id, '-', 2) WHEN '1' THEN 7200 WHEN '2' THEN 10800 ELSE 3600 END AS horizon_s, p50, upper, surge, safe, reason FROM ({' UNION ALL '.join(parts)}) WHERE status = 'ok'"


@query(_forecasts_sql())
def stream_forecasts(spark, sf_dir):
    """The forecaster's loop over three days' batches of samples: the snapshots that it leaves."""
    at = folder(spark)
    declared = lifecycle.contracts(spark, sf_dir)
    samples = lifecycle.demand(spark, sf_dir, declared)
    for k, until in enumerate(BATCHES):
        since = BATCHES[k - 1] if k else "1970-01-01 00:00:00"
        part = samples.where((F.col("observed_at") >= F.lit(since).cast("timestamp")) & (F.col("observed_at") < F.lit(until).cast("timestamp")))
        part.select("cluster_id", *SERIES, "observed_at", "observed_value").coalesce(1).write.mode("append").parquet(f"{at}/in")
    forecaster = loops.Forecaster(f"{at}/store", loops.LastGood(spark, lambda: declared, f"{at}/contracts"), loops.LastGood(spark, lambda: lifecycle.replicas(declared), f"{at}/state"))
    source = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    loops.run(source, forecaster, f"{at}/checkpoint").awaitTermination()
    return rounded(forecaster.snapshots(spark).select("batch", "workload_id", "engine", "observed_at", "horizon_s", "p50", "upper", "surge", "safe", "reason"))


@query(f"""WITH {SERIES_SQL}, {forecasts.SURGE_SQL.replace('MULT', '3.0').replace('BASE', '1.5')}, last_ AS (SELECT workload_id, max(observed_at) AS observed_at FROM dense GROUP BY 1)
SELECT workload_id, observed_at, triggered, round(CASE WHEN triggered THEN least(value + greatest(0, slope) * 15, value * 1.5) ELSE 0 END, 6) AS demand, value, round(slope, 6) AS slope, round(baseline, 6) AS baseline, round(slope_p95, 6) AS slope_p95 FROM surges JOIN last_ USING (workload_id)""")
def stream_surges(spark, sf_dir):
    """Surge detection in state over the month in three batches: the signals after each series' last row."""
    at = folder(spark)
    rows = full(spark, sf_dir).withColumn("lead_minutes", F.lit(15.0))
    for since, until in (("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-02-01")):
        part = rows.where((F.col("observed_at") >= F.lit(since).cast("timestamp")) & (F.col("observed_at") < F.lit(until).cast("timestamp")))
        part.coalesce(1).write.mode("append").parquet(f"{at}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")
    surge_state.surge_stream(source, HOUR).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    last = out.groupBy(*SERIES).agg(F.max_by(F.struct("observed_at", "triggered", "demand", "value", "slope", "baseline", "slope_p95"), "batch").alias("r"))
    return rounded(last.select("workload_id", "r.*"))

"""Queries on series: reading, quality, gaps, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import is_plain_address, parse_finite
from tidemark.operators import fill, quality, repair
from tidemark.operators.fill_function import register
from tidemark.plans.registry import END, HOUR, ORACLES, SERIES_SQL, START, query
from tidemark.schema import SERIES
from tidemark.sources.series import dense, hourly, observations, table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(events(spark, sf_dir))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(events(spark, sf_dir))


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(sparse(spark, sf_dir), START, END)


def ts(text: str):
    return F.lit(text).cast("timestamp")


def shown(df: DataFrame) -> DataFrame:
    """Times without a zone, as other engines show them, and without the fingerprint's column."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes if c not in ("source_fingerprint", "cluster_id")])


@query("""
SELECT event_id, v AS value FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events)
WHERE v IS NOT NULL AND isfinite(v)""")
def value_parse(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", parse_finite(F.get_json_object("props", "$.k")).alias("value")).where("value is not null")


@query("""
SELECT page_id, coalesce(regexp_full_match(trim(url), 'https?://[^/?#@\\s]+([/?][^#\\s]*)?'), false) AS plain FROM pages""")
def source_address(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", is_plain_address(F.col("url")).alias("plain"))


@query(f"""WITH {SERIES_SQL}
SELECT workload_id, observed_at, observed_value FROM raw
WHERE observed_at BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'""")
def window_scan(spark, sf_dir):
    rows = raw(spark, sf_dir).where(F.col("observed_at").between(ts("2024-01-08 00:00:00"), ts("2024-01-15 00:00:00")))
    return shown(rows.select("workload_id", "observed_at", "observed_value")).orderBy("workload_id", "observed_at")


@query(f"""WITH {SERIES_SQL}
SELECT workload_id, count(*) AS samples, round(sum(observed_value), 6) AS demand FROM raw
WHERE observed_at >= TIMESTAMP '2024-01-08 00:00:00' AND observed_at < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1""")
def half_open_scan(spark, sf_dir):
    rows = raw(spark, sf_dir).where((F.col("observed_at") >= ts("2024-01-08 00:00:00")) & (F.col("observed_at") < ts("2024-01-15 00:00:00")))
    return rows.groupBy("workload_id").agg(F.count("*").alias("samples"), F.round(F.sum("observed_value"), 6).alias("demand"))


@query(f"""WITH {SERIES_SQL}
SELECT workload_id, source_fingerprint, observed_at, observed_value FROM hourly""")
def hourly_samples(spark, sf_dir):
    return sparse(spark, sf_dir).select("workload_id", "source_fingerprint", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), "observed_value")


@query(f"""WITH {SERIES_SQL}
SELECT workload_id, observed_at, observed_value FROM dense""")
def dense_samples(spark, sf_dir):
    return shown(full(spark, sf_dir).select("workload_id", "observed_at", "observed_value"))


@query(f"""WITH {SERIES_SQL}
SELECT s.workload_id, coalesce(c.oldest, TIMESTAMP '1970-01-01') AS oldest, coalesce(c.newest, TIMESTAMP '1970-01-01') AS newest, coalesce(c.samples, 0) AS samples, CAST(168 AS BIGINT) AS expected,
  coalesce(c.samples, 0) >= 166 AND coalesce(c.oldest, TIMESTAMP '1970-01-01') <= TIMESTAMP '2024-01-08 01:00:00' AND coalesce(c.newest, TIMESTAMP '1970-01-01') >= TIMESTAMP '2024-01-14 22:00:00' AS sufficient
FROM (SELECT DISTINCT workload_id FROM hourly) s LEFT JOIN (
  SELECT workload_id, min(observed_at) AS oldest, max(observed_at) AS newest, count(*) AS samples FROM hourly
  WHERE observed_at BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1) c USING (workload_id)""")
def history_sufficiency(spark, sf_dir):
    rows = sparse(spark, sf_dir)
    series = rows.select(*SERIES).distinct()
    return shown(quality.sufficient_history(rows, series, ts("2024-01-08 00:00:00"), ts("2024-01-15 00:00:00"), HOUR))


@query(f"""WITH {SERIES_SQL}
SELECT workload_id, min(observed_at) AS oldest, max(observed_at) AS newest, count(*) AS samples FROM raw GROUP BY 1""")
def coverage_scan(spark, sf_dir):
    return shown(quality.coverage(raw(spark, sf_dir)))


@query(f"""WITH {SERIES_SQL}, k AS (
  SELECT *, row_number() OVER (PARTITION BY workload_id, date_trunc('hour', observed_at) ORDER BY observed_at DESC, sequence DESC) AS n FROM raw)
SELECT workload_id, observed_at, observed_value, sequence FROM k WHERE n = 1""")
def slot_dedup(spark, sf_dir):
    return shown(quality.slot_dedup(raw(spark, sf_dir), HOUR).drop("slot"))


@query(f"""WITH {SERIES_SQL}
SELECT workload_id, observed_at, count(*) AS rows FROM raw GROUP BY 1, 2 HAVING count(*) > 1""")
def order_faults(spark, sf_dir):
    return shown(quality.order_faults(raw(spark, sf_dir)))


@query(f"""WITH {SERIES_SQL}, g AS (
  SELECT *, epoch_us(observed_at) - epoch_us(lag(observed_at) OVER w) AS gap_us, row_number() OVER w AS place FROM hourly WINDOW w AS (PARTITION BY workload_id ORDER BY observed_at)
), f AS (
  SELECT *, CASE WHEN NOT isfinite(observed_value) THEN 'not_finite' WHEN gap_us <= 0 THEN 'not_ordered' WHEN gap_us > 7200000000 THEN 'gap' END AS fault FROM g
), a AS (
  SELECT workload_id, count(*) AS rows, max(gap_us) AS worst, min(CASE WHEN fault IS NOT NULL THEN place END) AS spot FROM f GROUP BY 1
)
SELECT a.workload_id, a.rows, round(worst / 1000000.0, 6) AS worst_gap_s, CASE WHEN a.rows < 200 THEN 'too_few' ELSE coalesce(f.fault, 'ok') END AS reason, CAST(CASE WHEN a.rows >= 200 THEN spot END AS INTEGER) AS first_fault
FROM a LEFT JOIN f ON f.workload_id = a.workload_id AND f.place = a.spot""")
def series_quality(spark, sf_dir):
    return shown(quality.series_quality(sparse(spark, sf_dir), HOUR, 200))


@query(f"""WITH {SERIES_SQL}, a AS (SELECT workload_id, max(observed_at) AS latest FROM hourly GROUP BY 1)
SELECT workload_id, latest, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(latest)) / 1000000.0 AS age_s,
  CASE WHEN latest > TIMESTAMP '2024-01-31 00:00:00' THEN 'future' WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(latest) > 7200000000 THEN 'stale' ELSE 'fresh' END AS state FROM a""")
def freshness(spark, sf_dir):
    return shown(quality.freshness(sparse(spark, sf_dir), ts(END), HOUR))


@query(f"""WITH {SERIES_SQL}, g AS (
  SELECT *, observed_at - lag(observed_at) OVER (PARTITION BY workload_id ORDER BY observed_at) AS gap FROM hourly
), s AS (
  SELECT *, sum(CASE WHEN gap > INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY workload_id ORDER BY observed_at ROWS UNBOUNDED PRECEDING) AS seg FROM g
), m AS (SELECT *, max(seg) OVER (PARTITION BY workload_id) AS last_seg FROM s)
SELECT workload_id, observed_at, observed_value FROM m WHERE seg = last_seg""")
def recent_contiguous(spark, sf_dir):
    return shown(quality.recent_contiguous(sparse(spark, sf_dir), HOUR))


@query(f"""WITH {SERIES_SQL}, r AS (
  SELECT *, CAST(epoch_us(observed_at) // 3600000000 AS BIGINT) - row_number() OVER (PARTITION BY workload_id ORDER BY observed_at) AS run FROM hourly
), z AS (SELECT *, count(*) OVER (PARTITION BY workload_id, run) AS size FROM r), m AS (SELECT *, max(run) OVER (PARTITION BY workload_id) AS newest FROM z WHERE size >= 10)
SELECT workload_id, observed_at, observed_value FROM m WHERE run = newest""")
def training_segment(spark, sf_dir):
    return shown(quality.training_segment(sparse(spark, sf_dir), HOUR, 10).drop("slot"))


#: The latest run of real hours.
SUFFIX_SQL = """WITH p AS (
  SELECT workload_id, source_fingerprint, date_trunc('hour', observed_at) AS slot_at, min(observed_at) AS first_at, max(observed_at) AS last_at FROM raw GROUP BY 1, 2, 3
), v AS (
  SELECT p.*, k.observed_value, k.sequence FROM p JOIN (
    SELECT *, row_number() OVER (PARTITION BY workload_id, date_trunc('hour', observed_at) ORDER BY observed_at DESC, sequence DESC) AS n FROM raw) k
  ON k.workload_id = p.workload_id AND date_trunc('hour', k.observed_at) = p.slot_at AND k.n = 1
), g AS (SELECT *, epoch_us(first_at) - epoch_us(lag(last_at) OVER (PARTITION BY workload_id ORDER BY slot_at)) AS gap FROM v
), s AS (SELECT *, sum(CASE WHEN gap >= 5400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY workload_id ORDER BY last_at ROWS UNBOUNDED PRECEDING) AS seg FROM g
), m AS (SELECT *, max(seg) OVER (PARTITION BY workload_id) AS last_seg FROM s)
SELECT workload_id, last_at AS observed_at, observed_value, sequence FROM m WHERE seg = last_seg"""


@query(f"WITH {SERIES_SQL} {SUFFIX_SQL.replace('WITH p AS', ', p AS', 1)}")
def real_suffix(spark, sf_dir):
    return shown(quality.real_suffix(raw(spark, sf_dir), HOUR).drop("slot"))


#: The model input of a table ``SOURCE`` with a row per hour.
FILL_SQL = """WITH g AS (
  SELECT *, lag(observed_at) OVER w AS before_at, lag(observed_value) OVER w AS before FROM SOURCE WINDOW w AS (PARTITION BY workload_id ORDER BY observed_at)
), q AS (SELECT *, (epoch_us(observed_at) - epoch_us(before_at)) / 1000000.0 AS gap FROM g
), b AS (
  SELECT *, round(gap / 3600) AS steps, coalesce(gap >= 5400 AND gap <= 18000 + 900 AND abs(gap - round(gap / 3600) * 3600) <= 900 AND abs(observed_value - before) / greatest(1, before, observed_value) <= 0.25 AND round(gap / 3600) <= 6, false) AS bridge FROM q
), s AS (SELECT *, sum(CASE WHEN coalesce(gap >= 5400, false) AND NOT bridge THEN 1 ELSE 0 END) OVER (PARTITION BY workload_id ORDER BY observed_at ROWS UNBOUNDED PRECEDING) AS seg FROM b
), m AS (SELECT *, max(seg) OVER (PARTITION BY workload_id) AS last_seg FROM s
), c AS (SELECT * FROM m WHERE seg = last_seg
), x AS (
  SELECT workload_id, observed_at, observed_value, false AS is_estimated, last_seg > 0 AS used_suffix FROM c
  UNION ALL
  SELECT workload_id, before_at + k * INTERVAL 1 HOUR, (1 - k * 3600 / gap) * before + k * 3600 / gap * observed_value, true, last_seg > 0
  FROM (SELECT *, unnest(generate_series(1, CAST(steps AS INTEGER) - 1)) AS k FROM c WHERE bridge)
), e AS (SELECT *, row_number() OVER (PARTITION BY workload_id ORDER BY observed_at DESC) AS from_end FROM x
), t AS (
  SELECT *, sum(is_estimated::INT) OVER p AS est, count(*) OVER p AS size, sum(CASE WHEN from_end <= 60 THEN is_estimated::INT ELSE 0 END) OVER p AS rest, sum(CASE WHEN from_end <= 60 THEN 1 ELSE 0 END) OVER p AS rsize,
    min(CASE WHEN is_estimated THEN from_end END) OVER p AS nearest FROM e WINDOW p AS (PARTITION BY workload_id)
)
SELECT workload_id, observed_at, observed_value, is_estimated, used_suffix, CAST(est AS BIGINT) AS estimated_count,
  CASE WHEN est > 0 AND est / size::DOUBLE > 0.05 THEN 'too_many_estimated' WHEN est > 0 AND rest / rsize::DOUBLE > 0.05 THEN 'too_many_recent' WHEN est > 0 AND nearest <= 2 THEN 'short_real_tail' ELSE 'ok' END AS status FROM t"""


@query(f"""WITH {SERIES_SQL} SELECT workload_id, observed_at, round(observed_value, 6) AS observed_value, is_estimated, used_suffix, estimated_count, status FROM ({FILL_SQL.replace('SOURCE', 'hourly')})""")
def bounded_fill(spark, sf_dir):
    out = fill.bounded_fill(sparse(spark, sf_dir), HOUR, max_gap_s=5 * HOUR)
    return shown(out.withColumn("observed_value", F.round("observed_value", 6)).withColumn("estimated_count", F.col("estimated_count").cast("long")))


@query(ORACLES["bounded_fill"])
def fill_function(spark, sf_dir):
    """The same rows from SQL, by the table function."""
    register(spark)
    rows = spark.sql(f"SELECT * FROM bounded_fill(TABLE({{samples}}), {HOUR}, {5 * HOUR})", samples=sparse(spark, sf_dir))
    return shown(rows.withColumn("observed_value", F.round("observed_value", 6)))


MISSING_SQL = f"""WITH {SERIES_SQL}, missing AS (
  SELECT d.workload_id, CAST(epoch_us(d.observed_at) // 3600000000 AS BIGINT) - 473352 AS place FROM dense d LEFT JOIN hourly h ON h.workload_id = d.workload_id AND h.observed_at = d.observed_at WHERE h.workload_id IS NULL)"""


def holes(spark, sf_dir):
    rows = sparse(spark, sf_dir)
    return repair.missing_slots(rows, rows, START, END, HOUR)


@query(MISSING_SQL + " SELECT workload_id, place FROM missing")
def missing_slots(spark, sf_dir):
    return shown(holes(spark, sf_dir).drop("slot"))


@query(MISSING_SQL + """, r AS (SELECT *, place - row_number() OVER (PARTITION BY workload_id ORDER BY place) AS run FROM missing
), h AS (SELECT *, min(place) OVER (PARTITION BY workload_id, run) AS head FROM r
), s AS (SELECT workload_id, run, (place - head) // 100 AS part, min(place) AS first, max(place) AS last FROM h GROUP BY 1, 2, 3
), c AS (SELECT *, count(*) OVER (PARTITION BY workload_id) AS runs FROM s)
SELECT workload_id, first, last, last - first + 1 AS points FROM c WHERE runs <= 25
UNION ALL
SELECT workload_id, min(place), max(place), max(place) - min(place) + 1 FROM missing WHERE workload_id IN (SELECT workload_id FROM c WHERE runs > 25) GROUP BY workload_id, place // 100""")
def repair_plan(spark, sf_dir):
    return shown(repair.repair_plan(holes(spark, sf_dir), points=100, most_runs=25))


@query(MISSING_SQL + """, n AS (SELECT workload_id, count(*) AS missing_before, count(DISTINCT run) AS runs FROM (SELECT *, place - row_number() OVER (PARTITION BY workload_id ORDER BY place) AS run FROM missing) GROUP BY 1)
SELECT s.workload_id, CASE WHEN runs > 128 THEN 1 ELSE coalesce(runs, 0) END AS requests, CAST(720 AS BIGINT) AS expected, coalesce(missing_before, 0) AS missing_before, CAST(0 AS BIGINT) AS missing_after, coalesce(missing_before, 0) AS inserted
FROM (SELECT DISTINCT workload_id FROM hourly) s LEFT JOIN n USING (workload_id)""")
def repair_report(spark, sf_dir):
    rows = sparse(spark, sf_dir)

    def ask(plan: DataFrame) -> DataFrame:
        places = plan.withColumn("place", F.explode(F.sequence("first", "last")))
        return places.select(*SERIES, F.timestamp_seconds(F.unix_seconds(ts(START)) + F.col("place") * HOUR).alias("observed_at"), F.lit(123.0).alias("value"))

    return shown(repair.repair(rows, rows.select("cluster_id", *SERIES).distinct(), START, END, HOUR, ask)[1].drop("failed_parts"))


@query(MISSING_SQL + """, r AS (SELECT *, place - row_number() OVER (PARTITION BY workload_id ORDER BY place) AS run FROM missing
), p AS (SELECT workload_id, min(place) AS first, count(*) AS n, row_number() OVER (PARTITION BY workload_id ORDER BY min(place)) AS part, count(*) OVER (PARTITION BY workload_id) AS parts FROM r GROUP BY workload_id, run
), a AS (SELECT workload_id, sum(n) AS missing_before, least(40, any_value(parts)) AS requests, coalesce(sum(CASE WHEN part <= 40 AND first % 3 <> 0 THEN n END), 0) AS inserted, count(CASE WHEN part <= 40 AND first % 3 = 0 THEN 1 END) AS failed_parts FROM p GROUP BY 1)
SELECT s.workload_id, coalesce(requests, 0) AS requests, CAST(720 AS BIGINT) AS expected, CAST(coalesce(missing_before, 0) AS BIGINT) AS missing_before, CAST(coalesce(missing_before - inserted, 0) AS BIGINT) AS missing_after, CAST(coalesce(inserted, 0) AS BIGINT) AS inserted, coalesce(failed_parts, 0) AS failed_parts
FROM (SELECT DISTINCT workload_id FROM hourly) s LEFT JOIN a USING (workload_id)""")
def partial_repair(spark, sf_dir):
    """A repair of 40 requests a series from a source that answers some parts wrongly: what is good is kept. Each run is a part, whatever their number; a series has 720 slots."""
    rows = sparse(spark, sf_dir)

    def ask(plan: DataFrame) -> DataFrame:
        places = plan.withColumn("place", F.explode(F.sequence("first", "last")))
        value = F.when((F.col("place") == F.col("first")) & (F.col("first") % 3 == 0), -1.0).otherwise(5.0)
        return places.select(*SERIES, F.timestamp_seconds(F.unix_seconds(ts(START)) + F.col("place") * HOUR).alias("observed_at"), value.alias("value"))

    return shown(repair.repair(rows, rows.select("cluster_id", *SERIES).distinct(), START, END, HOUR, ask, repair.RepairLimits(requests=40, runs=720))[1])


@query("""
WITH w AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS start_s, CAST(epoch(o_orderdate) AS BIGINT) + 86400 * CAST(1 + o_orderkey % 90 AS BIGINT) AS end_s, CAST(60 AS BIGINT) AS interval_s FROM orders
), c AS (SELECT *, unnest(generate_series(0, greatest(CAST(ceil((end_s - start_s) / (interval_s * 9999.0)) AS BIGINT), 1) - 1)) AS chunk FROM w)
SELECT o_orderkey, chunk, start_s + chunk * interval_s * 9999 AS first_s, least(end_s, start_s + (chunk + 1) * interval_s * 9999) AS last_s FROM c""")
def query_chunks(spark, sf_dir):
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    windows = table(spark, sf_dir, "orders").select("o_orderkey", start.alias("start_s"), (start + 86400 * (1 + F.col("o_orderkey") % 90)).alias("end_s"), F.lit(60).cast("long").alias("interval_s"))
    return repair.query_chunks(windows).select("o_orderkey", "chunk", "first_s", "last_s")


@query(f"""WITH {SERIES_SQL}, a AS (SELECT workload_id, max(observed_at) AS newest FROM hourly WHERE observed_at < TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1)
SELECT workload_id, newest, greatest(TIMESTAMP '2024-01-20 00:00:00', newest + INTERVAL 1 HOUR) AS recover_from, TIMESTAMP '2024-01-21 00:00:00' AS recover_to FROM a""")
def recovery_range(spark, sf_dir):
    newest = sparse(spark, sf_dir).where(F.col("observed_at") < ts("2024-01-20 12:00:00")).groupBy(*SERIES).agg(F.max("observed_at").alias("newest"))
    return shown(repair.recovery_range(newest, ts("2024-01-21 00:00:00"), 24 * HOUR, HOUR))

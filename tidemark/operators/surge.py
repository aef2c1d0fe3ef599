"""Surge detection on real, contiguous rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import nearest_rank
from tidemark.operators.quality import ordered
from tidemark.schema import SERIES

#: Rows of the recent baseline; minutes ahead where a contract gives none.
BASELINE_ROWS, LEAD_MINUTES = 5, 2.0


@dataclass(frozen=True)
class SurgePolicy:
    """Thresholds; values that can't hold give way to the defaults."""

    slope_multiplier: float = 3.0
    baseline_multiplier: float = 1.5
    confirmations: int = 2
    most_multiplier: float = 1.5

    def __post_init__(self):
        for name, least, default in (("slope_multiplier", 1, 3.0), ("baseline_multiplier", 1, 1.5), ("most_multiplier", 1, 1.5)):
            if getattr(self, name) <= least:
                object.__setattr__(self, name, default)
        if self.confirmations < 1:
            object.__setattr__(self, "confirmations", 2)


def lead_minutes(startup_s: Column, buffer_s: Column) -> Column:
    """Minutes until a new replica helps: start-up and buffer, or the default."""
    total = startup_s + buffer_s
    return F.when(total > 0, total / 60).otherwise(F.lit(LEAD_MINUTES))


def is_candidate(value: Column, baseline: Column, slope: Column, p95: Column, policy: SurgePolicy) -> Column:
    """Grows, both against the history of slopes and against the recent baseline."""
    steep = (p95 <= 0) | (slope >= p95 * policy.slope_multiplier)
    return (slope > 0) & (baseline > 0) & steep & (value >= baseline * policy.baseline_multiplier)


def projected(value: Column, slope: Column, lead: Column, policy: SurgePolicy) -> Column:
    """Demand after the lead time at this slope, no more than the policy's multiple of the value."""
    return F.least(value + F.greatest(F.lit(0.0), slope) * lead, value * policy.most_multiplier)


def slope_quantile(suffix: DataFrame, interval_s: int, confirmations: int = 2, q: float = 0.95) -> DataFrame:
    """Per series the nearest-rank quantile of its slopes a minute, without those of the last ``confirmations`` rows."""
    back = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.col("observed_at").desc()))
    slope = (F.col("observed_value") - F.lag("observed_value").over(ordered())) / (interval_s / 60)
    rows = suffix.select(*SERIES, "observed_at", "observed_value").withColumn("slope", slope).withColumn("back", back)
    slopes = rows.groupBy(*SERIES).agg(F.collect_list(F.when(F.col("back") > confirmations, F.col("slope"))).alias("slopes"))
    return slopes.select(*SERIES, nearest_rank(F.col("slopes"), q).alias("slope_p95"))


def surges(suffix: DataFrame, interval_s: int, leads: DataFrame, policy: SurgePolicy = SurgePolicy()) -> DataFrame:
    """Per series: triggered, projected demand (0 if not), and the signals of its last row.

    ``suffix`` holds the latest contiguous real rows, ``leads`` the series'
    ``lead_minutes``. All of the last rows that confirm must be candidates.
    """
    w, back = ordered(), F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.col("observed_at").desc()))
    k = policy.confirmations
    rows = suffix.select(*SERIES, "observed_at", "observed_value").withColumns({
        "slope": (F.col("observed_value") - F.lag("observed_value").over(w)) / (interval_s / 60),
        "baseline": F.avg("observed_value").over(w.rowsBetween(-BASELINE_ROWS, -1)),
        "back": back,
        "rows": F.count("*").over(Window.partitionBy(*SERIES)),
    })
    recent = F.col("back") <= k
    out = rows.groupBy(*SERIES).agg(
        F.collect_list(F.when(~recent, F.col("slope"))).alias("slopes"), F.array_sort(F.collect_list(F.when(recent, F.struct("back", "observed_value", "slope", "baseline")))).alias("last"), F.max("rows").alias("rows")
    )
    out = out.withColumn("slope_p95", nearest_rank(F.col("slopes"), 0.95))
    candidate = lambda x: F.coalesce(is_candidate(x["observed_value"], x["baseline"], x["slope"], F.col("slope_p95"), policy), F.lit(False))
    at_end = lambda c: F.get("last", F.lit(0))[c]
    out = out.withColumns({"confirmed": F.forall("last", candidate), "value": at_end("observed_value"), "slope": at_end("slope"), "baseline": at_end("baseline")}).drop("slopes", "last")
    triggered = F.col("confirmed") & (F.col("rows") >= k + BASELINE_ROWS)
    out = out.join(leads.select(*SERIES, "lead_minutes"), SERIES, "left").withColumn("lead_minutes", F.coalesce("lead_minutes", F.lit(LEAD_MINUTES)))
    out = out.withColumn("triggered", triggered & (F.col("lead_minutes") > 0))
    demand = F.when(F.col("triggered"), projected(F.col("value"), F.col("slope"), F.col("lead_minutes"), policy)).otherwise(0.0)
    return out.select(*SERIES, "triggered", demand.alias("demand"), "value", "slope", "baseline", "slope_p95")


def surge_of(suffix: Column, lead: Column, policy: SurgePolicy = SurgePolicy()) -> Column:
    """struct(triggered, demand) of a series' latest contiguous real rows, an array of (observed_at, observed_value, slope, baseline) in order: what ``surges`` finds."""
    k, n = policy.confirmations, F.size(suffix)
    slopes = F.filter(F.transform(F.slice(suffix, F.lit(1), F.greatest(n - k, F.lit(0))), lambda x: x["slope"]), lambda x: x.isNotNull())
    last = F.slice(suffix, F.greatest(n - k + 1, F.lit(1)), F.lit(k))
    enough = (n >= k + BASELINE_ROWS) & (lead > 0)

    def found(p95: Column) -> Column:
        candidate = lambda x: F.coalesce(is_candidate(x["observed_value"], x["baseline"], x["slope"], p95, policy), F.lit(False))
        newest = F.element_at(last, -1)
        triggered = enough & F.forall(last, candidate)
        return F.struct(triggered.alias("triggered"), F.when(triggered, projected(newest["observed_value"], newest["slope"], lead, policy)).otherwise(0.0).alias("demand"))

    return F.when(n > 0, F.transform(F.array(nearest_rank(slopes, 0.95)), found)[0])

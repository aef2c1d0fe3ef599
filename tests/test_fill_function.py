"""The gap filler from SQL against the table operator."""

import math
import random

import pytest
from pyspark.errors import AnalysisException

from tests.helpers import series
from tidemark.operators.fill import bounded_fill
from tidemark.operators.fill_function import register


def called(spark, df, *settings):
    register(spark)
    return spark.sql(f"SELECT * FROM bounded_fill(TABLE({{df}}), {', '.join(map(str, settings))})", df=df)


def plain(df):
    show = lambda v: None if v is None else "nan" if math.isnan(v) else round(v, 9)
    rows = df.select("workload_id", "observed_at", "observed_value", "is_estimated", "used_suffix", "estimated_count", "status").collect()
    return sorted((r.workload_id, r.observed_at, show(r.observed_value), *r[3:]) for r in rows)


def many(spark, seed):
    rng, out = random.Random(seed), None
    for name in "abcdef":
        values = rng.choice([[10], [10, 10.5, 11], [10, 20], [5, 5, 5, 5, -1], [5] * 40 + [float("nan")], [5] * 40 + [float("inf")]])
        places = sorted(rng.sample(range(130), rng.choice([1, 20, 100, 122, 127])))
        points = [(k + rng.choice([0, 0, 0, 0.2, 0.4]), rng.choice(values)) for k in places]
        df = series(spark, points, name)
        out = df if out is None else out.unionByName(df)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_function_is_the_operator(spark, seed):
    df = many(spark, seed)
    for gap, look in ((300, 0), (300, 30), (120, 61)):
        assert plain(called(spark, df, 60, gap, look)) == plain(bounded_fill(df, 60, gap, look))


def test_repeats_nulls_defaults_and_empty_tables(spark):
    twice = series(spark, [(0, 1), (0, 2), (1, 2)])
    assert {r.status for r in called(spark, twice, 60).collect()} == {"not_ordered"}
    holes = series(spark, [1, 2, 3, 4]).selectExpr("* except (observed_value)", "nullif(observed_value, 3) AS observed_value", "'x' AS status")
    assert {r.status for r in called(spark, holes, 60).collect()} == {"invalid_value"}
    timeless = series(spark, [1, 2, 3]).selectExpr("* except (observed_at)", "CASE WHEN observed_value > 1 THEN observed_at END AS observed_at")
    assert called(spark, timeless, 60).count() == 2
    assert called(spark, twice.limit(0), 60).count() == 0
    named = spark.sql("SELECT * FROM bounded_fill(TABLE({df}), interval_s => 60, lookback => 2)", df=series(spark, [1, 2, 3]))
    assert [r.observed_value for r in named.orderBy("observed_at").collect()] == [2, 3]


def test_bad_calls_fail_when_planned(spark):
    df = series(spark, [1, 2])
    for bad, settings in ((df.drop("observed_value"), (60,)), (df, (0,)), (df, ("'60'",)), (df, (60, 300, -1)), (df.withColumnRenamed("workload_id", "w"), (60,))):
        with pytest.raises(AnalysisException, match="bounded_fill"):
            called(spark, bad, *settings)


def test_one_exchange_by_series(spark):
    plan = called(spark, series(spark, [1, 2]), 60)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1

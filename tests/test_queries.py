"""Every query with SQL against that SQL, and every query's schema."""

import datetime as dt
import decimal

import duckdb
import pytest

from tidemark.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.isoformat() if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted(str([plain(r[p]) for p in places]) for r in cursor.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_filters_and_prune(spark):
    text = QUERIES["window_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double" in text and "IsNotNull(ts)" in text
    assert "Cartesian" not in QUERIES["matured_error"](spark, SF)._jdf.queryExecution().executedPlan().toString()

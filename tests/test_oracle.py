"""Every registered query against its SQL oracle (DuckDB) on sf0.001."""
import decimal

import duckdb
import pytest

from conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return v.normalize()
    if isinstance(v, float):
        return round(v, 9)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(repr(_norm(r[i])) for i in order) for r in rows))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _names():
    from stocksmith.plans.catalog import oracle_sql
    return sorted(oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    df = queries()[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(oracle_sql()[name])
    cols = [d[0] for d in res.description]
    exp = res.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(exp)
    assert _rows(df.columns, got) == _rows(cols, exp)


def test_every_query_has_an_oracle(spark):
    from stocksmith.plans.catalog import oracle_sql, queries
    assert set(queries()) == set(oracle_sql())


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["period", "total_orders", "total_revenue", "avg_order_value", "delivered_orders",
                          "cancelled_orders"]
    assert df.count() > 0

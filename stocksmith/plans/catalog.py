"""Registry of named queries and their independent SQL oracles.

Each entry is a callable ``(spark, sf_dir) -> DataFrame`` that builds the
domain tables from the test folder and runs one operator of the library over
all of it, plus (where SQL can state it) the same result in plain SQL over
the test tables, with the mapping of :mod:`stocksmith.sources.fixture_sql`
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixture_sql import with_fixtures
from ..sources.fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_fixtures(sql)
        return fn
    return deco


# SQL spellings of the exact money helpers of functions/money.py
def CENTS(x: str) -> str:
    return f"cast(({x}) * 100 as hugeint)"


def HALF_UP(num: str, den: str) -> str:
    return f"(case when ({den}) > 0 then (2 * cast({num} as hugeint) + ({den})) // (2 * cast({den} as hugeint)) end)"


def FROM_CENTS(c: str) -> str:
    return f"cast(cast({c} as decimal(38,0)) * 0.01 as decimal(18,2))"


def LINE_TOTAL(q: str = "quantity", p: str = "unit_price") -> str:
    return f"cast(cast({q} as decimal(10,0)) * {p} as decimal(18,2))"


def _load_all() -> None:
    from . import queries_read  # noqa: F401  (registers on import)
    from . import queries_write  # noqa: F401
    from . import queries_log  # noqa: F401
    from . import queries_deltas  # noqa: F401
    from . import queries_index  # noqa: F401
    from . import queries_stream  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLES)


def materialize(df: DataFrame) -> None:
    """Run a query to the end without bringing rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


__all__ = ["register", "queries", "oracle_sql", "materialize"]

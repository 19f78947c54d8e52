"""Sorting, paging and top-k (G1, G2, G5, G6; A6).

A page is ``orderBy(...).offset(o).limit(n)``: Spark plans it as a
``TakeOrderedAndProject`` that keeps only ``o + n`` rows per task, so no full
sort is shuffled.  Deep pages should use :func:`keyset_page`, which filters on
the last key seen instead of ranking every skipped row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _check(page: int, limit: int) -> None:
    if int(limit) < 1 or int(page) < 1:
        raise ValueError("page and limit must be >= 1")


def page(df: DataFrame, order: list[Column], page_no: int = 1, limit: int = 20) -> DataFrame:   # G1
    _check(page_no, limit)
    off = (int(page_no) - 1) * int(limit)
    out = df.orderBy(*order)
    if off:
        out = out.offset(off)
    return out.limit(int(limit))


def page_summary(total: DataFrame, page_no: int, limit: int, total_col: str = "total") -> DataFrame:   # G2, A6
    """One row: total, page, limit, total_pages = ceil(total / limit)."""
    _check(page_no, limit)
    t = F.col(total_col)
    return total.select(t.cast("bigint").alias("total"), F.lit(int(page_no)).alias("page"),
                        F.lit(int(limit)).alias("limit"),
                        F.ceil(t / F.lit(int(limit))).cast("bigint").alias("total_pages"))


def keyset_page(df: DataFrame, keys: list[tuple[str, bool]], after: tuple | None, limit: int) -> DataFrame:   # G5
    """The ``limit`` rows that follow ``after`` in the order of ``keys``
    ((column, ascending) pairs; the last key must be unique).  NULL keys sort as in the
    other lists: last when ascending, first when descending."""
    if int(limit) < 1:
        raise ValueError("limit must be >= 1")
    order = [F.col(c).asc_nulls_last() if a else F.col(c).desc_nulls_first() for c, a in keys]
    if after is not None:
        conds = []
        for i, (c, a) in enumerate(keys):
            eq = [F.col(k).eqNullSafe(F.lit(v)) for (k, _), v in zip(keys[:i], after[:i])]
            if a:
                beyond = F.lit(False) if after[i] is None else F.col(c).isNull() | (F.col(c) > F.lit(after[i]))
            else:
                beyond = F.col(c).isNotNull() if after[i] is None else F.col(c) < F.lit(after[i])
            conds.append(reduce(lambda x, y: x & y, eq + [beyond]))
        df = df.filter(reduce(lambda x, y: x | y, conds))
    return df.orderBy(*order).limit(int(limit))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:                       # G6
    if int(k) < 1:
        raise ValueError("k must be >= 1")
    return df.orderBy(*order).limit(int(k))

"""Exact money arithmetic.

Money is DECIMAL(10,2) in the tables.  Sums stay decimal; averages and
shares are computed on integer cents in DECIMAL(38,0) and rounded half-up
with integer division, so every engine gives the same digits.  (Averaging
doubles does not: two engines differed by a cent on real rows.)
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

OUT = "decimal(18,2)"


def cents(col: Column) -> Column:
    """Exact number of cents of a DECIMAL(*,2) value, as DECIMAL(38,0)."""
    return (col * 100).cast("decimal(38,0)")


def half_up_div(num: Column, den: Column) -> Column:
    """round(num / den) half-up for num >= 0, den > 0; NULL if den is 0."""
    num = num.cast("decimal(38,0)")
    den = den.cast("decimal(38,0)")
    return F.when(den > 0, F.call_function("div", (num * 2 + den).cast("decimal(38,0)"),
                                           (den * 2).cast("decimal(38,0)")))


def from_cents(c: Column) -> Column:
    return (c.cast("decimal(38,0)") * F.lit(Decimal("0.01"))).cast(OUT)


def money(col: Column) -> Column:
    return col.cast(OUT)


def avg_money(sum_cents: Column, n: Column) -> Column:
    """Average of money values from their cent sum and count, 2 dp half-up."""
    return from_cents(half_up_div(sum_cents, n))


def pct_of(part_cents: Column, total_cents: Column) -> Column:
    """100 * part / total with 2 dp, half-up (part, total >= 0)."""
    return from_cents(half_up_div(part_cents.cast("decimal(38,0)") * 10000, total_cents))

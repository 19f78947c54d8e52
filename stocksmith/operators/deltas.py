"""Reports R2, R3, R4 and the orders' part of R6, kept up by changes.

Each of these reports is a finish (top-k, averages, shares) over sums per key.
The sums of a table are kept as a small *state*; a batch of changed orders adds the
sums of its rows as they are after the change and takes away those of the same rows
before it, so a cancelled, patched or deleted order is retracted exactly.
A batch shuffles its own rows and the state, never the orders.  The state
holds every key, not the k best, so a product that falls out of the top-k
by a retraction is replaced by the right one.

A batch is two tables with the columns of orders: ``before`` (rows that were changed or
deleted, as they were) and ``after`` (rows that were changed or inserted, as they are).
An order that is in both with equal values cancels out.  Null users and null times
are keys like any other, as in the reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import money as M
from ..plans import reports

#: Key and sums of each state; the first sum counts rows, and a key is dropped when it is 0.
STATES = {
    "sales": ("period", ["total_orders", "_rev_cents", "_rev_n", "delivered_orders", "cancelled_orders"]),
    "customers": ("user_id", ["total_orders", "completed_orders", "_ltv_cents", "_ltv_n"]),
    "statuses": ("status", ["total_orders", "_cents"]),
    "products": ("product_id", ["lines", "total_sold", "_cents"]),
}


def images(before: DataFrame, after: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The rows of a table before and after a job, for the keys that it changed."""
    ids = ids.select(F.col(ids.columns[0]).alias(key))
    return before.join(ids, key, "left_semi"), after.join(ids, key, "left_semi")


def _signed(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    columns = ["id", "user_id", "status", "total_amount", "created_at"]
    parts = [df.select(*columns, F.lit(sign).alias("_sign")) for df, sign in ((before, -1), (after, 1)) if df is not None]
    if not parts:
        raise ValueError("a batch needs rows before or after")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _count(when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, F.col("_sign"))), F.lit(0)).cast("bigint")


def _cents(value: Column, when: Column) -> Column:
    cents = M.cents(value)
    return F.coalesce(F.sum(F.when(when, F.when(F.col("_sign") < 0, -cents).otherwise(cents))), F.lit(0)).cast("decimal(38,0)")


def delta(name: str, before: DataFrame | None, after: DataFrame | None, items: DataFrame | None = None) -> DataFrame:
    """What a batch adds to the state ``name``.

    ``items`` (for ``products``): the items of the batch's orders; of a deleted
    order, as they were.  Only orders that begin or cease to be revenue meet their items."""
    rows = _signed(before, after)
    revenue, every = reports.REVENUE(), F.lit(True)
    paid = revenue & F.col("total_amount").isNotNull()
    if name == "sales":
        return rows.groupBy(F.to_date("created_at").alias("period")).agg(
            _count(every).alias("total_orders"), _cents(F.col("total_amount"), revenue).alias("_rev_cents"), _count(paid).alias("_rev_n"),
            _count(F.col("status") == "delivered").alias("delivered_orders"), _count(F.col("status") == "cancelled").alias("cancelled_orders"))
    if name == "customers":
        return rows.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
            _count(every).alias("total_orders"), _count(F.col("status") == "delivered").alias("completed_orders"),
            _cents(F.col("total_amount"), revenue).alias("_ltv_cents"), _count(paid).alias("_ltv_n"))
    if name == "statuses":
        return rows.groupBy("status").agg(_count(every).alias("total_orders"), _cents(F.col("total_amount"), every).alias("_cents"))
    if name != "products":
        raise ValueError(f"no such state: {name}")
    flips = rows.where(revenue).groupBy(F.col("id").alias("order_id")).agg(F.sum("_sign").alias("_sign")).where(F.col("_sign") != 0)
    sold = items.join(flips, "order_id")
    return sold.groupBy("product_id").agg(
        _count(every).alias("lines"), F.coalesce(F.sum(F.col("_sign") * F.col("quantity")), F.lit(0)).cast("bigint").alias("total_sold"),
        _cents(C.line_total(), every).alias("_cents"))


def initial(name: str, orders: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """The state of a whole table."""
    return delta(name, None, orders, items)


def merge(name: str, state: DataFrame, change: DataFrame) -> DataFrame:
    """The state with a batch's change added; keys without rows left are dropped."""
    key, sums = STATES[name]
    types = dict(state.dtypes)
    both = state.unionByName(change).groupBy(key).agg(*(F.sum(c).cast(types[c]).alias(c) for c in sums))
    return both.where(F.col(sums[0]) != 0)


def sales_summary(state: DataFrame, period: str = "month", last: int = 12) -> DataFrame:           # R3
    """R3 from the state ``sales``, which is by day."""
    if period not in ("day", "week", "month"):
        raise ValueError("period must be day, week or month")
    key, sums = STATES["sales"]
    by = state.groupBy(F.to_date(F.date_trunc(period, F.col(key).cast("timestamp_ntz"))).alias(key)).agg(*(F.sum(c).alias(c) for c in sums))
    return reports.finish_sales(by, last)


def customer_analytics(state: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:               # R4
    """R4 from the state ``customers``."""
    return reports.finish_customers(state, users, n)


def top_products(state: DataFrame, products: DataFrame, categories: DataFrame, n: int = 10) -> DataFrame:   # R2
    """R2 from the state ``products``."""
    sold = state.select("product_id", "total_sold", M.from_cents(F.col("_cents")).alias("total_revenue"))
    return reports.rank_products(sold, products, categories, n)


def order_kpis(state: DataFrame) -> DataFrame:                                                       # R6
    """The orders' part of R6 from the state ``statuses``: one row."""
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("total_orders"))), F.lit(0)).cast("bigint")
    cents = F.coalesce(F.sum(F.when(reports.REVENUE(), F.col("_cents"))), F.lit(0)).cast("decimal(38,0)")
    status = lambda s: n(F.col("status") == s).alias(f"{s}_orders")
    return state.agg(n(F.lit(True)).alias("total_orders"), status("pending"), status("delivered"), status("cancelled"),
                     M.from_cents(cents).alias("total_revenue"), M.avg_money(cents, n(reports.REVENUE())).alias("avg_order_value"))

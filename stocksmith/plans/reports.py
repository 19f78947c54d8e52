"""Admin reports R1-R6.

Only R1 and R5 have their full query in the application; R2-R4 keep only
their output columns and titles, R6 only its name.  Choices made here are
marked [decision]:

* revenue, lifetime value and averages leave cancelled orders out (their
  stock is given back); order counts include them;
* money averages and shares are exact on integer cents, rounded half-up;
* ties are broken by id so every cut is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import money as M
from ..functions import predicates as P
from ..operators import paging
from ..operators import relations as R

def REVENUE():
    """Orders whose money counts as revenue [decision]: all but cancelled."""
    return F.col("status") != F.lit("cancelled")


def low_stock(products: DataFrame, categories: DataFrame) -> DataFrame:              # R1
    """Live products at or below their threshold, with their category and
    the units needed to reach it; lowest stock first (tie: id)."""
    p = products.filter(P.live() & P.low_stock())
    p = R.products_with_category(p, categories)
    return p.select("id", "name", "sku", "category_id", "category_name", "price", "stock_quantity",
                    "low_stock_threshold", C.units_needed()).orderBy(F.col("stock_quantity").asc(), F.col("id").asc())


def top_products(items: DataFrame, orders: DataFrame, products: DataFrame, categories: DataFrame,
                 n: int = 10) -> DataFrame:                                           # R2, W1, W2
    """Top products by units sold (non-cancelled orders), with their rank,
    revenue and share of all revenue.

    Items are aggregated per product before anything else (partial
    aggregation, so a hot product is combined map-side); only the top ``n``
    rows are joined to products and ranked, and the share divides by a
    scalar subquery total instead of an unpartitioned window."""
    live_orders = orders.filter(REVENUE()).select(F.col("id").alias("order_id"))
    sold = items.join(live_orders, "order_id", "left_semi")
    per_product = sold.groupBy("product_id").agg(
        F.sum("quantity").cast("bigint").alias("total_sold"),
        F.sum(C.line_total()).cast("decimal(18,2)").alias("total_revenue"))
    return rank_products(per_product, products, categories, n)


def rank_products(per_product: DataFrame, products: DataFrame, categories: DataFrame, n: int) -> DataFrame:
    """R2 from product_id, total_sold and total_revenue."""
    # all revenue as a sum over the products' sums: the subquery reads the
    # same exchange as the ranking, so items and orders are scanned once
    grand_cents = per_product.select(F.sum(M.cents(F.col("total_revenue")))).scalar()
    top = paging.top_k(per_product, [F.col("total_sold").desc(), F.col("total_revenue").desc(),
                                     F.col("product_id").asc()], n).withColumn("_grand", grand_cents)
    top = top.join(products.select(F.col("id").alias("product_id"), "name", "sku", "category_id"), "product_id", "left")
    top = R.products_with_category_ids(top, categories)
    rank = F.rank().over(Window.orderBy(F.col("total_sold").desc()))   # over the n cut rows only
    return top.select(F.col("product_id").alias("id"), rank.cast("bigint").alias("rank"), "name", "sku", "category_name",
                      "total_sold", "total_revenue",
                      M.pct_of(M.cents(F.col("total_revenue")), F.col("_grand")).alias("revenue_share_pct"))


def sales_summary(orders: DataFrame, period: str = "month", last: int = 12) -> DataFrame:   # R3
    """Orders per period bucket (day, week or month of created_at): count,
    revenue, average order value, delivered and cancelled counts; the
    ``last`` latest buckets, newest first."""
    if period not in ("day", "week", "month"):
        raise ValueError("period must be day, week or month")
    o = orders.withColumn("period", F.to_date(F.date_trunc(period, F.col("created_at"))))
    live_cents = F.when(REVENUE(), M.cents(F.col("total_amount")))
    agg = o.groupBy("period").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum(live_cents).alias("_rev_cents"),
        F.count(live_cents).alias("_rev_n"),
        C.status_count("delivered").alias("delivered_orders"),
        C.status_count("cancelled").alias("cancelled_orders"))
    return finish_sales(agg, last)


def finish_sales(agg: DataFrame, last: int) -> DataFrame:
    """R3 from the counts and cent sums of each period."""
    agg = agg.select("period", "total_orders",
                     M.from_cents(F.coalesce(F.col("_rev_cents"), F.lit(0))).alias("total_revenue"),
                     M.avg_money(F.col("_rev_cents"), F.col("_rev_n")).alias("avg_order_value"),
                     "delivered_orders", "cancelled_orders")
    return paging.top_k(agg, [F.col("period").desc_nulls_last()], last)


def customer_analytics(orders: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:   # R4
    """Top customers by lifetime value (non-cancelled order totals).
    Orders are aggregated per user first (map-side combine), users that no longer
    exist drop out by a semi-join on the id (as in the order list), and only
    the top ``n`` fetch their names."""
    live_cents = F.when(REVENUE(), M.cents(F.col("total_amount")))
    per_user = orders.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        C.status_count("delivered").alias("completed_orders"),
        F.sum(live_cents).alias("_ltv_cents"),
        F.count(live_cents).alias("_ltv_n"))
    return finish_customers(per_user, users, n)


def finish_customers(per_user: DataFrame, users: DataFrame, n: int) -> DataFrame:
    """R4 from the counts and cent sums of each user."""
    j = per_user.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    j = j.select("user_id", "total_orders", "completed_orders",
                 M.from_cents(F.coalesce(F.col("_ltv_cents"), F.lit(0))).alias("lifetime_value"),
                 M.avg_money(F.col("_ltv_cents"), F.col("_ltv_n")).alias("avg_order_value"))
    order = [F.col("lifetime_value").desc(), F.col("user_id").asc()]
    u = users.select(F.col("id").alias("user_id"), F.col("name").alias("customer_name"), "email")
    top = paging.top_k(j, order, n).join(u, "user_id", "inner")
    return top.select("user_id", "customer_name", "email", "total_orders", "completed_orders", "lifetime_value",
                      "avg_order_value").orderBy(*order)


def AUDIT_ORDER():
    """Newest first; the rest only makes the order total, for stable pages."""
    return [F.col("changed_at").desc_nulls_first(), F.col("product_id").asc(), F.col("ref_id").asc(),
            F.col("line_no").asc(), F.col("reason").asc()]


def audit_log(audit: DataFrame, products: DataFrame, users: DataFrame, product_id=None,
              page: int = 1, limit: int = 20) -> tuple[DataFrame, DataFrame]:        # R5
    """One page of the audit log with product and user names, newest first,
    and its page summary.  The count skips the joins it does not need: the
    inner join to products only drops rows with a NULL product.  The
    per-product log exists only for a live product (else it is empty)."""
    a = audit.filter(P.audit_filter(product_id))
    if product_id:
        live = products.filter(P.live() & (F.col("id") == F.lit(int(product_id)))).select(
            F.col("id").alias("product_id"))
        a = a.join(live, "product_id", "left_semi")
    # rows whose product is gone drop out by id; only the page fetches names
    known = a.join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    rows = R.audit_with_names(paging.page(known, AUDIT_ORDER(), page, limit), products, users).orderBy(*AUDIT_ORDER())
    total = R.count_matching(a, F.col("product_id").isNotNull())
    return rows, paging.page_summary(total, page, limit)


def dashboard_kpis(products: DataFrame, categories: DataFrame, users: DataFrame,
                   orders: DataFrame) -> DataFrame:                                  # R6
    """One row of headline numbers [decision: the application keeps only the
    report's name].  One aggregate per table; the one-row results are
    combined by union + max, without a join."""
    live = P.live()
    prod = products.agg(
        F.count_if(live).alias("active_products"),
        F.count_if(live & P.low_stock()).alias("low_stock_products"),
        F.count_if(live & (F.col("stock_quantity") <= 0)).alias("out_of_stock_products"),
        M.from_cents(F.coalesce(F.sum(F.when(live, M.cents(F.col("price") * F.col("stock_quantity")))), F.lit(0)))
        .alias("inventory_value"))
    cats = categories.agg(F.count(F.lit(1)).alias("categories"))
    cust = users.agg(F.count_if(F.col("role") == "user").alias("customers"))
    live_cents = F.when(REVENUE(), M.cents(F.col("total_amount")))
    ords = orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        C.status_count("pending").alias("pending_orders"),
        C.status_count("delivered").alias("delivered_orders"),
        C.status_count("cancelled").alias("cancelled_orders"),
        M.from_cents(F.coalesce(F.sum(live_cents), F.lit(0))).alias("total_revenue"),
        M.avg_money(F.sum(live_cents), F.count(live_cents)).alias("avg_order_value"))
    parts = [prod, cats, cust, ords]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    cols = [c for p in parts for c in p.columns]
    return u.agg(*[F.max(c).alias(c) for c in cols])

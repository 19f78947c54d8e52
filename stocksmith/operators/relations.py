"""Joins (J1-J8), aggregates (A1-A5) and windows (W3-W4) on domain tables.

Join strategy is left to Catalyst and AQE: dimension tables are broadcast
when their file size (static plan) or measured shuffle size (AQE) is under
the broadcast threshold, so nothing whose size grows with the data is
broadcast on faith.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import predicates as P
from ..sources import schemas as S
from . import audit, running

LEDGER_ORDER = ("changed_at", "ref_id", "line_no")


# ------------------------------------------------------------------ joins
def orders_with_customer(orders: DataFrame, users: DataFrame) -> DataFrame:          # J1
    u = users.select(F.col("id").alias("_uid"), F.col("name").alias("customer_name"),
                     F.col("email").alias("customer_email"))
    return orders.join(u, orders["user_id"] == u["_uid"], "inner").drop("_uid")


def products_with_category(products: DataFrame, categories: DataFrame) -> DataFrame:  # J2
    c = categories.select(F.col("id").alias("_cid"), F.col("name").alias("category_name"))
    return products.join(c, products["category_id"] == c["_cid"], "left").drop("_cid")


def items_with_product(items: DataFrame, products: DataFrame) -> DataFrame:          # J3
    """Items with their product; deleted products are kept (history)."""
    p = products.select(F.col("id").alias("_pid"), F.col("name").alias("product_name"), "sku",
                        F.col("description").alias("product_description"))
    return items.join(p, items["product_id"] == p["_pid"], "inner").drop("_pid")


def audit_with_names(audit: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:   # J4
    p = products.select(F.col("id").alias("_pid"), F.col("name").alias("product_name"), "sku")
    u = users.select(F.col("id").alias("_uid"), F.col("name").alias("changed_by_name"))
    out = audit.join(p, audit["product_id"] == p["_pid"], "inner").drop("_pid")
    return out.join(u, out["changed_by"] == u["_uid"], "left").drop("_uid")


ITEM_FIELDS = ("line_no", "product_id", "product_name", "sku", "product_description", "quantity", "unit_price")


def order_document(orders: DataFrame, users: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:   # J5
    """Each order with its customer, its item count and total, and its items:
    one row per item, keyed (id, line_no), whatever an order's size; an order without
    items has one row with NULL item fields and no total.  No group is
    collected, so a huge order is many small rows."""
    it = items_with_product(items, products).select("order_id", *ITEM_FIELDS, C.line_total().alias("_lt"))
    totals = it.groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count"),
                                        F.sum("_lt").cast("decimal(18,2)").alias("order_total"))
    head = orders_with_customer(orders, users)
    doc = head.join(totals, head["id"] == totals["order_id"], "left").drop("order_id")
    lines = it.drop("_lt")
    doc = doc.join(lines, doc["id"] == lines["order_id"], "left").drop("order_id")
    return doc.withColumn("item_count", F.coalesce("item_count", F.lit(0)))


def require(tables: dict[str, DataFrame], names) -> None:
    """A check over a table that was not given would pass unseen: refuse it."""
    missing = [n for n in names if n not in tables]
    if missing:
        raise ValueError(f"tables to check are missing: {', '.join(missing)}")


def fk_orphans(tables: dict[str, DataFrame], children: list[str] | None = None) -> DataFrame:   # J6
    """Rows whose non-NULL foreign key has no parent row, for every FK of
    ``children`` (default: all tables); they and their parents must be given."""
    children = list(S.TABLES) if children is None else children
    keys = [k for k in S.FOREIGN_KEYS if k[0] in children]
    require(tables, [*children, *(parent for _, _, parent, _ in keys)])
    parts = []
    for child, col, parent, _rule in keys:
        c = tables[child].select(F.col(col).cast("bigint").alias("fk_value")).filter(F.col("fk_value").isNotNull())
        p = tables[parent].select(F.col("id").cast("bigint").alias("fk_value"))
        parts.append(c.join(p, "fk_value", "left_anti")
                     .select(F.lit(child).alias("child_table"), F.lit(col).alias("fk_column"),
                             F.lit(parent).alias("parent_table"), "fk_value"))
    return reduce(DataFrame.unionByName, parts)


def sales_fact(items: DataFrame, orders: DataFrame, products: DataFrame,
               categories: DataFrame) -> DataFrame:                                  # J7
    o = orders.select(F.col("id").alias("order_id"), F.col("status").alias("order_status"),
                      F.col("user_id"), F.col("created_at").alias("ordered_at"))
    f = items.join(o, "order_id", "inner")
    p = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "sku",
                        "category_id")
    f = f.join(p, "product_id", "inner")
    f = products_with_category_ids(f, categories)
    return f.withColumn("line_total", C.line_total())


def products_with_category_ids(df: DataFrame, categories: DataFrame) -> DataFrame:
    c = categories.select(F.col("id").alias("_cid"), F.col("name").alias("category_name"))
    return df.join(c, df["category_id"] == c["_cid"], "left").drop("_cid")


def id_set_conflict(batch: DataFrame, table: DataFrame, key: str, keep: str = "conflicts") -> DataFrame:   # J8
    """Batch rows whose unique ``key`` already exists in ``table``
    (``keep='new'`` gives the others)."""
    existing = table.select(F.col(key)).filter(F.col(key).isNotNull())
    return batch.join(existing, key, "left_semi" if keep == "conflicts" else "left_anti")


def lookup(table: DataFrame, keys: DataFrame, key: str = "id", on: str | None = None,
           live_only: bool = False) -> DataFrame:                                   # F9
    """Rows of ``table`` whose ``key`` is in the key set (a semi-join; AQE
    broadcasts the key set when it is measured small)."""
    on = on or key
    t = table.filter(P.live()) if live_only else table
    k = keys.select(F.col(on).alias(key)).filter(F.col(key).isNotNull())
    return t.join(k, key, "left_semi")


# ------------------------------------------------------------------ aggregates
def count_matching(df: DataFrame, pred: Column) -> DataFrame:                        # A1
    return df.filter(pred).agg(F.count(F.lit(1)).alias("total"))


def order_totals(items: DataFrame, orders: DataFrame | None = None) -> DataFrame:   # A2
    """Per order: exact sum of quantity * unit price, and (if orders are
    given) the stored total and whether the two differ."""
    t = items.groupBy("order_id").agg(F.sum(C.line_total()).cast("decimal(18,2)").alias("items_total"),
                                      F.count(F.lit(1)).alias("item_count"))
    if orders is None:
        return t
    o = orders.select(F.col("id").alias("order_id"), F.col("total_amount").cast("decimal(18,2)").alias("stored_total"))
    t = t.join(o, "order_id", "left")
    return t.withColumn("total_mismatch", ~F.col("items_total").eqNullSafe(F.col("stored_total")))


def duplicate_products(items: DataFrame, order_col: str = "order_id") -> DataFrame:  # A3
    return (items.filter(F.col("product_id").isNotNull())
            .groupBy(order_col, F.col("product_id").cast("bigint").alias("product_id"))
            .agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > 1))


def unique_violations(tables: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:   # A4
    """Values of a primary or unique key held by more than one row, in the tables
    ``names`` (default: all that have keys), which must be given."""
    names = list(dict.fromkeys([*S.PRIMARY_KEYS, *S.UNIQUE_KEYS])) if names is None else names
    require(tables, names)
    return audit.violations(tables, audit.key_rules(names))


def low_stock_count(products: DataFrame) -> DataFrame:                               # A5
    return products.agg(F.count_if(P.live() & P.low_stock()).alias("low_stock_products"))


# ------------------------------------------------------------------ windows
def stock_ledger(movements: DataFrame, start: DataFrame | None = None,
                 hot_threshold: int | None = None) -> DataFrame:                       # W3
    """Audit rows from signed stock movements.

    ``movements``: product_id, changed_by, delta, reason, changed_at, ref_id,
    line_no.  ``start``: (product_id, stock_quantity) before the movements
    (rows without a product_id count for none), or None for 0.  Each row gets
    quantity_after = start + running sum of delta per product in (changed_at,
    ref_id, line_no) order, and quantity_before = quantity_after - delta.  Hot
    products are split by time and reference id (see :mod:`running`); the start
    is joined to the rows where they lie, after their only shuffle."""
    chunk = running.time_levels(F.col("changed_at"), F.col("ref_id"))
    hot = running.hot_levels(movements, ["product_id"], chunk, hot_threshold)
    order = [F.col(c) for c in LEDGER_ORDER]
    delta = F.col("delta").cast("bigint")
    if start is not None:
        start = start.filter(F.col("product_id").isNotNull())
    if start is None:
        led = running.running_sum(movements, ["product_id"], order, delta, "_after", chunk=chunk, hot=hot)
    elif not hot:
        had = start.groupBy("product_id").agg(F.sum(F.col("stock_quantity").cast("int")).alias("_start"))
        led = running.running_sum(movements, ["product_id"], order, delta, "_moved", chunk=chunk, hot=hot).join(had, "product_id", "left")
        led = led.withColumn("_after", F.coalesce(F.col("_start") + F.col("_moved"), F.col("_start"), F.col("_moved")))
    else:
        # the start is the first row of its product: it has no time, so it is in the product's first chunk
        base = start.select("product_id", F.col("stock_quantity").cast("int").alias("delta"), F.lit(0).alias("_phase"))
        rows = movements.withColumn("_phase", F.lit(1)).unionByName(base, allowMissingColumns=True)
        led = running.running_sum(rows, ["product_id"], [F.col("_phase"), *order], delta, "_after", chunk=chunk, hot=hot)
        led = led.filter(F.col("_phase") == 1)
    return led.select(
        "product_id", "changed_by",
        (F.col("_after") - F.col("delta")).cast("int").alias("quantity_before"),
        F.col("_after").cast("int").alias("quantity_after"),
        "reason", "changed_at", "ref_id", "line_no")


def audit_continuity(audit: DataFrame, hot_threshold: int | None = None) -> DataFrame:                   # W4
    """Audit rows whose quantity_before differs from the quantity_after of the
    product's previous row (stale reads in the application can write them)."""
    order = [F.col(c) for c in LEDGER_ORDER]
    a = running.previous_value(audit, ["product_id"], order, F.col("quantity_after"), "expected_before",
                               chunk=running.time_levels(F.col("changed_at"), F.col("ref_id")), threshold=hot_threshold)
    return a.filter(F.col("expected_before").isNotNull() & (F.col("quantity_before") != F.col("expected_before")))

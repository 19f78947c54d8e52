"""Registered read queries: sources, projections, filters, joins,
aggregates, windows, paging and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import predicates as P
from ..operators import paging
from ..operators import relations as R
from ..session import shared_path
from ..sources import fixtures as FX
from ..sources import schemas as S
from ..sources import tables as TB
from ..sources.schemas import REASON_ORDER_CANCELLED
from . import reports
from .catalog import CENTS, FROM_CENTS, HALF_UP, LINE_TOTAL, register
from .flaws import flawed, flawed_sql

# ---------------------------------------------------------------- S1 sources


@register("S1_users", "select id, name, email, role from f_users")
def s1_users(t):
    """Users mapped from customers (no password column is ever loaded)."""
    return t.users.select("id", "name", "email", "role")


@register("S1_load_tables", """
select 'users' as table_name, count(*) as rows, cast(sum(id) as bigint) as keys from f_users
union all select 'categories', count(*), cast(sum(id) as bigint) from f_categories
union all select 'products', count(*), cast(sum(id) as bigint) from f_products
union all select 'orders', count(*), cast(sum(id) as bigint) from f_orders
union all select 'order_items', count(*), cast(sum(order_id * 8 + line_no) as bigint) from f_order_items
union all select 'stock_audit_log', count(*), cast(sum(quantity_after) as bigint) from f_audit_log""")
def s1_load(t):
    """All six tables written as committed versions and loaded with their declared schemas."""
    root = shared_path(t.spark, "tables")
    for name, df in t.domain().items():
        columns = {c: df[c] for c in df.columns}
        TB.write_snapshot(df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.TABLES[name].fields]), root, name)
    key = {"order_items": F.col("order_id") * 8 + F.col("line_no"), "stock_audit_log": F.col("quantity_after")}
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), F.sum(key.get(n, F.col("id"))).cast("bigint").alias("keys"))
             .select(F.lit(n).alias("table_name"), "rows", "keys") for n, df in TB.load_tables(t.spark, root).items()]
    return reduce(DataFrame.unionByName, parts)


@register("S1_categories", "select id, name from f_categories")
def s1_categories(t):
    return t.categories.select("id", "name")


@register("S1_products", """
select id, category_id, name, description, price, stock_quantity, low_stock_threshold, sku, deleted_at, created_at
from f_products""")
def s1_products(t):
    return t.products.drop("updated_at")


@register("S1_orders", "select id, user_id, status, total_amount, created_at from f_orders")
def s1_orders(t):
    return t.orders.select("id", "user_id", "status", "total_amount", "created_at")


@register("W5_line_no", "select order_id, line_no, product_id, quantity, unit_price from f_order_items")
def w5_line_no(t):
    """Order items; line_no numbers each order's lines (skew-safe running count)."""
    return t.items


@register("W3_stock_ledger", """
select product_id, changed_by, quantity_before, quantity_after, reason, changed_at, ref_id, line_no from f_audit_log""")
def w3_stock_ledger(t):
    """Audit rows: running stock per product over all movements."""
    return t.audit


# The same three windows with the hot-key threshold forced low, so that
# almost every product (order) takes the chunked skew path on whole tables.
LEDGER_SQL = ("select product_id, changed_by, quantity_before, quantity_after, reason, changed_at, ref_id, line_no "
              "from f_audit_log")


@register("W3_stock_ledger_skew_path", LEDGER_SQL)
def w3_skew(t):
    """W3 with every product of more than 10 movements split by time and id."""
    return R.stock_ledger(t.movements, start=None, hot_threshold=10)


def _hot_product_movements(t):
    """Stand-in input with one hot product: every movement of a delivered
    order is booked on product 0 (about a third of all rows)."""
    delivered = t.orders.filter(F.col("status") == "delivered").select(F.col("id").alias("ref_id"),
                                                                       F.lit(True).alias("_hot"))
    mv = t.movements.join(delivered, "ref_id", "left")
    return mv.withColumn("product_id", F.when(F.col("_hot").isNotNull(), F.lit(0).cast("bigint"))
                         .otherwise(F.col("product_id"))).drop("_hot")


@register("W3_stock_ledger_hot_product", """
with mv as (select case when o.status = 'delivered' then cast(0 as bigint) else m.product_id end as product_id,
                   m.changed_by, m.delta, m.reason, m.changed_at, m.ref_id, m.line_no
            from f_stock_movements m left join f_orders o on m.ref_id = o.id)
select product_id, changed_by, cast(qa - delta as int) as quantity_before, cast(qa as int) as quantity_after, reason,
       changed_at, ref_id, line_no
from (select *, sum(delta) over (partition by product_id order by changed_at, ref_id, line_no
                                 rows between unbounded preceding and current row) as qa from mv) t""")
def w3_hot_product(t):
    """W3 when one product holds a third of all movements: the sampled
    detector (threshold 2,000 rows) finds it and splits it into minute
    chunks; every other product takes the plain window."""
    return R.stock_ledger(_hot_product_movements(t), start=None, hot_threshold=2000)


@register("W5_line_no_skew_path", "select order_id, line_no, product_id, quantity, unit_price from f_order_items")
def w5_skew(t):
    """W5 with every order of more than 3 lines split by line-number chunks."""
    return FX.order_items(t.spark, t.d, hot_threshold=3)


# ---------------------------------------------------------------- projections


@register("P1_public_users", "select id, name, email, role from f_users")
def p1_public_users(t):
    return t.users.select("id", "name", "email", "role")


@register("P2_units_needed", """
select id, stock_quantity, low_stock_threshold, low_stock_threshold - stock_quantity as units_needed from f_products""")
def p2_units_needed(t):
    return t.products.select("id", "stock_quantity", "low_stock_threshold", C.units_needed())


@register("P3_line_total", f"""
select order_id, line_no, quantity, unit_price, {LINE_TOTAL()} as line_total from f_order_items""")
def p3_line_total(t):
    return t.items.select("order_id", "line_no", "quantity", "unit_price", C.line_total().alias("line_total"))


@register("P4_stock_delta", """
select product_id, changed_at, ref_id, line_no, reason,
       quantity_after - quantity_before as delta,
       quantity_after - quantity_before > 0 as is_increase,
       case when quantity_after - quantity_before > 0 then '+' || cast(quantity_after - quantity_before as varchar)
            else cast(quantity_after - quantity_before as varchar) end as delta_text
from f_audit_log""")
def p4_stock_delta(t):
    return t.audit.select("product_id", "changed_at", "ref_id", "line_no", "reason", *C.stock_delta())


@register("P5_audit_labels", """
select a.product_id, a.changed_at, a.ref_id, a.line_no,
       coalesce(replace(nullif(a.reason, ''), '_', ' '), 'unknown') as reason_label,
       coalesce(nullif(u.name, ''), 'System') as actor_label,
       coalesce(nullif(p.name, ''), 'Product #' || cast(a.product_id as varchar)) as product_label
from f_audit_log a join f_products p on a.product_id = p.id left join f_users u on a.changed_by = u.id""")
def p5_audit_labels(t):
    j = R.audit_with_names(t.audit, t.products, t.users)
    return j.select("product_id", "changed_at", "ref_id", "line_no", *C.audit_labels())


@register("P6_next_status", """
select id, status,
       case status when 'pending' then 'confirmed' when 'confirmed' then 'packed' when 'packed' then 'shipped'
                   when 'shipped' then 'delivered' end as next_status,
       status in ('pending', 'confirmed') as can_cancel
from f_orders""")
def p6_next_status(t):
    return t.orders.select("id", "status", *C.next_status())


@register("P7_stock_state", """
select id, stock_quantity, low_stock_threshold,
       case when stock_quantity <= 0 then 'out' when stock_quantity <= low_stock_threshold then 'low' else 'ok' end
         as stock_state
from f_products""")
def p7_stock_state(t):
    return t.products.select("id", "stock_quantity", "low_stock_threshold", C.stock_state())


# ---------------------------------------------------------------- filters


@register("F1_live", "select id, name, sku from f_products where deleted_at is null")
def f1_live(t):
    return t.products.filter(P.live()).select("id", "name", "sku")


@register("F2_search", """
select id, name, sku from f_products where deleted_at is null and (name ilike '%ring%' or sku ilike '%ring%')""")
def f2_search(t):
    return t.products.filter(P.product_filter(search_text="ring")).select("id", "name", "sku")


@register("F2_search_wildcard", """
select id, name, sku from f_products
where deleted_at is null and (name ilike '%r_d%' or sku ilike '%r_d%')""")
def f2_search_wildcard(t):
    """'_' in the search text is a one-character wildcard, as in the application."""
    return t.products.filter(P.product_filter(search_text="r_d")).select("id", "name", "sku")


@register("F3_category", "select id, category_id from f_products where deleted_at is null and category_id = 3")
def f3_category(t):
    return t.products.filter(P.product_filter(category_id="3")).select("id", "category_id")


@register("F4_price_between", """
select id, price from f_products where deleted_at is null and price >= 925 and price <= 950.5""")
def f4_price_between(t):
    return t.products.filter(P.product_filter(min_price="925", max_price="950.5")).select("id", "price")


@register("F5_low_stock", """
select id, stock_quantity, low_stock_threshold from f_products
where deleted_at is null and stock_quantity <= low_stock_threshold""")
def f5_low_stock(t):
    return t.products.filter(P.product_filter(low_stock_opt="true")).select("id", "stock_quantity",
                                                                            "low_stock_threshold")


F6_OPTS = dict(search_text="e", category_id=5, min_price=0, max_price="990.5", low_stock_opt="1")
F6_WHERE = """deleted_at is null and (name ilike '%e%' or sku ilike '%e%') and category_id = 5
  and price >= 0 and price <= 990.5 and stock_quantity <= low_stock_threshold"""


@register("F6_conjunction", f"select id, name, price, stock_quantity from f_products where {F6_WHERE}")
def f6_conjunction(t):
    """All product-list options at once; a price bound of 0 counts as given."""
    return t.products.filter(P.product_filter(**F6_OPTS)).select("id", "name", "price", "stock_quantity")


@register("F7_order_filter", "select id, user_id, status from f_orders where status = 'shipped'")
def f7_order_filter(t):
    return t.orders.filter(P.order_filter(status="shipped")).select("id", "user_id", "status")


@register("F7_user_orders", """
select o.id, o.status, o.created_at, u.name as customer_name
from f_orders o join f_users u on o.user_id = u.id
where o.status = 'delivered' and o.user_id = (select min(user_id) from f_orders where status = 'delivered')
order by o.created_at desc nulls first, o.id limit 10""")
def f7_user_orders(t):
    """The first page of one user's delivered orders, newest first."""
    first = t.orders.filter(F.col("status") == "delivered").select(F.min("user_id")).scalar()
    mine = t.orders.filter(P.order_filter(status="delivered") & (F.col("user_id") == first))
    o = R.orders_with_customer(mine, t.users)
    return paging.page(o, P.sort_columns("created_at", False), 1, 10).select("id", "status", "created_at", "customer_name")


@register("F7_user_orders_total", """
select count(*) as total, 1 as page, 10 as "limit", cast(ceil(count(*) / 10.0) as bigint) as total_pages
from f_orders where status = 'shipped' and user_id = 10""")
def f7_user_orders_total(t):
    """Status and user together: the page summary of one user's shipped orders."""
    return paging.page_summary(R.count_matching(t.orders, P.order_filter(status="shipped", user_id=10)), 1, 10)


@register("F8_audit_filter", """
select product_id, changed_at, ref_id, line_no, quantity_before, quantity_after from f_audit_log where product_id = 7""")
def f8_audit_filter(t):
    return t.audit.filter(P.audit_filter(7)).select("product_id", "changed_at", "ref_id", "line_no",
                                                    "quantity_before", "quantity_after")


@register("F9_lookup", """
select id, name, sku from f_products
where deleted_at is null and id in (select i.product_id from f_order_items i join f_orders o on i.order_id = o.id
                                    where o.status = 'cancelled')""")
def f9_lookup(t):
    """Live products looked up by a key set: the products of cancelled orders."""
    keys = t.items.join(t.orders.filter(F.col("status") == "cancelled").select(F.col("id").alias("order_id")),
                        "order_id", "left_semi")
    return R.lookup(t.products, keys, key="id", on="product_id", live_only=True).select("id", "name", "sku")


@register("F9_lookup_users_by_email", """
select id, name, role from f_users where email in (select 'user' || cast(s_suppkey * 3 as varchar) || '@example.com' from supplier)""")
def f9_users(t):
    """Users looked up by a set of emails."""
    keys = t.raw("supplier").select(F.concat(F.lit("user"), (F.col("s_suppkey") * 3).cast("string"), F.lit("@example.com")).alias("email"))
    return R.lookup(t.users, keys, key="email").select("id", "name", "role")


@register("F9_lookup_categories_by_name", """
select id, name from f_categories where name in (select p_brand from part where p_size < 3)""")
def f9_categories(t):
    """Categories looked up by a set of names."""
    return R.lookup(t.categories, t.raw("part").filter("p_size < 3").select(F.col("p_brand").alias("name")), key="name").select("id", "name")


@register("F9_lookup_orders", """
select id, user_id, status from f_orders where id in (select order_id from f_order_items where quantity >= 49)""")
def f9_orders(t):
    """Orders looked up by the ids that large items name."""
    return R.lookup(t.orders, t.items.filter("quantity >= 49"), on="order_id").select("id", "user_id", "status")


@register("F9_lookup_users", """
select id, name, email from f_users where id in (select user_id from f_orders where status = 'pending')""")
def f9_users_by_id(t):
    """Users looked up by the ids that pending orders name."""
    return R.lookup(t.users, t.orders.filter("status = 'pending'"), on="user_id").select("id", "name", "email")


@register("F10_visible_to", "select id, user_id, status from f_orders where user_id = 10")
def f10_visible_to(t):
    """Orders a non-admin viewer (user 10) may see; an admin sees all."""
    return t.orders.filter(P.visible_to(10, "user")).select("id", "user_id", "status")


@register("F10_visible_to_admin", "select id, user_id, status from f_orders")
def f10_visible_to_admin(t):
    return t.orders.filter(P.visible_to(100, "admin")).select("id", "user_id", "status")


@register("F11_in_stock", "select id, stock_quantity from f_products where stock_quantity > 0")
def f11_in_stock(t):
    return t.products.filter(P.in_stock()).select("id", "stock_quantity")


# ---------------------------------------------------------------- joins


@register("J1_orders_with_customer", """
select o.id, o.user_id, o.status, o.total_amount, o.created_at, u.name as customer_name, u.email as customer_email
from f_orders o join f_users u on o.user_id = u.id""")
def j1(t):
    return R.orders_with_customer(t.orders, t.users).select("id", "user_id", "status", "total_amount", "created_at",
                                                            "customer_name", "customer_email")


@register("J2_products_with_category", """
select p.id, p.category_id, c.name as category_name from f_products p left join f_categories c on p.category_id = c.id""")
def j2(t):
    return R.products_with_category(t.products, t.categories).select("id", "category_id", "category_name")


@register("J3_items_with_product", """
select i.order_id, i.line_no, i.product_id, i.quantity, i.unit_price,
       p.name as product_name, p.sku, p.description as product_description
from f_order_items i join f_products p on i.product_id = p.id""")
def j3(t):
    return R.items_with_product(t.items, t.products)


@register("J4_audit_with_names", """
select a.product_id, a.changed_by, a.quantity_before, a.quantity_after, a.reason, a.changed_at, a.ref_id, a.line_no,
       p.name as product_name, p.sku, u.name as changed_by_name
from f_audit_log a join f_products p on a.product_id = p.id left join f_users u on a.changed_by = u.id""")
def j4(t):
    return R.audit_with_names(t.audit, t.products, t.users)


@register("J5_order_document", f"""
with it as (
  select i.order_id, i.line_no, i.product_id, p.name as product_name, p.sku, p.description as product_description,
         i.quantity, i.unit_price, {LINE_TOTAL('i.quantity', 'i.unit_price')} as lt
  from f_order_items i join f_products p on i.product_id = p.id)
select o.id, o.user_id, o.status, u.name as customer_name, it.line_no, it.product_id, it.product_name, it.sku,
       it.product_description, it.quantity, it.unit_price,
       (select count(*) from it x where x.order_id = o.id) as item_count,
       (select cast(sum(lt) as decimal(18,2)) from it x where x.order_id = o.id) as order_total
from f_orders o join f_users u on o.user_id = u.id left join it on it.order_id = o.id""")
def j5(t):
    """Order documents: header, total and count beside each item line."""
    doc = R.order_document(t.orders, t.users, t.items, t.products)
    return doc.select("id", "user_id", "status", "customer_name", *R.ITEM_FIELDS, "item_count", "order_total")


@register("J6_fk_orphans", """
select 'products' as child_table, 'category_id' as fk_column, 'categories' as parent_table,
       cast(category_id as bigint) as fk_value
from f_products where category_id is not null and category_id not in (select id from f_categories)
union all
select 'orders', 'user_id', 'users', user_id from f_orders
where user_id is not null and user_id not in (select id from f_users)
union all
select 'order_items', 'order_id', 'orders', order_id from f_order_items
where order_id is not null and order_id not in (select id from f_orders)
union all
select 'order_items', 'product_id', 'products', product_id from f_order_items
where product_id is not null and product_id not in (select id from f_products)
union all
select 'stock_audit_log', 'product_id', 'products', product_id from f_audit_log
where product_id is not null and product_id not in (select id from f_products)
union all
select 'stock_audit_log', 'changed_by', 'users', changed_by from f_audit_log
where changed_by is not null and changed_by not in (select id from f_users)""")
def j6(t):
    return R.fk_orphans(t.domain())


@register("J6_fk_orphans_raw_delete", """
select 'products' as child_table, 'category_id' as fk_column, 'categories' as parent_table,
       cast(category_id as bigint) as fk_value
from f_products where category_id is not null
  and category_id not in (select id from f_categories where id not in (select n_nationkey from nation
                                                                        where n_regionkey = 2))""")
def j6_raw_delete(t):
    """J6 after categories (region 2's nation keys) were removed by a plain
    anti-join, without the ON DELETE SET NULL rule: their products are
    orphans."""
    gone = t.raw("nation").filter(F.col("n_regionkey") == 2).select(F.col("n_nationkey").alias("id"))
    cats = t.categories.join(gone, "id", "left_anti")
    return R.fk_orphans({"products": t.products, "categories": cats}, ["products"])


@register("J7_sales_fact", f"""
select i.order_id, i.line_no, i.product_id, i.quantity, i.unit_price, o.status as order_status, o.user_id,
       o.created_at as ordered_at, p.name as product_name, p.sku, p.category_id, c.name as category_name,
       {LINE_TOTAL('i.quantity', 'i.unit_price')} as line_total
from f_order_items i join f_orders o on i.order_id = o.id join f_products p on i.product_id = p.id
left join f_categories c on p.category_id = c.id""")
def j7(t):
    return R.sales_fact(t.items, t.orders, t.products, t.categories)


def _supplier_products(t):
    """A batch of new products, one per supplier (stand-in input)."""
    s = t.raw("supplier")
    return s.select(F.concat(F.lit("SKU-"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 8, "0")).alias("sku"),
                    F.col("s_name").alias("name"))


SUPPLIER_BATCH = "select 'SKU-' || lpad(cast(s_suppkey * 3 as varchar), 8, '0') as sku, s_name as name from supplier"


@register("J8_id_set_conflict", f"""
select b.sku, b.name from ({SUPPLIER_BATCH}) b where b.sku in (select sku from f_products)""")
def j8(t):
    return R.id_set_conflict(_supplier_products(t), t.products, "sku")


# ---------------------------------------------------------------- aggregates


@register("A1_count_matching", f"select count(*) as total from f_products where {F6_WHERE}")
def a1(t):
    """The product-list count, without the category join the application keeps."""
    return R.count_matching(t.products, P.product_filter(**F6_OPTS))


@register("A2_order_totals", f"""
select i.order_id, cast(sum({LINE_TOTAL()}) as decimal(18,2)) as items_total, count(*) as item_count,
       cast(o.total_amount as decimal(18,2)) as stored_total,
       cast(sum({LINE_TOTAL()}) as decimal(18,2)) is distinct from cast(o.total_amount as decimal(18,2)) as total_mismatch
from f_order_items i left join f_orders o on i.order_id = o.id group by i.order_id, o.total_amount""")
def a2(t):
    return R.order_totals(t.items, t.orders)


@register("A3_duplicate_products", """
select order_id, product_id, count(*) as times from f_order_items where product_id is not null
group by order_id, product_id having count(*) > 1""")
def a3(t):
    return R.duplicate_products(t.items)


@register("A4_unique_violations", flawed_sql("""
select table_name, rule, key_columns, key_value, rows from broken where rule in ('primary_key', 'unique')"""))
def a4(t):
    """Key violations over all tables (each holds some rows twice)."""
    return R.unique_violations(flawed(t))


@register("A5_low_stock_count", """
select count(*) filter (where deleted_at is null and stock_quantity <= low_stock_threshold) as low_stock_products
from f_products""")
def a5(t):
    return R.low_stock_count(t.products)


@register("A6_page_count", """
select count(*) as total, 2 as page, 10 as "limit", cast(ceil(count(*) / 10.0) as bigint) as total_pages
from f_orders o join f_users u on o.user_id = u.id where o.status = 'pending'""")
def a6(t):
    """Page summary of the pending-order list (page 2, 10 per page).  The
    count keeps the users join: orders may name users that do not exist."""
    o = R.orders_with_customer(t.orders.filter(P.order_filter(status="pending")), t.users)
    return paging.page_summary(R.count_matching(o, F.lit(True)), 2, 10)


# ---------------------------------------------------------------- windows


def _stale_audit(t):
    """Audit rows as the application writes them when a cancelled order holds
    a deleted product: quantity_before falls back to the item quantity."""
    deleted = t.products.filter(F.col("deleted_at").isNotNull()).select(F.col("id").alias("product_id"))
    a = t.audit.join(deleted.withColumn("_del", F.lit(True)), "product_id", "left")
    stale = (F.col("reason") == REASON_ORDER_CANCELLED) & F.col("_del").isNotNull()
    return a.withColumn("quantity_before",
                        F.when(stale, F.col("quantity_after") - F.col("quantity_before"))
                        .otherwise(F.col("quantity_before"))).drop("_del")


STALE_AUDIT_SQL = """
select a.product_id, a.changed_by,
       case when a.reason = 'order_cancelled' and p.deleted_at is not null then a.quantity_after - a.quantity_before
            else a.quantity_before end as quantity_before,
       a.quantity_after, a.reason, a.changed_at, a.ref_id, a.line_no
from f_audit_log a left join f_products p on a.product_id = p.id"""


@register("W4_audit_continuity", f"""
select product_id, changed_at, ref_id, line_no, reason, quantity_before, expected_before from (
  select *, lag(quantity_after) over (partition by product_id order by changed_at, ref_id, line_no) as expected_before
  from ({STALE_AUDIT_SQL}) s) t
where expected_before is not null and quantity_before <> expected_before""")
def w4(t):
    out = R.audit_continuity(_stale_audit(t))
    return out.select("product_id", "changed_at", "ref_id", "line_no", "reason", "quantity_before", "expected_before")


@register("W4_audit_continuity_skew_path", f"""
select product_id, changed_at, ref_id, line_no, reason, quantity_before, expected_before from (
  select *, lag(quantity_after) over (partition by product_id order by changed_at, ref_id, line_no) as expected_before
  from ({STALE_AUDIT_SQL}) s) t
where expected_before is not null and quantity_before <> expected_before""")
def w4_skew(t):
    """W4 with every product of more than 10 audit rows split by time and id."""
    out = R.audit_continuity(_stale_audit(t), hot_threshold=10)
    return out.select("product_id", "changed_at", "ref_id", "line_no", "reason", "quantity_before", "expected_before")


# ---------------------------------------------------------------- sorting and paging


@register("G1_page", """
select p.id, p.name, p.sku, p.price, p.created_at, c.name as category_name
from f_products p left join f_categories c on p.category_id = c.id
where p.deleted_at is null order by p.created_at desc nulls first, p.id limit 20 offset 40""")
def g1(t):
    """Third page of 20 of the product list in its default order."""
    col, asc = P.safe_sort(None, None)
    order = P.sort_columns(col, asc)
    # a left join drops no row: cut first, then fetch 20 category names
    page = paging.page(t.products.filter(P.product_filter()), order, 3, 20)
    return R.products_with_category(page, t.categories).orderBy(*order).select("id", "name", "sku", "price",
                                                                               "created_at", "category_name")


@register("G2_page_summary", f"""
select count(*) as total, 1 as page, 20 as "limit", cast(ceil(count(*) / 20.0) as bigint) as total_pages
from f_products where {F6_WHERE}""")
def g2(t):
    return paging.page_summary(R.count_matching(t.products, P.product_filter(**F6_OPTS)), 1, 20)


@register("G3_safe_sort", """
select id, name, price from f_products where deleted_at is null order by price asc nulls last, id limit 20 offset 20""")
def g3(t):
    col, asc = P.safe_sort("price", "asc")
    return paging.page(t.products.filter(P.live()), P.sort_columns(col, asc), 2, 20).select("id", "name", "price")


@register("G3_safe_sort_fallback", """
select id, name, created_at from f_products where deleted_at is null
order by created_at desc nulls first, id limit 20""")
def g3_fallback(t):
    """An unknown sort column and direction fall back to created_at DESC."""
    col, asc = P.safe_sort("sku; drop table products", "sideways")
    return paging.page(t.products.filter(P.live()), P.sort_columns(col, asc), 1, 20).select("id", "name",
                                                                                            "created_at")


@register("G4_default_orders", """
select o.id, o.created_at, o.status, u.name as customer_name
from f_orders o join f_users u on o.user_id = u.id order by o.created_at desc nulls first, o.id limit 10""")
def g4(t):
    """First page of the order list: newest first (tie: id)."""
    o = R.orders_with_customer(t.orders, t.users)
    return paging.page(o, P.sort_columns("created_at", False), 1, 10).select("id", "created_at", "status",
                                                                             "customer_name")


@register("G4_categories_by_name", "select id, name from f_categories order by name")
def g4_categories(t):
    return t.categories.orderBy(F.col("name").asc(), F.col("id").asc()).select("id", "name")


@register("G5_keyset_page", """
select id, created_at, total_amount from f_orders
where created_at < timestamp '1998-01-01 00:00:00' or (created_at = timestamp '1998-01-01 00:00:00' and id < 5000)
order by created_at desc, id desc limit 10""")
def g5(t):
    import datetime as dt
    after = (dt.datetime(1998, 1, 1), 5000)
    return paging.keyset_page(t.orders.select("id", "created_at", "total_amount"),
                              [("created_at", False), ("id", False)], after, 10)


@register("G5_keyset_nulls", """
select id, created_at from f_products
where (created_at is null and id > 97) or created_at is not null order by created_at desc nulls first, id limit 200""")
def g5_nulls(t):
    """The page after a product without a creation time: the others without
    one, then the newest."""
    return paging.keyset_page(t.products.select("id", "created_at"), [("created_at", False), ("id", True)], (None, 97), 200)


@register("G6_top_k", """
select id, total_amount from f_orders order by total_amount desc, id limit 5""")
def g6(t):
    return paging.top_k(t.orders.select("id", "total_amount"), [F.col("total_amount").desc(), F.col("id")], 5)


# ---------------------------------------------------------------- reports


@register("R1_low_stock", """
select p.id, p.name, p.sku, p.category_id, c.name as category_name, p.price, p.stock_quantity, p.low_stock_threshold,
       p.low_stock_threshold - p.stock_quantity as units_needed
from f_products p left join f_categories c on p.category_id = c.id
where p.deleted_at is null and p.stock_quantity <= p.low_stock_threshold""")
def r1(t):
    return reports.low_stock(t.products, t.categories)


R2_SQL = f"""
with sold as (
  select i.product_id, cast(sum(i.quantity) as bigint) as total_sold,
         cast(sum({LINE_TOTAL('i.quantity', 'i.unit_price')}) as decimal(18,2)) as total_revenue
  from f_order_items i where i.order_id in (select id from f_orders where status <> 'cancelled')
  group by i.product_id),
grand as (select sum({CENTS('total_revenue')}) as g from sold),
top as (select * from sold order by total_sold desc, total_revenue desc, product_id limit 10)
select top.product_id as id, rank() over (order by total_sold desc) as rank, p.name, p.sku,
       c.name as category_name, total_sold, total_revenue,
       {FROM_CENTS(HALF_UP(CENTS('total_revenue') + ' * 10000', 'grand.g'))} as revenue_share_pct
from top cross join grand left join f_products p on top.product_id = p.id
left join f_categories c on p.category_id = c.id"""


@register("R2_top_products", R2_SQL)
def r2(t):
    return reports.top_products(t.items, t.orders, t.products, t.categories, 10)


TOP25_SQL = R2_SQL.replace("limit 10", "limit 25")


@register("W1_product_rank", f"select id, rank, total_sold from ({TOP25_SQL}) x")
def w1(t):
    """rank() by units sold, over the cut rows only (top 25; ties share a rank)."""
    return reports.top_products(t.items, t.orders, t.products, t.categories, 25).select("id", "rank", "total_sold")


@register("W2_revenue_share", f"select id, total_revenue, revenue_share_pct from ({TOP25_SQL}) x")
def w2(t):
    """Share of all revenue, from a scalar-subquery total (no unpartitioned window)."""
    return reports.top_products(t.items, t.orders, t.products, t.categories, 25).select(
        "id", "total_revenue", "revenue_share_pct")


def _sales_summary_sql(period: str) -> str:
    rev = CENTS("total_amount")
    return f"""
select cast(date_trunc('{period}', created_at) as date) as period, count(*) as total_orders,
       {FROM_CENTS(f"coalesce(sum({rev}) filter (where status <> 'cancelled'), 0)")} as total_revenue,
       {FROM_CENTS(HALF_UP(f"sum({rev}) filter (where status <> 'cancelled')",
                           "count(*) filter (where status <> 'cancelled')"))} as avg_order_value,
       count(*) filter (where status = 'delivered') as delivered_orders,
       count(*) filter (where status = 'cancelled') as cancelled_orders
from f_orders group by 1 order by 1 desc nulls last limit 12"""


@register("R3_sales_summary", _sales_summary_sql("month"))
def r3(t):
    return reports.sales_summary(t.orders, "month")


@register("R3_sales_summary_week", _sales_summary_sql("week"))
def r3_week(t):
    return reports.sales_summary(t.orders, "week")


@register("R3_sales_summary_day", _sales_summary_sql("day"))
def r3_day(t):
    return reports.sales_summary(t.orders, "day")


@register("R4_customer_analytics", f"""
with per_user as (
  select user_id, count(*) as total_orders, count(*) filter (where status = 'delivered') as completed_orders,
         sum({CENTS('total_amount')}) filter (where status <> 'cancelled') as c,
         count(*) filter (where status <> 'cancelled') as n
  from f_orders where user_id is not null group by user_id)
select pu.user_id, u.name as customer_name, u.email, pu.total_orders, pu.completed_orders,
       {FROM_CENTS('coalesce(pu.c, 0)')} as lifetime_value, {FROM_CENTS(HALF_UP('pu.c', 'pu.n'))} as avg_order_value
from per_user pu join f_users u on pu.user_id = u.id
order by lifetime_value desc, pu.user_id limit 10""")
def r4(t):
    return reports.customer_analytics(t.orders, t.users, 10)


@register("R5_audit_log", """
select a.product_id, a.changed_by, a.quantity_before, a.quantity_after, a.reason, a.changed_at, a.ref_id, a.line_no,
       p.name as product_name, p.sku, u.name as changed_by_name
from f_audit_log a join f_products p on a.product_id = p.id left join f_users u on a.changed_by = u.id
order by a.changed_at desc nulls first, a.product_id, a.ref_id, a.line_no, a.reason limit 20 offset 20""")
def r5(t):
    rows, _ = reports.audit_log(t.audit, t.products, t.users, page=2, limit=20)
    return rows


@register("R5_audit_log_product", """
select a.product_id, a.quantity_before, a.quantity_after, a.reason, a.changed_at, p.sku
from f_audit_log a join f_products p on a.product_id = p.id
where a.product_id = 11 and p.deleted_at is null
order by a.changed_at desc nulls first, a.product_id, a.ref_id, a.line_no, a.reason limit 20""")
def r5_product(t):
    rows, _ = reports.audit_log(t.audit, t.products, t.users, product_id=11, page=1, limit=20)
    return rows.select("product_id", "quantity_before", "quantity_after", "reason", "changed_at", "sku")


@register("R5_audit_log_deleted_product", """
select count(*) as total, 1 as page, 20 as "limit", cast(ceil(count(*) / 20.0) as bigint) as total_pages
from f_audit_log a join f_products p on a.product_id = p.id where a.product_id = 49 and p.deleted_at is null""")
def r5_deleted(t):
    """The per-product log of a deleted product (49) is empty."""
    _, summary = reports.audit_log(t.audit, t.products, t.users, product_id=49, page=1, limit=20)
    return summary


@register("R5_audit_log_summary", """
select count(*) as total, 1 as page, 20 as "limit", cast(ceil(count(*) / 20.0) as bigint) as total_pages
from f_audit_log a join f_products p on a.product_id = p.id""")
def r5_summary(t):
    _, summary = reports.audit_log(t.audit, t.products, t.users, page=1, limit=20)
    return summary


@register("R6_dashboard_kpis", f"""
select * from
 (select count(*) filter (where deleted_at is null) as active_products,
         count(*) filter (where deleted_at is null and stock_quantity <= low_stock_threshold) as low_stock_products,
         count(*) filter (where deleted_at is null and stock_quantity <= 0) as out_of_stock_products,
         {FROM_CENTS(f"coalesce(sum({CENTS('price * stock_quantity')}) filter (where deleted_at is null), 0)")}
           as inventory_value
  from f_products) p,
 (select count(*) as categories from f_categories) c,
 (select count(*) filter (where role = 'user') as customers from f_users) u,
 (select count(*) as total_orders, count(*) filter (where status = 'pending') as pending_orders,
         count(*) filter (where status = 'delivered') as delivered_orders,
         count(*) filter (where status = 'cancelled') as cancelled_orders,
         {FROM_CENTS(f"coalesce(sum({CENTS('total_amount')}) filter (where status <> 'cancelled'), 0)")}
           as total_revenue,
         {FROM_CENTS(HALF_UP(f"sum({CENTS('total_amount')}) filter (where status <> 'cancelled')",
                             "count(*) filter (where status <> 'cancelled')"))} as avg_order_value
  from f_orders) o""")
def r6(t):
    return reports.dashboard_kpis(t.products, t.categories, t.users, t.orders)


"""Registered changes that go through the transaction log (S3), and batches
whose sequence numbers are missing, not positive or tied (M2, M7, M9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mutate as MU
from ..operators import validate as V
from ..session import shared_path
from ..sources.commits import Store
from .catalog import register
from .queries_write import (AS_OF, CANCELLED_NOW_SQL, MANY_PATCHES_SQL, ORDER_REQUESTS_SQL, PATCH_OK_SQL, STATUS_OUTCOME_SQL, TRIM,
                            USER_BATCH_SQL, _many_patched_batch, _many_status_requests, m6_ctes, patch_batch, user_batch)


def _loaded(t, *names: str, buckets: int = 16) -> Store:
    store = Store(t.spark, shared_path(t.spark, "log"), buckets)
    domain = t.domain()
    store.commit(store.snapshot(), {n: domain[n] for n in names}, "load")
    return store


# ---------------------------------------------------------------- S3 through the log


@register("S3_commit_status", f"""
with back as (select i.product_id, sum(i.quantity) as q from f_order_items i join ({CANCELLED_NOW_SQL}) c on i.order_id = c.order_id
              group by i.product_id)
select 'orders' as table_name, o.id, coalesce(x.status, o.status) as value
from f_orders o left join (select order_id, status from ({STATUS_OUTCOME_SQL}) y where reason is null) x on o.id = x.order_id
union all
select 'products', p.id, cast(p.stock_quantity + coalesce(b.q, 0) as varchar) from f_products p left join back b on p.id = b.product_id
union all
select 'stock_audit_log', i.product_id, cast(i.quantity as varchar)
from f_order_items i join ({CANCELLED_NOW_SQL}) c on i.order_id = c.order_id join f_products p on p.id = i.product_id""")
def s3_status(t):
    """A status batch (M7) and the stock it gives back (M8): orders, products and audit rows
    change in one commit and are read from one snapshot."""
    store = _loaded(t, "orders", "products", "order_items")
    base = store.snapshot()
    adv = MU.advance_status(base.table("orders"), t.status_requests, as_of=AS_OF)
    back = MU.cancel_orders(base.table("products"), base.table("order_items"), adv.extra["cancelled"], as_of=AS_OF)
    store.commit(base, {"orders": adv.table, "products": back.table, "stock_audit_log": back.audit}, "status", read=["order_items"])
    now = store.snapshot()
    rows = [now.table("orders").select(F.lit("orders").alias("table_name"), "id", F.col("status").alias("value")),
            now.table("products").select(F.lit("products").alias("table_name"), "id", F.col("stock_quantity").cast("string").alias("value")),
            now.table("stock_audit_log").select(F.lit("stock_audit_log").alias("table_name"), F.col("product_id").alias("id"),
                                                (F.col("quantity_after") - F.col("quantity_before")).cast("string").alias("value"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@register("S3_patch_buckets", f"""
select p.id, coalesce(b.price, p.price) as price, coalesce(b.name, p.name) as name from f_products p
left join ({PATCH_OK_SQL}) b on p.id = b.id and p.deleted_at is null
  and (b.category_id is null or b.category_id in (select id from f_categories))""")
def s3_patch(t):
    """The patches of M2 as a copy-on-write change: only the buckets of the patched ids are read and written."""
    store = _loaded(t, "products", "categories")
    base = store.snapshot()
    ok, _ = V.split(V.product_patches(patch_batch(t)))
    fields = ["category_id", "name", "description", "price", "low_stock_threshold"]
    store.change("products", ok.select("id"), lambda rows: MU.patch(rows, ok.drop("sku"), fields, live_only=True, as_of=AS_OF,
                                                                    references={"category_id": base.table("categories")}).table,
                 base, "patch", read=["categories"])
    return store.snapshot().table("products").select("id", "price", "name")


@register("M6_commit", m6_ctes(ORDER_REQUESTS_SQL) + """
, placed as (select r.* from req r join decisions d on r.request_id = d.request_id and d.accepted)
select 'products' as table_name, p.id, cast(p.stock_quantity - coalesce(s.q, 0) as bigint) as value
from f_products p left join (select product_id, sum(quantity) as q from placed group by product_id) s on p.id = s.product_id
union all
select 'stock_audit_log', product_id, -quantity from placed""")
def m6_commit(t):
    """Order placement: the new stock and its audit rows are committed together and read from one snapshot."""
    from ..operators.allocate import place_orders
    store = _loaded(t, "products")
    base = store.snapshot()
    placed = place_orders(base.table("products"), t.order_request_items, as_of=AS_OF)
    store.commit(base, {"products": placed.products, "stock_audit_log": placed.audit}, "orders")
    now = store.snapshot()
    stock = now.table("products").select(F.lit("products").alias("table_name"), "id", F.col("stock_quantity").cast("bigint").alias("value"))
    return stock.unionByName(now.table("stock_audit_log").select(
        F.lit("stock_audit_log").alias("table_name"), F.col("product_id").alias("id"),
        (F.col("quantity_after") - F.col("quantity_before")).cast("bigint").alias("value")))


# ---------------------------------------------------------------- sequence numbers that order nothing

# the patches of M2_patch_many: some numbers are missing, some zero, many stand twice for one product
TIED_PATCHES_SQL = f"""
select id, case when seq % 7 = 0 then null when seq % 11 = 0 then 0 when seq % 2 = 0 then seq else seq % 40 + 1 end as seq, category_id, name
from ({MANY_PATCHES_SQL}) x"""

TIED_PATCHES_CTE = f"""
with req as ({TIED_PATCHES_SQL}),
checked as (select r.*, case when p.id is null or p.deleted_at is not null then 'not_found'
                             when r.seq is null or r.seq < 1 then 'invalid_seq'
                             when count(*) over (partition by r.id, r.seq) > 1 then 'duplicate_seq'
                             when r.category_id is not null and c.id is null then 'unknown_category_id' end as reason
            from req r left join f_products p on r.id = p.id left join f_categories c on r.category_id = c.id)
"""


def _tied_patches(t):
    k = F.col("seq")
    batch = _many_patched_batch(t).withColumn("seq", F.when(k % 7 == 0, None).when(k % 11 == 0, 0).when(k % 2 == 0, k).otherwise(k % 40 + 1))
    return MU.patch(t.products, batch, ["category_id", "name"], live_only=True, as_of=AS_OF, references={"category_id": t.categories})


@register("M2_patch_tied", TIED_PATCHES_CTE + """
select p.id, coalesce((select arg_max(category_id, seq) from checked k where k.id = p.id and reason is null and category_id is not null),
                      p.category_id) as category_id,
       coalesce((select arg_max(name, seq) from checked k where k.id = p.id and reason is null and name is not null), p.name) as name
from f_products p""")
def m2_tied(t):
    """Patches whose numbers are missing, zero or tied: these change nothing, the others apply in order."""
    return _tied_patches(t).table.select("id", "category_id", "name")


@register("M2_patch_tied_rejected", TIED_PATCHES_CTE + "select id, seq, reason from checked where reason is not null")
def m2_tied_rejected(t):
    return _tied_patches(t).rejected


# the requests of M7_many_requests: a quarter of the orders keeps its numbers, the others lose, shift or tie some
TIED_STATUS_SQL = """
select order_id, case order_id % 4 when 0 then line_no when 1 then nullif(line_no, 2) when 2 then line_no - 1 else (line_no + 1) // 2 end as seq,
       case (order_id + line_no) % 6 when 0 then 'confirmed' when 1 then 'packed' when 2 then 'shipped'
       when 3 then 'delivered' when 4 then 'cancelled' else 'pending' end as status
from f_order_items"""


@register("M7_tied_requests", f"""
with recursive req as (select *, case when seq is null then 'invalid_seq'
                                      when count(*) over (partition by order_id, seq) > 1 then 'duplicate_seq' end as bad
                       from ({TIED_STATUS_SQL}) x),
good as (select *, row_number() over (partition by order_id order by seq) as n from req where bad is null),
walk(order_id, n, status, accepted) as (
  select id, 0, status, false from f_orders
  union all
  select w.order_id, r.n, case when ok then r.status else w.status end, ok
  from walk w join good r on r.order_id = w.order_id and r.n = w.n + 1,
       lateral (select w.status || '>' || r.status in ('pending>confirmed', 'confirmed>packed', 'packed>shipped', 'shipped>delivered',
                                                       'pending>cancelled', 'confirmed>cancelled') as ok) o)
select r.order_id, r.seq, r.status, false as accepted, r.bad as reason from req r where bad is not null
union all
select g.order_id, g.seq, g.status, w.accepted, case when not w.accepted then 'invalid_transition' end
from good g join walk w on w.order_id = g.order_id and w.n = g.n""")
def m7_tied(t):
    """Status requests of which some numbers are missing or tied: only the others move their order."""
    n, k = F.col("seq"), F.col("order_id") % 4
    requests = _many_status_requests(t).withColumn("seq", F.when(k == 0, n).when(k == 1, F.when(n != 2, n)).when(k == 2, n - 1)
                                                   .otherwise(F.floor((n + 1) / 2)).cast("bigint"))
    return MU.advance_status(t.orders, requests, as_of=AS_OF).extra["requests"].select("order_id", "seq", "status", "accepted", "reason")


TIED_USERS_SQL = f"""
select case when seq % 7 = 0 then null when seq % 11 = 0 then 0 when seq % 5 < 2 then seq // 5 + 1 else seq + 1000000 end as seq, name, email, role
from ({USER_BATCH_SQL}) x"""

TIED_USERS_CTE = f"""
with b as (select seq, case when seq is null or seq < 1 then 'invalid_seq' when count(*) over (partition by seq) > 1 then 'duplicate_seq' end as bad,
                  {TRIM('name')} as name, lower({TRIM('email')}) as email, coalesce(role, 'user') as role from ({TIED_USERS_SQL}) x),
v as (select *, coalesce(bad, case when name is null or length(name) = 0 then 'name_required' when length(name) > 100 then 'name_too_long'
                                   when email is null or not regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') then 'invalid_email'
                                   when role not in ('user', 'admin') then 'invalid_role' when role = 'admin' then 'admin_not_allowed' end) as r1 from b),
f as (select email, min(seq) as first_seq from v where r1 is null group by email),
checked as (select v.seq, v.name, v.email, v.role, coalesce(v.r1, case when v.seq <> f.first_seq then 'duplicate_in_batch' end,
                   case when v.email in (select email from f_users) then 'email_taken' end) as reason
            from v left join f on v.email = f.email)
"""


def _tied_users(t):
    k = F.col("seq")
    seq = F.when(k % 7 == 0, None).when(k % 11 == 0, 0).when(k % 5 < 2, F.floor(k / 5) + 1).otherwise(k + 1_000_000)
    return MU.register_users(t.users, user_batch(t).withColumn("seq", seq.cast("bigint")), as_of=AS_OF)


@register("M9_register_users_tied", TIED_USERS_CTE + """
select id, name, email, role from f_users
union all
select (select max(id) from f_users) + seq, name, email, role from checked where reason is null""")
def m9_tied(t):
    """Registrations whose numbers are missing, zero or tied make no user: ids stay unique."""
    return _tied_users(t).table.select("id", "name", "email", "role")


@register("M9_register_users_tied_rejected", TIED_USERS_CTE + "select seq, email, reason from checked where reason is not null")
def m9_tied_rejected(t):
    return _tied_users(t).rejected

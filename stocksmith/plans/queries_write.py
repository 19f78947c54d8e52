"""Registered validation and state-change queries (V1-V7, M1-M5, M7-M9,
S2, S5, S6).

Request batches are stand-in inputs built from the test tables; they only
give rows in the schema each job expects.  Each oracle states the job's
result for that batch in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mutate as MU
from ..operators import validate as V
from ..session import DEFAULT_AS_OF, shared_path
from ..sources import tables as TB
from ..sources.schemas import SEED_CATEGORIES, SEED_PRODUCTS
from .catalog import register
from .flaws import flawed, flawed_sql

AS_OF = DEFAULT_AS_OF


# ---------------------------------------------------------------- stand-in batches
def product_batch(t):
    """New-product requests, one per part (some break the rules)."""
    p = t.raw("part")
    name = F.when(F.col("p_size") % 9 == 0, "\t\n ").when(F.col("p_size") % 4 == 0, F.concat(F.lit("\t "), "p_name", F.lit(" \n"))) \
        .otherwise(F.col("p_name"))
    return p.select(
        (F.col("p_partkey") + 1).alias("seq"), name.alias("name"),
        (F.col("p_retailprice") - 950).cast("decimal(10,2)").alias("price"),
        F.concat(F.col("p_type"), F.when(F.col("p_size") > 40, ".").otherwise("-"),
                 F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 5 == 0, "\n").otherwise("")).alias("sku"),
        (F.col("p_size") - 5).cast("int").alias("stock_quantity"),
        (F.col("p_size") % 7 - 1).cast("int").alias("low_stock_threshold"))


PRODUCT_BATCH_SQL = """
select p_partkey + 1 as seq,
       case when p_size % 9 = 0 then chr(9) || chr(10) || ' ' when p_size % 4 = 0 then chr(9) || ' ' || p_name || ' ' || chr(10)
            else p_name end as name, cast(p_retailprice - 950 as decimal(10,2)) as price,
       p_type || case when p_size > 40 then '.' else '-' end || cast(p_partkey as varchar)
         || case when p_size % 5 = 0 then chr(10) else '' end as sku,
       cast(p_size - 5 as int) as stock_quantity, cast(p_size % 7 - 1 as int) as low_stock_threshold
from part"""


def patch_batch(t):
    """Product patches, one per part: some fields NULL (keep), some invalid.

    Dealt by key first: a file of parts is one task, however long, and the rules
    that follow are most of the work."""
    p = t.raw("part").repartition("p_partkey")
    s = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") + 1).alias("seq"),
        F.when(s > 45, F.lit(" \t\n")).when(s > 30, F.concat(F.lit("\t"), F.upper("p_name"), F.lit(" "))).alias("name"),
        F.when(s < 30, (F.col("p_retailprice") - 920).cast("decimal(10,2)")).alias("price"),
        (s - 3).cast("int").alias("low_stock_threshold"),
        F.when(s == 50, F.lit("NEW-SKU")).alias("sku"),
        F.when(s % 2 == 0, F.lower("p_type")).alias("description"),
        F.when(s < 10, _brand_id_plus_one()).alias("category_id"))


def _brand_id_plus_one():
    """Move the product to the next brand's category."""
    return (F.substring(F.col("p_brand"), 7, 1000).cast("int") + 1).cast("int")


PATCH_BATCH_SQL = """
select p_partkey as id, p_partkey + 1 as seq,
       case when p_size > 45 then ' ' || chr(9) || chr(10) when p_size > 30 then chr(9) || upper(p_name) || ' ' end as name,
       case when p_size < 30 then cast(p_retailprice - 920 as decimal(10,2)) end as price,
       cast(p_size - 3 as int) as low_stock_threshold,
       case when p_size = 50 then 'NEW-SKU' end as sku,
       case when p_size % 2 = 0 then lower(p_type) end as description,
       case when p_size < 10 then cast(cast(substring(p_brand, 7) as int) + 1 as int) end as category_id
from part"""


def TRIM(c: str) -> str:
    """SQL for a text without white space at its ends."""
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def restock_batch(t):
    """Restock requests: one per ordered item, 250 units per ordered unit,
    two days after the order."""
    o = t.orders.select(
        F.col("id").alias("request_id"), F.col("user_id").alias("actor_id"),
        (F.col("created_at") + F.expr("interval 2 days")).alias("requested_at"))
    return t.items.join(o, t.items["order_id"] == o["request_id"]).select(
        "request_id", "line_no", "product_id", (F.col("quantity") * 250).cast("int").alias("quantity"),
        "actor_id", "requested_at")


RESTOCK_BATCH_SQL = """
select o.id as request_id, i.line_no, i.product_id, cast(i.quantity * 250 as int) as quantity, o.user_id as actor_id,
       o.created_at + interval '2' day as requested_at
from f_order_items i join f_orders o on i.order_id = o.id"""


def user_batch(t):
    """Sign-ups, one per customer; pairs of customers share an email."""
    c = t.raw("customer")
    email = F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.col("c_name")).otherwise(
        F.concat(F.lit(" \tMember"), (F.col("c_custkey") / 2).cast("bigint").cast("string"), F.lit("@Example.COM\n")))
    name = F.when(F.col("c_custkey") % 11 == 0, "\n\t").when(F.col("c_custkey") % 13 == 0, F.repeat(F.lit("n"), 101)) \
        .otherwise(F.concat(F.lit(" \t"), F.col("c_name")))
    return c.select((F.col("c_custkey") + 1).alias("seq"), name.alias("name"),
                    email.alias("email"), F.when(F.col("c_acctbal") < 0, F.lit("admin")).alias("role"))


USER_BATCH_SQL = """
select c_custkey + 1 as seq, case when c_custkey % 11 = 0 then chr(10) || chr(9) when c_custkey % 13 = 0 then repeat('n', 101)
                                  else ' ' || chr(9) || c_name end as name,
       case when c_mktsegment = 'AUTOMOBILE' then c_name
            else ' ' || chr(9) || 'Member' || cast(cast(c_custkey // 2 as bigint) as varchar) || '@Example.COM' || chr(10) end as email,
       case when c_acctbal < 0 then 'admin' end as role
from customer"""


# ---------------------------------------------------------------- validation


@register("V1_validate_orders", """
with req as (select o.id as request_id, i.line_no, i.product_id, i.quantity, cast(null as varchar) as notes
             from f_orders o left join f_order_items i on i.order_id = o.id),
agg as (select request_id, count(line_no) as n_items,
               count(*) filter (where line_no is not null and (product_id is null or product_id < 1)) as bad_product,
               count(*) filter (where line_no is not null and (quantity is null or quantity < 1 or quantity > 1000))
                 as bad_qty,
               max(length(trim(notes))) as notes_len
        from req group by request_id),
dup as (select distinct request_id from req where line_no is not null and product_id is not null
        group by request_id, product_id having count(*) > 1)
select a.request_id,
       case when n_items < 1 then 'no_items' when bad_product > 0 then 'invalid_product_id'
            when bad_qty > 0 then 'invalid_quantity' when coalesce(notes_len, 0) > 500 then 'notes_too_long'
            when d.request_id is not null then 'duplicate_product' end as reason
from agg a left join dup d on a.request_id = d.request_id""")
def v1(t):
    """Every order request with the first rule it breaks (NULL = valid)."""
    return V.orders(t.order_request_items)


@register("V2_validate_products", f"""
select seq, sku, name, case
  when name is null or length(name) = 0 then 'name_required'
  when length(name) > 200 then 'name_too_long'
  when price is null or price <= 0 then 'invalid_price'
  when sku is null or length(sku) = 0 then 'sku_required'
  when length(sku) > 100 then 'sku_too_long'
  when not regexp_matches(sku, '^[A-Za-z0-9_\\-]+$') then 'invalid_sku'
  when stock_quantity < 0 then 'invalid_stock_quantity'
  when low_stock_threshold < 0 then 'invalid_low_stock_threshold' end as reason
from (select * replace ({TRIM('name')} as name, {TRIM('sku')} as sku) from ({PRODUCT_BATCH_SQL}) x) b""")
def v2(t):
    """New products, some with tabs and newlines around (or for) their names and SKUs."""
    return V.products(product_batch(t)).select("seq", "sku", "name", "reason")


@register("V3_validate_patches", f"""
select id, name, case
  when name is not null and length(name) = 0 then 'name_blank'
  when name is not null and length(name) > 200 then 'name_too_long'
  when price is not null and price <= 0 then 'invalid_price'
  when low_stock_threshold is not null and low_stock_threshold < 0 then 'invalid_low_stock_threshold'
  when sku is not null then 'sku_immutable' end as reason
from (select * replace ({TRIM('name')} as name) from ({PATCH_BATCH_SQL}) x) b""")
def v3(t):
    return V.product_patches(patch_batch(t)).select("id", "name", "reason")


@register("V4_validate_restocks", f"""
select request_id, line_no, case when quantity is null or quantity < 1 or quantity > 10000 then 'invalid_quantity' end
  as reason
from ({RESTOCK_BATCH_SQL}) b""")
def v4(t):
    return V.restocks(restock_batch(t)).select("request_id", "line_no", "reason")


@register("V5_validate_users", f"""
select seq, name, email, case
  when name is null or length(name) = 0 then 'name_required' when length(name) > 100 then 'name_too_long'
  when email is null or not regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') then 'invalid_email'
  when length(email) > 150 then 'email_too_long' end as reason
from (select * replace ({TRIM('name')} as name, {TRIM('email')} as email) from ({USER_BATCH_SQL}) x) b""")
def v5(t):
    return V.users(user_batch(t)).select("seq", "name", "email", "reason")


@register("V6_validate_categories", f"""
select seq, name, case when length(name) = 0 then 'name_required' when length(name) > 100 then 'name_too_long' end as reason
from (select n_nationkey as seq, {TRIM("""case when n_regionkey = 0 then ' ' || chr(9) when n_regionkey = 1 then repeat(n_name, 20)
       else chr(10) || n_name || ' ' end""")} as name from nation) b""")
def v6(t):
    n = t.raw("nation")
    name = F.when(F.col("n_regionkey") == 0, " \t").when(F.col("n_regionkey") == 1, F.repeat("n_name", F.lit(20))) \
        .otherwise(F.concat(F.lit("\n"), "n_name", F.lit(" ")))
    return V.categories(n.select(F.col("n_nationkey").alias("seq"), name.alias("name"))).select("seq", "name", "reason")


@register("V7_table_audit", flawed_sql("select * from broken"))
def v7(t):
    """All schema constraints over all six tables, each of them with rows that
    break its rules."""
    return V.table_audit(flawed(t))


# ---------------------------------------------------------------- M1 upsert

SUPPLIER_PRODUCTS_SQL = """
select s_suppkey + 1 as seq, 'SKU-' || lpad(cast(s_suppkey * 3 as varchar), 8, '0') as sku, s_name as name,
       cast(100 + s_acctbal / 100 as decimal(10,2)) as price from supplier"""


def supplier_products(t):
    s = t.raw("supplier")
    return s.select((F.col("s_suppkey") + 1).alias("seq"),
                    F.concat(F.lit("SKU-"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 8, "0")).alias("sku"),
                    F.col("s_name").alias("name"), (F.lit(100) + F.col("s_acctbal") / 100).cast("decimal(10,2)")
                    .alias("price"))


@register("M1_upsert_conflicts", f"""
select sku, 'conflict' as reason from ({SUPPLIER_PRODUCTS_SQL}) b where sku in (select sku from f_products)""")
def m1_conflicts(t):
    """Inserting supplier products: skus that exist already are rejected."""
    return MU.upsert(t.products, supplier_products(t), "sku", on_conflict="reject", as_of=AS_OF).rejected.select("sku", "reason")


@register("M1_upsert_insert", f"""
select id, sku, name, price, stock_quantity, low_stock_threshold from f_products
union all
select (select max(id) from f_products) + seq, sku, name, price, 0, 10
from ({SUPPLIER_PRODUCTS_SQL}) b where sku not in (select sku from f_products)""")
def m1_insert(t):
    """Insert-if-absent: the new product table (defaults filled for new rows)."""
    r = MU.upsert(t.products, supplier_products(t), "sku", on_conflict="ignore", as_of=AS_OF)
    out = MU.apply_defaults(r.table, "products", AS_OF)
    return out.select("id", "sku", "name", "price", "stock_quantity", "low_stock_threshold")


@register("M1_upsert_update", """
with b as (select p_brand as name, p_type || ' ' || cast(p_partkey as varchar) as description, p_partkey + 1 as seq
           from part),
last as (select name, arg_max(description, seq) as description from b group by name)
select c.id, c.name, l.description
from f_categories c left join last l on c.name = l.name""")
def m1_update(t):
    """Categories upserted on name; the batch's last description wins."""
    p = t.raw("part")
    b = p.select(F.col("p_brand").alias("name"),
                 F.concat(F.col("p_type"), F.lit(" "), F.col("p_partkey").cast("string")).alias("description"),
                 (F.col("p_partkey") + 1).alias("seq"))
    r = MU.upsert(t.categories, b, "name", on_conflict="update", update_cols=["description"], as_of=AS_OF)
    return r.table.select("id", "name", "description")


# one request per line item: its product's brand or type, so most names come again and again; some are NULL
CATEGORY_REQUESTS_SQL = """
select l_orderkey * 8 + l_linenumber as seq,
       case when l_orderkey % 31 = 0 then null when l_suppkey % 2 = 0 then p_brand else p_type end as name,
       'order ' || cast(l_orderkey as varchar) as description
from (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey
      from lineitem group by l_orderkey, l_linenumber) l join part p on l.l_partkey = p.p_partkey"""

# each request meets the table and the requests before it, one after the other
CATEGORY_REPLAY_SQL = f"""
with req as ({CATEGORY_REQUESTS_SQL}),
seen as (select *, name in (select name from f_categories) as stored,
                row_number() over (partition by name order by seq) as k from req)
"""


def category_requests(t):
    li = t.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p_partkey"),
                                                                     F.min("l_suppkey").alias("l_suppkey"))
    li = li.join(t.raw("part").select("p_partkey", "p_brand", "p_type"), "p_partkey")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
                     F.when(F.col("l_orderkey") % 31 == 0, F.lit(None)).when(F.col("l_suppkey") % 2 == 0, F.col("p_brand"))
                     .otherwise(F.col("p_type")).alias("name"),
                     F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("description"))


@register("M1_upsert_repeats", CATEGORY_REPLAY_SQL + """
select id, name, null as description from f_categories
union all
select (select max(id) from f_categories) + seq, name, description from seen where name is not null and not stored and k = 1""")
def m1_repeats(t):
    """Categories inserted by many requests of the same names: the first of a
    new name is stored."""
    r = MU.upsert(t.categories.withColumn("id", F.col("id").cast("bigint")), category_requests(t), "name", as_of=AS_OF)
    return r.table.select("id", "name", "description")


@register("M1_upsert_repeats_rejected", CATEGORY_REPLAY_SQL + """
select name, seq, case when name is null then 'key_required' when stored then 'conflict' else 'duplicate_in_batch' end as reason
from seen where name is null or stored or k > 1""")
def m1_repeats_rejected(t):
    """All other requests are refused, each with its reason."""
    return MU.upsert(t.categories.withColumn("id", F.col("id").cast("bigint")), category_requests(t), "name", as_of=AS_OF).rejected


# ---------------------------------------------------------------- M2 patch

PATCH_OK_SQL = f"""
select * from (select * replace ({TRIM('name')} as name) from ({PATCH_BATCH_SQL}) x) b
where not ((name is not null and (length(name) = 0 or length(name) > 200))
        or (price is not null and price <= 0) or (low_stock_threshold is not null and low_stock_threshold < 0)
        or sku is not null)"""


def _patched(t):
    ok, _ = V.split(V.product_patches(patch_batch(t)))
    return MU.patch(t.products, ok.drop("sku"), ["category_id", "name", "description", "price", "low_stock_threshold"],
                    live_only=True, as_of=AS_OF, references={"category_id": t.categories})


@register("M2_patch", f"""
select p.id, coalesce(b.category_id, p.category_id) as category_id, coalesce(b.name, p.name) as name,
       coalesce(b.description, p.description) as description, coalesce(b.price, p.price) as price,
       coalesce(b.low_stock_threshold, p.low_stock_threshold) as low_stock_threshold,
       case when b.id is not null then timestamp '{AS_OF}' else p.updated_at end as updated_at
from (select *, cast(null as timestamp) as updated_at from f_products) p
left join ({PATCH_OK_SQL}) b on p.id = b.id and p.deleted_at is null
  and (b.category_id is null or b.category_id in (select id from f_categories))""")
def m2(t):
    return _patched(t).table.select("id", "category_id", "name", "description", "price", "low_stock_threshold",
                                    "updated_at")


@register("M2_patch_rejected", f"""
select b.id, case when b.id not in (select id from f_products where deleted_at is null) then 'not_found'
                  else 'unknown_category_id' end as reason
from ({PATCH_OK_SQL}) b
where b.id not in (select id from f_products where deleted_at is null)
   or (b.category_id is not null and b.category_id not in (select id from f_categories))""")
def m2_rejected(t):
    """Patches of deleted products, or naming a missing category, are refused."""
    return _patched(t).rejected.select("id", "reason")


# one patch per line item: several for each product, some naming a missing category
MANY_PATCHES_SQL = """
select p as id, k as seq, case when k % 5 = 0 then 900 + k % 3 when k % 3 = 0 then k % 25 + 1 end as category_id,
       case when k % 2 = 0 then 'renamed ' || cast(k as varchar) end as name
from (select min(l_partkey) as p, l_orderkey * 8 + l_linenumber as k from lineitem group by l_orderkey, l_linenumber) l"""


def _many_patched_batch(t):
    li = t.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("id"))
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return li.select("id", k.alias("seq"),
                     F.when(k % 5 == 0, 900 + k % 3).when(k % 3 == 0, k % 25 + 1).cast("int").alias("category_id"),
                     F.when(k % 2 == 0, F.concat(F.lit("renamed "), k.cast("string"))).alias("name"))


def _many_patched(t):
    return MU.patch(t.products, _many_patched_batch(t), ["category_id", "name"], live_only=True, as_of=AS_OF,
                    references={"category_id": t.categories})


MANY_PATCHES_CTE = f"""
with req as ({MANY_PATCHES_SQL}),
checked as (select r.*, case when p.id is null or p.deleted_at is not null then 'not_found'
                             when r.category_id is not null and c.id is null then 'unknown_category_id' end as reason
            from req r left join f_products p on r.id = p.id left join f_categories c on r.category_id = c.id)
"""


@register("M2_patch_many", MANY_PATCHES_CTE + """
select p.id, coalesce((select arg_max(category_id, seq) from checked k where k.id = p.id and reason is null and category_id is not null),
                      p.category_id) as category_id,
       coalesce((select arg_max(name, seq) from checked k where k.id = p.id and reason is null and name is not null), p.name) as name
from f_products p""")
def m2_many(t):
    """Several patches of each product, applied in seq order; a refused one
    takes nothing else with it."""
    return _many_patched(t).table.select("id", "category_id", "name")


@register("M2_patch_many_rejected", MANY_PATCHES_CTE + "select id, seq, reason from checked where reason is not null")
def m2_many_rejected(t):
    return _many_patched(t).rejected


@register("M2_patch_categories", """
with req as (select n_nationkey + n_regionkey * 7 as id, n_nationkey + 1 as seq, n_name as name,
                    case when n_regionkey < 3 then 'all of ' || n_name end as description from nation),
known as (select * from req where id in (select id from f_categories))
select c.id, coalesce((select arg_max(name, seq) from known k where k.id = c.id), c.name) as name,
       (select arg_max(description, seq) from known k where k.id = c.id and description is not null) as description
from f_categories c""")
def m2_categories(t):
    """Categories patched by id, some more than once."""
    n = t.raw("nation").select((F.col("n_nationkey") + F.col("n_regionkey") * 7).alias("id"), (F.col("n_nationkey") + 1).alias("seq"),
                               F.col("n_name").alias("name"), F.when(F.col("n_regionkey") < 3, F.concat(F.lit("all of "), "n_name")).alias("description"))
    return MU.patch(t.categories, n, ["name", "description"], as_of=AS_OF).table.select("id", "name", "description")


# ---------------------------------------------------------------- M3 soft delete

RETURNED_PARTS_SQL = "select distinct l_partkey as id from lineitem where l_returnflag = 'R'"


def _soft_deleted(t):
    ids = t.raw("lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("id"))
    return MU.soft_delete(t.products, ids, as_of=AS_OF)


@register("M3_soft_delete", f"""
select id, case when deleted_at is null and id in ({RETURNED_PARTS_SQL}) then timestamp '{AS_OF}'
                else deleted_at end as deleted_at
from f_products""")
def m3(t):
    """Archive every product that had returned items."""
    return _soft_deleted(t).table.select("id", "deleted_at")


@register("M3_soft_delete_rejected", f"""
select id, 'not_found' as reason from ({RETURNED_PARTS_SQL}) r
where id not in (select id from f_products where deleted_at is null)""")
def m3_rejected(t):
    return _soft_deleted(t).rejected


# ---------------------------------------------------------------- M4 hard delete


@register("M4_hard_delete_categories", """
select p.id, case when p.category_id in (select n_nationkey from nation where n_regionkey = 2) then null
                  else p.category_id end as category_id
from f_products p""")
def m4_categories(t):
    """Delete the categories named by region 2's nation keys: products keep
    their rows with category_id set to NULL."""
    ids = t.raw("nation").filter(F.col("n_regionkey") == 2).select(F.col("n_nationkey").alias("id"))
    r = MU.hard_delete(t.domain(), "categories", ids)
    return r.extra["products"].select("id", "category_id")


@register("M4_hard_delete_users", """
select i.order_id, i.line_no from f_order_items i
where i.order_id not in (select o.id from f_orders o join customer c on o.user_id = c.c_custkey
                         where c.c_mktsegment = 'BUILDING')""")
def m4_users(t):
    """Delete the users of one market segment: their orders and those
    orders' items go too (CASCADE); the remaining items."""
    ids = t.raw("customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("id"))
    r = MU.hard_delete(t.domain(), "users", ids)
    return r.extra["order_items"].select("order_id", "line_no")


@register("M4_hard_delete_products", """
with req as (select distinct p_partkey + 1 as id from part where p_size = 1)
select id, case when id not in (select id from f_products) then 'not_found' else 'restricted' end as reason
from req where id not in (select id from f_products) or id in (select product_id from f_order_items)""")
def m4_products(t):
    """Deleting products still named by order items is refused (RESTRICT)."""
    ids = t.raw("part").filter(F.col("p_size") == 1).select((F.col("p_partkey") + 1).alias("id"))
    return MU.hard_delete(t.domain(), "products", ids).rejected


@register("M4_hard_delete_users_audit", """
select product_id, ref_id, line_no, reason,
       case when changed_by in (select c_custkey from customer where c_mktsegment = 'MACHINERY') then null else changed_by end as changed_by
from f_audit_log""")
def m4_users_audit(t):
    """Users of one segment are deleted: the audit rows they made stay, without
    their id (SET NULL)."""
    ids = t.raw("customer").filter(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("id"))
    r = MU.hard_delete(t.domain(), "users", ids)
    return r.extra["stock_audit_log"].select("product_id", "ref_id", "line_no", "reason", "changed_by")


@register("M4_hard_delete_products_audit", """
select product_id, ref_id, line_no, reason, quantity_after from f_audit_log
where product_id not in (select id from f_products where deleted_at is not null
                         and id not in (select product_id from f_order_items where order_id in (select id from f_orders where status = 'cancelled')))""")
def m4_products_audit(t):
    """With the items of cancelled orders alone in the item table, archived products
    that none of them names are deleted, with their audit rows (CASCADE)."""
    left = t.items.join(t.orders.filter("status = 'cancelled'").select(F.col("id").alias("order_id")), "order_id", "left_semi")
    r = MU.hard_delete({**t.domain(), "order_items": left}, "products", t.products.filter("deleted_at is not null").select("id"))
    return r.extra["stock_audit_log"].select("product_id", "ref_id", "line_no", "reason", "quantity_after")


# ---------------------------------------------------------------- M5 restock

RESTOCK_OK_SQL = f"""
select b.* from ({RESTOCK_BATCH_SQL}) b join f_products p on b.product_id = p.id
where p.deleted_at is null and b.quantity between 1 and 10000"""


def _restocked(t):
    return MU.restock(t.products, restock_batch(t), as_of=AS_OF)


@register("M5_restock", f"""
select product_id, actor_id as changed_by, cast(qa - quantity as int) as quantity_before, cast(qa as int) as quantity_after,
       'manual_restock' as reason, requested_at as changed_at, request_id as ref_id, line_no
from (select r.*, p.stock_quantity + sum(r.quantity) over (partition by r.product_id
             order by r.requested_at, r.request_id, r.line_no rows between unbounded preceding and current row) as qa
      from ({RESTOCK_OK_SQL}) r join f_products p on r.product_id = p.id) t""")
def m5(t):
    """Audit rows of accepted restocks, with the true running stock."""
    return _restocked(t).audit


@register("M5_restock_stock", f"""
select p.id, cast(p.stock_quantity + coalesce(s.q, 0) as int) as stock_quantity
from f_products p left join (select product_id, sum(quantity) as q from ({RESTOCK_OK_SQL}) r group by product_id) s
on p.id = s.product_id""")
def m5_stock(t):
    return _restocked(t).table.select("id", "stock_quantity")


@register("M5_restock_rejected", f"""
select b.request_id, b.line_no, b.product_id,
       case when b.quantity is null or b.quantity < 1 or b.quantity > 10000 then 'invalid_quantity'
            else 'not_found' end as reason
from ({RESTOCK_BATCH_SQL}) b left join f_products p on b.product_id = p.id
where b.quantity is null or b.quantity < 1 or b.quantity > 10000 or p.id is null or p.deleted_at is not null""")
def m5_rejected(t):
    return _restocked(t).rejected


# ---------------------------------------------------------------- M7 / M8 status

STATUS_OUTCOME_SQL = """
select r.order_id, r.seq, r.status, r.actor_id, r.actor_role,
       case when o.id is null then 'not_found'
            when r.actor_role <> 'admin' and r.status <> 'cancelled' then 'admin_only'
            when r.actor_role <> 'admin' and o.user_id is distinct from r.actor_id then 'not_owner'
            when o.status || '>' || r.status in ('pending>confirmed', 'confirmed>packed', 'packed>shipped',
                                                  'shipped>delivered', 'pending>cancelled', 'confirmed>cancelled')
              then null
            else 'invalid_transition' end as reason
from f_status_requests r left join f_orders o on r.order_id = o.id"""


def _advanced(t):
    return MU.advance_status(t.orders, t.status_requests, as_of=AS_OF)


@register("M7_advance_status", f"""
select order_id, seq, status, actor_id, actor_role, reason is null as accepted, reason from ({STATUS_OUTCOME_SQL}) x""")
def m7(t):
    """Every status request with its outcome."""
    return _advanced(t).extra["requests"]


@register("M7_orders", f"""
select o.id, coalesce(x.status, o.status) as status
from f_orders o left join (select order_id, status from ({STATUS_OUTCOME_SQL}) y where reason is null) x
on o.id = x.order_id""")
def m7_orders(t):
    return _advanced(t).table.select("id", "status")


# four requests for each order, one for each line item's place in it: a replay in seq order
MANY_STATUS_SQL = """
select order_id, line_no as seq, case (order_id + line_no) % 6 when 0 then 'confirmed' when 1 then 'packed' when 2 then 'shipped'
       when 3 then 'delivered' when 4 then 'cancelled' else 'pending' end as status, 0 as actor_id, 'admin' as actor_role
from f_order_items"""

MANY_STATUS_REPLAY_SQL = f"""
with recursive req as ({MANY_STATUS_SQL}),
walk(order_id, seq, status, accepted) as (
  select id, 0, status, false from f_orders
  union all
  select w.order_id, r.seq,
         case when ok then r.status else w.status end, ok
  from walk w join (select *, true as t from req) r on r.order_id = w.order_id and r.seq = w.seq + 1,
       lateral (select w.status || '>' || r.status in ('pending>confirmed', 'confirmed>packed', 'packed>shipped', 'shipped>delivered',
                                                       'pending>cancelled', 'confirmed>cancelled') as ok) o)
"""


def _many_status_requests(t):
    k = (F.col("order_id") + F.col("line_no")) % 6
    status = F.when(k == 0, "confirmed").when(k == 1, "packed").when(k == 2, "shipped").when(k == 3, "delivered") \
        .when(k == 4, "cancelled").otherwise("pending")
    return t.items.select("order_id", F.col("line_no").alias("seq"), status.alias("status"), F.lit(0).cast("bigint").alias("actor_id"),
                          F.lit("admin").alias("actor_role"))


def _many_status(t):
    return MU.advance_status(t.orders, _many_status_requests(t), as_of=AS_OF)


@register("M7_many_requests", MANY_STATUS_REPLAY_SQL + """
select order_id, seq, accepted from walk where seq > 0""")
def m7_many(t):
    """Several status requests for each order: which are accepted, one after the other."""
    return _many_status(t).extra["requests"].select("order_id", "seq", "accepted")


@register("M7_many_requests_orders", MANY_STATUS_REPLAY_SQL + """
select order_id as id, arg_max(status, seq) as status from walk group by order_id""")
def m7_many_orders(t):
    """The statuses after them."""
    return _many_status(t).table.select("id", "status")


CANCELLED_NOW_SQL = f"select order_id, actor_id from ({STATUS_OUTCOME_SQL}) y where reason is null and status = 'cancelled'"


@register("M8_cancel_orders", f"""
select product_id, changed_by, cast(qa - quantity as int) as quantity_before, cast(qa as int) as quantity_after,
       'order_cancelled' as reason, timestamp '{AS_OF}' as changed_at, order_id as ref_id, line_no
from (select i.product_id, c.actor_id as changed_by, i.quantity, i.order_id, i.line_no,
             p.stock_quantity + sum(i.quantity) over (partition by i.product_id order by i.order_id, i.line_no
               rows between unbounded preceding and current row) as qa
      from f_order_items i join ({CANCELLED_NOW_SQL}) c on i.order_id = c.order_id
      join f_products p on i.product_id = p.id) t""")
def m8(t):
    """Stock given back for the orders cancelled by the status batch."""
    adv = _advanced(t)
    return MU.cancel_orders(t.products, t.items, adv.extra["cancelled"], as_of=AS_OF).audit


# ---------------------------------------------------------------- M6 placement


# The oracle replays the orders one at a time in SQL: a recursive CTE walks
# the valid orders in (created_at, id) order carrying a product -> stock map,
# and accepts an order when every item fits.  Exact, and a few seconds to a
# minute on sf0.01 in DuckDB.
ORDER_REQUESTS_SQL = """
select o.id as request_id, o.user_id, o.created_at, i.line_no, i.product_id, i.quantity
from f_orders o left join f_order_items i on i.order_id = o.id"""

# line 1 of every delivered order asks for product 1 instead (one hot product)
HOT_ORDER_REQUESTS_SQL = f"""
select request_id, user_id, created_at, line_no, quantity,
       case when line_no = 1 and request_id in (select id from f_orders where status = 'delivered')
            then cast(1 as bigint) else product_id end as product_id
from ({ORDER_REQUESTS_SQL}) r"""


def m6_ctes(requests_sql: str) -> str:
    """The replay oracle's CTEs over a request query (flat items)."""
    return M6_CTES.replace("{requests}", requests_sql)


M6_CTES = """
with recursive
req as ({requests}),
agg as (select request_id, count(line_no) as n_items,
               count(*) filter (where line_no is not null and (product_id is null or product_id < 1)) as bad_product,
               count(*) filter (where line_no is not null and (quantity is null or quantity < 1 or quantity > 1000))
                 as bad_qty,
               count(*) filter (where line_no is not null and product_id not in
                                (select id from f_products where deleted_at is null)) as missing
        from req group by request_id),
dup as (select distinct request_id from req where line_no is not null and product_id is not null
        group by request_id, product_id having count(*) > 1),
static as (select a.request_id,
                  case when n_items < 1 then 'no_items' when bad_product > 0 then 'invalid_product_id'
                       when bad_qty > 0 then 'invalid_quantity' when d.request_id is not null then 'duplicate_product'
                       when missing > 0 then 'product_not_found' end as reason
           from agg a left join dup d on a.request_id = d.request_id),
valid as (select r.request_id, min(r.created_at) as created_at,
                 list(struct_pack(p := r.product_id, q := r.quantity)) as items
          from req r join static s on r.request_id = s.request_id and s.reason is null group by r.request_id),
seqd as (select row_number() over (order by created_at, request_id) as k, request_id, items from valid),
walk(k, stock, ok) as (
  select 0::bigint, (select map_from_entries(list(struct_pack(k := id, v := stock_quantity))) from f_products
                     where deleted_at is null), null::boolean
  union all
  select s.k, case when f.fits then map_concat(w.stock, map_from_entries(
                   list_transform(s.items, lambda x: struct_pack(k := x.p, v := w.stock[x.p] - x.q)))) else w.stock end,
         f.fits
  from walk w join seqd s on s.k = w.k + 1,
       lateral (select list_bool_and(list_transform(s.items, lambda x: w.stock[x.p] >= x.q)) as fits) f),
decisions as (
  select st.request_id, coalesce(st.reason is null and sq.ok, false) as accepted,
         coalesce(st.reason, case when sq.ok then null else 'insufficient_stock' end) as reason
  from static st left join (select s.request_id, w.ok from walk w join seqd s on w.k = s.k) sq
    on st.request_id = sq.request_id)"""


def _placed(t):
    from ..operators.allocate import place_orders
    return place_orders(t.products, t.order_request_items, as_of=AS_OF)


@register("M6_place_orders", m6_ctes(ORDER_REQUESTS_SQL) + "\nselect request_id, accepted, reason from decisions")
def m6(t):
    """Every order of the test data placed against the product stock, in
    (created_at, id) order, all-or-nothing per order: accepted or the reason
    it was refused (set-based rounds; the oracle replays order by order)."""
    return _placed(t).decisions


@register("M6_place_orders_audit", m6_ctes(ORDER_REQUESTS_SQL) + """
, placed as (select r.* from req r join decisions d on r.request_id = d.request_id and d.accepted),
led as (select pl.*, p.stock_quantity - sum(pl.quantity) over (partition by pl.product_id
          order by pl.created_at, pl.request_id, pl.line_no rows between unbounded preceding and current row) as qa
        from placed pl join f_products p on pl.product_id = p.id)
select product_id, user_id as changed_by, cast(qa + quantity as int) as quantity_before, cast(qa as int) as quantity_after,
       'order_placed' as reason, created_at as changed_at, request_id as ref_id, line_no from led""")
def m6_audit(t):
    """The order_placed audit rows of the accepted orders (true running stock)."""
    return _placed(t).audit


def _hot_requests(t):
    """Stand-in requests with one hot product: line 1 of every delivered
    order asks for product 1 instead."""
    delivered = t.orders.filter(F.col("status") == "delivered").select(F.col("id").alias("request_id"),
                                                                       F.lit(True).alias("_d"))
    r = t.order_request_items.join(delivered, "request_id", "left")
    return r.withColumn("product_id", F.when(F.col("_d").isNotNull() & (F.col("line_no") == 1),
                                             F.lit(1).cast("bigint")).otherwise(F.col("product_id"))).drop("_d")


@register("M6_place_orders_hot_product",
          m6_ctes(HOT_ORDER_REQUESTS_SQL) + "\nselect request_id, accepted, reason from decisions")
def m6_hot(t):
    """Placement when one product is asked for by a third of all orders: the
    sampled detector (threshold 1,000 rows) splits it by time and id in every round."""
    from ..operators.allocate import place_orders
    return place_orders(t.products, _hot_requests(t), as_of=AS_OF, hot_threshold=1000).decisions


# ---------------------------------------------------------------- M9 users

USER_CHECKED_SQL = f"""
with b as (select seq, {TRIM('name')} as name, lower({TRIM('email')}) as email, coalesce(role, 'user') as role
           from ({USER_BATCH_SQL}) x),
v as (select *, case when name is null or length(name) = 0 then 'name_required' when length(name) > 100 then 'name_too_long'
                     when email is null or not regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')
                       then 'invalid_email'
                     when role not in ('user', 'admin') then 'invalid_role'
                     when role = 'admin' then 'admin_not_allowed' end as r1 from b),
f as (select email, min(seq) as first_seq from v where r1 is null group by email)
select v.seq, v.name, v.email, v.role,
       coalesce(v.r1, case when v.seq <> f.first_seq then 'duplicate_in_batch' end,
                case when v.email in (select email from f_users) then 'email_taken' end) as reason
from v left join f on v.email = f.email"""


def _registered(t):
    return MU.register_users(t.users, user_batch(t), allow_admin=False, as_of=AS_OF)


@register("M9_register_users", f"""
select id, name, email, role from f_users
union all
select (select max(id) from f_users) + seq, name, email, role from ({USER_CHECKED_SQL}) c where reason is null""")
def m9(t):
    return _registered(t).table.select("id", "name", "email", "role")


@register("M9_register_users_rejected", f"select seq, email, reason from ({USER_CHECKED_SQL}) c where reason is not null")
def m9_rejected(t):
    return _registered(t).rejected


# ---------------------------------------------------------------- S2, S5, S6


@register("S2_apply_defaults", f"""
select id, coalesce(created_at, timestamp '{AS_OF}') as created_at, timestamp '{AS_OF}' as updated_at,
       stock_quantity, low_stock_threshold
from f_products""")
def s2(t):
    out = MU.apply_defaults(t.products, "products", AS_OF)
    return out.select("id", "created_at", "updated_at", "stock_quantity", "low_stock_threshold")


@register("S5_seed", "select id, name, cast(null as varchar) as description from f_categories")
def s5(t):
    """The starter catalogue is skipped when live products exist (here they do)."""
    r = MU.seed(t.spark, t.categories, t.products, as_of=AS_OF)
    return r.extra["categories"].select("id", "name", "description")


@register("S5_seed_products", "select id, sku from f_products")
def s5_products(t):
    r = MU.seed(t.spark, t.categories, t.products, as_of=AS_OF)
    return r.table.select("id", "sku")


def _all_archived(t):
    return t.products.withColumn("deleted_at", F.lit(AS_OF).cast("timestamp_ntz"))


# the starter catalogue as the application's seed file gives it
SEEDED_CATEGORIES_SQL = "(values " + ", ".join(f"({k}, '{n}', '{d}')" for k, (n, d) in enumerate(SEED_CATEGORIES, 1)) + ") v(seq, name, description)"
SEEDED_PRODUCTS_SQL = "(values " + ", ".join(
    f"({k}, '{sku}', '{n}', '{d}', '{c}', {p}, {q}, {low})" for k, (sku, n, d, c, p, q, low) in enumerate(SEED_PRODUCTS, 1)) + \
    ") v(seq, sku, name, description, category, price, stock_quantity, low_stock_threshold)"


@register("S5_seed_archived", f"""
select id, name, null as description from f_categories
union all
select (select max(id) from f_categories) + seq, name, description from {SEEDED_CATEGORIES_SQL}""")
def s5_archived(t):
    """Every product is archived, so the starter catalogue is loaded: its categories."""
    return MU.seed(t.spark, t.categories, _all_archived(t), as_of=AS_OF).extra["categories"].select("id", "name", "description")


@register("S5_seed_archived_products", f"""
select id, sku, name, description, category_id, price, stock_quantity, low_stock_threshold from f_products
union all
select (select max(id) from f_products) + v.seq, v.sku, v.name, v.description,
       (select max(id) from f_categories) + c.seq, cast(v.price as decimal(10,2)), v.stock_quantity, v.low_stock_threshold
from {SEEDED_PRODUCTS_SQL} join {SEEDED_CATEGORIES_SQL.replace('v(', 'c(')} on v.category = c.name""")
def s5_archived_products(t):
    """The same: its products, in their categories."""
    return MU.seed(t.spark, t.categories, _all_archived(t), as_of=AS_OF).table.select(
        "id", "sku", "name", "description", "category_id", "price", "stock_quantity", "low_stock_threshold")


@register("S3_write_snapshot", f"""
select p.id, coalesce(b.price, p.price) as price from f_products p
left join ({PATCH_OK_SQL}) b on p.id = b.id and p.deleted_at is null
  and (b.category_id is null or b.category_id in (select id from f_categories))""")
def s3(t):
    """Products written as version 1, the patched table (M2) committed as
    version 2, and the newest committed version read back."""
    root = shared_path(t.spark, "snapshots")
    TB.write_snapshot(t.products.repartition("id"), root, "products")
    TB.write_snapshot(_patched(t).table, root, "products")
    return TB.load_table(t.spark, root, "products").select("id", "price")


@register("S4_append_audit", f"""
select product_id, quantity_before, quantity_after, reason from f_audit_log
union all
select product_id, cast(qa - quantity as int), cast(qa as int), 'manual_restock'
from (select r.*, p.stock_quantity + sum(r.quantity) over (partition by r.product_id
             order by r.requested_at, r.request_id, r.line_no rows between unbounded preceding and current row) as qa
      from ({RESTOCK_OK_SQL}) r join f_products p on r.product_id = p.id) t""")
def s4(t):
    """Two jobs append to one audit table (the whole ledger, then the restock
    audit rows, the second one twice as after a failure); the table is read back whole."""
    root = shared_path(t.spark, "audit")
    TB.append_audit(t.audit, root, "ledger")
    TB.append_audit(_restocked(t).audit, root, "restock")
    TB.append_audit(_restocked(t).audit, root, "restock")
    return TB.load_audit(t.spark, root).select("product_id", "quantity_before", "quantity_after", "reason")


@register("S6_read_request_log", """
select date_trunc('millisecond', ts) as ts, method, url, status, floor(ms * 100) / 100 as ms, request_id, ip
from f_request_log""")
def s6(t):
    """Request-log rows written as the server's JSON lines (ms as a string
    with two decimals, ISO time in ms), then read back by the S6 reader."""
    path = write_request_log_lines(t)
    return TB.read_request_log(t.spark, path)


def _with_bad_lines(t):
    """The log's lines, and one bad line for every event of each second minute: cut off, no JSON, a bad time or number."""
    path = write_request_log_lines(t)
    e = t.raw("events").filter(F.minute("ts") % 2 == 0)
    k = F.col("event_id").cast("string")
    bad = F.when(F.col("event_type") == "view", F.concat(F.lit('{"ts":"2001-01-01T00:00:00.000Z","method":"G'), k)) \
        .when(F.col("event_type") == "click", F.concat(F.lit("server started "), k)) \
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"ts":"yesterday","method":"GET","ms":"1.00","requestId":"'), k, F.lit('"}'))) \
        .otherwise(F.concat(F.lit('{"ts":"2001-01-01T00:00:00.000Z","method":"GET","ms":"fast","requestId":"'), k, F.lit('"}')))
    return t.spark.read.text(path).unionByName(e.select(bad.alias("value")))


@register("S6_bad_lines_left_out", """
select date_trunc('millisecond', ts) as ts, method, url, status, floor(ms * 100) / 100 as ms, request_id, ip
from f_request_log""")
def s6_bad(t):
    """A log with lines that cannot be read: the good ones."""
    return TB.parse_request_log(_with_bad_lines(t))


@register("S6_bad_lines", """
select case event_type when 'view' then 'not_json' when 'click' then 'not_json' when 'purchase' then 'invalid_ts'
                       else 'invalid_ms' end as reason,
       case event_type when 'view' then '{"ts":"2001-01-01T00:00:00.000Z","method":"G' || event_id
                       when 'click' then 'server started ' || event_id
                       when 'purchase' then '{"ts":"yesterday","method":"GET","ms":"1.00","requestId":"' || event_id || '"}'
                       else '{"ts":"2001-01-01T00:00:00.000Z","method":"GET","ms":"fast","requestId":"' || event_id || '"}' end as line
from events where date_part('minute', ts) % 2 = 0""")
def s6_bad_lines(t):
    """The same log: the lines left out, with the reason."""
    return TB.rejected_log_lines(_with_bad_lines(t))


def write_request_log_lines(t, files: int | None = None) -> str:
    """Write the test request log as JSON lines to a new shared folder; ``files``: dealt at random to so many files."""
    log = t.request_log.withColumn("ms", F.floor(F.col("ms") * 100) / 100)
    path = shared_path(t.spark, "request-log")
    lines = TB.to_log_lines(log)
    if files:
        lines = lines.repartition(files, F.xxhash64("value"))
    lines.write.mode("errorifexists").text(path)
    return path

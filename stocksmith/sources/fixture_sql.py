"""The test-table mapping as SQL text, for the independent oracle.

Each block maps the driver's TPC-H-like tables onto this domain.  The oracle
queries inline the blocks they need as CTEs; the Spark side builds the same
tables with DataFrame code in :mod:`stocksmith.sources.fixtures`.
"""

from __future__ import annotations

import re

FIXTURE_SQL: dict[str, str] = {
    "f_users": """
select c_custkey as id, c_name as name,
       concat('user', cast(c_custkey as varchar), '@example.com') as email,
       case when c_custkey % 100 = 0 then 'admin' else 'user' end as role
from customer""",
    "f_categories": """
select distinct cast(substring(p_brand, 7) as int) as id, p_brand as name from part""",
    "f_products": """
select p_partkey as id,
       case when p_partkey % 17 = 0 then null else cast(substring(p_brand, 7) as int) end as category_id,
       p_name as name, p_type as description,
       cast(p_retailprice as decimal(10,2)) as price,
       cast((p_partkey * 7) % 60 as int) as stock_quantity,
       cast(10 + p_size % 11 as int) as low_stock_threshold,
       concat('SKU-', lpad(cast(p_partkey as varchar), 8, '0')) as sku,
       case when p_partkey % 50 = 49 then timestamp '2001-08-01 00:00:00' end as deleted_at,
       case when p_partkey % 97 = 0 then null
            else cast(date '1995-01-01' + cast(p_partkey % 1000 as int) as timestamp) end as created_at
from part""",
    "f_orders": """
select o_orderkey as id, o_custkey as user_id,
       case when o_orderstatus = 'F' then 'delivered'
            when o_orderstatus = 'P' and o_orderkey % 3 = 0 then 'cancelled'
            when o_orderkey % 4 = 0 then 'pending'
            when o_orderkey % 4 = 1 then 'confirmed'
            when o_orderkey % 4 = 2 then 'packed'
            else 'shipped' end as status,
       cast(o_totalprice as decimal(10,2)) as total_amount,
       o_orderdate as created_at
from orders""",
    "f_order_items": """
select l_orderkey as order_id,
       cast(row_number() over (partition by l_orderkey
            order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as int) as line_no,
       l_partkey as product_id,
       cast(l_quantity as int) as quantity,
       cast(cast(cast(floor(round(l_extendedprice * 100) / l_quantity) as bigint) as decimal(12,0))
            * cast(0.01 as decimal(3,2)) as decimal(10,2)) as unit_price
from lineitem""",
    "f_stock_movements": """
select i.product_id, o.user_id as changed_by, -i.quantity as delta, 'order_placed' as reason,
       o.created_at as changed_at, o.id as ref_id, i.line_no
from f_order_items i join f_orders o on i.order_id = o.id
union all
select i.product_id, o.user_id, i.quantity, 'order_cancelled',
       o.created_at + interval '1' day, o.id, i.line_no
from f_order_items i join f_orders o on i.order_id = o.id where o.status = 'cancelled'
union all
select id, case when id % 10 = 0 then null else 0 end, cast(5000 + 1000 * (id % 3) as int), 'manual_restock',
       cast('1994-12-31 00:00:00' as timestamp), -1, 0
from f_products""",
    "f_audit_log": """
select product_id, changed_by, cast(qa - delta as int) as quantity_before, cast(qa as int) as quantity_after,
       reason, changed_at, ref_id, line_no
from (select *, sum(delta) over (partition by product_id
                order by changed_at, ref_id, line_no rows between unbounded preceding and current row) as qa
      from f_stock_movements) t""",
    "f_request_log": """
select ts,
       case event_type when 'view' then 'GET' when 'click' then 'PATCH' when 'error' then 'GET' else 'POST' end as method,
       case event_type when 'view' then '/api/v1/products' when 'click' then '/api/v1/orders/1/status'
                       when 'purchase' then '/api/v1/orders' when 'signup' then '/api/v1/auth/register'
                       else '/api/v1/reports/low-stock' end as url,
       case when event_type = 'error' then 500 when event_type = 'view' then 200
            when event_id % 7 = 0 then 404 when event_id % 11 = 0 then 302 else 201 end as status,
       value as ms, cast(event_id as varchar) as request_id, cast(user_id as varchar) as ip, user_id as session_key
from events""",
    "f_revocations": """
select user_id as key, ts as revoked_at, ts + interval '7' day as expires_at
from events where event_type = 'signup'""",
    "f_status_requests": """
select o_orderkey as order_id,
       case o_orderkey % 6 when 0 then 'pending' when 1 then 'confirmed' when 2 then 'packed'
            when 3 then 'shipped' when 4 then 'delivered' else 'cancelled' end as status,
       case when o_orderkey % 5 = 0 then o_custkey else 0 end as actor_id,
       case when o_orderkey % 5 = 0 then 'user' else 'admin' end as actor_role,
       o_orderkey as seq
from orders""",
}


def _deps(name: str) -> list[str]:
    body = FIXTURE_SQL[name]
    return [d for d in FIXTURE_SQL if d != name and re.search(rf"\b{d}\b", body)]


def with_fixtures(sql: str) -> str:
    """Prefix ``sql`` with the fixture CTEs it uses (and theirs)."""
    needed: list[str] = []

    def visit(n: str) -> None:
        for d in _deps(n):
            visit(d)
        if n not in needed:
            needed.append(n)

    for n in FIXTURE_SQL:
        if re.search(rf"\b{n}\b", sql):
            visit(n)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} as ({FIXTURE_SQL[n].strip()})" for n in needed)
    body = sql.strip()
    m = re.match(r"(?is)^with\s+recursive\s", body)
    if m:
        return f"with recursive {ctes},\n{body[m.end():].lstrip()}"
    if re.match(r"(?is)^with\s", body):
        return f"with {ctes},\n{body[4:].lstrip()}"
    return f"with {ctes}\n{body}"

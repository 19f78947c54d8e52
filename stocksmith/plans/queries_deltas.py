"""Registered reports that are kept up by three batches of changes: orders placed,
status changes (M7, some cancel), and old pending orders cancelled."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deltas as D
from ..operators import mutate as MU
from ..session import shared_path
from .catalog import CENTS, FROM_CENTS, HALF_UP, register
from .queries_read import R2_SQL, _sales_summary_sql
from .queries_write import AS_OF, STATUS_OUTCOME_SQL

PLACED_FROM, CANCELLED_BEFORE = "1995-01-01 00:00:00", "1996-01-01 00:00:00"

# the orders after all three batches
FINAL_SQL = f"""
select id, user_id, created_at, total_amount,
       case when st = 'pending' and created_at < timestamp '{CANCELLED_BEFORE}' then 'cancelled' else st end as status
from (select o.id, o.user_id, o.created_at, o.total_amount, coalesce(x.status, o.status) as st
      from f_orders o left join (select order_id, status from ({STATUS_OUTCOME_SQL}) y where reason is null) x on o.id = x.order_id) z"""


def _final(sql: str) -> str:
    sql = sql.strip().replace("f_orders", "final_orders")
    head = f"with final_orders as ({FINAL_SQL})"
    return f"{head}, {sql[len('with '):]}" if sql.startswith("with ") else f"{head}\n{sql}"


def _saved(t, df):
    path = shared_path(t.spark, "report-state")
    df.write.parquet(path)
    return t.spark.read.schema(df.schema).parquet(path)


def _kept_up(t, name: str):
    """The state ``name`` after the three batches, written after each."""
    orders, items = t.orders, t.items if name == "products" else None
    old = F.coalesce(F.col("created_at") < F.lit(PLACED_FROM).cast("timestamp_ntz"), F.lit(False))
    state = _saved(t, D.initial(name, orders.where(old), items))
    adv = MU.advance_status(orders, t.status_requests, as_of=AS_OF)
    moved = adv.extra["requests"].where("accepted").select("order_id").distinct()
    late = adv.table.where((F.col("status") == "pending") & (F.col("created_at") < F.lit(CANCELLED_BEFORE).cast("timestamp_ntz")))
    batches = [(None, orders.where(~old)), D.images(orders, adv.table, moved), (late, late.withColumn("status", F.lit("cancelled")))]
    for before, after in batches:
        state = _saved(t, D.merge(name, state, D.delta(name, before, after, items)))
    return state


@register("R2_deltas", _final(R2_SQL))
def r2_deltas(t):
    """Top products after the batches; cancelled orders are taken back."""
    return D.top_products(_kept_up(t, "products"), t.products, t.categories, 10)


@register("R3_deltas", _final(_sales_summary_sql("month")))
def r3_deltas(t):
    return D.sales_summary(_kept_up(t, "sales"), "month")


@register("R3_deltas_week", _final(_sales_summary_sql("week")))
def r3_deltas_week(t):
    return D.sales_summary(_kept_up(t, "sales"), "week")


@register("R4_deltas", _final(f"""
with per_user as (
  select user_id, count(*) as total_orders, count(*) filter (where status = 'delivered') as completed_orders,
         sum({CENTS('total_amount')}) filter (where status <> 'cancelled') as c,
         count(*) filter (where status <> 'cancelled') as n
  from f_orders where user_id is not null group by user_id)
select pu.user_id, u.name as customer_name, u.email, pu.total_orders, pu.completed_orders,
       {FROM_CENTS('coalesce(pu.c, 0)')} as lifetime_value, {FROM_CENTS(HALF_UP('pu.c', 'pu.n'))} as avg_order_value
from per_user pu join f_users u on pu.user_id = u.id
order by lifetime_value desc, pu.user_id limit 10"""))
def r4_deltas(t):
    return D.customer_analytics(_kept_up(t, "customers"), t.users, 10)


@register("R6_deltas", _final(f"""
select count(*) as total_orders, count(*) filter (where status = 'pending') as pending_orders,
       count(*) filter (where status = 'delivered') as delivered_orders,
       count(*) filter (where status = 'cancelled') as cancelled_orders,
       {FROM_CENTS(f"coalesce(sum({CENTS('total_amount')}) filter (where status <> 'cancelled'), 0)")} as total_revenue,
       {FROM_CENTS(HALF_UP(f"sum({CENTS('total_amount')}) filter (where status <> 'cancelled')",
                           "count(*) filter (where status <> 'cancelled')"))} as avg_order_value
from f_orders"""))
def r6_deltas(t):
    return D.order_kpis(_kept_up(t, "statuses"))

"""Stand-in tables that break every constraint of the schema, and their SQL.

Each table holds some of its rows a second time with some fields changed by
the expressions below (the same text for Spark and DuckDB); the checks
themselves are the library's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# table: (which rows occur a second time, changed fields of the second copies)
FLAWS = {
    "users": ("id % 25 = 0", {
        "name": "case when id % 50 = 25 then null when id % 100 = 50 then repeat('x', 101) else name end",
        "email": "case when id % 75 = 0 then repeat('e', 151) when id % 125 = 0 then null else email end",
        "role": "case when id % 100 = 0 then 'guest' else role end",
        "id": "case when id % 150 = 0 then null else id end"}),
    "categories": ("id % 2 = 0", {
        "name": "case when id % 4 = 0 then null when id % 6 = 0 then repeat('c', 101) else name end",
        "id": "case when id % 10 = 0 then null else id end"}),
    "products": ("id % 20 = 0", {
        "category_id": "case when id % 40 = 0 then 9999 else category_id end",
        "name": "case when id % 60 = 0 then null when id % 100 = 0 then repeat('p', 201) else name end",
        "price": "case when id % 80 = 0 then null else price end",
        "stock_quantity": "case when id % 120 = 0 then null else stock_quantity end",
        "low_stock_threshold": "case when id % 140 = 0 then null else low_stock_threshold end",
        "sku": "case when id % 160 = 0 then null when id % 180 = 0 then repeat('s', 101) else sku end"}),
    "orders": ("id % 50 = 0", {
        "user_id": "case when id % 100 = 0 then -1 else user_id end",
        "status": "case when id % 150 = 0 then 'lost' else status end",
        "total_amount": "case when id % 250 = 0 then null else total_amount end"}),
    "order_items": ("order_id % 50 = 0", {
        "order_id": "case when order_id % 100 = 0 then -order_id else order_id end",
        "line_no": "case when order_id % 150 = 0 then null else line_no end",
        "product_id": "case when order_id % 200 = 0 then -product_id else product_id end",
        "quantity": "case when order_id % 250 = 0 then null else quantity end",
        "unit_price": "case when order_id % 300 = 0 then null else unit_price end"}),
    "stock_audit_log": ("ref_id % 50 = 0", {
        "product_id": "case when ref_id % 100 = 0 then -product_id else product_id end",
        "changed_by": "case when ref_id % 150 = 0 then -7 else changed_by end",
        "quantity_before": "case when ref_id % 200 = 0 then null else quantity_before end",
        "quantity_after": "case when ref_id % 250 = 0 then null else quantity_after end",
        "reason": "case when ref_id % 300 = 0 then null when ref_id % 350 = 0 then repeat('r', 101) else reason end"}),
}
SOURCE = {"users": "f_users", "categories": "f_categories", "products": "f_products", "orders": "f_orders",
          "order_items": "f_order_items", "stock_audit_log": "f_audit_log"}


def flawed(t) -> dict[str, DataFrame]:
    """All six tables with their second copies."""
    out = {}
    for name, (which, changed) in FLAWS.items():
        df = t.domain()[name]
        again = df.where(which).select(*[F.expr(changed[c]).cast(df.schema[c].dataType).alias(c) if c in changed
                                         else F.col(c) for c in df.columns])
        out[name] = df.unionByName(again)
    return out


# The schema's rules, written out for the oracle: keys, references, lengths, lists.
_KEYS = [("users", "primary_key", ["id"]), ("categories", "primary_key", ["id"]), ("products", "primary_key", ["id"]),
         ("orders", "primary_key", ["id"]), ("order_items", "primary_key", ["order_id", "line_no"]),
         ("users", "unique", ["email"]), ("categories", "unique", ["name"]), ("products", "unique", ["sku"])]
_NEEDED = {"users": ["id", "name", "email"], "categories": ["id", "name"],
           "products": ["id", "name", "price", "stock_quantity", "low_stock_threshold", "sku"],
           "orders": ["id", "total_amount"], "order_items": ["order_id", "line_no", "quantity", "unit_price"],
           "stock_audit_log": ["quantity_before", "quantity_after", "reason"]}
_LONGEST = [("users", "name", 100), ("users", "email", 150), ("categories", "name", 100), ("products", "name", 200),
            ("products", "sku", 100), ("stock_audit_log", "reason", 100)]
_PARENTS = [("products", "category_id", "categories"), ("orders", "user_id", "users"), ("order_items", "order_id", "orders"),
            ("order_items", "product_id", "products"), ("stock_audit_log", "product_id", "products"),
            ("stock_audit_log", "changed_by", "users")]
_LISTS = [("users", "role", "'user', 'admin'"),
          ("orders", "status", "'pending', 'confirmed', 'packed', 'shipped', 'delivered', 'cancelled'")]


def flawed_sql(select: str) -> str:
    """``select`` over ``broken``: every violated rule of the flawed tables."""
    ctes = []
    for name, (which, changed) in FLAWS.items():
        ctes.append(f"x_{name} as (select * from {SOURCE[name]} union all select * replace ("
                    + ", ".join(f"{e} as {c}" for c, e in changed.items()) + f") from {SOURCE[name]} where {which})")
    parts = []
    for name, rule, cols in _KEYS:
        value = " || '|' || ".join(f"cast({c} as varchar)" for c in cols)
        there = " and ".join(f"{c} is not null" for c in cols)
        parts.append(f"select '{name}' as table_name, '{rule}' as rule, '{','.join(cols)}' as key_columns, {value} as key_value, "
                     f"count(*) as rows from x_{name} where {there} group by {', '.join(cols)} having count(*) > 1")
    for name, cols in _NEEDED.items():
        parts += [f"select '{name}', 'not_null', '{c}', null, count(*) from x_{name} where {c} is null having count(*) > 0" for c in cols]
    parts += [f"select '{n}', 'length', '{c}', null, count(*) from x_{n} where length({c}) > {k} having count(*) > 0" for n, c, k in _LONGEST]
    parts += [f"select '{n}', 'check', '{c}', {c}, count(*) from x_{n} where {c} not in ({v}) group by {c}" for n, c, v in _LISTS]
    parts += [f"select '{n}', 'foreign_key', '{c}', cast({c} as varchar), count(*) from x_{n} where {c} is not null and {c} not in "
              f"(select id from x_{p} where id is not null) group by {c}" for n, c, p in _PARENTS]
    return "with " + ",\n".join(ctes) + ",\nbroken as (" + "\nunion all\n".join(parts) + ")" + select

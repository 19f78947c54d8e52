"""Derived columns (P2-P7) and small Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import schemas as S


def units_needed() -> Column:                                           # P2
    return (F.col("low_stock_threshold") - F.col("stock_quantity")).alias("units_needed")


def line_total(qty: str = "quantity", price: str = "unit_price") -> Column:   # P3
    """Exact decimal quantity * unit price."""
    return (F.col(qty).cast("decimal(10,0)") * F.col(price)).cast("decimal(18,2)")


def stock_delta() -> list[Column]:                                      # P4
    d = F.col("quantity_after") - F.col("quantity_before")
    return [d.alias("delta"), (d > 0).alias("is_increase"),
            F.when(d > 0, F.concat(F.lit("+"), d.cast("string"))).otherwise(d.cast("string")).alias("delta_text")]


def blank_to_null(c: Column) -> Column:
    """JavaScript's ``x || y`` treats '' like a missing value."""
    return F.when(c == "", F.lit(None)).otherwise(c)


def audit_labels() -> list[Column]:                                     # P5
    reason = F.coalesce(F.replace(blank_to_null(F.col("reason")), F.lit("_"), F.lit(" ")), F.lit("unknown"))
    actor = F.coalesce(blank_to_null(F.col("changed_by_name")), F.lit("System"))
    product = F.coalesce(blank_to_null(F.col("product_name")),
                         F.concat(F.lit("Product #"), F.col("product_id").cast("string")))
    return [reason.alias("reason_label"), actor.alias("actor_label"), product.alias("product_label")]


def next_status(status: str = "status") -> list[Column]:               # P6
    flow = S.STATUS_FLOW
    pairs = []
    for a, b in zip(flow, flow[1:]):
        pairs += [F.lit(a), F.lit(b)]
    nxt = F.try_element_at(F.create_map(*pairs), F.col(status))
    return [nxt.alias("next_status"), F.col(status).isin(*S.CANCELLABLE_FROM).alias("can_cancel")]


def stock_state() -> Column:                                            # P7
    return (F.when(F.col("stock_quantity") <= 0, "out")
            .when(F.col("stock_quantity") <= F.col("low_stock_threshold"), "low")
            .otherwise("ok")).alias("stock_state")


def status_count(status: str, col: str = "status") -> Column:
    return F.count_if(F.col(col) == F.lit(status))

"""Row predicates (F1-F11) and the product sort whitelist (G3), as Columns.

Options follow the list endpoints: an empty string or None means "no
filter"; search text is matched with ILIKE and its ``%``/``_`` act as
wildcards, exactly like the application's bound ``%text%`` parameter.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import schemas as S


def _given(v) -> bool:
    return v is not None and v != ""


def live(prefix: str = "") -> Column:                                   # F1
    return F.col(f"{prefix}deleted_at").isNull()


def search(text: str | None, prefix: str = "") -> Column | None:        # F2
    if not text:
        return None
    pat = f"%{text}%"
    return F.col(f"{prefix}name").ilike(pat) | F.col(f"{prefix}sku").ilike(pat)


def category(category_id, prefix: str = "") -> Column | None:           # F3
    if not category_id:            # falsy (None, '', 0) means no filter
        return None
    return F.col(f"{prefix}category_id") == F.lit(int(category_id))


def price_between(min_price=None, max_price=None, prefix: str = "") -> Column | None:   # F4
    preds = []
    if _given(min_price):
        preds.append(F.col(f"{prefix}price") >= F.lit(Decimal(str(min_price))))
    if _given(max_price):
        preds.append(F.col(f"{prefix}price") <= F.lit(Decimal(str(max_price))))
    return reduce(and_, preds) if preds else None


def low_stock_flag(flag) -> bool:
    """The list endpoint turns the filter on only for 'true' or '1'."""
    return flag is True or str(flag) in ("true", "1")


def low_stock(prefix: str = "") -> Column:                              # F5
    return F.col(f"{prefix}stock_quantity") <= F.col(f"{prefix}low_stock_threshold")


def conjunction(preds: list[Column | None]) -> Column:                  # F6
    given = [p for p in preds if p is not None]
    return reduce(and_, given) if given else F.lit(True)


def product_filter(search_text=None, category_id=None, min_price=None, max_price=None,
                   low_stock_opt=None, prefix: str = "") -> Column:
    """The product list's WHERE clause: live AND whichever options are set."""
    return conjunction([
        live(prefix), search(search_text, prefix), category(category_id, prefix),
        price_between(min_price, max_price, prefix),
        low_stock(prefix) if low_stock_flag(low_stock_opt) else None,
    ])


def order_filter(status: str | None = None, user_id=None, prefix: str = "") -> Column:   # F7
    return conjunction([
        F.col(f"{prefix}status") == F.lit(status) if status else None,
        F.col(f"{prefix}user_id") == F.lit(int(user_id)) if user_id else None,
    ])


def audit_filter(product_id=None, prefix: str = "") -> Column:          # F8
    return conjunction([F.col(f"{prefix}product_id") == F.lit(int(product_id)) if product_id else None])


def visible_to(viewer_id, viewer_role: str, prefix: str = "") -> Column:   # F10
    """Admins see every order, anyone else only their own."""
    if viewer_role == "admin":
        return F.lit(True)
    return F.col(f"{prefix}user_id") == F.lit(int(viewer_id))


def in_stock(prefix: str = "") -> Column:                               # F11
    return F.col(f"{prefix}stock_quantity") > 0


def safe_sort(sort_by: str | None, sort_order: str | None) -> tuple[str, bool]:   # G3
    """Whitelisted sort column and direction (True = ascending).
    Unknown columns fall back to created_at; any direction but ASC is DESC."""
    col = sort_by if sort_by in S.PRODUCT_SORT_COLUMNS else S.DEFAULT_PRODUCT_SORT
    asc = (sort_order or "DESC").upper() == "ASC"
    return col, asc


def sort_columns(col: str, asc: bool, tie: str = "id", prefix: str = "") -> list[Column]:
    """ORDER BY with the database's NULL placement (last for ASC, first for
    DESC) and an id tie-break so pages are stable."""
    c = F.col(f"{prefix}{col}")
    return [c.asc_nulls_last() if asc else c.desc_nulls_first(), F.col(f"{prefix}{tie}").asc()]

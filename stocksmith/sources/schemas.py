"""Table schemas and the fixed values of the domain.

Fixed values (they must equal the application's for equal results):
statuses, the status flow, cancellable statuses, roles, sortable product
columns, default page sizes, validation limits, audit reasons and the seed
catalogue.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
ORDER_STATUSES = ["pending", "confirmed", "packed", "shipped", "delivered", "cancelled"]
STATUS_FLOW = ["pending", "confirmed", "packed", "shipped", "delivered"]
CANCELLABLE_FROM = ["pending", "confirmed"]
ROLES = ["user", "admin"]
PRODUCT_SORT_COLUMNS = ["name", "price", "stock_quantity", "created_at", "updated_at"]
DEFAULT_PRODUCT_SORT = "created_at"
PAGE_SIZE = {"products": 20, "orders": 10, "audit": 20}
MAX_ITEM_QUANTITY = 1000
MAX_RESTOCK_QUANTITY = 10000
MAX_NOTES_LENGTH = 500
MAX_PRODUCT_NAME = 200
MAX_SKU_LENGTH = 100
MAX_USER_NAME = 100
MAX_EMAIL = 150
MAX_CATEGORY_NAME = 100
MAX_REASON = 100
SKU_PATTERN = r"^[A-Za-z0-9_\-]+$"
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
REASON_ORDER_PLACED = "order_placed"
REASON_ORDER_CANCELLED = "order_cancelled"
REASON_RESTOCK = "manual_restock"
DEFAULTS = {"role": "user", "status": "pending", "stock_quantity": 0, "low_stock_threshold": 10}

SEED_CATEGORIES = [
    ("Electronics", "Gadgets, devices, and accessories"),
    ("Groceries", "Everyday food and household staples"),
    ("Stationery", "Office and school supplies"),
]
# (sku, name, description, category, price, stock_quantity, low_stock_threshold)
SEED_PRODUCTS = [
    ("ELEC-001", "Wireless Mouse", "Ergonomic 2.4GHz wireless mouse with USB receiver, DPI adjustable up to 1600.",
     "Electronics", Decimal("599.00"), 40, 10),
    ("ELEC-002", "USB-C Charging Cable", "1-metre braided USB-C to USB-A fast-charging cable, compatible with most "
     "smartphones and laptops.", "Electronics", Decimal("299.00"), 60, 15),
    ("ELEC-003", "Bluetooth Headphones", "Over-ear wireless headphones with active noise cancellation and 30-hour "
     "battery life.", "Electronics", Decimal("1999.00"), 8, 10),
    ("GROC-001", "Basmati Rice (5kg)", "Premium aged long-grain basmati rice, ideal for biryanis and everyday "
     "cooking.", "Groceries", Decimal("450.00"), 25, 5),
    ("GROC-002", "Cooking Oil (1L)", "Refined sunflower cooking oil, low in saturated fat, suitable for frying and "
     "baking.", "Groceries", Decimal("180.00"), 50, 10),
    ("STAT-001", "A4 Notebook (200pg)", "Ruled A4 notebook with 200 pages, hard cover, and micro-perforated tear-out "
     "sheets.", "Stationery", Decimal("60.00"), 100, 20),
    ("STAT-002", "Ballpoint Pen (Pack of 10)", "Smooth-writing blue ballpoint pens, pack of 10, suitable for office "
     "and school use.", "Stationery", Decimal("90.00"), 3, 15),
]


def transitions() -> list[tuple[str, str]]:
    """The legal (from, to) status pairs: one step forward, or a cancel."""
    steps = list(zip(STATUS_FLOW, STATUS_FLOW[1:]))
    return steps + [(s, "cancelled") for s in CANCELLABLE_FROM]


# ---------------------------------------------------------------- schemas
MONEY = T.DecimalType(10, 2)
TS = T.TimestampNTZType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


USERS = _st(("id", T.LongType(), False), ("name", T.StringType(), False), ("email", T.StringType(), False),
            ("role", T.StringType(), True), ("created_at", TS, True))
CATEGORIES = _st(("id", T.IntegerType(), False), ("name", T.StringType(), False),
                 ("description", T.StringType(), True), ("created_at", TS, True))
PRODUCTS = _st(("id", T.LongType(), False), ("category_id", T.IntegerType(), True), ("name", T.StringType(), False),
               ("description", T.StringType(), True), ("price", MONEY, False),
               ("stock_quantity", T.IntegerType(), False), ("low_stock_threshold", T.IntegerType(), False),
               ("sku", T.StringType(), False), ("deleted_at", TS, True), ("created_at", TS, True),
               ("updated_at", TS, True))
ORDERS = _st(("id", T.LongType(), False), ("user_id", T.LongType(), True), ("status", T.StringType(), True),
             ("total_amount", MONEY, False), ("notes", T.StringType(), True), ("created_at", TS, True),
             ("updated_at", TS, True))
ORDER_ITEMS = _st(("order_id", T.LongType(), True), ("line_no", T.IntegerType(), False),
                  ("product_id", T.LongType(), True), ("quantity", T.IntegerType(), False),
                  ("unit_price", MONEY, False))
STOCK_AUDIT_LOG = _st(("product_id", T.LongType(), True), ("changed_by", T.LongType(), True),
                      ("quantity_before", T.IntegerType(), False), ("quantity_after", T.IntegerType(), False),
                      ("reason", T.StringType(), False), ("changed_at", TS, True),
                      ("ref_id", T.LongType(), True), ("line_no", T.IntegerType(), True))
REQUEST_LOG = _st(("ts", T.TimestampType(), True), ("method", T.StringType(), True), ("url", T.StringType(), True),
                  ("status", T.IntegerType(), True), ("ms", T.DoubleType(), True),
                  ("request_id", T.StringType(), True), ("ip", T.StringType(), True))
# The JSON log line: `ms` is written as a string with two decimals.
REQUEST_LOG_JSON = _st(("ts", T.StringType(), True), ("method", T.StringType(), True), ("url", T.StringType(), True),
                       ("status", T.IntegerType(), True), ("ms", T.StringType(), True),
                       ("requestId", T.StringType(), True), ("ip", T.StringType(), True))

TABLES = {
    "users": USERS, "categories": CATEGORIES, "products": PRODUCTS, "orders": ORDERS,
    "order_items": ORDER_ITEMS, "stock_audit_log": STOCK_AUDIT_LOG,
}

# Primary and unique keys, and foreign keys with their delete rule.
PRIMARY_KEYS = {"users": ["id"], "categories": ["id"], "products": ["id"], "orders": ["id"],
                "order_items": ["order_id", "line_no"]}
UNIQUE_KEYS = {"users": ["email"], "categories": ["name"], "products": ["sku"]}
# (child table, column, parent table, rule on parent delete)
FOREIGN_KEYS = [
    ("products", "category_id", "categories", "set_null"),
    ("orders", "user_id", "users", "cascade"),
    ("order_items", "order_id", "orders", "cascade"),
    ("order_items", "product_id", "products", "restrict"),
    ("stock_audit_log", "product_id", "products", "cascade"),
    ("stock_audit_log", "changed_by", "users", "set_null"),
]
NOT_NULL = {
    "users": ["name", "email"], "categories": ["name"],
    "products": ["name", "price", "stock_quantity", "low_stock_threshold", "sku"],
    "orders": ["total_amount"], "order_items": ["quantity", "unit_price"],
    "stock_audit_log": ["quantity_before", "quantity_after", "reason"],
}
MAX_LENGTHS = {
    "users": {"name": MAX_USER_NAME, "email": MAX_EMAIL}, "categories": {"name": MAX_CATEGORY_NAME},
    "products": {"name": MAX_PRODUCT_NAME, "sku": MAX_SKU_LENGTH}, "stock_audit_log": {"reason": MAX_REASON},
}
CHECKS = {"users": ("role", ROLES), "orders": ("status", ORDER_STATUSES)}

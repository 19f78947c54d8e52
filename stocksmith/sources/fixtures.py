"""Domain tables built from the driver's test tables (TPC-H-like).

These only give rows in the schemas of :mod:`stocksmith.sources.schemas`;
the jobs themselves never rely on how the rows were made.  The mapping is the
same as the SQL in :mod:`stocksmith.sources.fixture_sql`, written with the
DataFrame API.  The two windows of that SQL (line numbers per order, running
stock per product) go through :mod:`stocksmith.operators.running`, so a hot
order or product is split over many tasks.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import running
from . import schemas as S


def raw(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def _brand_id(col: str = "p_brand"):
    return F.substring(F.col(col), 7, 1000).cast("int")


def users(spark: SparkSession, d: str) -> DataFrame:
    c = raw(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.when(F.col("c_custkey") % 100 == 0, "admin").otherwise("user").alias("role"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"))


def categories(spark: SparkSession, d: str) -> DataFrame:
    p = raw(spark, d, "part")
    return (p.select(_brand_id().alias("id"), F.col("p_brand").alias("name")).distinct()
            .select("id", "name", F.lit(None).cast("string").alias("description"),
                    F.lit(None).cast("timestamp_ntz").alias("created_at")))


def products(spark: SparkSession, d: str) -> DataFrame:
    p = raw(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"),
        F.when(k % 17 == 0, F.lit(None).cast("int")).otherwise(_brand_id()).alias("category_id"),
        F.col("p_name").alias("name"), F.col("p_type").alias("description"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
        ((k * 7) % 60).cast("int").alias("stock_quantity"),
        (F.lit(10) + F.col("p_size") % 11).cast("int").alias("low_stock_threshold"),
        F.concat(F.lit("SKU-"), F.lpad(k.cast("string"), 8, "0")).alias("sku"),
        F.when(k % 50 == 49, F.lit("2001-08-01 00:00:00").cast("timestamp_ntz")).alias("deleted_at"),
        F.when(k % 97 == 0, F.lit(None).cast("timestamp_ntz"))
         .otherwise(F.date_add(F.lit("1995-01-01").cast("date"), (k % 1000).cast("int")).cast("timestamp_ntz"))
         .alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    o = raw(spark, d, "orders")
    k = F.col("o_orderkey")
    status = (F.when(F.col("o_orderstatus") == "F", "delivered")
              .when((F.col("o_orderstatus") == "P") & (k % 3 == 0), "cancelled")
              .when(k % 4 == 0, "pending").when(k % 4 == 1, "confirmed").when(k % 4 == 2, "packed")
              .otherwise("shipped"))
    return o.select(
        k.alias("id"), F.col("o_custkey").alias("user_id"), status.alias("status"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("total_amount"),
        F.lit(None).cast("string").alias("notes"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"))


def order_items(spark: SparkSession, d: str, hot_threshold: int | None = None) -> DataFrame:
    """One row per line item; ``line_no`` numbers the lines of an order in
    the order of their columns (W5).

    Discount, tax and ship date come last in that order and are not in the
    result: lines that differ in these alone give the same rows whichever is
    first, so these columns are not shuffled."""
    li = raw(spark, d, "lineitem")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    numbered = running.running_sum(li, ["l_orderkey"], order, F.lit(1), "_rn",
                                   chunk=[F.coalesce(F.col("l_linenumber").cast("bigint"), F.lit(-(2**62))),
                                          F.coalesce(F.floor(F.col("l_partkey") / running.ID_BLOCK), F.lit(-(2**62)))], threshold=hot_threshold)
    cents = F.floor(F.round(F.col("l_extendedprice") * 100) / F.col("l_quantity")).cast("bigint")
    unit_price = (cents.cast("decimal(12,0)") * F.lit(Decimal("0.01")).cast("decimal(3,2)")).cast("decimal(10,2)")
    return numbered.select(
        F.col("l_orderkey").alias("order_id"), F.col("_rn").cast("int").alias("line_no"),
        F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity"),
        unit_price.alias("unit_price"))


def stock_movements(spark: SparkSession, d: str, items: DataFrame | None = None,
                    ords: DataFrame | None = None, prods: DataFrame | None = None) -> DataFrame:
    """Signed stock changes: placed orders, cancelled orders, one restock per product."""
    items = items if items is not None else order_items(spark, d)
    ords = ords if ords is not None else orders(spark, d)
    prods = prods if prods is not None else products(spark, d)
    io = items.join(ords.select(F.col("id").alias("order_id"), "user_id", "status", "created_at"), "order_id")
    # one pass over the joined items: every item is placed, and given back a
    # day later if its order was cancelled (explode of one or two rows)
    placed = F.struct(F.lit(-1).alias("sign"), F.lit(S.REASON_ORDER_PLACED).alias("reason"),
                      F.col("created_at").alias("changed_at"))
    given_back = F.struct(F.lit(1).alias("sign"), F.lit(S.REASON_ORDER_CANCELLED).alias("reason"),
                          (F.col("created_at") + F.expr("interval 1 day")).alias("changed_at"))
    moves = io.select("product_id", "user_id", "quantity", "order_id", "line_no", F.explode(
        F.when(F.col("status") == "cancelled", F.array(placed, given_back)).otherwise(F.array(placed))).alias("m"))
    orders_moves = moves.select(
        "product_id", F.col("user_id").alias("changed_by"), (F.col("m.sign") * F.col("quantity")).alias("delta"),
        F.col("m.reason").alias("reason"), F.col("m.changed_at").alias("changed_at"),
        F.col("order_id").alias("ref_id"), "line_no")
    k = F.col("id")
    restock = prods.select(
        k.alias("product_id"), F.when(k % 10 == 0, F.lit(None).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        .alias("changed_by"), (F.lit(5000) + F.lit(1000) * (k % 3)).cast("int").alias("delta"),
        F.lit(S.REASON_RESTOCK).alias("reason"), F.lit("1994-12-31 00:00:00").cast("timestamp_ntz").alias("changed_at"),
        F.lit(-1).cast("bigint").alias("ref_id"), F.lit(0).cast("int").alias("line_no"))
    return orders_moves.unionByName(restock)


def audit_log(spark: SparkSession, d: str, movements: DataFrame | None = None) -> DataFrame:
    from ..operators.relations import stock_ledger
    mv = movements if movements is not None else stock_movements(spark, d)
    return stock_ledger(mv, start=None)


def request_log(spark: SparkSession, d: str) -> DataFrame:
    return request_log_from(raw(spark, d, "events"))


def request_log_from(e: DataFrame) -> DataFrame:
    """Events (batch or stream) mapped to request-log rows."""
    et = F.col("event_type")
    method = (F.when(et == "view", "GET").when(et == "click", "PATCH").when(et == "error", "GET").otherwise("POST"))
    url = (F.when(et == "view", "/api/v1/products").when(et == "click", "/api/v1/orders/1/status")
           .when(et == "purchase", "/api/v1/orders").when(et == "signup", "/api/v1/auth/register")
           .otherwise("/api/v1/reports/low-stock"))
    status = (F.when(et == "error", 500).when(et == "view", 200).when(F.col("event_id") % 7 == 0, 404)
              .when(F.col("event_id") % 11 == 0, 302).otherwise(201))
    return e.select("ts", method.alias("method"), url.alias("url"), status.cast("int").alias("status"),
                    F.col("value").alias("ms"), F.col("event_id").cast("string").alias("request_id"),
                    F.col("user_id").cast("string").alias("ip"), F.col("user_id").alias("session_key"))


def revocations(spark: SparkSession, d: str) -> DataFrame:
    return revocations_from(raw(spark, d, "events"))


def revocations_from(events: DataFrame) -> DataFrame:
    """Every sign-up event revokes its user's key for 7 days."""
    e = events.filter(F.col("event_type") == "signup")
    return e.select(F.col("user_id").alias("key"), F.col("ts").alias("revoked_at"),
                    (F.col("ts") + F.expr("interval 7 days")).alias("expires_at"))


def status_requests(spark: SparkSession, d: str) -> DataFrame:
    return status_requests_from(raw(spark, d, "orders"))


def status_requests_from(o: DataFrame) -> DataFrame:
    """One status request per order row (batch or stream)."""
    k = F.col("o_orderkey")
    m = k % 6
    status = (F.when(m == 0, "pending").when(m == 1, "confirmed").when(m == 2, "packed").when(m == 3, "shipped")
              .when(m == 4, "delivered").otherwise("cancelled"))
    by_user = k % 5 == 0
    return o.select(k.alias("order_id"), status.alias("status"),
                    F.when(by_user, F.col("o_custkey")).otherwise(F.lit(0).cast("bigint")).alias("actor_id"),
                    F.when(by_user, "user").otherwise("admin").alias("actor_role"), k.alias("seq"))


def order_request_items(spark: SparkSession, d: str, items: DataFrame | None = None,
                        ords: DataFrame | None = None) -> DataFrame:
    """Order requests in flat form: one row per requested item, with the
    request header (user, time) repeated.  Each request is an order of the
    test data; ``request_id`` is its id."""
    items = items if items is not None else order_items(spark, d)
    ords = ords if ords is not None else orders(spark, d)
    head = ords.select(F.col("id").alias("request_id"), "user_id", "notes", "created_at")
    return items.select(F.col("order_id").alias("request_id"), "line_no", "product_id", "quantity") \
        .join(head, "request_id", "right")


class Tables:
    """The domain tables of one test-data folder, built on first use."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d
        self._cache: dict[str, DataFrame] = {}

    def _get(self, name: str, make) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = make()
        return self._cache[name]

    def raw(self, name: str) -> DataFrame:
        return raw(self.spark, self.d, name)

    @property
    def users(self) -> DataFrame:
        return self._get("users", lambda: users(self.spark, self.d))

    @property
    def categories(self) -> DataFrame:
        return self._get("categories", lambda: categories(self.spark, self.d))

    @property
    def products(self) -> DataFrame:
        return self._get("products", lambda: products(self.spark, self.d))

    @property
    def orders(self) -> DataFrame:
        return self._get("orders", lambda: orders(self.spark, self.d))

    @property
    def items(self) -> DataFrame:
        return self._get("items", lambda: order_items(self.spark, self.d))

    @property
    def movements(self) -> DataFrame:
        return self._get("movements", lambda: stock_movements(self.spark, self.d, self.items, self.orders,
                                                              self.products))

    @property
    def audit(self) -> DataFrame:
        return self._get("audit", lambda: audit_log(self.spark, self.d, self.movements))

    @property
    def request_log(self) -> DataFrame:
        return self._get("request_log", lambda: request_log(self.spark, self.d))

    @property
    def revocations(self) -> DataFrame:
        return self._get("revocations", lambda: revocations(self.spark, self.d))

    @property
    def status_requests(self) -> DataFrame:
        return self._get("status_requests", lambda: status_requests(self.spark, self.d))

    @property
    def order_request_items(self) -> DataFrame:
        return self._get("order_request_items", lambda: order_request_items(self.spark, self.d, self.items,
                                                                            self.orders))

    def domain(self) -> dict[str, DataFrame]:
        return {"users": self.users, "categories": self.categories, "products": self.products,
                "orders": self.orders, "order_items": self.items, "stock_audit_log": self.audit}

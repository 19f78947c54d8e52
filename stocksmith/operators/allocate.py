"""M6: place a batch of orders against stock, all-or-nothing per order,
first come first served -- as set-based rounds instead of a row loop.

The application places one order at a time: every item must name a live
product with enough stock, else the whole order is rolled back and its
stock stays free for later orders.  Replaying that order by order would be a
driver loop over all orders.  Instead, orders are totally ordered by
``(created_at, request_id)`` and kept in three states (accepted, rejected,
open).  Each round computes, per product and in that order,

* ``hi`` = units of earlier accepted **and** open orders, and
* ``lo`` = units of earlier accepted orders only,

(running sums, split by time and id so a hot product is not one task).  An
open order whose every item fits under ``hi`` is accepted whatever the open
ones before it do; one with an item that does not fit even under ``lo`` is
rejected.  The earliest open order always has ``hi = lo``, so every round
settles at least one order per product chain; in practice a few rounds
settle everything.  The result equals processing the orders one by one.

Rejected orders leave the working set each round.  So do all rows of products
that no open order names any more, so the rounds work on ever fewer rows.  Every round cuts lineage by writing its decisions and rows
under the shared folder; the rows of the round before are removed.
"""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import DEFAULT_AS_OF, shared_path, ts_lit
from ..sources import schemas as S
from ..sources.commits import Files
from . import relations as R
from . import running
from . import validate as V

OPEN, ACCEPTED, REJECTED = "open", "accepted", "rejected"


def _cut(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Rows written once under ``folder`` and read back: cuts lineage.  A checkpoint would run its last stage
    twice and keep whole rows; readers of these files take the columns that they need."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


@dataclass
class Placement:
    decisions: DataFrame      # request_id, accepted, reason
    orders: DataFrame         # new order rows (id = request_id)
    items: DataFrame          # new order_items rows (price snapshot)
    products: DataFrame       # products with new stock
    audit: DataFrame          # order_placed audit rows
    rounds: int
    rows: list[int]           # rows kept after each round


def place_orders(products: DataFrame, requests: DataFrame, as_of=None, hot_threshold: int | None = None) -> Placement:
    """``requests``: flat order requests (request_id, line_no, product_id,
    quantity, user_id, notes, created_at; one row per item, a request with
    no items has one row with NULL item fields).

    Rejection reasons: the V1 rules, then ``product_not_found`` (an item
    names a missing or deleted product), then ``insufficient_stock``."""
    spark = requests.sparkSession
    folder = shared_path(spark, "placement")
    now = ts_lit(as_of or DEFAULT_AS_OF)

    requests = _cut(requests, folder, "requests")        # read three times below; computed once
    prod = products.select(F.col("id").alias("product_id"), "stock_quantity", "price")
    static = _cut(V.orders(requests, products.filter(F.col("deleted_at").isNull())), folder, "static")
    valid = static.filter(F.col("reason").isNull()).select("request_id")
    items = requests.filter(F.col("line_no").isNotNull()).join(prod, "product_id", "left")

    work = (items.join(valid, "request_id", "left_semi")
            .select("request_id", "line_no", "product_id", F.col("quantity").cast("bigint").alias("quantity"),
                    F.col("stock_quantity").cast("bigint").alias("stock"), "created_at",
                    F.lit(OPEN).alias("state")))
    work = _cut(work, folder, "work-0")
    # hot products only shrink as rounds drop decided orders: find them once
    levels = running.time_levels(F.col("created_at"), F.col("request_id"))
    hot = running.hot_levels(work, ["product_id"], levels, hot_threshold)
    rounds, accepted, kept_rows = 0, [], []
    order = [F.col("created_at"), F.col("request_id"), F.col("line_no")]
    open_rows = 1 if not work.isEmpty() else 0
    files = Files(spark, folder)
    while open_rows:
        rounds += 1
        q = F.col("quantity")
        led = running.running_sums(
            work, ["product_id"], order,
            {"_hi": F.when(F.col("state").isin(OPEN, ACCEPTED), q).otherwise(0),
             "_lo": F.when(F.col("state") == ACCEPTED, q).otherwise(0)},
            chunk=levels, hot=hot)
        # an open row's own units are in _hi (inclusive) but not in _lo, so
        # "hi before + q fits" is _hi <= stock and "lo before + q fails" is _lo + q > stock
        fits = F.col("_hi") <= F.col("stock")
        fails = (F.col("_lo") + q) > F.col("stock")
        dec = (led.filter(F.col("state") == OPEN).groupBy("request_id")
               .agg(F.bool_and(fits).alias("_all_fit"), F.bool_or(fails).alias("_any_fail"))
               .select("request_id", F.when(F.col("_all_fit"), F.lit(ACCEPTED))
                       .when(F.col("_any_fail"), F.lit(REJECTED)).alias("new_state"))
               .filter(F.col("new_state").isNotNull()))
        dec = _cut(dec, folder, f"decided-{rounds}")
        accepted.append(dec.filter(F.col("new_state") == ACCEPTED).select("request_id"))
        # rejected orders leave the working set (they hold no stock); accepted
        # rows stay while an open order of their product may count them
        nxt = work.join(dec, "request_id", "left").withColumn("state", F.coalesce("new_state", "state")).drop("new_state") \
            .filter(F.col("state") != REJECTED)
        unsettled = nxt.filter(F.col("state") == OPEN).select("product_id")
        nxt = nxt.join(unsettled, "product_id", "left_semi")
        # the open-row count is observed by the job that writes the rows
        seen = Observation(f"placement_round_{rounds}")
        work = _cut(nxt.observe(seen, F.count_if(F.col("state") == OPEN).alias("open"), F.count(F.lit(1)).alias("rows")), folder, f"work-{rounds}")
        files.remove(f"{folder}/work-{rounds - 1}")
        open_rows = seen.get["open"]
        kept_rows.append(seen.get["rows"])

    final = static.select("request_id").limit(0)
    for a in accepted:
        final = final.unionByName(a)
    decisions = static.join(final.withColumn("_accepted", F.lit(True)), "request_id", "left").select(
        "request_id",
        F.coalesce("_accepted", F.lit(False)).alias("accepted"),
        F.coalesce(F.col("reason"), F.when(F.col("_accepted").isNull(), F.lit("insufficient_stock"))).alias("reason"))

    ok = decisions.filter("accepted").select("request_id")
    acc_items = items.join(ok, "request_id", "left_semi")
    new_items = acc_items.select(F.col("request_id").alias("order_id"), "line_no", "product_id",
                                 F.col("quantity").cast("int").alias("quantity"),
                                 F.col("price").cast("decimal(10,2)").alias("unit_price"))
    totals = R.order_totals(new_items).select(F.col("order_id").alias("id"), "items_total")
    heads = requests.join(ok, "request_id", "left_semi").groupBy("request_id").agg(
        F.first("user_id").alias("user_id"), F.first("notes").alias("notes"), F.first("created_at").alias("created_at"))
    new_orders = heads.select(F.col("request_id").alias("id"), "user_id", F.lit(S.DEFAULTS["status"]).alias("status"),
                              "notes", "created_at", now.alias("updated_at")) \
        .join(totals, "id", "left").withColumn("total_amount", F.col("items_total").cast("decimal(10,2)")) \
        .drop("items_total")
    moves = acc_items.select("product_id", F.col("user_id").alias("changed_by"), (-F.col("quantity")).alias("delta"),
                             F.lit(S.REASON_ORDER_PLACED).alias("reason"), F.col("created_at").alias("changed_at"),
                             F.col("request_id").alias("ref_id"), "line_no")
    start = products.select(F.col("id").alias("product_id"), "stock_quantity")
    touched = moves.groupBy("product_id").agg(F.sum("delta").alias("_d"))
    audit = R.stock_ledger(moves, start=start)
    new_products = products.join(touched.withColumnRenamed("product_id", "id"), "id", "left") \
        .withColumn("stock_quantity", (F.col("stock_quantity") + F.coalesce(F.col("_d"), F.lit(0))).cast("int")) \
        .withColumn("updated_at", F.when(F.col("_d").isNotNull(), now).otherwise(F.col("updated_at"))) \
        .select(*products.columns)
    return Placement(decisions, new_orders, new_items, new_products, audit, rounds, kept_rows)


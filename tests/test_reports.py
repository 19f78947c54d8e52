"""Seed goldens, report boundaries and exact money."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from stocksmith.functions import predicates as P
from stocksmith.operators import mutate as MU
from stocksmith.operators import paging
from stocksmith.plans import reports
from stocksmith.sources import schemas as S


def _empty(spark, schema):
    return spark.createDataFrame([], schema)


def seeded(spark):
    cats, prods = _empty(spark, S.CATEGORIES), _empty(spark, S.PRODUCTS)
    r = MU.seed(spark, cats, prods, as_of="2024-01-01 00:00:00")
    return r.extra["categories"], MU.apply_defaults(r.table, "products", "2024-01-01 00:00:00")


def test_seed_low_stock_golden(spark):
    cats, prods = seeded(spark)
    assert cats.count() == 3 and prods.count() == 7
    rows = reports.low_stock(prods, cats).collect()
    assert [(r.sku, r.units_needed, r.category_name) for r in rows] == [
        ("STAT-002", 12, "Stationery"), ("ELEC-003", 2, "Electronics")]


def test_seed_is_skipped_when_live_products_exist(spark):
    cats, prods = seeded(spark)
    again = MU.seed(spark, cats, prods)
    assert again.table.count() == 7 and again.extra["categories"].count() == 3


def test_seed_updates_description_on_name_conflict(spark):
    cats = spark.createDataFrame([(9, "Groceries", "old", None)], S.CATEGORIES)
    r = MU.seed(spark, cats, _empty(spark, S.PRODUCTS))
    got = {row.name: (row.id, row.description) for row in r.extra["categories"].collect()}
    assert got["Groceries"] == (9, "Everyday food and household staples")
    assert len(got) == 3


def _products(spark, rows):
    full = [(i, c, n, None, Decimal(p), s, t, f"SKU-{i}", d, None, None) for i, c, n, p, s, t, d in rows]
    return spark.createDataFrame(full, S.PRODUCTS)


def test_low_stock_is_inclusive_and_threshold_zero_kept(spark):
    prods = _products(spark, [(1, None, "a", "1.00", 10, 10, None), (2, None, "b", "1.00", 0, 0, None),
                              (3, None, "c", "1.00", 11, 10, None)])
    cats = _empty(spark, S.CATEGORIES)
    got = [(r.id, r.units_needed, r.category_name) for r in reports.low_stock(prods, cats).collect()]
    assert got == [(2, 0, None), (1, 0, None)]


def test_price_bounds_inclusive_and_zero_is_a_bound(spark):
    prods = _products(spark, [(1, 1, "a", "0.00", 5, 1, None), (2, 1, "b", "10.00", 5, 1, None),
                              (3, 1, "c", "10.01", 5, 1, None)])
    ids = lambda **kw: sorted(r.id for r in prods.filter(P.product_filter(**kw)).collect())
    assert ids(min_price=0, max_price="10") == [1, 2]
    assert ids(min_price="", max_price="") == [1, 2, 3]
    assert ids(category_id=0) == [1, 2, 3]          # falsy category: no filter


def test_search_wildcards_and_deleted_hidden(spark):
    prods = _products(spark, [(1, 1, "50% off", "1.00", 5, 1, None), (2, 1, "500 off", "1.00", 5, 1, None),
                              (3, 1, "a_b", "1.00", 5, 1, None), (4, 1, "axb", "1.00", 5, 1, dt.datetime(2020, 1, 1))])
    ids = lambda t: sorted(r.id for r in prods.filter(P.product_filter(search_text=t)).collect())
    assert ids("0%") == [1, 2]        # % is a wildcard, like the application's ILIKE
    assert ids("a_b") == [3]          # deleted product 4 would match "a_b" too
    assert ids("A_B") == [3]


def test_sort_whitelist_and_null_order(spark):
    assert P.safe_sort("price", "asc") == ("price", True)
    assert P.safe_sort("password", "ASC") == ("created_at", True)
    assert P.safe_sort("name", None) == ("name", False)
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "id long, created_at long")
    desc = [r.id for r in paging.page(df, P.sort_columns("created_at", False), 1, 10).collect()]
    asc = [r.id for r in paging.page(df, P.sort_columns("created_at", True), 1, 10).collect()]
    assert desc == [1, 3, 2] and asc == [2, 3, 1]


def test_page_past_end_and_summary(spark):
    df = spark.range(0, 25).withColumnRenamed("id", "id")
    assert paging.page(df, [F.col("id")], 4, 10).count() == 0
    s = paging.page_summary(df.agg(F.count(F.lit(1)).alias("total")), 3, 10).collect()[0]
    assert (s.total, s.page, s.limit, s.total_pages) == (25, 3, 10, 3)


def test_keyset_equals_offset_paging(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(40)], "id long, k long")
    offset_page = [r.id for r in paging.page(df, [F.col("k").desc(), F.col("id").desc()], 2, 7).collect()]
    first = paging.page(df, [F.col("k").desc(), F.col("id").desc()], 1, 7).collect()[-1]
    keyset = [r.id for r in paging.keyset_page(df, [("k", False), ("id", False)], (first.k, first.id), 7).collect()]
    assert keyset == offset_page


def test_money_average_half_up(spark):
    from stocksmith.functions import money as M
    df = spark.createDataFrame([(Decimal("0.01"),), (Decimal("0.02"),)], "x decimal(10,2)")
    out = df.agg(M.avg_money(F.sum(M.cents(F.col("x"))), F.count("x")).alias("a")).collect()[0].a
    assert out == Decimal("0.02")     # 1.5 cents rounds half-up


def test_top_products_ranks_ties(spark):
    items = spark.createDataFrame([(1, 1, 1, 5, Decimal("1.00")), (2, 1, 2, 5, Decimal("2.00")),
                                   (3, 1, 3, 1, Decimal("9.00"))],
                                  "order_id long, line_no int, product_id long, quantity int, unit_price decimal(10,2)")
    orders = spark.createDataFrame([(1, 1, "pending"), (2, 1, "shipped"), (3, 1, "cancelled")],
                                   "id long, user_id long, status string")
    prods = _products(spark, [(1, None, "a", "1.00", 5, 1, None), (2, None, "b", "1.00", 5, 1, None),
                              (3, None, "c", "1.00", 5, 1, None)])
    out = reports.top_products(items, orders, prods, _empty(spark, S.CATEGORIES), n=10).orderBy("id").collect()
    assert [(r.id, r.rank, r.total_sold, str(r.revenue_share_pct)) for r in out] == [
        (1, 1, 5, "33.33"), (2, 1, 5, "66.67")]


def test_null_user_order_absent_from_order_list(spark):
    from stocksmith.operators import relations as R
    orders = spark.createDataFrame([(1, None, "pending", Decimal("1.00"), None, None, None),
                                    (2, 7, "pending", Decimal("2.00"), None, None, None)], S.ORDERS)
    users = spark.createDataFrame([(7, "u", "u@x.io", "user", None)], S.USERS)
    assert [r.id for r in R.orders_with_customer(orders, users).collect()] == [2]


def test_deleted_product_stays_in_history_not_in_lists(spark):
    from stocksmith.operators import relations as R
    prods = _products(spark, [(1, None, "gone", "1.00", 5, 1, dt.datetime(2020, 1, 1)),
                              (2, None, "here", "1.00", 5, 1, None)])
    items = spark.createDataFrame([(10, 1, 1, 2, Decimal("1.00"))], S.ORDER_ITEMS)
    assert [r.product_name for r in R.items_with_product(items, prods).collect()] == ["gone"]
    assert [r.id for r in prods.filter(P.product_filter()).collect()] == [2]

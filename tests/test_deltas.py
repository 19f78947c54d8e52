"""Reports kept up by batches equal the reports of the tables as they are."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from stocksmith.operators import deltas as D
from stocksmith.plans import reports

ORDERS = "id long, user_id long, status string, total_amount decimal(10,2), created_at timestamp_ntz"
ITEMS = "order_id long, line_no int, product_id long, quantity int, unit_price decimal(10,2)"


def _orders(spark, rows):
    return spark.createDataFrame([(i, u, s, Decimal(a) if a else None, d and dt.datetime(*d)) for i, u, s, a, d in rows], ORDERS)


def _small(spark):
    before = [(1, 1, "pending", "10.00", (2001, 1, 5)), (2, 1, "delivered", "7.25", (2001, 1, 31)), (3, None, "packed", "3.10", None),
              (4, 2, "shipped", "99.99", (2001, 2, 1)), (5, 3, "cancelled", "5.00", (2001, 3, 1)), (6, 4, "pending", None, (2001, 3, 2))]
    # 1 cancelled, 3 gets a user and a time, 4 deleted, 5 unchanged, 7 inserted
    after = [(1, 1, "cancelled", "10.00", (2001, 1, 5)), before[1], (3, 2, "packed", "4.10", (2001, 2, 3)), before[4], before[5],
             (7, 5, "pending", "1.00", (2001, 2, 9))]
    items = [(1, 1, 11, 3, "2.00"), (1, 2, 12, 1, "4.00"), (2, 1, 11, 1, "7.25"), (3, 1, 13, 1, "3.10"), (4, 1, 12, 9, "11.11"),
             (5, 1, 14, 5, "1.00"), (7, 1, 12, 1, "1.00"), (7, 2, 12, 1, "0.00")]
    items = spark.createDataFrame([(*r[:4], Decimal(r[4])) for r in items], ITEMS)
    return _orders(spark, before), _orders(spark, after), items


def _rows(df):
    return sorted(map(str, df.collect()))


def test_states_equal_those_of_the_whole_table(spark):
    before, after, items = _small(spark)
    for name in D.STATES:
        got = D.merge(name, D.initial(name, before, items), D.delta(name, before, after, items))
        whole = D.initial(name, after, items)
        assert got.dtypes == whole.dtypes
        assert _rows(got) == _rows(whole), name
        # deleted again, nothing is left; an unchanged batch changes nothing
        assert D.merge(name, got, D.delta(name, after, None, items)).count() == 0
        assert _rows(D.merge(name, got, D.delta(name, after, after, items))) == _rows(whole)
        none = after.limit(0)
        assert _rows(D.merge(name, got, D.delta(name, none, none, items))) == _rows(whole)


def test_reports_from_states(spark, tables):
    before, after, items = _small(spark)
    state = {n: D.merge(n, D.initial(n, before, items), D.delta(n, before, after, items)) for n in D.STATES}
    for period in ("day", "week", "month"):
        assert _rows(D.sales_summary(state["sales"], period)) == _rows(reports.sales_summary(after, period))
    assert _rows(D.customer_analytics(state["customers"], tables.users)) == _rows(reports.customer_analytics(after, tables.users))
    for n in (1, 2, 10):  # product 12 leads until order 4 is deleted
        assert _rows(D.top_products(state["products"], tables.products, tables.categories, n)) == \
            _rows(reports.top_products(items, after, tables.products, tables.categories, n))
    kpis = reports.dashboard_kpis(tables.products, tables.categories, tables.users, after)
    got = D.order_kpis(state["statuses"])
    assert _rows(got.drop("avg_order_value")) == _rows(kpis.select(*got.drop("avg_order_value").columns))


def test_a_batch_does_not_read_the_orders(spark, tables, tmp_path):
    """The plan of a merge scans the state and the batch, nothing else."""
    before, after, _ = _small(spark)
    D.initial("sales", tables.orders).write.parquet(f"{tmp_path}/state")
    state = spark.read.parquet(f"{tmp_path}/state")
    plan = D.merge("sales", state, D.delta("sales", before.where(F.col("id") == 1), after.where(F.col("id") == 1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan

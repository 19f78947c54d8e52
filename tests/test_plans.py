"""Physical-plan properties that matter at scale."""
import contextlib
import io
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from stocksmith.functions import predicates as P
from stocksmith.operators import running
from stocksmith.plans import reports
from stocksmith.sources import tables as TB


def _explain(df, mode: str) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def plan(df) -> str:
    return _explain(df, "simple")


def formatted(df) -> str:
    return _explain(df, "formatted")


def test_product_list_pushes_filters_and_prunes_columns(spark, tables):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    TB.write_snapshot(tables.products, root, "products")
    prods = TB.load_table(spark, root, "products")
    df = prods.filter(P.product_filter(min_price="925", max_price="950", category_id=3)).select("id", "name")
    text = formatted(df)
    assert "IsNull(deleted_at)" in text
    assert "GreaterThanOrEqual(price" in text and "LessThanOrEqual(price" in text
    assert "EqualTo(category_id,3)" in text
    read = [line for line in text.splitlines() if line.startswith("ReadSchema")][0]
    assert "stock_quantity" not in read and "description" not in read


def test_reports_use_top_k_not_a_full_sort(spark, tables):
    assert "TakeOrderedAndProject" in plan(reports.sales_summary(tables.orders))
    assert "TakeOrderedAndProject" in plan(reports.customer_analytics(tables.orders, tables.users))


def test_no_cartesian_products(spark, tables):
    kpis = reports.dashboard_kpis(tables.products, tables.categories, tables.users, tables.orders)
    top = reports.top_products(tables.items, tables.orders, tables.products, tables.categories)
    for df in (kpis, top):
        p = plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_top_products_total_is_one_scalar_subquery(spark, tables):
    text = formatted(reports.top_products(tables.items, tables.orders, tables.products, tables.categories))
    assert text.count("Subquery:") == 1


def test_plain_keys_take_one_window_and_no_union(spark, tables):
    df = tables.raw("lineitem")
    out = running.running_sum(df, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")], F.lit(1), "n",
                              chunk=[F.col("l_linenumber")], threshold=10**9)
    p = plan(out)
    assert p.count("Window") == 1 and "Union" not in p


def test_hot_keys_are_split_into_chunks(spark, tables):
    df = tables.raw("lineitem")
    out = running.running_sum(df, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")], F.lit(1), "n",
                              chunk=[F.col("l_linenumber")], threshold=2)
    p = plan(out)
    assert "Union" in p and p.count("Window") >= 3


def test_scale_conf_sizes_partitions_from_input():
    from stocksmith.session import scale_conf
    c = scale_conf(100 * (1 << 40), executors=1000)
    assert int(c["spark.sql.shuffle.partitions"]) == 50_000      # 100 TB: bounded for the driver's map statuses
    c = scale_conf(10 * (1 << 40), executors=1000)
    assert int(c["spark.sql.shuffle.partitions"]) == 10 * (1 << 40) // (256 << 20)    # 40,960
    small = scale_conf(1 << 30, executors=10)
    assert int(small["spark.sql.shuffle.partitions"]) == 120                            # 3 waves of 40 cores


def _line_items(spark):
    """Lines whose columns after the price differ alone, lines that come twice, and lines without a number."""
    import tempfile
    rows = [(o, p, 1, n, 2.0, 10.0 * o, 0.01 * k, 0.1 * k, f"2001-01-{k + 1:02d}")
            for o in range(40) for n in (1, 1, None) for p in (3, 3, 900) for k in (0, 1)]
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_shipdate string").write.parquet(f"{base}/lineitem.parquet")
    return base


def test_line_numbers_shuffle_what_can_change_them(spark):
    """Columns that only part equal rows are not shuffled, and the numbers are those of the whole order."""
    from stocksmith.sources import fixtures as FX
    base = _line_items(spark)
    got = FX.order_items(spark, base)
    assert not any(c in got._jdf.queryExecution().executedPlan().toString() for c in ("l_shipdate", "l_tax", "l_discount"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    want = spark.read.parquet(f"{base}/lineitem.parquet").select(F.col("l_orderkey").alias("order_id"), F.row_number().over(w).alias("line_no"),
                                                                F.col("l_partkey").alias("product_id"))
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_the_start_of_a_ledger_is_not_shuffled_with_its_rows(spark):
    """Rows that lie by product already are not shuffled again for the start, which may name a product twice or without stock."""
    from stocksmith.operators import relations as R
    mv = spark.range(300).select((F.col("id") % 7).alias("product_id"), F.lit(None).cast("long").alias("changed_by"),
                                 (F.col("id") % 11 - 5).cast("int").alias("delta"), F.lit("x").alias("reason"),
                                 F.lit("2001-01-01").cast("timestamp_ntz").alias("changed_at"), F.col("id").alias("ref_id"), F.lit(1).alias("line_no"))
    mv = mv.withColumn("product_id", F.when(F.col("product_id") < 6, F.col("product_id")))
    start = spark.createDataFrame([(0, 5), (1, 5), (1, 20), (2, None), (9, 3), (None, 100)], "product_id long, stock_quantity int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = R.stock_ledger(mv.repartition(8, "product_id"), start, hot_threshold=1000)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "Union" not in plan
        hot = R.stock_ledger(mv, start, hot_threshold=10)
        had = {0: 5, 1: 25}
        total, want = {}, []
        for r in sorted(mv.collect(), key=lambda r: r.ref_id):
            before = total.get(r.product_id, had.get(r.product_id, 0))
            total[r.product_id] = before + r.delta
            want.append((r.ref_id, before, before + r.delta))
        for df in (got, hot):
            assert sorted((r.ref_id, r.quantity_before, r.quantity_after) for r in df.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_patches_are_dealt_before_they_are_checked(spark, tables):
    """One file of parts is one task; the rules run after the exchange, in as many as there are."""
    from stocksmith.operators import validate as V
    from stocksmith.plans.queries_write import patch_batch
    plan = V.product_patches(patch_batch(tables))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(p_partkey" in plan
    assert plan.index("regexp") < plan.index("Exchange hashpartitioning(p_partkey")


def test_placement_keeps_one_state(spark):
    """Each round's rows are written once and replace those of the round before; nothing goes through checkpoints."""
    import os
    from stocksmith.operators.allocate import place_orders
    from stocksmith.session import shared_root
    products = spark.createDataFrame([(1, 10), (2, 3)], "id long, stock_quantity int").selectExpr(
        "id", "stock_quantity", "cast(2 as decimal(10,2)) price", "cast(null as timestamp_ntz) deleted_at", "cast(null as timestamp_ntz) updated_at")
    rows = [(r, 1, 1 + r % 2, 2 + r % 3, 1, None, "2001-01-01") for r in range(1, 12)]
    requests = spark.createDataFrame(rows, "request_id long, line_no int, product_id long, quantity int, user_id long, notes string, c string")
    requests = requests.withColumn("created_at", F.col("c").cast("timestamp_ntz")).drop("c")
    base = f"{shared_root(spark)}/stocksmith".removeprefix("file:")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    placed = place_orders(products, requests)
    new = [n for n in set(os.listdir(base)) - before if n.startswith("placement-")]
    assert len(new) == 1 and placed.rounds > 1
    assert [n for n in os.listdir(f"{base}/{new[0]}") if n.startswith("work-")] == [f"work-{placed.rounds}"]
    stock, want = {1: 10, 2: 3}, []
    for r, _, p, q, *_ in rows:
        if stock[p] >= q:
            stock[p] -= q
            want.append(r)
    assert sorted(d.request_id for d in placed.decisions.where("accepted").collect()) == want
    assert {r.id: r.stock_quantity for r in placed.products.collect()} == stock

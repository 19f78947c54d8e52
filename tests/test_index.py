"""One-scan audits, pages by number and trigram search: plans, and results against plain scans."""
import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from stocksmith.functions import predicates as P
from stocksmith.operators import relations as R
from stocksmith.operators import validate as V
from stocksmith.sources import schemas as S
from stocksmith.sources.pages import PagedList
from stocksmith.sources.trigrams import TrigramIndex, grams_of


def _folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_audit_reads_each_table_once(spark, tables):
    root = _folder()
    for name, df in tables.domain().items():
        df.write.parquet(f"{root}/{name}")
    given = {n: spark.read.parquet(f"{root}/{n}") for n in S.TABLES}
    plan = _plan(V.table_audit(given))
    assert plan.count("FileScan") == len(S.TABLES)
    assert plan.count("Exchange") == 1 and "Join" not in plan
    plan = _plan(R.unique_violations(given, ["products"]))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_audit_on_small_tables(spark):
    at = dt.datetime(2020, 1, 1)
    empty = {n: spark.createDataFrame([], s) for n, s in S.TABLES.items()}
    assert V.table_audit(empty).count() == 0
    orders = spark.createDataFrame([(1, 7, "lost", 1, None, at, at), (1, 8, None, 1, None, at, at), (2, None, "pending", 1, None, at, at)],
                                   "id long, user_id long, status string, total_amount int, notes string, created_at timestamp_ntz, updated_at timestamp_ntz")
    users = spark.createDataFrame([(7, "a", "a@b.c", "user", at)], S.USERS)
    got = sorted(map(tuple, V.table_audit(empty | {"orders": orders, "users": users}).collect()))
    assert got == [("orders", "check", "status", "lost", 1), ("orders", "foreign_key", "user_id", "8", 1), ("orders", "primary_key", "id", "1", 2)]
    # two children of one parent that is not there; a key that stands twice is a parent all the same
    items = spark.createDataFrame([(1, 1, 5, 1, 1), (1, 2, 5, 1, 1), (2, 1, 5, 1, 1)], "order_id long, line_no int, product_id long, quantity int, unit_price int")
    audit = spark.createDataFrame([(5, 9, 0, 1, "r", at, 1, 1)], S.STOCK_AUDIT_LOG)
    got = {tuple(r) for r in V.table_audit(empty | {"orders": orders, "users": users, "order_items": items, "stock_audit_log": audit}).collect()}
    assert {g for g in got if g[1] == "foreign_key"} == {
        ("orders", "foreign_key", "user_id", "8", 1), ("order_items", "foreign_key", "product_id", "5", 3),
        ("stock_audit_log", "foreign_key", "product_id", "5", 1), ("stock_audit_log", "foreign_key", "changed_by", "9", 1)}


def test_audit_of_a_hot_value_is_combined_before_the_shuffle(spark):
    rows = spark.range(200_000).select(F.lit(1).cast("long").alias("id"), F.lit("n").alias("name"), F.lit("e").alias("email"),
                                       F.lit("user").alias("role"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    out = R.unique_violations({"users": rows}, ["users"])
    assert sorted(tuple(r) for r in out.collect()) == [("users", "primary_key", "id", "1", 200_000), ("users", "unique", "email", "e", 200_000)]
    assert "partial_count" in _plan(out)


# ---------------------------------------------------------------- pages


def _list(spark):
    rows = [(i, None if i % 7 == 0 else i % 10, f"n{i}") for i in range(500)]
    return spark.createDataFrame(rows, "id long, v int, name string")


@pytest.mark.parametrize("asc", [True, False])
def test_pages_equal_offset(spark, asc):
    df, order = _list(spark), P.sort_columns("v", asc)
    pages = PagedList.write(df, _folder(), order, 30)
    assert len(pages.counts) > 5 and pages.total() == 500
    for no, limit in ((1, 7), (3, 45), (10, 50), (11, 50), (500, 1), (1, 500), (2, 499), (900, 10)):
        want = df.orderBy(*order).offset((no - 1) * limit).limit(limit).collect()
        assert pages.page(no, limit).collect() == want, (no, limit)
    where = (F.col("v") > 3) | F.col("v").isNull()
    for no, limit in ((1, 10), (4, 33), (30, 10), (400, 10)):
        want = df.where(where).orderBy(*order).offset((no - 1) * limit).limit(limit).collect()
        assert pages.page(no, limit, where).collect() == want, (no, limit)
    assert pages.total(where) == df.where(where).count()
    assert pages.summary(2, 30).first().asDict() == {"total": 500, "page": 2, "limit": 30, "total_pages": 17}
    with pytest.raises(ValueError):
        pages.page(0, 10)


def test_a_deep_page_reads_one_range(spark):
    pages = PagedList.write(_list(spark), _folder(), P.sort_columns("id", True), 25)
    page = pages.page(200, 2)
    assert [r.id for r in page.collect()] == [398, 399] and len(pages.counts) == 20
    read = {f.split("/_range=")[1].split("/")[0] for f in page.inputFiles()}
    assert read == {"15"}, read


def test_many_ranges_share_folders(spark):
    """Far more ranges than folders: as many tasks and folders as the rows need, ranges of the asked size, the same pages."""
    import os
    rows = spark.range(6000).select(((F.col("id") * 7919) % 6000).alias("id"), (F.col("id") % 13).cast("int").alias("v"))
    order, root = P.sort_columns("v", False), _folder()
    pages = PagedList.write(rows, root, order, 10)
    folders = [n for n in os.listdir(f"{root}/rows") if n.startswith("_range=")]
    assert len(pages.counts) >= 600 and len(folders) <= 64 and max(pages.counts.values()) <= 10
    for where in (None, F.col("id") % 5 == 2):
        want = (rows if where is None else rows.where(where)).orderBy(*order)
        for no, limit in ((1, 10), (37, 10), (3, 333), (500, 2), (1, 6000), (900, 10)):
            assert pages.page(no, limit, where).collect() == want.offset((no - 1) * limit).limit(limit).collect(), (no, limit)
        assert pages.total(where) == want.count()
    page = pages.page(300, 10)
    assert len({f.split("/_range=")[1].split("/")[0] for f in page.inputFiles()}) <= 2
    assert "_slice" in _plan(page).split("PushedFilters: [")[1].split("]")[0]


def test_unfinished_and_empty_lists(spark):
    root = _folder()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        PagedList(spark, root, [F.col("id")])
    pages = PagedList.write(_list(spark).limit(0), f"{root}/empty", P.sort_columns("id", True))
    assert pages.total() == 0 and pages.page(1, 10).collect() == [] and pages.summary(1, 10).first().total_pages == 0
    assert pages.page(1, 10, F.col("v") > 1).columns == ["id", "v", "name"]


# ---------------------------------------------------------------- trigrams


def test_trigrams_of_patterns():
    assert grams_of("%ring%") == ["ing", "rin"]
    assert grams_of("%RiNg_ab%abc") == ["abc", "ing", "rin"]
    assert grams_of("%ab_cd%") == [] and grams_of("") == []
    assert grams_of(r"%50\%x%") == ["0%x", "50%"]
    assert grams_of("%éabc%") == ["abc"] and grams_of("%aéb%") == []


def test_search_equals_a_scan(spark):
    names = ["Blue Ring", "bluering", "RING", None, "", "ri", "rin g", "50% off", "50x off", "Kelvin King ring", "cafÉ ring", "İring",
             "r\ni\ng ring", "aaa", "aaaa", "ring" * 40]
    rows = [(i if i != 12 else 11, n, f"SKU-{i}") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "id long, name string, sku string")
    index = TrigramIndex(spark, _folder() + "/t", ["name", "sku"], folders=8).write(df)
    for text in ("ring", "RING", "r_ng", "king", "sku-1", "SKU-1_", "blue%ring", "aaa", "aaaa", "ri", "%", "_", r"50\%", "fé ri", "zzz", "ing%ing", "sku%ring"):
        pattern = f"%{text}%"
        want = df.where(F.col("name").ilike(pattern) | F.col("sku").ilike(pattern))
        assert sorted(map(str, index.search(df, text).collect())) == sorted(map(str, want.collect())), text


def test_search_opens_the_folders_of_its_trigrams(spark, tables):
    index = TrigramIndex(spark, _folder() + "/t", ["name", "sku"]).write(tables.products)
    found = index.candidates("%ring%")
    assert 1 <= len({f.split("/_folder=")[1].split("/")[0] for f in found.inputFiles()}) <= 2      # rin, ing
    assert "In(gram" in _plan(found).split("PushedFilters: [")[1]
    assert index.candidates("%r_%") is None
    none = TrigramIndex(spark, _folder() + "/t", ["name", "sku"]).write(tables.products.limit(0))
    assert none.search(tables.products.limit(0), "ring").count() == 0

"""Snapshot storage, the audit sink, the log reader and stream state."""
import datetime as dt
import json
import os
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from stocksmith.sources import schemas as S
from stocksmith.sources import tables as TB
from stocksmith.streaming import streams as ST


def _tmp():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_snapshot_versions(spark):
    root = _tmp()
    cats = spark.createDataFrame([(1, "A", None, None)], S.CATEGORIES)
    assert TB.write_snapshot(cats, root, "categories") == 1
    more = cats.unionByName(spark.createDataFrame([(2, "B", "b", None)], S.CATEGORIES))
    assert TB.write_snapshot(more, root, "categories") == 2
    assert TB.versions(spark, root, "categories") == [1, 2]
    assert TB.load_table(spark, root, "categories").count() == 2
    assert TB.load_table(spark, root, "categories", version=1).count() == 1
    assert set(TB.load_tables(spark, root)) == {"categories"}
    # a job that dies after its files and before its commit: readers do not see them, the next job replaces them
    cats.limit(0).unionByName(cats).write.parquet(f"{root}/categories/v=00000003")
    assert TB.versions(spark, root, "categories") == [1, 2]
    assert TB.load_table(spark, root, "categories").count() == 2
    assert TB.write_snapshot(more, root, "categories") == 3
    assert TB.load_table(spark, root, "categories").count() == 2


def test_all_tables_keep_their_declared_schema(spark):
    root = _tmp()
    for name, schema in S.TABLES.items():
        TB.write_snapshot(spark.createDataFrame([], schema), root, name)
    loaded = TB.load_tables(spark, root)
    assert set(loaded) == set(S.TABLES)
    assert all([(f.name, f.dataType) for f in loaded[n].schema] == [(f.name, f.dataType) for f in S.TABLES[n]] for n in loaded)


def test_audit_append(spark):
    root = _tmp()
    row = [(1, None, 0, 5, "manual_restock", dt.datetime(2024, 1, 1), None, None)]
    for job in ("a", "b", "b"):       # job b fails after its write and runs again
        TB.append_audit(spark.createDataFrame(row, S.STOCK_AUDIT_LOG), root, job)
    assert TB.load_audit(spark, root).count() == 2


def test_request_log_lines_roundtrip(spark):
    d = _tmp()
    lines = [json.dumps({"ts": "2024-01-01T00:00:01.250Z", "method": "GET", "url": "/api/v1/products?page=2",
                         "status": 200, "ms": "12.50", "requestId": "r1", "ip": "1.2.3.4"})]
    with open(os.path.join(d, "log.jsonl"), "w") as f:
        f.write("\n".join(lines) + "\n")
    r = TB.read_request_log(spark, d).collect()[0]
    assert (r.ts, r.ms, r.status, r.request_id) == (dt.datetime(2024, 1, 1, 0, 0, 1, 250000), 12.5, 200, "r1")
    assert spark.range(1).select(ST.route_of(F.lit("/api/v1/orders/12/status?x=1")).alias("r")).first().r == \
        "/api/v1/orders/:id/status"


def test_stock_alerts_carry_state_between_batches(spark):
    root = _tmp()
    thresholds = spark.createDataFrame([(1, 5, None)], "id long, low_stock_threshold int, deleted_at timestamp_ntz")
    initial = spark.createDataFrame([(1, 8)], "product_id long, stock_quantity int")
    schema = "product_id long, changed_by long, delta int, reason string, changed_at timestamp_ntz, ref_id long, " \
             "line_no int"
    b0 = spark.createDataFrame([(1, 1, -2, "order_placed", dt.datetime(2024, 1, 1), 1, 1)], schema)
    b1 = spark.createDataFrame([(1, 1, -2, "order_placed", dt.datetime(2024, 1, 2), 2, 1),
                                (1, 1, -1, "order_placed", dt.datetime(2024, 1, 3), 3, 1)], schema)
    ST.stock_alert_batch(spark, b0, thresholds, f"{root}/state", f"{root}/alerts", 0, initial)
    ST.stock_alert_batch(spark, b1, thresholds, f"{root}/state", f"{root}/alerts", 1, initial)
    alerts = spark.read.parquet(f"{root}/alerts").collect()
    assert [(a.ref_id, a.quantity_before, a.quantity_after) for a in alerts] == [(2, 6, 4)]
    state = spark.read.parquet(f"{root}/state/batch=1").collect()
    assert [(s.product_id, s.stock_quantity) for s in state] == [(1, 3)]
    # a batch touching another product leaves product 1's logged stock alone
    b2 = spark.createDataFrame([(2, 1, 4, "manual_restock", dt.datetime(2024, 1, 4), 4, 0)], schema)
    ST.stock_alert_batch(spark, b2, thresholds, f"{root}/state", f"{root}/alerts", 2, initial)
    b3 = spark.createDataFrame([(1, 1, -1, "order_placed", dt.datetime(2024, 1, 5), 5, 1)], schema)
    ST.stock_alert_batch(spark, b3, thresholds, f"{root}/state", f"{root}/alerts", 3, initial)
    last = spark.read.parquet(f"{root}/state/batch=3").collect()
    assert [(s.product_id, s.stock_quantity) for s in last] == [(1, 2)]
    # a replayed batch rewrites the same output
    ST.stock_alert_batch(spark, b1, thresholds, f"{root}/state", f"{root}/alerts", 1, initial)
    assert spark.read.parquet(f"{root}/alerts").count() == 1


def test_status_stream_over_two_files(spark):
    root = _tmp()
    orders = spark.createDataFrame([(1, 5, "pending", Decimal("1.00"), None, None, None)], S.ORDERS)
    schema = "order_id long, status string, actor_id long, actor_role string, seq long"
    src = f"{root}/src"
    spark.createDataFrame([(1, "confirmed", 0, "admin", 1)], schema).write.parquet(f"{src}/a")
    spark.createDataFrame([(1, "packed", 0, "admin", 2)], schema).write.parquet(f"{src}/b")
    files = sorted(p for p in (os.path.join(dp, f) for dp, _, fs in os.walk(src) for f in fs)
                   if p.endswith(".parquet"))
    inbox = f"{root}/inbox"
    os.makedirs(inbox)
    for i, p in enumerate(files):
        os.link(p, os.path.join(inbox, f"part-{i}.parquet"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    q = ST.status_stream(stream, orders, f"{root}/state", f"{root}/out", f"{root}/cp")
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out").collect()
    got = sorted((r.batch, r.status, r.accepted) for r in out)
    # two micro-batches (ids need not be consecutive); the second sees the first's change
    assert [(s, a) for _, s, a in got] == [("confirmed", True), ("packed", True)] and got[0][0] < got[1][0]


def test_rate_limit_stream(spark):
    root = _tmp()
    rows = [json.dumps({"ts": f"2024-01-01T00:00:{s:02d}.000Z", "method": "GET", "url": "/x", "status": 200,
                        "ms": "1.00", "requestId": str(s), "ip": "a" if s < 40 else "b"}) for s in range(50)]
    rows.append(json.dumps({"ts": "2024-01-01T01:00:00.000Z", "method": "GET", "url": "/x", "status": 200,
                            "ms": "1.00", "requestId": "late", "ip": "c"}))
    os.makedirs(f"{root}/log")
    with open(f"{root}/log/a.jsonl", "w") as f:
        f.write("\n".join(rows) + "\n")
    log = TB.read_request_log(spark, f"{root}/log", stream=True)
    ST.count_stream(ST.rate_rows(log), ST.RATE_KEYS, f"{root}/out", f"{root}/cp").awaitTermination()
    result = lambda: [(r.ip, r.hits, r.refused) for r in ST.rate_violations(spark.read.parquet(f"{root}/out"), limit=30).collect()]
    assert result() == [("a", 40, 10)]
    # an hour later, rows of the first minute arrive: they count in their window
    with open(f"{root}/log/b.jsonl", "w") as f:
        f.write("\n".join(rows[:5]) + "\n")
    log = TB.read_request_log(spark, f"{root}/log", stream=True)
    ST.count_stream(ST.rate_rows(log), ST.RATE_KEYS, f"{root}/out", f"{root}/cp").awaitTermination()
    assert result() == [("a", 45, 15)]
    ST.compact_counts(spark, f"{root}/out", ST.RATE_KEYS, f"{root}/compact")
    compact = spark.read.parquet(f"{root}/compact")
    assert [(r.ip, r.hits) for r in ST.rate_violations(compact, limit=30).collect()] == [("a", 45)]


def test_percentile_is_exact_whatever_the_size(spark):
    rows = spark.range(30_000).select(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), F.lit("GET").alias("method"),
                                      F.lit("/x").alias("url"), F.lit(200).alias("status"), (F.col("id") * 7919 % 30_000 / 100).alias("ms"))
    counts = ST.metric_rows(rows).groupBy(*ST.METRIC_KEYS).agg(F.count(F.lit(1)).alias("n"))
    assert float(ST.request_metrics(counts).first().p95_ms) == 284.99

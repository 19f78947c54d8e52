"""Registered streaming queries (T1-T5).

Each query runs its stream over the whole test input with an
``availableNow`` trigger into a new folder under the shared root, waits
for it, and returns what the sink holds.  T1 and T2 run in several
micro-batches whose files are not in time order; their oracles state all windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path
from ..sources import fixtures as FX
from ..sources import tables as TB
from ..streaming import streams as ST
from .catalog import register
from .queries_write import AS_OF, STATUS_OUTCOME_SQL, write_request_log_lines


def _utc(t) -> None:
    """Log and event times are UTC wall-clock values (TIMESTAMP_NTZ); the
    cast to TIMESTAMP for watermarks uses the session zone, so pin UTC."""
    t.spark.conf.set("spark.sql.session.timeZone", "UTC")


def _stream_table(t, name: str) -> DataFrame:
    """A test table read as a file stream (one file, so one micro-batch)."""
    schema = t.raw(name).schema
    return (t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .parquet(t.d))


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def _sink(t, stream: DataFrame, name: str) -> DataFrame:
    base = shared_path(t.spark, name)
    _run(ST.to_parquet(stream, f"{base}/out", f"{base}/checkpoint"))
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


def _counted(t, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The counts of a stream that runs in several micro-batches."""
    base = shared_path(t.spark, name)
    _run(ST.count_stream(rows, keys, f"{base}/counts", f"{base}/checkpoint"))
    return t.spark.read.parquet(f"{base}/counts")


def _log_stream(t) -> DataFrame:
    """The request log as JSON lines in several files, not in time order, one file to a micro-batch."""
    return TB.read_request_log(t.spark, write_request_log_lines(t, files=4), stream=True, max_files=1)


@register("T1_rate_violations", """
with log as (select date_trunc('millisecond', ts) as ts, ip from f_request_log),
w as (select date_trunc('day', ts) as window_start, ip, count(*) as hits from log group by 1, 2)
select window_start, window_start + interval '1 day' as window_end, ip, hits, hits - 3 as refused
from w where hits > 3""")
def t1(t):
    """Per-IP request counts over tumbling 1-day windows, limit 3 (the
    application's 60 s / 100 are never reached by the test log), read from
    the JSON request log as a stream."""
    _utc(t)
    return ST.rate_violations(_counted(t, ST.rate_rows(_log_stream(t), "1 day"), ST.RATE_KEYS, "t1"), limit=3)


@register("T1_refused_requests", """
with log as (select date_trunc('millisecond', ts) as ts, ip, request_id from f_request_log),
w as (select *, date_trunc('day', ts) as window_start, row_number() over (partition by date_trunc('day', ts), ip order by ts, request_id) as number from log)
select window_start, ip, ts, request_id, number from w where number > 3""")
def t1_refused(t):
    """The refused requests themselves: the fourth and later of an IP's day, numbered in time order."""
    _utc(t)
    return ST.refused_requests(TB.read_request_log(t.spark, write_request_log_lines(t, files=4)), "1 day", limit=3)


@register("T2_request_metrics", """
with log as (select date_trunc('millisecond', ts) as ts, method,
                    regexp_replace(regexp_replace(url, '\\?.*$', ''), '/[0-9]+(/|$)', '/:id\\1', 'g') as route,
                    status, cast(floor(ms * 100) / 100 as decimal(12,2)) as ms from f_request_log),
w as (select date_trunc('hour', ts) as window_start, method, route, count(*) as requests,
             count(*) filter (where status < 300) as ok_2xx,
             count(*) filter (where status >= 300 and status < 400) as redirect_3xx,
             count(*) filter (where status >= 400 and status < 500) as client_4xx,
             count(*) filter (where status >= 500) as server_5xx,
             cast(sum(ms) as decimal(18,2)) as total_ms, max(ms) as max_ms,
             list_sort(list(ms))[cast(ceil(0.95 * count(*)) as bigint)] as p95_ms
      from log group by 1, 2, 3)
select window_start, window_start + interval '1 hour' as window_end, method, route, requests, ok_2xx, redirect_3xx,
       client_4xx, server_5xx, total_ms, max_ms, p95_ms
from w""")
def t2(t):
    """Hourly request metrics per method and route from the JSON log stream."""
    _utc(t)
    return ST.request_metrics(_counted(t, ST.metric_rows(_log_stream(t), "1 hour"), ST.METRIC_KEYS, "t2"))


@register("T3_stock_alerts", """
with led as (select mv.*, p.low_stock_threshold, p.deleted_at,
               p.stock_quantity + 10 - (5000 + 1000 * (p.id % 3)) + sum(mv.delta) over (partition by mv.product_id
                 order by mv.changed_at, mv.ref_id, mv.line_no rows between unbounded preceding and current row) as qa
        from f_stock_movements mv join f_products p on mv.product_id = p.id)
select product_id, changed_by, cast(qa - delta as int) as quantity_before, cast(qa as int) as quantity_after, reason,
       changed_at, ref_id, line_no, low_stock_threshold
from led where qa - delta > low_stock_threshold and qa <= low_stock_threshold and deleted_at is null""")
def t3(t):
    """Low-stock alerts from a stream of all stock movements (written first as a
    movement log): stock crossing down to its threshold, for products that are not
    archived.  The start stock is such that the restock brings it to ten over the
    product's current stock."""
    _utc(t)
    base = shared_path(t.spark, "t3")
    t.movements.write.parquet(f"{base}/movements")
    schema = t.spark.read.parquet(f"{base}/movements").schema
    moves = t.spark.readStream.schema(schema).parquet(f"{base}/movements")
    start = t.products.select(F.col("id").alias("product_id"), (
        F.col("stock_quantity") + 10 - (5000 + 1000 * (F.col("id") % 3))).cast("int").alias("stock_quantity"))
    _run(ST.stock_alerts(moves, t.products, f"{base}/state", f"{base}/alerts", f"{base}/checkpoint",
                         initial=start))
    return t.spark.read.parquet(f"{base}/alerts").drop("batch")


REVOKED_SQL = """
select a.session_key as key, a.ts, a.request_id
from f_request_log a
where exists (select 1 from f_revocations r where a.session_key = r.key and a.ts >= r.revoked_at and a.ts < r.expires_at)"""


def _revoked(t, events: DataFrame, name: str) -> DataFrame:
    base = shared_path(t.spark, name)
    rows = ST.access_rows(FX.request_log_from(events), FX.revocations_from(events))
    _run(ST.revoked_use(rows, f"{base}/state", f"{base}/out", f"{base}/checkpoint"))
    return t.spark.read.parquet(f"{base}/out").drop("batch")


@register("T4_revoked_use", REVOKED_SQL)
def t4(t):
    """Requests made with a key while it is revoked, each once (requests and revocations both from events)."""
    _utc(t)
    return _revoked(t, _stream_table(t, "events"), "t4")


@register("T4_revoked_use_batches", REVOKED_SQL)
def t4_batches(t):
    """The same from four files, one to a micro-batch, none in time order: requests come long after or before
    the revocations that hold them, and nothing is lost."""
    _utc(t)
    base = shared_path(t.spark, "t4-events")
    t.raw("events").repartition(4, F.xxhash64("event_id")).write.parquet(base)
    stream = t.spark.readStream.schema(t.raw("events").schema).option("maxFilesPerTrigger", 1).parquet(base)
    return _revoked(t, stream, "t4")


@register("T5_status_stream", f"""
select order_id, seq, status, actor_id, actor_role, reason is null as accepted, reason from ({STATUS_OUTCOME_SQL}) x""")
def t5(t):
    """Status requests as a stream, applied batch by batch to the orders."""
    _utc(t)
    base = shared_path(t.spark, "t5")
    req = FX.status_requests_from(_stream_table(t, "orders"))
    _run(ST.status_stream(req, t.orders, f"{base}/state", f"{base}/out", f"{base}/checkpoint", as_of=AS_OF))
    return t.spark.read.parquet(f"{base}/out").drop("batch")

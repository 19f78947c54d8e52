"""Structured Streaming jobs (T1-T5).

The application keeps this state in process memory (per-IP counters, a
revoked-token map) or changes it per request (stock, order status).  Here
they are streams over event time:

* T1 ``rate_violations``  tumbling windows per IP, over-limit counts
* T2 ``request_metrics``  windowed counts, status classes, latency totals and p95;
  both from counts that each micro-batch writes and a reader sums
* T3 ``stock_alerts``     ``foreachBatch``: running stock per product from
  its current stock (a change log), alerts on crossing down to the threshold
* T4 ``revoked_use``      ``foreachBatch``: requests meet the revocations of their
  days, late ones of either kind too; state is kept by day
* T5 ``status_stream``    ``foreachBatch``: status requests applied to the
  current status of the orders they name (M7); state is a change log

``foreachBatch`` jobs write each batch's output under its
batch id with overwrite, so a replayed batch after a failure rewrites the
same files (idempotent).  Test tables store TIMESTAMP_NTZ, which
``withWatermark`` rejects, so event times are cast to TIMESTAMP first.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from ..operators import mutate as MU
from ..operators import relations as R
from ..operators import running
from ..sources.commits import Files


def event_time(col: str) -> Column:
    return F.col(col).cast("timestamp")


def route_of(url: Column) -> Column:
    """URL without query string, numeric path segments replaced by ':id'."""
    path = F.regexp_replace(url, r"\?.*$", "")
    return F.regexp_replace(path, r"/[0-9]+(?=/|$)", "/:id")


def status_class(status: Column) -> Column:
    return F.when(status >= 500, "5xx").when(status >= 400, "4xx").when(status >= 300, "3xx").otherwise("2xx")


# ------------------------------------------------------------------ T1, T2
def count_stream(rows: DataFrame, keys: list[str], out_dir: str, checkpoint: str, available_now: bool = True):
    """Start a stream that writes, per micro-batch, the number of rows of each
    combination of ``keys`` under its batch id (a replay rewrites the same files).

    Counts add up over batches, so no state is held, a late row counts in its
    own window like any other, and the last window needs no later row to
    close it: whoever reads the counts sums them."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    w = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def compact_counts(spark: SparkSession, out_dir: str, keys: list[str], to: str) -> None:
    """The counts of all batches so far as one table in a new folder ``to``."""
    spark.read.parquet(out_dir).groupBy(*keys).agg(F.sum("n").alias("n")).write.mode("errorifexists").parquet(to)


RATE_KEYS = ["window_start", "window_end", "ip"]


def rate_rows(log: DataFrame, window: str = "60 seconds") -> DataFrame:                 # T1
    """Each request with the tumbling window it falls into."""
    w = F.window(event_time("ts"), window)
    return log.select(w.alias("w"), "ip").select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                                                 F.col("w.end").cast("timestamp_ntz").alias("window_end"), "ip")


def rate_violations(counts: DataFrame, limit: int = 100) -> DataFrame:                  # T1
    """Per IP and window: requests over ``limit`` are refused (refused
    requests count too, as in the application's counter)."""
    hits = counts.groupBy(*RATE_KEYS).agg(F.sum("n").alias("hits"))
    return hits.filter(F.col("hits") > limit).select(*RATE_KEYS, "hits", (F.col("hits") - limit).alias("refused"))


METRIC_KEYS = ["window_start", "window_end", "method", "route", "status_class", "ms"]


def metric_rows(log: DataFrame, window: str = "1 hour") -> DataFrame:                   # T2
    """Each request with its window, route, status class and latency (ms as DECIMAL)."""
    w = F.window(event_time("ts"), window)
    return log.select(w.alias("w"), "method", "url", "status", "ms").select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "method", route_of(F.col("url")).alias("route"), status_class(F.col("status")).alias("status_class"),
        F.col("ms").cast("decimal(12,2)").alias("ms"))


def request_metrics(counts: DataFrame) -> DataFrame:                                    # T2
    """Per window, method and route, from the latency histogram that
    :func:`count_stream` writes: request count by status class, exact latency total and
    maximum, and the exact 95th percentile (the value at rank ceil(0.95 n) of
    the requests that have a latency)."""
    group = ["window_start", "window_end", "method", "route"]
    n_of = lambda cls: F.coalesce(F.sum(F.when(F.col("status_class") == cls, F.col("n"))), F.lit(0))
    totals = counts.groupBy(*group).agg(
        F.sum("n").alias("requests"), n_of("2xx").alias("ok_2xx"), n_of("3xx").alias("redirect_3xx"),
        n_of("4xx").alias("client_4xx"), n_of("5xx").alias("server_5xx"),
        F.sum(F.col("ms") * F.col("n")).cast("decimal(18,2)").alias("total_ms"), F.max("ms").alias("max_ms"))
    by_ms = counts.filter(F.col("ms").isNotNull()).groupBy(*group, "ms").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*group)
    below = F.sum("n").over(w.orderBy("ms").rowsBetween(Window.unboundedPreceding, 0))
    ranked = by_ms.select(*group, "ms", below.alias("_below"), F.sum("n").over(w).alias("_all"))
    p95 = ranked.filter(F.col("_below") * 100 >= F.col("_all") * 95).groupBy(*group).agg(F.min("ms").alias("p95_ms"))
    x, y = totals.alias("x"), p95.alias("y")
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in group]
    return x.join(y, on, "left").select("x.*", "y.p95_ms")


def refused_requests(log: DataFrame, window: str = "60 seconds", limit: int = 100) -> DataFrame:     # T1
    """The requests that the limit refuses: in each IP's window all after the
    first ``limit``, in the order of time and request id.  Numbered from the log itself, so
    they do not depend on how it was cut into files or batches; the rows of a hot IP are split by time."""
    w = F.window(event_time("ts"), window)
    rows = log.select(w.alias("w"), "ip", "ts", "request_id").select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "ip", F.col("ts").cast("timestamp_ntz").alias("ts"), "request_id")
    # ids of the same time are dealt to a thousand blocks that follow their order
    block = F.substring(F.coalesce("request_id", F.lit("")), 1, 3)
    levels = [*running.time_levels(F.col("ts"), F.lit(0))[:3], block]
    numbered = running.running_sum(rows, ["window_start", "ip"], [F.col("ts"), F.coalesce("request_id", F.lit("")), F.col("request_id")],
                                   F.lit(1).cast("bigint"), "number", chunk=levels)
    return numbered.filter(F.col("number") > limit)


# ------------------------------------------------------------------ T4
def access_rows(access: DataFrame, revocations: DataFrame) -> DataFrame:
    """Requests and revocations (batches or streams) as one: ``revocation``, key, ts, request_id."""
    a = access.select(F.lit(False).alias("revocation"), F.col("session_key").alias("key"), F.col("ts").cast("timestamp_ntz").alias("ts"), "request_id")
    return a.unionByName(revocations.select(F.lit(True).alias("revocation"), "key", F.col("revoked_at").cast("timestamp_ntz").alias("ts"),
                                            F.lit(None).cast("string").alias("request_id")))


def _held(requests: DataFrame, revocations: DataFrame, days: int, how: str) -> DataFrame:
    """``requests`` whose key a revocation holds at their time (``left_semi``) or none does (``left_anti``).

    A revocation stands under each day that it touches, so both sides meet by key
    and day, not by key alone."""
    r = revocations.select("key", F.col("ts").alias("_from"), (F.col("ts") + F.expr(f"interval {days} days")).alias("_to")).distinct()
    r = r.withColumn("_day", F.explode(F.sequence(F.to_date("_from"), F.to_date("_to"))))
    # merged and not broadcast: these are many times the rows that the files' size tells of
    q, r = requests.alias("q"), r.alias("r").hint("merge")
    return q.join(r, (F.col("q.key") == F.col("r.key")) & (F.to_date(F.col("q.ts")) == F.col("r._day"))
                  & (F.col("q.ts") >= F.col("r._from")) & (F.col("q.ts") < F.col("r._to")), how)


class DayLog:
    """Rows kept by the day of their time and the batch that brought them; only the days asked for are listed and read."""

    def __init__(self, spark: SparkSession, folder: str, schema):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.files = Files(spark, folder)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """A replayed batch replaces what it wrote."""
        out = rows.withColumn("day", F.to_date("ts")).withColumn("batch", F.lit(batch_id))
        out = out.repartition("day", F.pmod(F.xxhash64("key"), F.lit(8)))    # a few files a day, also of a day or key with most rows
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(self.folder)

    def days(self) -> list[str]:
        return sorted(n.removeprefix("day=") for n, _ in self.files.names(self.folder) if n.startswith("day="))

    def read(self, first, last, before: int) -> DataFrame:
        """Rows of the days from first to last that came before a batch."""
        days = [d for d in self.days() if str(first) <= d <= str(last)]
        if not days:
            return self.spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema.fields, T.StructField("day", T.DateType()), T.StructField("batch", T.LongType())])
        rows = self.spark.read.schema(schema).option("basePath", self.folder).parquet(*[f"{self.folder}/day={d}" for d in days])
        return rows.filter(F.col("batch") < before).drop("day", "batch")

    def expire(self, before: str) -> None:
        """Removes the days before ``before``: rows that come later for them find nothing there."""
        for d in self.days():
            if d < before:
                self.files.remove(f"{self.folder}/day={d}")


def revoked_use_batch(spark: SparkSession, rows: DataFrame, state_dir: str, out_dir: str, batch_id: int, days: int = 7) -> None:
    """One micro-batch of requests and revocations (:func:`access_rows`).

    New requests meet all revocations so far; requests of earlier batches that
    none of the earlier revocations held meet the new ones.  So each request is
    refused once, in the batch in which the first of its request and a holding
    revocation is complete, whatever the order of arrival.  Both are kept by
    day, and a batch reads the days within ``days`` of its own rows only."""
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("ts", T.TimestampNTZType()),
                           T.StructField("request_id", T.StringType())])
    known, asked = DayLog(spark, f"{state_dir}/revocations", schema), DayLog(spark, f"{state_dir}/requests", schema)
    rows = rows.filter(F.col("key").isNotNull() & F.col("ts").isNotNull())
    new_keys, new = rows.filter("revocation").drop("revocation"), rows.filter("not revocation").drop("revocation")
    span = rows.groupBy("revocation").agg(F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last")).collect()
    span = {r.revocation: (r.first, r.last) for r in span}
    week = dt.timedelta(days=days)
    found = None
    if False in span:
        first, last = span[False]
        found = _held(new, known.read(first - week, last, batch_id).unionByName(new_keys), days, "left_semi")
    if True in span:
        first, last = span[True]
        earlier = asked.read(first, last + week, batch_id)
        late = _held(_held(earlier, new_keys, days, "left_semi"), known.read(first - 2 * week, last + week, batch_id), days, "left_anti")
        found = late if found is None else found.unionByName(late)
    if found is not None:
        found.select("key", "ts", "request_id").write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
    known.write(new_keys, batch_id)
    asked.write(new, batch_id)


def revoked_use(rows: DataFrame, state_dir: str, out_dir: str, checkpoint: str, days: int = 7, available_now: bool = True):
    """Start T4 on a stream of :func:`access_rows`: requests made with a key while one of its
    revocations holds (``revoked_at <= ts < revoked_at + days``), each once.

    No row is dropped for being late: it meets the days that it belongs to.
    ``DayLog.expire`` removes days that no later row can need."""
    spark = rows.sparkSession
    w = rows.writeStream.foreachBatch(lambda batch, batch_id: revoked_use_batch(spark, batch, state_dir, out_dir, batch_id, days))
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


# ------------------------------------------------------------------ T3
def stock_alert_batch(spark: SparkSession, movements: DataFrame, thresholds: DataFrame, state_dir: str,
                      out_dir: str, batch_id: int, initial: DataFrame | None = None) -> None:
    """One micro-batch of stock movements: ledger from the current stock of
    the products it touches, alerts where stock crosses from above the
    threshold to at or below it (live products only), and the touched products' new stock.

    State is a change log under ``state_dir`` (product_id, stock_quantity,
    batch): the current stock of a product is its latest logged value, else
    its ``initial`` stock, else 0.  A batch reads and writes only the
    products it touches, and writes under its batch id (a replay rewrites
    the same files)."""
    touched = movements.select("product_id").distinct()
    start = None
    if initial is not None:
        start = initial.select("product_id", "stock_quantity").join(touched, "product_id", "left_semi")
    if batch_id > 0:                   # every batch before wrote its state
        logged = (spark.read.parquet(state_dir).filter(F.col("batch") < batch_id)
                  .join(touched, "product_id", "left_semi")
                  .groupBy("product_id").agg(F.max_by("stock_quantity", "batch").alias("stock_quantity")))
        start = logged if start is None else \
            start.join(logged.withColumnRenamed("stock_quantity", "_logged"), "product_id", "full_outer") \
            .select("product_id", F.coalesce("_logged", "stock_quantity").alias("stock_quantity"))
    audit = R.stock_ledger(movements, start=start)
    thr = thresholds.filter(P.live()).select(F.col("id").alias("product_id"), "low_stock_threshold")
    alerts = audit.join(thr, "product_id", "inner").filter(
        (F.col("quantity_before") > F.col("low_stock_threshold")) &
        (F.col("quantity_after") <= F.col("low_stock_threshold")))
    alerts.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
    moved = movements.groupBy("product_id").agg(F.sum("delta").alias("_d"))
    base = start if start is not None else moved.select("product_id", F.lit(0).alias("stock_quantity"))
    new = moved.join(base, "product_id", "left").select(
        "product_id", (F.coalesce("stock_quantity", F.lit(0)) + F.col("_d")).cast("int").alias("stock_quantity"))
    new.write.mode("overwrite").parquet(f"{state_dir}/batch={batch_id}")


def stock_alerts(movements: DataFrame, thresholds: DataFrame, state_dir: str, out_dir: str,
                 checkpoint: str, initial: DataFrame | None = None, available_now: bool = True):
    """Start T3 on a stream of movements (product_id, changed_by, delta,
    reason, changed_at, ref_id, line_no)."""
    spark = movements.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            stock_alert_batch(spark, batch, thresholds, state_dir, out_dir, batch_id, initial)
        finally:
            batch.unpersist()

    w = movements.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


# ------------------------------------------------------------------ T5
def status_stream(requests: DataFrame, orders: DataFrame, state_dir: str, out_dir: str, checkpoint: str,
                  as_of=None, available_now: bool = True):
    """Start T5: each micro-batch of status requests is applied (M7) to the
    current status of the orders it names.  State is a log of status
    changes (order_id, status, batch) under ``state_dir``: the current
    status of an order is its latest change, else its base row.  Each batch
    writes only its outcomes and its changes, under its batch id."""
    spark = requests.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            _status_batch(batch, batch_id)
        finally:
            batch.unpersist()

    def _status_batch(batch: DataFrame, batch_id: int) -> None:
        ids = batch.select("order_id").distinct()
        cur = orders.join(ids.withColumnRenamed("order_id", "id"), "id", "left_semi")
        if batch_id > 0:
            log = spark.read.parquet(state_dir).filter(F.col("batch") < batch_id) \
                .join(ids, "order_id", "left_semi")
            last = log.groupBy("order_id").agg(F.max_by("status", "batch").alias("_s"))
            cur = cur.join(last.withColumnRenamed("order_id", "id"), "id", "left") \
                .withColumn("status", F.coalesce("_s", "status")).drop("_s")
        res = MU.advance_status(cur, batch, as_of=as_of)
        res.extra["requests"].write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
        changed = res.table.alias("n").join(cur.alias("c"), "id").filter(F.col("n.status") != F.col("c.status")) \
            .select(F.col("id").alias("order_id"), F.col("n.status").alias("status"))
        changed.write.mode("overwrite").parquet(f"{state_dir}/batch={batch_id}")

    w = requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


# ------------------------------------------------------------------ sinks
def to_parquet(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append a streaming result to Parquet (exactly-once file sink)."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()

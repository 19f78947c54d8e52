"""T4 and T1: the same rows however the input is cut into batches."""
import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from stocksmith.streaming import streams as ST

T0 = dt.datetime(2024, 1, 1)


def _rows(seed):
    rng = random.Random(seed)
    at = lambda: T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 30))
    out = [(False, rng.randrange(4), at(), f"r{i}") for i in range(60)] + [(True, rng.randrange(4), at(), None) for _ in range(5)]
    # on the edges, a key revoked twice, and rows without key or time
    out += [(True, 9, T0, None), (False, 9, T0, "first"), (False, 9, T0 + dt.timedelta(days=7), "free"),
            (False, 9, T0 + dt.timedelta(days=7) - dt.timedelta(microseconds=1), "last"), (True, 9, T0 + dt.timedelta(days=3), None),
            (False, None, T0, "no key"), (False, 9, None, "no time"), (True, None, T0, None)]
    return out


def _want(rows):
    keys = [(k, t) for r, k, t, _ in rows if r and k is not None]
    return sorted(i for r, k, t, i in rows if not r and k is not None and t and any(k == x and y <= t < y + dt.timedelta(days=7) for x, y in keys))


@pytest.mark.parametrize("batches", [1, 4])
def test_any_batching(spark, batches):
    rows = _rows(batches)
    random.Random(7).shuffle(rows)
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for b in range(batches):
        df = spark.createDataFrame(rows[b::batches], "revocation boolean, key long, ts timestamp_ntz, request_id string")
        for _ in range(2 if b == 1 else 1):      # one batch is replayed
            ST.revoked_use_batch(spark, df, f"{base}/state", f"{base}/out", b)
    got = sorted(r.request_id for r in spark.read.parquet(f"{base}/out").collect())
    assert got == _want(rows) and len(got) > 5


def test_one_late_request_and_its_revocation(spark):
    """A request hours behind the newest row, and the revocation that holds it, each in a batch of its own."""
    schema = "revocation boolean, key long, ts timestamp_ntz, request_id string"
    late = [(False, 1, T0, "late")], [(True, 1, T0 - dt.timedelta(hours=1), None)], [(False, 2, T0 + dt.timedelta(days=5), "new")]
    for order in ((2, 0, 1), (2, 1, 0), (0, 1, 2)):
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        for b, k in enumerate(order):
            ST.revoked_use_batch(spark, spark.createDataFrame(late[k], schema), f"{base}/state", f"{base}/out", b)
        assert [r.request_id for r in spark.read.parquet(f"{base}/out").collect()] == ["late"]


def test_revocations_are_not_broadcast(spark):
    """A few hundred bytes of file become eight rows for each revocation: no task holds them all, however small the file looks."""
    import contextlib
    import io
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    keys = spark.range(2000).select(F.col("id").alias("key"), F.lit(T0).cast("timestamp_ntz").alias("ts"))
    keys.write.parquet(f"{base}/keys")
    asked = keys.select("key", (F.col("ts") + F.expr("interval 3 days")).alias("ts"), F.col("key").cast("string").alias("request_id"))
    for how, want in (("left_semi", 2000), ("left_anti", 0)):
        held = ST._held(asked, spark.read.parquet(f"{base}/keys"), 7, how)
        assert held.count() == want
        with contextlib.redirect_stdout(io.StringIO()) as out:
            held.explain()
        assert "SortMergeJoin" in out.getvalue() and "Broadcast" not in out.getvalue()


def test_refused_requests(spark):
    rng = random.Random(3)
    rows = [(T0 + dt.timedelta(seconds=rng.randrange(120)), rng.choice("ab"), f"r{i}") for i in range(300)] + [(T0, None, "x"), (T0, None, "y")]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, ip string, request_id string")
    want = []
    for ip in ("a", "b", None):
        for minute in (0, 1):
            mine = sorted((t, i) for t, p, i in rows if p == ip and t.minute == minute)
            want += [(i, n) for n, (_, i) in enumerate(mine, 1) if n > 40]
    got = ST.refused_requests(df, limit=40).collect()
    assert sorted((r.request_id, r.number) for r in got) == sorted(want) and want
    assert ST.refused_requests(df.filter(F.lit(False))).collect() == []

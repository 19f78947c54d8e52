"""Spark session defaults and the shared working folder.

Everything that must outlive a task (checkpoints, streaming state, snapshot
versions written by jobs) goes under the folder the cluster names in
``spark.checkpoint.dir``.  Only a local-mode session with no such setting
gets a fresh folder of its own (tests, benchmarks).
"""

from __future__ import annotations

import datetime as _dt
import os
import tempfile
import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on: UTC wall clock, AQE for runtime join
# selection, partition coalescing and skewed-join splitting.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    # remove checkpoint files once their plans are garbage (M6/M7 rounds)
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


#: Beyond it the map statuses of a shuffle no longer fit a driver; partitions then grow instead.
MAX_SHUFFLE_PARTITIONS = 50_000


def scale_conf(input_bytes: int, executors: int, cores_per_executor: int = 4,
               target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Shuffle and scan sizing for a cluster run over ``input_bytes``.

    ``input_bytes`` is what a job reads after column pruning and partition
    filters, not the size of the tables.  Scans split files into
    ``target_partition_bytes`` pieces.  Shuffles start from enough partitions
    that each holds about that much of the input (never fewer than 3 waves of
    the cluster's cores, never more than ``MAX_SHUFFLE_PARTITIONS``: the driver
    keeps a status of each map task for every one of them), and AQE coalesces them
    to the same advisory size once sizes are known.  Skewed join
    partitions above 4x the median are split by AQE; windows and
    aggregates handle their own hot keys (``operators/running.py``)."""
    cores = max(1, executors * cores_per_executor)
    parts = min(max(3 * cores, input_bytes // target_partition_bytes), MAX_SHUFFLE_PARTITIONS)
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }


def get_spark(master: str | None = None, app: str = "stocksmith",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Base of the shared folder; sets the RDD checkpoint dir if unset."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", base)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared root for one job run."""
    return f"{shared_root(spark)}/stocksmith/{name}-{uuid.uuid4().hex[:12]}"


def ts_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal (the test tables store NTZ timestamps)."""
    if isinstance(value, (_dt.datetime, _dt.date)):
        value = value.isoformat(sep=" ") if isinstance(value, _dt.datetime) else value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


# One fixed run time for jobs that stamp rows, so reruns give equal output.
DEFAULT_AS_OF = "2001-08-02 00:00:00"

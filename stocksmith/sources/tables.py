"""Table storage: versioned Parquet snapshots, the audit sink and the
request log reader (S1, S3, S4, S6).

Plain Parquet has no MERGE or UPDATE, so a job that changes one table writes a
whole new version ``<root>/<table>/v=<n>`` and then adds its number to the
table's list of commits; readers take the newest listed version.  A writer first
claims its number, so two writers never write the same one, and a listed version is
never overwritten.  Changes of several tables at once, or of few rows, go through
:mod:`stocksmith.sources.commits`.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import commits
from . import schemas as S


def versions(spark: SparkSession, root: str, table: str) -> list[int]:
    """Committed versions of a table, oldest first: one small row each in its list of commits."""
    found = _commits(spark, root, table)
    return [] if found is None else sorted(r.version for r in found.collect())


def latest_version(spark: SparkSession, root: str, table: str) -> int | None:
    found = _commits(spark, root, table)
    return None if found is None else found.agg(F.max("version")).first()[0]


def _commits(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """The list of commits; None if the table has none yet. Any other failure to read it is an error."""
    try:
        return spark.read.schema("version long").parquet(f"{root}/{table}.commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_table(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:   # S1
    """A table snapshot with its declared schema (no inference)."""
    if version is None:
        version = latest_version(spark, root, table)
        if version is None:
            raise FileNotFoundError(f"no committed version of {table} under {root}")
    return spark.read.schema(S.TABLES[table]).parquet(f"{root}/{table}/v={version:08d}")


def load_tables(spark: SparkSession, root: str, wanted: list[str] | None = None) -> dict[str, DataFrame]:
    """The newest version of each table that has one; with ``wanted`` of exactly those, and an error if one has none."""
    found = {t: latest_version(spark, root, t) for t in (wanted or S.TABLES)}
    absent = [t for t, v in found.items() if v is None]
    if wanted and absent:
        raise FileNotFoundError(f"no committed version of {', '.join(absent)} under {root}")
    return {t: load_table(spark, root, t, v) for t, v in found.items() if v is not None}


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int,
              num_partitions: int, properties: dict | None = None) -> DataFrame:                    # S1
    """A table of a live database, read in ``num_partitions`` parallel range
    queries on ``partition_column`` (the JDBC driver jar must be on the
    classpath), then given the declared schema's column types."""
    df = spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                         numPartitions=num_partitions, properties=properties or {})
    schema = S.TABLES[table]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_snapshot(df: DataFrame, root: str, table: str, partition_by: list[str] | None = None) -> int:   # S3
    """Commit ``df`` as the next version of ``table``; returns the version.
    Columns are put in the declared order and types first.  What a failed write left
    under that version is overwritten; it was never committed.  A number that another
    writer claimed, finished or not, is passed over."""
    spark = df.sparkSession
    v = (latest_version(spark, root, table) or 0) + 1
    files = commits.Files(spark, root)
    while not files.create_once(f"{root}/{table}.claims/{v:08d}", ""):
        v += 1
    schema = S.TABLES[table]
    out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{root}/{table}/v={v:08d}")
    spark.range(v, v + 1, 1, 1).select(F.col("id").alias("version")).write.mode("append").parquet(f"{root}/{table}.commits")
    return v


def append_audit(df: DataFrame, root: str, job: str) -> None:                             # S4
    """Append the audit rows of one job run to the append-only audit table.
    ``job`` names the run: a run that is repeated after a failure replaces its own
    rows and no others."""
    schema = S.STOCK_AUDIT_LOG
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]) \
        .write.mode("overwrite").parquet(f"{root}/stock_audit_log_append/job={job}")


def load_audit(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(S.STOCK_AUDIT_LOG).parquet(f"{root}/stock_audit_log_append").select(
        *S.STOCK_AUDIT_LOG.fieldNames())


def _parsed_log(lines: DataFrame, col: str) -> DataFrame:
    """Log lines with their typed fields and ``reason`` (NULL: a good line)."""
    schema = T.StructType([*S.REQUEST_LOG_JSON.fields, T.StructField("_corrupt", T.StringType())])
    j = F.from_json(F.col(col), schema, {"columnNameOfCorruptRecord": "_corrupt"})
    p = lines.select(F.col(col).alias("line"), j.alias("j")).select("line", "j.*")
    ts = F.regexp_replace("ts", "Z$", "").try_cast("timestamp_ntz")
    ms = F.col("ms").try_cast("double")
    reason = F.when(F.col("_corrupt").isNotNull() | F.coalesce(F.trim("line") == "", F.lit(True)), "not_json") \
        .when(ts.isNull(), "invalid_ts").when(F.col("ms").isNotNull() & ms.isNull(), "invalid_ms")
    return p.select("line", ts.alias("ts"), "method", "url", F.col("status").cast("int").alias("status"), ms.alias("ms"),
                    F.col("requestId").alias("request_id"), "ip", reason.alias("reason"))


def parse_request_log(lines: DataFrame, col: str = "value") -> DataFrame:                # S6
    """JSON log lines -> typed rows.  ``ts`` is the ISO time in UTC (kept as
    TIMESTAMP_NTZ wall time), ``ms`` arrives as a string and becomes DOUBLE.  Lines that
    are not JSON or hold a bad time or number are left to
    :func:`rejected_log_lines`."""
    return _parsed_log(lines, col).filter(F.col("reason").isNull()).drop("line", "reason")


def rejected_log_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """(line, reason) of the log lines that :func:`parse_request_log` leaves out."""
    return _parsed_log(lines, col).filter(F.col("reason").isNotNull()).select("line", "reason")


def read_request_log(spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """Batch or streaming read of a folder of JSON-lines request logs."""
    if stream:
        r = spark.readStream.format("text")
        if max_files:
            r = r.option("maxFilesPerTrigger", max_files)
        return parse_request_log(r.load(path))
    return parse_request_log(spark.read.text(path))


def to_log_lines(log: DataFrame) -> DataFrame:
    """Typed request-log rows -> the JSON line the server prints: ISO time
    with milliseconds, ``ms`` as a string with two decimals."""
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), "method", "url", "status",
        F.format_string("%.2f", F.col("ms")).alias("ms"), F.col("request_id").alias("requestId"), "ip"))
    return log.select(line.alias("value"))

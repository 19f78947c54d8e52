"""Lists kept in their order, with row counts per range: any page by its number (G1, G2).

``offset`` ranks every row before the page.  Here a list is written once in
its order, cut into ranges, and the rows of each range are counted beside it.  A
page is then found in the counts: only the ranges that hold it are read.  Page
and total come from the same files, so they tell of one state.

Ranges lie in folders that follow the order too.  Up to :data:`MIN_FOLDERS` ranges
have a folder each; more than these share folders, so tasks, files and what the
driver hears of them grow with the rows and not with the ranges.  A range inside
a folder is found by its number, which Parquet keeps minima and maxima of.

The counts are written last; a list without them was not finished and is not
read.  There are at most :data:`MAX_RANGES` ranges, so the counts (24 bytes each)
fit on the driver at every size.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_RANGES = 100_000
RANGE_ROWS = 1_000_000
MIN_FOLDERS = 64


def _with_range(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_slice", T.LongType()), T.StructField("_range", T.IntegerType())])


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_range", "_slice").agg(F.count(F.lit(1)).alias("rows"))


def _by_range(counts: DataFrame) -> dict[tuple[int, int], int]:
    """Rows by (folder, range in it), in the list's order."""
    return {(f, k): n for f, k, n in sorted((r["_range"], r["_slice"], r.rows) for r in counts.collect())}


class PagedList:
    def __init__(self, spark: SparkSession, root: str, order: list[Column]):
        self.spark, self.root, self.order = spark, root.rstrip("/"), order
        self.counts = _by_range(spark.read.schema("_range int, _slice long, rows bigint").parquet(f"{self.root}/counts"))
        self.schema = spark.read.parquet(f"{self.root}/none").schema

    @classmethod
    def write(cls, df: DataFrame, root: str, order: list[Column], range_rows: int = RANGE_ROWS) -> PagedList:
        """Writes ``df`` as a list in ``order``, whose last column must be unique for pages to be stable."""
        spark, root = df.sparkSession, root.rstrip("/")
        if range_rows < 1:
            raise ValueError("range_rows must be >= 1")
        rows = df.count()
        ranges = min(MAX_RANGES, max(1, -(-rows // range_rows)))
        folders = min(ranges, max(MIN_FOLDERS, -(-rows // RANGE_ROWS)))
        # a folder that is one range is not cut; others after so many of their sorted rows
        size = max(range_rows, -(-rows // MAX_RANGES)) if folders < ranges else rows + 1
        dealt = df.repartitionByRange(folders, *order).sortWithinPartitions(*order)
        # both numbers are taken after the exchange and the sort, in the job that writes the rows
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        dealt = dealt.select(*df.columns, F.floor(place / F.lit(size)).alias("_slice"), F.spark_partition_id().alias("_range"))
        dealt.write.partitionBy("_range").parquet(f"{root}/rows")
        df.limit(0).write.parquet(f"{root}/none")
        _counted(spark.read.schema(_with_range(df.schema)).parquet(f"{root}/rows")).write.parquet(f"{root}/counts")
        return cls(spark, root, order)

    def total(self, where: Column | None = None) -> int:
        return sum(self._matching(where).values())

    def _matching(self, where: Column | None) -> dict[tuple[int, int], int]:
        """Rows by range: the stored counts, or with a filter one count over its columns."""
        if where is None:
            return self.counts
        if not self.counts:
            return {}
        rows = self.spark.read.schema(_with_range(self.schema)).parquet(f"{self.root}/rows")
        return _by_range(_counted(rows.where(where)))

    def _read(self, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
        """The rows of consecutive ranges; the folders of others are neither listed nor opened."""
        folders = sorted({f for f, _ in self.counts if first[0] <= f <= last[0]})
        paths = [f"{self.root}/rows/_range={f}" for f in folders]
        rows = self.spark.read.schema(_with_range(self.schema)).option("basePath", f"{self.root}/rows").parquet(*paths)
        folder, number = F.col("_range"), F.col("_slice")
        rows = rows.where((number >= first[1]) & (number <= last[1]) if len(folders) == 1 else
                          ((folder > first[0]) | (number >= first[1])) & ((folder < last[0]) | (number <= last[1])))
        return rows.select(*self.schema.names)

    def page(self, page_no: int, limit: int, where: Column | None = None) -> DataFrame:
        """As ``orderBy(order).offset((page_no - 1) * limit).limit(limit)`` over the rows that pass ``where``;
        reads only the ranges that hold these rows."""
        if int(limit) < 1 or int(page_no) < 1:
            raise ValueError("page and limit must be >= 1")
        first = (int(page_no) - 1) * int(limit)
        counts = self._matching(where)
        ends = dict(zip(counts, accumulate(counts.values())))
        wanted = [k for k, end in ends.items() if end > first and end - counts[k] < first + int(limit)]
        rows = self._read(wanted[0], wanted[-1]) if wanted else self.spark.createDataFrame([], self.schema)
        if where is not None:
            rows = rows.where(where)
        skip = first - (ends[wanted[0]] - counts[wanted[0]]) if wanted else 0
        out = rows.orderBy(*self.order)
        return (out.offset(skip) if skip else out).limit(int(limit))

    def summary(self, page_no: int, limit: int, where: Column | None = None) -> DataFrame:
        """total, page, limit, total_pages (G2) of the state that :meth:`page` reads."""
        from ..operators.paging import page_summary
        return page_summary(self.spark.range(1).select(F.lit(self.total(where)).cast("bigint").alias("total")), page_no, limit)

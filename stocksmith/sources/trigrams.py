"""Substring search by trigrams (F2).

Postings name for each three characters of a lower-cased field the rows that
hold them.  A LIKE pattern is cut at its wildcards; a row that matches holds all
trigrams of the pieces, so the postings of these give candidates, and the
pattern itself is tested on the candidates alone.

Postings lie in folders by a hash of the trigram, in order of trigram and key, so a search
opens the folders of its trigrams only.  They are dealt by ranges of
(folder, trigram, key): a trigram that every row holds is split over tasks and files by key.

Rule for patterns without trigrams (no piece of three ASCII characters between
wildcards): the table is scanned.  Other characters end a piece, because
lower-casing them is the database's matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Files

FOLDERS = 256


def grams_of(pattern: str) -> list[str]:
    """Trigrams that every text matching the LIKE ``pattern`` (escape: backslash) has in lower case."""
    pieces, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            pieces[-1] += pattern[at] if pattern[at].isascii() else ""
            if not pattern[at].isascii():
                pieces.append("")
        elif c in "%_" or not c.isascii():
            pieces.append("")
        else:
            pieces[-1] += c.lower()
        at += 1
    return sorted({p.lower()[i:i + 3] for p in pieces for i in range(len(p) - 2)})


def _folder(gram: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(folders)).cast("int")


def _postings(low: Column, field: int) -> Column:
    """(field, trigram) of each distinct trigram of a lower-cased field; none for NULL."""
    places = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    grams = F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(3))))
    return F.transform(grams, lambda g: F.struct(F.lit(field).cast("tinyint").alias("field"), g.alias("gram")))


class TrigramIndex:
    """Postings of some string columns of a table, for rows found again by ``key``."""

    def __init__(self, spark: SparkSession, root: str, fields: list[str], key: str = "id", folders: int = FOLDERS):
        self.spark, self.root, self.fields, self.key, self.folders = spark, root.rstrip("/"), fields, key, folders

    def _schema(self):
        return self.spark.read.parquet(f"{self.root}/_none").schema

    def write(self, table: DataFrame) -> TrigramIndex:
        """Postings of all rows whose key is not NULL; NULL and short fields have none."""
        marks = [_postings(F.lower(F.col(f)), k) for k, f in enumerate(self.fields)]
        post = table.where(F.col(self.key).isNotNull()).select(F.col(self.key).alias("_key"), F.inline(F.concat(*marks)))
        post = post.withColumn("_folder", _folder(F.col("gram"), self.folders))
        order = ["_folder", "gram", "_key"]
        post.limit(0).drop("_folder").write.parquet(f"{self.root}/_none")
        post.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").partitionBy("_folder").parquet(self.root)
        return self

    def candidates(self, pattern: str) -> DataFrame | None:
        """Keys of the rows one of whose fields holds all trigrams of the pattern; None where it has none."""
        grams = grams_of(pattern)
        if not grams:
            return None
        which = self.spark.range(1).select(F.array_distinct(F.array(*[_folder(F.lit(g), self.folders) for g in grams])).alias("f"))
        there = {n for n, _ in Files(self.spark, self.root).names(self.root)}
        # only these folders are listed and read; a trigram that no row holds may have none
        paths = [f"{self.root}/_folder={f}" for f in sorted(which.first().f) if f"_folder={f}" in there]
        read = self.spark.read.schema(self._schema())
        post = (read.parquet(*paths) if paths else self.spark.createDataFrame([], self._schema())).where(F.col("gram").isin(grams))
        # a key that two rows share may have a posting twice
        full = post.groupBy("_key", "field").agg(*[F.bool_or(F.col("gram") == g).alias(f"g{i}") for i, g in enumerate(grams)])
        return full.where(reduce(lambda a, b: a & b, [F.col(f"g{i}") for i in range(len(grams))])).select("_key").distinct()

    def search(self, table: DataFrame, text: str) -> DataFrame:
        """The rows of ``table`` with a field that is ILIKE ``%text%``, as a scan would find them."""
        pattern = f"%{text}%"
        hit = reduce(lambda a, b: a | b, [F.col(f).ilike(pattern) for f in self.fields])
        keys = self.candidates(pattern)
        if keys is None:
            return table.where(hit)
        return table.join(keys.withColumnRenamed("_key", self.key), self.key, "left_semi").where(hit)

"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, shared_root

#: Rows are handled in pieces of about this many bytes of text inside a task.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (any path that Spark can open)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per Spark application, wherever it lies on the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_corpus_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp()) / f"{package.name}.zip"  # the driver's own copy; Spark hands it on
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(to))
    sc._corpus_shipped = True


def text_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id (bigint) and text of each row, whatever else there is."""
    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that no later step replays its lineage."""
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A reliable checkpoint under ``spark.checkpoint.dir``; Spark removes its files when unused."""
    shared_root(spark)
    return df.checkpoint()


def text_slices(batches, text_at: int, limit: int = SLICE_BYTES):
    """Arrow batches cut into runs of rows with about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pa.compute.binary_length(batch.column(text_at)).fill_null(0)).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Gives a worker's freed memory back to the system: workers stay, and a later stage needs it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves
        ctypes.CDLL(None).malloc_trim(0)


def ragged_take(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs ``flat[starts[c] : starts[c] + lens[c]]`` for each c of ``codes``, one after another."""
    n = lens[codes]
    out_at = np.cumsum(n) - n
    return flat[np.repeat(starts[codes] - out_at, n) + np.arange(int(n.sum()))]


def distinct(words: list[str], nul: bool) -> tuple[np.ndarray, list[str]]:
    """The number of each word's distinct value, and the values. ``nul``: a word may hold a NUL, at which pandas would end it."""
    if not nul:
        codes, unique = pd.factorize(np.array(words, dtype=object))
        return codes, list(unique)
    place: dict[str, int] = {}
    codes = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
    return codes, list(place)

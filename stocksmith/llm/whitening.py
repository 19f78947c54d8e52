"""Embedding whitening with weighted multiplicities (operator 11).

Equal vectors are grouped, and every step works on the distinct ones: each
counts in the fit with its multiplicity (or with one).  The mean is a sum of
whole numbers; the covariance is a weighted product of centred blocks, one
matrix per task, added up in two rounds of bounded width.  Each distinct
vector is whitened once and joined back to its rows.  Only a matrix of
dimension x dimension comes to the driver.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written

#: Entries of a block that is multiplied at once.
BLOCK = 1 << 19
#: Eigenvalues below this part of the largest one are rounding errors of zero.
ZERO = 1e-12
#: A vector with at least one row in so many is joined by broadcast: there are at most so many of them.
HOT = 1024

RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def integral(df: DataFrame, id_: str, vector: str, scale: int, offset: int) -> DataFrame:
    """vec_id and x = floor(scale * component) + offset of each row whose vector has only finite entries."""
    ship(df.sparkSession)
    x = F.col("x")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.select(F.col(id_).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where(x.isNotNull() & finite)
    return rows.select("vec_id", F.transform(x, lambda c: F.floor(c * scale) + F.lit(offset).cast("bigint")).alias("x"))


def _slices(batches, d: int):
    """Parts of the batches, and the n x d matrix of the first column of each."""
    rows = max(1, BLOCK // d)
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield part, pa.compute.list_flatten(part.column(0)).to_numpy().reshape(part.num_rows, d)


def _fits(most: float) -> None:
    if most >= 2.0**63:
        raise OverflowError("sums of these vectors exceed 64 bits; take a smaller scale or offset")


def sums(distinct: DataFrame, d: int) -> np.ndarray:
    """The exact weighted sum of each dimension."""
    def part(batches):
        s = np.zeros(d, np.int64)
        for rows, x in _slices(batches, d):
            w = rows.column(1).to_numpy()
            _fits(float(np.abs(x).max(initial=0)) * float(w.sum()) + float(np.abs(s).max()))
            s += w @ x
        yield pa.RecordBatch.from_pydict({"dim": np.arange(d, dtype=np.int32), "s": s})

    found = distinct.mapInArrow(part, "dim int, s bigint").groupBy("dim").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(d, np.int64)
    for r in found:  # one row per dimension
        out[r.dim] = r.s
    return out


class Moments:
    """Weight, mean and centred product of a set of weighted vectors; sets can be added."""

    def __init__(self, d: int, raw: bytes | None = None):
        if raw is None:
            self.w, self.mean, self.product = 0.0, np.zeros(d), np.zeros((d, d))
        else:
            flat = np.frombuffer(raw, "<f8")
            self.w, self.mean, self.product = float(flat[0]), flat[1:d + 1].copy(), flat[d + 1:].reshape(d, d).copy()

    def raw(self) -> bytes:
        return np.r_[self.w, self.mean, self.product.ravel()].astype("<f8").tobytes()

    @classmethod
    def of(cls, y: np.ndarray, w: np.ndarray) -> Moments:
        out = cls(y.shape[1])
        out.w = float(w.sum())
        out.mean = (w @ y) / out.w
        c = y - out.mean
        out.product = (c * w[:, None]).T @ c
        return out

    def add(self, other: Moments) -> None:
        total = self.w + other.w
        if other.w:
            step = other.mean - self.mean
            self.product += other.product + np.outer(step, step) * (self.w * other.w / total)
            self.mean += step * (other.w / total)
            self.w = total


def moments(vectors: DataFrame, center: np.ndarray | None, n: int, d: int) -> Moments:
    """Moments of the weighted vectors (y, w); ``center``: y are whole numbers, of which center / n is taken first.

    A task makes one matrix; about the root of their number is added in each of two further rounds."""
    def part(batches):
        sum_ = Moments(d)
        for rows, y in _slices(batches, d):
            sum_.add(Moments.of(y if center is None else deviations(y, center, n) / n, rows.column(1).to_numpy().astype(np.float64)))
        yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int64()), "m": [sum_.raw()]})

    def added(batches):
        sum_ = Moments(d)
        for b in batches:
            for raw in b.column(1):
                sum_.add(Moments(d, raw.as_buffer().to_pybytes()))
        yield pa.RecordBatch.from_pydict({"task": pa.array([0], pa.int64()), "m": [sum_.raw()]})

    schema = "task bigint, m binary"
    partials = vectors.mapInArrow(part, schema)
    # the vectors were written by about as many tasks
    width = max(1, isqrt(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    total = Moments(d)
    for r in partials.repartition(width, "task").mapInArrow(added, schema).repartition(1).mapInArrow(added, schema).collect():
        total.add(Moments(d, bytes(r.m)))  # one row
    return total


def deviations(x: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
    """n * x - s in whole numbers: only a division by n rounds."""
    _fits(float(np.abs(x).max(initial=0)) * n + float(np.abs(s).max(initial=0)))
    return x * np.int64(n) - s


def _square_sums(v: np.ndarray) -> pa.Array:
    """Exact sums of squares by row; null where one exceeds 64 bits."""
    if float(np.abs(v).max(initial=0)) ** 2 * v.shape[1] < 2.0**63:
        return pa.array((v * v).sum(1), pa.int64())
    exact = [sum(e * e for e in row) for row in v.tolist()]
    return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors (columns), without those of eigenvalue zero; the largest entry of each is positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > ZERO * max(e[0], 0)).sum()))
    u = u[:, :k]
    return e[:k], u * np.sign(u[np.abs(u).argmax(0), np.arange(k)])


def whiten(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", scale: int = 64, offset: int = 1_000_000, most: int = 32, counted: bool = True) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: up to ``most`` whitened components of each row.

    Each entry c of a vector becomes the whole number x = floor(scale * c) + offset.
    A vector counts in the fit as often as it occurs (``counted``), or once.  n is
    the fit's total weight, S its sum; deviation is the exact sum of (n * x - S)^2;
    whitened is x - S / n along the component's unit eigenvector over the root of its
    eigenvalue; explained is the eigenvalue's share of the trace; identity_error is the
    largest entry of the whitened fit's covariance minus the identity.

    Rows whose vector is null or has a null or non-finite entry take no part.  Of
    vectors of several lengths the most frequent length is fitted (ties: the
    longer), and the others take no part.  Null ids and repeated rows come out as they went
    in.  Components of eigenvalue zero are left out, so a single distinct vector, like an
    empty table, gives no rows.  deviation is null where it exceeds 64 bits; sums that
    do raise an error.  Further columns of any name are ignored."""
    spark = df.sparkSession
    rows = integral(df, id_, vector, scale, offset)
    weight = F.count("*") if counted else F.lit(1).cast("bigint")
    distinct = written(spark, rows.groupBy("x").agg(F.count("*").alias("copies"), weight.alias("w")), "whitening-distinct")
    length = distinct.groupBy(F.size("x").alias("d")).agg(F.sum("copies").alias("copies"), F.sum("w").alias("n")).orderBy(F.desc("copies"), F.desc("d")).first()
    if length is None or length.d == 0:
        return spark.createDataFrame([], RESULT)
    d, n, copies = length.d, length.n, length.copies
    distinct = distinct.where(F.size("x") == d)
    fit = distinct.select("x", "w")
    s = sums(fit, d)
    v = moments(fit, s, n, d).product / n
    e, u = components(v, most)
    if not len(e):
        return spark.createDataFrame([], RESULT)
    onto = u / np.sqrt(e)
    k = len(e)

    def project(batches):
        for part, x in _slices(batches, d):
            diff = deviations(x, s, n)
            y = (diff / n) @ onto
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, k), pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([lists, *part.columns, _square_sums(diff)], names=["y", "x", "copies", "w", "deviation"])

    done = written(spark, distinct.select("x", "copies", "w").mapInArrow(project, "y array<double>, x array<bigint>, copies bigint, w bigint, deviation bigint"), "whitening-done")
    got = moments(done.select("y", "w"), None, n, k)
    error = float(np.abs(got.product / n - np.eye(k)).max())

    often = F.col("copies") * HOT >= copies
    hot = F.broadcast(done.where(often).select("x", "y", "deviation"))
    rare = done.where(~often).select("x", "y", "deviation")
    back = rows.join(hot, "x").unionByName(rows.join(hot.select("x"), "x", "left_anti").join(rare, "x"))
    share = F.array(*(F.lit(float(x)) for x in e / np.trace(v)))
    one = F.posexplode(F.arrays_zip(F.col("y").alias("whitened"), share.alias("explained"))).alias("place", "c")
    return back.select("vec_id", "deviation", one).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), F.lit(error).alias("identity_error"))

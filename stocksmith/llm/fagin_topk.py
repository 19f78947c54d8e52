"""Exact top-k inner products by Fagin's threshold algorithm (operator 5).

Candidates lie in row blocks.  A block keeps one list per dimension, its rows
sorted by that component.  A query walks all lists from their good ends in
step, scores each row the first time a list shows it, and stops when the sum of
the best components that are still ahead is below its k-th score: no unseen row
can then get in, nor tie.  Blocks of queries meet blocks of rows one pair at a
time; the blocks' results are ranked by Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

ROW_BLOCK, QUERY_BLOCK = 16384, 1024


class SortedLists:
    """One block of rows (n x d integers) with its sorted list per dimension."""

    def __init__(self, rows: np.ndarray, exact: type):
        self.rows = np.ascontiguousarray(rows, dtype=exact)
        by_dim = np.ascontiguousarray(rows.T)
        self.up = np.argsort(by_dim, axis=1, kind="stable").astype(np.int32)  # per dimension, smallest first
        self.best_up = np.take_along_axis(by_dim, self.up, axis=1)

    def depths(self) -> list[int]:
        n, at, out = len(self.rows), 8, []
        while at < n:
            out.append(at)
            at = at * 3 // 2
        return [*out, n]

    def bounds(self, queries: np.ndarray, depths: list[int]) -> np.ndarray:
        """For each query and depth: the most that a row not seen so far can score."""
        n = len(self.rows)
        low = self.best_up[:, [min(t, n - 1) for t in depths]]
        high = self.best_up[:, [max(n - 1 - t, 0) for t in depths]]
        return np.maximum(queries, 0) @ high + np.minimum(queries, 0) @ low

    def search(self, query: np.ndarray, k: int, depths: list[int], bounds: np.ndarray, ids: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of the k best, ties to the smaller id, the row(s) with id ``own`` left out."""
        n = len(self.rows)
        plus, minus = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        q = query.astype(self.rows.dtype)
        seen = np.zeros(n, dtype=bool)
        scored = ids == own
        rows, scores = np.zeros(0, np.int64), np.zeros(0, self.rows.dtype)
        at = 0
        for depth, bound in zip(depths, bounds, strict=True):
            seen[self.up[plus, n - depth:n - at]] = True
            seen[self.up[minus, at:depth]] = True
            if depth == n:
                seen[:] = True  # the lists end; a query of zeros has none to walk
            at = depth
            new = np.flatnonzero(seen & ~scored)
            scored |= seen
            # many new rows: one pass over the block is cheaper than fetching each
            own = (self.rows @ q)[new] if 4 * len(new) > n else self.rows[new] @ q
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, own])
            if len(rows) > k:
                order = np.lexsort((ids[rows], -scores))[:k] if len(rows) < 4 * k else _best(scores, ids[rows], k)
                rows, scores = rows[order], scores[order]
            if len(rows) == k and bound < scores.min() or scored.all():  # or no row is left to be seen
                break
        return rows, scores


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    kth = -np.partition(-scores, k - 1)[k - 1]
    at = np.flatnonzero(scores >= kth)
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    t = t.combine_chunks()
    ids = t.column("id").to_numpy()
    flat = pa.compute.list_flatten(t.column("v")).to_numpy()
    return ids, flat.reshape(len(ids), len(flat) // len(ids))


def search_block(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out_q, out_r, out_s = [], [], []
    if rows.num_rows and queries.num_rows:
        ids, x = _matrix(rows)
        of, q = _matrix(queries)
        # floats hold the integer scores exactly below these bounds, and multiply faster
        most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
        lists = SortedLists(x, np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64)
        depths = lists.depths()
        bounds = lists.bounds(q, depths)
        for i in range(len(of)):
            at, score = lists.search(q[i], k, depths, bounds[i], ids, of[i])
            out_q.append(np.full(len(at), of[i]))
            out_r.append(ids[at])
            out_s.append(score.astype(np.int64))
    join = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
    return pa.table({"query_id": join(out_q), "vec_id": join(out_r), "score": join(out_s)})


def quantized(df: DataFrame, id_: str, vector: str, scale: int) -> DataFrame:
    """id, v = floor(scale * x) of the rows with an id and only finite components."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (df.select(F.col(id_).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & finite)
            .select("id", F.transform(v, lambda x: F.floor(x * scale)).alias("v")))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows of largest integer inner product.

    ``rows`` and ``queries`` have columns id (bigint) and v (array<bigint>).  Ties go
    to the smaller id; rows with the query's own id are left out; fewer than k
    other rows give all of them.  Only vectors of equal length meet.  A repeated
    row counts as often as it occurs; a query id that occurs more than once is
    asked once, with its smallest vector.  Empty tables give an empty result.
    Scores must fit 64 bits."""
    ship(rows.sparkSession)
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    n_row, n_query = max(1, -(-rows.count() // row_block)), max(1, -(-queries.count() // query_block))

    def block(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.select("id", "v", F.size("v").alias("d"), F.pmod(F.xxhash64("id"), F.lit(n)).alias(own), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint"))).alias(other))

    keys = ["rb", "qb", "d"]
    left = block(rows, "rb", n_row, "qb", n_query).groupBy(*keys)
    right = block(queries, "qb", n_query, "rb", n_row).groupBy(*keys)
    found = left.cogroup(right).applyInArrow(lambda a, b: search_block(a, b, k), "query_id bigint, vec_id bigint, score bigint")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

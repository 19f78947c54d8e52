"""Operator 11 against numpy over all rows, one by one."""
import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from stocksmith.llm import whitening
from stocksmith.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>"


def brute(rows, most=32, counted=True):
    """{row place: (n, deviation, y)}, shares of explained variance, and the eigenvectors' eigenvalues; no grouping, exact whole numbers."""
    good = [(k, [math.floor(64 * c) + 1_000_000 for c in v]) for k, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v)]
    if not good:
        return {}, [], []
    lens = [len(x) for _, x in good]
    d = max(sorted(set(lens), reverse=True), key=lens.count)
    good = [(k, x) for k, x in good if len(x) == d]
    fit = [x for _, x in good] if counted else [list(x) for x in {tuple(x) for _, x in good}]
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centre = lambda x: [(n * a - b) / n for a, b in zip(x, s)]
    c = np.array([centre(x) for x in fit])
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > 1e-12 * e[0]).sum())) if e[0] > 0 else 0
    return {p: (n, sum((n * a - b) ** 2 for a, b in zip(x, s)), np.array(centre(x)) @ u[:, :k] / np.sqrt(e[:k])) for p, x in good}, e[:k] / v.trace(), e


def check(got, rows, **how):
    want, share, _ = brute(rows, **how)
    k = len(share)
    assert len(got) == len(want) * k
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
        assert r.identity_error < 1e-9 and abs(r.explained / share[r.component - 1] - 1) < 1e-9
    assert len({r.identity_error for r in got}) <= 1
    expect = {}
    for p, w in want.items():
        expect.setdefault(rows[p][0], []).append(w)
    sign = None
    for i, ws in expect.items():
        mine = sorted(by_id[i], key=lambda r: r.component)
        assert [r.component for r in mine] == [c + 1 for c in range(k) for _ in ws]
        if len(ws) == 1 or len({w[1] for w in ws}) == 1:
            y = np.array([r.whitened for r in mine]).reshape(k, -1)[:, 0]
            n, deviation, z = ws[0]
            assert {(r.n, r.deviation) for r in mine} == {(n, deviation)}
            if sign is None:
                sign = np.where(np.abs(y - z) < np.abs(y + z), 1, -1)
            assert np.allclose(y, sign * z, atol=1e-7)


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    check(QUERIES["op11_whitening"](spark, SF).collect(), rows)


def made(rng, n, d, copies):
    base = rng.normal(size=(n, d)) * np.arange(1, d + 1) / 3
    rows = [(i, base[i].tolist()) for i in range(n)]
    return rows + [(1000 + i, base[0].tolist()) for i in range(copies)]


@pytest.mark.parametrize("counted", [True, False])
def test_copies(spark, counted):
    """A third of the rows are one vector; it is joined by broadcast, the others are not."""
    rows = made(np.random.default_rng(1), 2100, 5, 1100)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = whitening.whiten(df, most=3, counted=counted)
    check(out.collect(), rows, most=3, counted=counted)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = made(rng, 40, 4, 3) + [(None, [1.0, 2.0, 3.0, 4.0]), (7, None), (8, []), (9, [1.0, None, 2.0, 3.0]), (10, [float("nan")] * 4), (11, [float("inf"), 0.0, 0.0, 0.0]), (12, [1.0, 2.0]), (3, rng.normal(size=4).tolist())]
    rows += [rows[4], rows[4]]
    more = [(i, v, "x", 1) for i, v in rows]
    df = spark.createDataFrame(more, SCHEMA + ", x string, n int")
    check(whitening.whiten(df).collect(), rows)


def test_nothing_to_fit(spark):
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and [f"{n} {t}" for n, t in empty.dtypes] == whitening.RESULT.split(", ")
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).collect() == []
    flat = [(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [4.0, 2.0])]  # one dimension never changes
    check(whitening.whiten(spark.createDataFrame(flat, SCHEMA)).collect(), flat)


def test_moments_add_up():
    rng = np.random.default_rng(3)
    y, w = rng.normal(size=(50, 3)) + 100, rng.integers(1, 9, 50).astype(float)
    sum_ = whitening.Moments(3)
    for at in range(0, 50, 7):
        sum_.add(whitening.Moments.of(y[at:at + 7], w[at:at + 7]))
    back = whitening.Moments(3, sum_.raw())
    every = np.repeat(y, w.astype(int), axis=0)
    assert np.allclose(back.product / back.w, np.cov(every.T, bias=True)) and np.allclose(back.mean, every.mean(0))


def test_exact_beyond_floats():
    big = np.array([[3_000_000_001, 5], [-3_000_000_000, 1]])
    assert whitening._square_sums(big).to_pylist() == [3_000_000_001**2 + 25, 9 * 10**18 + 1]
    assert whitening._square_sums(big * 2).to_pylist() == [None, None]
    with pytest.raises(OverflowError):
        whitening.deviations(big, np.array([0, 0]), 10**10)

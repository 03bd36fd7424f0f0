"""Whitening against a full eigendecomposition."""

import math
from decimal import Decimal

import numpy as np
import pytest

from kestrelq.llm import queries as Q
from kestrelq.llm import whitening as W

SF = "/root/testdata/sf0.001"


def exact(vectors):
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    return n, sums, x, [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]


def compare(rows, data, k=8):
    """Rows of ``whiten`` by id against NumPy; ``data``: (id, vector) of the rows that remain, ids unique."""
    n, sums, x, deviations = exact([v for _, v in data])
    c = (np.array(x, np.int64) * n - np.array(sums, np.int64)) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    m = min(k, int((values > 1e-12 * values[0]).sum()))
    got = {}
    for r in rows:
        assert got.setdefault((r.vec_id, r.component), r) is r and r.n == n
    assert set(got) == {(i, j) for i, _ in data for j in range(1, m + 1)}
    for j in range(m):
        want = c @ vectors[:, j] / math.sqrt(values[j])
        have = np.array([got[i, j + 1].whitened for i, _ in data])
        have *= np.sign(have @ want)
        assert np.abs(have - want).max() < 1e-7
    for (i, _), d in zip(data, deviations):
        r = got[i, 1]
        assert (r.deviation, r.deviation_decimal) == (d if d < 1 << 63 else None, Decimal(d))
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    for j in range(m):
        assert got[data[0][0], j + 1].explained == pytest.approx(values[j] / values.sum(), rel=1e-9)


def test_op11(spark):
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compare(Q.QUERIES["op11_embedding_whitening"](spark, SF).collect(), data)


def test_rows_that_go(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=3).round(3).tolist(), "own") for i in range(40)]
    bad = [(100, None, "x"), (101, [1.0, None, 2.0], "x"), (102, [nan, 1.0, 2.0], None), (103, [1.0, -inf, 2.0], "x"), (104, [inf, 0.0, 0.0], "x")]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, x string").repartition(3)
    compare(W.whiten(df).collect(), [(i, v) for i, v, _ in good])


def test_repeated_rows_and_null_ids(spark):
    data = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [-0.5, 1.0]), (2, [0.125, 3.0])]
    got = W.whiten(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), c) for i, _ in data for c in (1, 2)) and got[0].n == 4


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]])
def test_no_component_without_deviation(spark, rows):
    assert W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() == []


def test_lengths_have_to_agree(spark):
    with pytest.raises(ValueError):
        W.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_breakdown_restarts():
    # eigenvalues of high multiplicity: a block's Krylov space ends at once
    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    a = q @ np.diag([5.0] * 12 + [1.0] * 28) @ q.T
    values, vectors, passes, breakdowns = W.lanczos(lambda b: a @ b, 40, 8, 3)
    assert breakdowns and np.allclose(values, 5) and np.allclose(a @ vectors, 5 * vectors) and np.allclose(vectors.T @ vectors, np.eye(8))
    low = np.diag([3.0, 2.0] + [0.0] * 30)
    values, vectors, *_ = W.lanczos(lambda b: low @ b, 32, 4, 2)
    assert np.allclose(values, [3, 2, 0, 0])


def test_it_ends_before_the_space_does():
    a = np.diag(np.concatenate((100.0 / np.arange(1, 13), np.full(288, 1e-3))))
    values, vectors, passes, _ = W.lanczos(lambda b: a @ b, 300, 8)
    assert passes * W.WIDTH < 150 and np.allclose(values, 100.0 / np.arange(1, 9)) and np.abs(np.abs(np.diag(vectors)) - 1).max() < 1e-9


@pytest.mark.parametrize("scale", [3, 10**9, 10**12, 10**15])
def test_exact_squares(scale):
    d = np.random.default_rng(7).integers(-scale, scale, (5, 64))
    assert W.squares(d) == [sum(int(x) ** 2 for x in r) for r in d]


def test_rank_below_the_components(spark):
    rng = np.random.default_rng(8)
    data = [(i, [float(a), float(b), float(a), 0.0]) for i, (a, b) in enumerate(rng.integers(-3, 4, (30, 2)))]
    compare(W.whiten(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect(), data)

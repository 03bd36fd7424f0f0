"""Embedding whitening: principal components by block Lanczos, without a covariance matrix.

The covariance is only ever applied to a block of vectors: a distributed pass centres every row, multiplies it with
the block, and adds up the products (``applied``); what reaches the driver is a matrix of dimensions x block.
Lanczos blocks are orthogonalised twice against all earlier ones. Directions that vanish (a breakdown) are replaced
by random ones that are orthogonal to the rest, so the search goes on in what it has not seen. It ends when every
wanted pair's residual, divided by the gap to the next eigenvalue, is below a tolerance, or the space is exhausted.

Entries are integers, so sums and deviations are exact, and so is the trace of the covariance, which is the sum of
the deviations; it gives the explained shares without the other eigenvalues.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelq.llm.common import free_name, one_thread, quoted, written

#: Entries become floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Vectors in a block; bound on a component's error (residual by gap); norm, relative to the block's largest, below
#: which a direction counts as vanished; eigenvalue, relative to the largest, below which there is no component.
WIDTH, TOLERANCE, VANISHED, NOTHING = 8, 1e-12, 1e-10, 1e-12


@dataclass
class Model:
    """n, exact sums by dimension, exact total deviation; components as columns, their eigenvalues, largest first;
    passes over the data, and blocks that broke down."""

    n: int
    sums: np.ndarray
    total: int
    components: np.ndarray
    values: np.ndarray
    passes: int = 0
    breakdowns: int = 0

    @property
    def trace(self) -> float:
        return self.total / self.n**3 if self.n else 0.0

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.total else self.values


def whole(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is neither null nor holds null, NaN or infinite entries."""
    v = quoted(vector_col)
    return df.where(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))


def scaled(df: DataFrame, vector_col: str) -> F.Column:
    """The vector's entries as long numbers."""
    return F.transform(quoted(vector_col).cast("array<double>"), lambda c: F.floor(c * SCALE) + F.lit(SHIFT))


def matrices(batches, dims: int | None = None) -> Iterator[np.ndarray]:
    """Rows of column ``x`` as matrices of long numbers; all have to have one length."""
    for b in batches:
        if b.num_rows:
            x = b["x"]
            n = np.diff(np.asarray(x.offsets))
            if (n != (n[0] if dims is None else dims)).any():
                raise ValueError("vectors differ in length")
            yield np.asarray(x.flatten()).reshape(len(n), -1)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n with one rounding: n x - sums is exact."""
    return (x * n - sums) / n


def squares(d: np.ndarray) -> list[int]:
    """Exact sums of the squares of each row of long numbers."""
    if not d.size:
        return [0] * len(d)
    if float(np.abs(d).max()) ** 2 * d.shape[1] < 2**62:
        return (d * d).sum(1).tolist()
    high, low = d >> 24, d & 0xFFFFFF  # high below 2^27 while n x is below 2^51
    if float(np.abs(high).max()) ** 2 * d.shape[1] >= 2**62:
        return [sum(x * x for x in row) for row in d.tolist()]
    parts = zip((high * high).sum(1).tolist(), (high * low).sum(1).tolist(), (low * low).sum(1).tolist())
    return [(a << 48) + (b << 25) + c for a, b, c in parts]


def summed(rows: DataFrame, f, size: int) -> np.ndarray:
    """The sum over all batches of ``f(matrix)``, ``size`` numbers. Every task adds up its own, the cluster adds up
    the tasks', and the driver gets ``size`` rows."""

    def run(batches):
        one_thread()
        total = None
        for x in matrices(batches):
            part = f(x).ravel()
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "v"])

    kind = "long" if f.__name__ == "exact" else "double"
    found = rows.select("x").mapInArrow(run, f"at long, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    out[found["at"]] = found["v"]
    return out


def applied(rows: DataFrame, n: int, sums: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Covariance times ``block``, by one pass over the rows."""

    def products(x):
        c = centred(x, n, sums)
        return c.T @ (c @ block)

    return summed(rows, products, block.size).reshape(block.shape) / n


def orthogonal(w: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """An orthonormal block, orthogonal to ``basis``, that spans ``w`` where it can, and random directions instead
    of those that vanish (their number is returned); narrower where the space has no more."""
    dims, width = len(w), min(w.shape[1], len(w) - basis.shape[1])
    size, out, lost = max(1e-300, float(np.linalg.norm(w, axis=0).max(initial=0))), np.zeros((dims, 0)), 0
    for k in range(w.shape[1]):
        if out.shape[1] == width:
            break
        v, least = w[:, k], VANISHED * size
        while True:
            known = np.concatenate((basis, out), 1)
            for _ in range(2):
                v = v - known @ (known.T @ v)
            norm = float(np.linalg.norm(v))
            if norm > least:
                v = v / norm
                v = v - known @ (known.T @ v)
                out = np.concatenate((out, (v / np.linalg.norm(v))[:, None]), 1)
                break
            lost += 1
            v, least = rng.standard_normal(dims), 1e-8
    return out, lost


def lanczos(apply, dims: int, k: int, width: int = WIDTH, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The ``k`` largest eigenvalues (fewer in a smaller space) of the symmetric operator ``apply``, their unit
    eigenvectors as columns, passes and breakdowns."""
    rng = np.random.default_rng(seed)
    basis, images = np.zeros((dims, 0)), np.zeros((dims, 0))
    block, lost = orthogonal(rng.standard_normal((dims, min(width, dims))), basis, rng)
    passes = breakdowns = 0
    while True:
        image = apply(block)
        passes += 1
        basis, images = np.concatenate((basis, block), 1), np.concatenate((images, image), 1)
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        top = min(k, dims)
        if basis.shape[1] == dims:
            break
        if len(values) > top:
            found = basis @ vectors[:, :top]
            residual = np.linalg.norm(images @ vectors[:, :top] - found * values[:top], axis=0)
            gap = np.minimum(np.concatenate(([np.inf], values[: top - 1] - values[1:top])), values[:top] - values[1 : top + 1])
            # a vanished eigenvalue has no component, so its vector need not converge
            if ((residual <= TOLERANCE * gap) | (values[:top] <= NOTHING * values[0])).all():
                break
        block, lost = orthogonal(image, basis, rng)
        breakdowns += lost > 0
    found = basis @ vectors[:, :top]
    return values[:top], found / np.linalg.norm(found, axis=0), passes, breakdowns


def fit(rows: DataFrame, k: int, width: int = WIDTH) -> Model:
    """The model of the vectors in column ``x`` (long numbers). Without rows, or without any deviation, it has no
    component. Vectors of different lengths raise ValueError."""

    def sizes(batches):
        n, least, most = 0, 1 << 62, 0
        for b in batches:
            d = np.diff(np.asarray(b["x"].offsets))
            if len(d):
                n, least, most = n + len(d), min(least, int(d.min())), max(most, int(d.max()))
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (n, least, most)], ["n", "least", "most"])

    n, least, dims = rows.select("x").mapInArrow(sizes, "n long, least long, most long").agg(F.sum("n"), F.min("least"), F.max("most")).first()
    if not n or not dims:
        return Model(n or 0, np.zeros(dims or 0, np.int64), 0, np.zeros((dims or 0, 0)), np.zeros(0))
    if least != dims:
        raise ValueError(f"vectors differ in length: {least} to {dims} entries")

    def exact(x):
        return x.sum(0)

    sums = summed(rows, exact, dims)
    total = deviation(rows, n, sums)
    if not total:
        return Model(n, sums, 0, np.zeros((dims, 0)), np.zeros(0))
    values, components, passes, breakdowns = lanczos(lambda block: applied(rows, n, sums, block), dims, k, width)
    some = values > NOTHING * values[0]
    return Model(n, sums, total, components[:, some], values[some], passes, breakdowns)


def deviation(rows: DataFrame, n: int, sums: np.ndarray) -> int:
    """The exact sum over all rows and dimensions of (n x - sum)^2; a number from each task."""
    from decimal import Decimal

    def run(batches):
        total = sum(sum(squares(x * n - sums)) for x in matrices(batches))
        yield pa.RecordBatch.from_arrays([pa.array([Decimal(total)], pa.decimal128(38, 0))], ["d"])

    return int(rows.select("x").mapInArrow(run, "d decimal(38,0)").agg(F.sum("d")).first()[0])


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, width: int = WIDTH) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error, deviation_decimal: a row for each
    remaining row of ``df`` and each component, ``k`` at most.

    Rows whose vector is null or holds a null, NaN or infinite entry are dropped. The other vectors have to have one
    length, else ValueError is raised. Repeated rows count and come back as often as they stand there; null ids stay
    null; other columns are not read. Equal eigenvalues (ties) give some orthonormal basis of their space. There are
    fewer than ``k`` components where the covariance has fewer eigenvalues above 1e-12 of the largest: none for an
    empty table, one row or equal rows, so the result is empty then. ``deviation`` is null where it is no long any
    more, ``deviation_decimal`` has it up to 38 digits. ``identity_error`` is the largest difference of the whitened
    values' covariance from the identity, measured by a pass over them.
    """
    ids = free_name(df, "x_id")
    rows = whole(df, vector_col).select(quoted(id_col).alias(ids), scaled(df, vector_col).alias("x"))
    rows = written(rows, "whitening")  # every pass reads it, and no pass reads anything else
    model = fit(rows, k, width)
    n, sums, m = model.n, model.sums, len(model.values)
    kind = rows.schema[ids].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_decimal decimal(38,0)"
    scale = model.components / np.sqrt(model.values)
    error = 0.0
    if m:

        def moments(x):
            w = centred(x, n, sums) @ scale
            return np.concatenate((w.sum(0), (w.T @ w).ravel()))

        found = summed(rows, moments, m + m * m) / n
        error = float(np.abs(found[m:].reshape(m, m) - np.outer(found[:m], found[:m]) - np.eye(m)).max())
    explained = model.explained

    def run(batches):
        from decimal import Decimal

        one_thread()
        for b in batches:
            if not b.num_rows or not m:
                continue
            x = next(matrices([b]))
            w = centred(x, n, sums) @ scale
            exact = squares(x * n - sums)
            each = np.repeat(np.arange(len(x)), m)
            long = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()).take(pa.array(each))
            many = pa.array([Decimal(v) for v in exact], pa.decimal128(38, 0)).take(pa.array(each))
            component = np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays(
                [b[ids].take(pa.array(each)), pa.array(component), pa.array(np.full(len(each), n)), long, pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error)), many],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_decimal"],
            )

    return rows.mapInArrow(run, schema)

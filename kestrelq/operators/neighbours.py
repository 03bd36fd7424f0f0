"""Nearest neighbours over vectors: inverted cells, with several probes, or exact by bounds on the cells.

Centroids are fitted on a bounded sample; every row of the base is then dealt to the cell of its nearest centroid, and
a cell keeps its radius. A query visits its nearest cells first. Any row of a cell is at least as far as the centroid's
distance less the radius, so with ``exact`` the query also visits each further cell whose bound is within its distance
to the k-th neighbour so far: nothing that could be nearer is left out.

Queries and rows meet by cell in a shuffle. Cells are cut into blocks of rows, so a cell that holds very many rows is
no single task, and a task multiplies matrices of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelq.operators.scratch import Rounds, quoted

#: Rows of the sample on which centroids are fitted, cells at most, rows of a cell in one block, queries at once in a
#: task, queries at once in all.
SAMPLE, CELLS, BLOCK, SOME, PART = 20_000, 1024, 4096, 512, 200_000


def centroids(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm from random rows of the sample; empty cells keep their place."""
    rng = np.random.default_rng(seed)
    at = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        own = distances(sample, at).argmin(1)
        total = np.zeros_like(at)
        np.add.at(total, own, sample)
        n = np.bincount(own, minlength=len(at))
        at = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], at)
    return at


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all pairs, from differences so that equal vectors are at exactly 0 apart."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 21) // max(1, b.size))
    for k in range(0, len(a), step):
        d = a[k : k + step, None, :] - b[None, :, :]
        out[k : k + step] = np.einsum("ijk,ijk->ij", d, d)
    return out


def vectors(column) -> np.ndarray:
    n = len(column)
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(n, -1)


def probes_for(sample: np.ndarray, at: np.ndarray, k: int, recall: float) -> int:
    """Cells to visit so that the share ``recall`` of the k nearest rows of the sample is in them, as measured by
    comparing up to 200 of its rows with all others."""
    own, some = distances(sample, at).argmin(1), sample[:: max(1, len(sample) // 200)]
    near = np.argsort(distances(some, sample), axis=1)[:, :k]
    order = np.argsort(np.argsort(distances(some, at), axis=1), axis=1)  # a cell's place by distance
    place = np.take_along_axis(order, own[near], 1)
    return 1 + int(np.quantile(place, recall, method="higher"))


def smallest(rows: DataFrame, total: int) -> DataFrame:
    """The vectors of the SAMPLE smallest hashes of ids. Only rows below a hash that about one and a half as many stay
    below are ordered: each task sends its own smallest ones to the driver, who would get SAMPLE from every task."""
    h = F.xxhash64("id")
    if total > 2 * SAMPLE:
        below = rows.where(h <= int(-(1 << 63) + (1 << 64) * (1.5 * SAMPLE / total)))
        if below.count() >= SAMPLE:
            rows = below
    return rows.orderBy(h).limit(SAMPLE).select("v")


def nearest(queries: DataFrame, base: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = 8, exact: bool = True, cells: int | None = None, recall: float = 0.95) -> DataFrame:
    """query, neighbour, distance (squared Euclidean), place (from 1): the ``k`` nearest rows of ``base`` for each row
    of ``queries``, itself included if it is there; ties go to the smaller id.

    Rows with a null id, or a null vector or one with a null entry, are left out on either side; ids of the base have
    to be unique for a row each. All vectors have to have one length. ``exact`` returns what comparing all pairs would;
    without it only the ``probes`` nearest cells are visited; None takes as many as ``recall`` needs on the sample. Fewer than ``k`` rows give fewer neighbours; an empty
    side gives none. ``cells``: the root of the base's rows by default, CELLS at most. The centroids, and a radius for
    each, are what is broadcast: 1024 vectors at most.
    """
    spark = base.sparkSession
    whole = lambda df: df.where(quoted(id_col).isNotNull() & quoted(vector_col).isNotNull() & ~F.exists(quoted(vector_col), lambda c: c.isNull())).select(quoted(id_col).alias("id"), quoted(vector_col).cast("array<double>").alias("v"))
    kind = dict(base.dtypes)[id_col]
    result = f"query {kind}, neighbour {kind}, distance double"
    with Rounds(spark, "neighbours") as r:
        rows, asking = whole(base), whole(queries)
        total = rows.count()
        few = [x["v"] for x in smallest(rows, total).collect()]
        if not few:
            return spark.createDataFrame([], result + ", place int")
        if len({len(x) for x in few}) > 1:
            raise ValueError("vectors differ in length")
        number = cells or min(CELLS, max(1, int(total**0.5)))
        sample = np.array(few, np.float64)
        at = spark.sparkContext.broadcast(centroids(sample, number))
        if probes is None:
            probes = probes_for(sample, at.value, k, recall)

        def dealt(batches):
            for b in batches:
                if b.num_rows:
                    d = distances(vectors(b["v"]), at.value)
                    own = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array(own), pa.array(np.sqrt(d[np.arange(len(own)), own]))], ["id", "v", "cell", "r"])

        stored = r.write(rows.mapInArrow(dealt, f"id {kind}, v array<double>, cell long, r double"))
        # a row for each cell
        info = stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("r")).toPandas()
        radius, blocks = np.full(len(at.value), -1.0), np.zeros(len(at.value), np.int64)
        radius[info["cell"]], blocks[info["cell"]] = info["r"], -(-info["n"] // BLOCK)
        shared = spark.sparkContext.broadcast((radius, blocks))

        def visits(limited: bool):
            """query, v, cell, block: cells to visit first, or then (``limited``: rows have the k-th distance)."""

            def run(batches):
                radius, blocks = shared.value
                for b in batches:
                    for a in range(0, b.num_rows, SOME):
                        part = b.slice(a, SOME)
                        far = np.where(radius >= 0, np.sqrt(distances(vectors(part["v"]), at.value)), np.inf)
                        order = np.argsort(far, axis=1, kind="stable")
                        first = np.zeros(far.shape, bool)
                        np.put_along_axis(first, order[:, :probes], True, 1)
                        wanted = first
                        if limited:
                            limit = np.sqrt(np.asarray(part["limit"]))
                            # a little more, so that no rounding leaves out an equal distance
                            wanted = ~first & (far - radius <= limit[:, None] * (1 + 1e-9) + 1e-9)
                        q, c = np.nonzero(wanted & (radius >= 0))
                        n = blocks[c]
                        q, c = np.repeat(q, n), np.repeat(c, n)
                        block = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
                        take = pa.array(q)
                        yield pa.RecordBatch.from_arrays([part["id"].take(take), part["v"].take(take), pa.array(c), pa.array(block)], ["id", "v", "cell", "block"])

            return run

        block = F.pmod(F.xxhash64("id"), F.element_at(F.lit([max(1, int(x)) for x in blocks]), (F.col("cell") + 1).cast("int")))
        held = stored.select("id", "v", "cell", block.alias("block"))
        schema, parts = f"id {kind}, v array<double>, cell long, block long", max(1, -(-asking.count() // PART))
        out = None
        for p in range(parts):
            some = asking.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p)
            found = r.write(_best(_met(some.mapInArrow(visits(False), schema), held, k, result), k))
            if exact:
                limit = found.groupBy("query").agg(F.max("distance").alias("d"), F.count("*").alias("c"))
                # with fewer than k neighbours so far every cell may hold one
                left = some.join(limit, F.col("id") == F.col("query"), "left").select("id", "v", F.when(F.col("c") >= k, F.col("d")).otherwise(F.lit(float("inf"))).alias("limit"))
                more = _met(left.mapInArrow(visits(True), schema), held, k, result)
                found = r.write(_best(found.drop("place").unionByName(more), k))
            out = found if out is None else out.unionByName(found)
        out = r.write(out)
        r.keep(out)
    return out


def _met(asked: DataFrame, held: DataFrame, k: int, result: str) -> DataFrame:
    """The k nearest rows of each block for the queries that visit it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, names = [], right["id"].combine_chunks()
        out_q, out_d = [], []
        if len(right) and len(left):
            b = vectors(right["v"].combine_chunks())
            rank = np.empty(len(names), np.int64)
            rank[np.asarray(pa.compute.sort_indices(names))] = np.arange(len(names))
            a = vectors(left["v"].combine_chunks())
            for s in range(0, len(a), SOME):
                d = distances(a[s : s + SOME], b)
                best = np.lexsort((np.broadcast_to(rank, d.shape), d), axis=1)[:, :k]
                ids.append(best.ravel())
                out_q.append(np.repeat(np.arange(s, s + len(d)), best.shape[1]))
                out_d.append(np.take_along_axis(d, best, 1).ravel())
        join = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0), t)
        return pa.table({"query": left["id"].combine_chunks().take(join(out_q, pa.int64())), "neighbour": names.take(join(ids, pa.int64())), "distance": join(out_d, pa.float64())})

    return asked.groupBy("cell", "block").cogroup(held.groupBy("cell", "block")).applyInArrow(run, result)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query: k from each block it has visited, a bounded number of rows."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return found.withColumn("place", place.cast("int")).where(F.col("place") <= k)

"""Nearest neighbours against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrelq.operators import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, n string"


def brute(queries, base, k):
    out = {}
    for q, v in queries:
        d = sorted((float(((np.array(v, np.float32).astype(float) - np.array(w, np.float32).astype(float)) ** 2).sum()), i) for i, w in base)
        out[q] = [(i, x) for x, i in d[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query, r.place)):
        out.setdefault(r.query, []).append((r.neighbour, r.distance))
        assert r.place == len(out[r.query])
    return out


@pytest.mark.parametrize("cells,block,part", [(None, 4096, 200_000), (7, 20, 3), (1, 4096, 200_000)])
def test_exact(spark, monkeypatch, cells, block, part):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "PART", part)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(5, 6)) * 3
    base = [(i, (middle[i % 5] + rng.normal(size=6)).tolist()) for i in range(200)]
    base += [(1000 + i, base[0][1]) for i in range(30)]  # copies: ties by id
    queries = base[::20] + [(5000, [100.0] * 6), (5001, [0.0] * 6)]
    rows = [(i, v, "own") for i, v in base] + [(None, base[0][1], None), (2000, None, "x"), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x")]
    ask = [(i, v, "own") for i, v in queries] + [(3000, None, "x")]
    got = found(N.nearest(spark.createDataFrame(ask, SCHEMA), spark.createDataFrame(rows, SCHEMA).repartition(3), 10, probes=2, cells=cells))
    want = brute(queries, base, 10)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(a == pytest.approx(b) for q in want for (_, a), (_, b) in zip(got[q], want[q]))


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], "x"), (2, [0.0, 3.0], "x")], SCHEMA)
    assert found(N.nearest(df, df, 5)) == {1: [(1, 0.0), (2, 4.0)], 2: [(2, 0.0), (1, 4.0)]}
    assert N.nearest(df, df.where("false"), 5).collect() == [] and N.nearest(df.where("false"), df, 5).collect() == []


def test_tasks_send_a_sample_in_all_and_not_each(spark, monkeypatch):
    monkeypatch.setattr(N, "SAMPLE", 200)
    rows = spark.range(4000).repartition(10).selectExpr("id", "array(CAST(id AS DOUBLE)) AS v")
    want = [r.v for r in rows.orderBy(F.xxhash64("id")).limit(200).collect()]
    got = N.smallest(rows, 4000)
    assert [r.v for r in got.collect()] == want
    # what is left to order is little more than the sample
    limit = int(got._jdf.queryExecution().optimizedPlan().toString().split("<= ")[1].split(")")[0])
    assert 200 <= rows.where(F.xxhash64("id") <= limit).count() < 400

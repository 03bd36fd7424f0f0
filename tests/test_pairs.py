"""Joins with very many pairs against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kestrelq.operators import pairs


def sides(spark, seed, keys):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, math.nan, 0.0, 1.0, 2.0, *(rng.random() * 3 for _ in range(5))])
    rows = [[(i, rng.choice([None, *range(keys)]), value()) for i in range(n)] for n in (70, 90)]
    rows[0] += [(100, 77, 1.0)]  # keys of one side only
    rows[1] += [(100, 78, 1.0)]
    return [*rows, spark.createDataFrame(rows[0], "a long, ak int, av double"), spark.createDataFrame(rows[1], "b long, bk int, bv double")]


def below(x, y):
    """NaN is larger than all other values."""
    return x is not None and y is not None and not math.isnan(x) and (math.isnan(y) or x < y)


@pytest.mark.parametrize("keys,block", [(1, 8), (3, 8), (3, 8192), (30, 2)])
def test_full(spark, keys, block):
    left, right, l, r = sides(spark, keys, keys)  # noqa: E741
    want = [(i, j) for i, k, x in left for j, m, y in right if k is not None and k == m and below(x, y)]
    want += [(i, None) for i, _, _ in left if i not in {a for a, _ in want}] + [(None, j) for j, _, _ in right if j not in {b for _, b in want}]
    got = pairs.full(l, r, ("ak", "bk"), ("av", "bv"), block).select("a", "b")
    order = lambda p: [(x is None, x or 0) for x in p]
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_without_keys_and_empty(spark):
    left, right, l, r = sides(spark, 9, 3)  # noqa: E741
    got = pairs.matched(l, r, None, F.expr("av < bv AND a > b"), 16).select("a", "b")
    assert sorted(map(tuple, got.collect())) == sorted((i, j) for i, _, x in left for j, _, y in right if below(x, y) and i > j)
    assert pairs.matched(l.where("false"), r, None, F.expr("av < bv")).collect() == []
    assert pairs.full(l.where("false"), r, ("ak", "bk"), ("av", "bv")).count() == len(right)


def test_tasks_hold_blocks_and_not_keys(spark):
    # one key: a plain join has one task for it
    l, r = (spark.range(2000).select(F.col("id").alias(c), F.expr("id DIV 10000").alias(f"{c}k")) for c in "ab")
    for key in (("ak", "bk"), None):
        got = pairs.matched(l, r, key, F.expr("a < b"), 20)
        sizes = [x["count"] for x in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 2000 * 1999 // 2 and len(sizes) > 400 and max(sizes) < 20_000

"""Exact quantiles and inequality joins against plain Python."""

import math
import random

import numpy as np
import pytest

from kestrelq.operators import inequality, quantiles


def quantile(values, p):
    v = sorted(values)
    at = p * (len(v) - 1)
    a, b = v[math.floor(at)], v[math.ceil(at)]
    return a if a == b else a * (1 - (at - math.floor(at))) + b * (at - math.floor(at))


WANTED = {"lo": 0.0, "q": 0.37, "med": 0.5, "hi": 1.0}


def test_quantiles_of_any_shape(spark):
    rng = random.Random(1)
    groups = {
        "one": [3.5], "ties": [2.0] * 500 + [1.0] * 3, "wide": [rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300) for _ in range(400)],
        "near": [1.0 + k * 2**-52 for k in rng.choices(range(4000), k=300)], "zeros": [0.0, -0.0, 5e-324, -5e-324, 0.0], "inf": [-math.inf, math.inf, math.inf, 1.0], None: [rng.gauss(0, 1) for _ in range(200)],
    }
    rows = [(k, v, "own") for k, vs in groups.items() for v in vs] + [("nulls", None, "own"), ("one", None, "own")]
    df = spark.createDataFrame(rows, "k string, v double, n string").repartition(3)
    got = {r.k: r for r in quantiles.quantiles(df, ["k"], "v", WANTED, bins=64).collect()}
    assert set(got) == {*groups, "nulls"} and all(got["nulls"][n] is None for n in WANTED)
    for k, vs in groups.items():
        for n, p in WANTED.items():
            assert got[k][n] == quantile(vs, p), (k, n)


def test_quantiles_without_keys_and_with_two(spark):
    df = spark.createDataFrame([(i % 2, i % 3, i) for i in range(50)], "a int, b int, v long")
    assert quantiles.quantiles(df, [], "v", {"med": 0.5}).collect() == [(24.5,)]
    assert quantiles.quantiles(df.where("false"), [], "v", {"med": 0.5}).collect() == [(None,)]
    assert quantiles.quantiles(df.where("false"), ["a"], "v", {"med": 0.5}).collect() == []
    got = {(r.a, r.b): r.med for r in quantiles.quantiles(df, ["a", "b"], "v", {"med": 0.5}).collect()}
    assert got == {(a, b): quantile([i for i in range(50) if i % 2 == a and i % 3 == b], 0.5) for a in (0, 1) for b in (0, 1, 2)}
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (float("nan"),)], "v double")
    assert [str(x) for x in quantiles.quantiles(nan, [], "v", {"lo": 0.0, "med": 0.5}).first()] == ["1.0", "nan"]
    with pytest.raises(ValueError):
        quantiles.quantiles(df, [], "v", {"x": 1.5})


OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@pytest.mark.parametrize("seed", range(4))
def test_matches_in_a_block(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 70))
    x, y, right = rng.integers(0, 9, n), rng.integers(0, 9, n).astype(float), rng.integers(0, 2, n)
    for ex in (False, True):
        for ey in (False, True):
            want = [0 if right[i] else sum(right[j] and (x[j] > x[i] or ex and x[j] == x[i]) and (y[j] > y[i] or ey and y[j] == y[i]) for j in range(n)) for i in range(n)]
            assert inequality.matches(x, y, right, ex, ey).tolist() == want


@pytest.mark.parametrize("ops", [("<", ">"), ("<=", "<"), (">=", ">="), (">", None), ("<=", None)])
def test_counts_against_all_pairs(spark, ops):
    rng = random.Random(str(ops))
    value = lambda: rng.choice([None, 7, 7, 7, 7, rng.randint(0, 40), rng.randint(0, 40)])
    left = [(i, value(), float(rng.randint(0, 9)), "own") for i in range(120)]
    right = [(value(), rng.choice([float(rng.randint(0, 9)), 3.0, float("nan"), None]), 5) for _ in range(150)]
    l, r = spark.createDataFrame(left, "id int, a int, b double, n string").repartition(3), spark.createDataFrame(right, "a int, b double, id int").repartition(2)  # noqa: E741
    second = ("b", ops[1], "b") if ops[1] else None
    got = {x.id: (x.n, x.n_) for x in inequality.count_matches(l, r, ("a", ops[0], "a"), second, block=20).collect()}
    key = lambda v: (v != v, 0 if v != v else v)
    hold = lambda op, a, b: a is not None and b is not None and OPS[op](key(a), key(b))
    want = {i: ("own", sum(hold(ops[0], a, c) and (not ops[1] or hold(ops[1], b, d)) for c, d, _ in right)) for i, a, b, _ in left}
    assert got == want


def test_empty_sides_and_kinds(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string")
    none = df.where("false")
    assert [r.n for r in inequality.count_matches(df, none, ("a", "<", "a")).collect()] == [0]
    assert inequality.count_matches(none, df, ("a", "<", "a")).collect() == []
    for bad in (("a", "<", "b"), ("c", "<", "c")):
        with pytest.raises(TypeError):
            inequality.count_matches(df, df, bad)


def test_block_sizes_follow_the_values(spark):
    # a third of all rows has one value: its block compares nothing
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 5 ELSE id END AS a", "id AS b")
    out = inequality.count_matches(df, df, ("a", "<", "a"), ("b", ">", "b"), block=100)
    import duckdb

    rows = [(5 if i % 3 == 0 else i, i) for i in range(3000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT CASE WHEN range % 3 = 0 THEN 5 ELSE range END AS a, range AS b FROM range(3000)")
    want = dict(con.execute("SELECT x.b, (SELECT count(*) FROM t y WHERE x.a < y.a AND x.b > y.b) FROM t x").fetchall())
    assert {r.b: r.n for r in out.collect()} == want and len(rows) == 3000

"""Graph operators against plain Python."""

import os
import random
import time
from collections import Counter

import pytest

from kestrelq.operators import graphs, scratch


def edges(seed, nodes=30, n=90):
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)] + [(None, 1), (2, None)]


def walk(pairs, damping, rounds):
    pairs = [(a, b) for a, b in pairs if a is not None and b is not None]
    nodes = sorted({x for p in pairs for x in p})
    out, rank = Counter(a for a, _ in pairs), {x: 1 / len(nodes) for x in nodes}
    for _ in range(rounds):
        lost = sum(rank[x] for x in nodes if not out[x])
        new = {x: (1 - damping + damping * lost) / len(nodes) for x in nodes}
        for a, b in pairs:
            new[b] += damping * rank[a] / out[a]
        rank = new
    return rank


@pytest.mark.parametrize("seed", [1, 2])
def test_pagerank(spark, seed):
    e = edges(seed)
    got = {r.node: r["rank"] for r in graphs.pagerank(spark.createDataFrame(e, "src int, dst int"), rounds=6).collect()}
    want = walk(e, 0.85, 6)
    assert set(got) == set(want) and all(got[x] == pytest.approx(want[x], rel=1e-12) for x in want) and sum(got.values()) == pytest.approx(1)


def test_pagerank_converges_and_takes_no_edges(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert {r.node: r["rank"] for r in graphs.pagerank(e, rounds=50, tolerance=1e-9).collect()} == {"a": 0.5, "b": 0.5}
    assert graphs.pagerank(e.where("false")).collect() == []


def test_a_round_of_pagerank_moves_no_edges(spark, monkeypatch):
    """Edges and ranks lie in buckets; a round has one shuffle, that of sums by the edges' ends."""
    moved, bucketed = [], graphs.Rounds.bucketed

    def watched(self, df, by, buckets):
        plan = df._jdf.queryExecution().executedPlan().toString()
        moved.append([line for line in plan.splitlines() if "Exchange hashpartitioning" in line])
        return bucketed(self, df, by, buckets)

    monkeypatch.setattr(graphs.Rounds, "bucketed", watched)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = edges(9)
        got = {r.node: r["rank"] for r in graphs.pagerank(spark.createDataFrame(e, "src int, dst int"), rounds=3).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = walk(e, 0.85, 3)
    assert set(got) == set(want) and all(got[x] == pytest.approx(want[x], rel=1e-12) for x in want)
    assert len(moved) == 5 and all(len(m) == 1 and "dst" in m[0] for m in moved[2:])
    assert not any("pagerank" in t.name for t in spark.catalog.listTables())


@pytest.mark.parametrize("seed", [3, 4])
def test_labels(spark, seed):
    pairs = {(a, b) for a, b in edges(seed) if a is not None and b is not None and a != b}
    pairs |= {(b, a) for a, b in pairs}
    label = {a: a for a, _ in pairs}
    for _ in range(4):
        seen = {x: Counter(label[b] for a, b in pairs if a == x) for x in label}
        label = {x: min(c, key=lambda k: (-c[k], k)) for x, c in seen.items()}
    got = graphs.propagate_labels(spark.createDataFrame(edges(seed), "src int, dst int"), rounds=4)
    assert {r.node: r.label for r in got.collect()} == label


def corners(pairs):
    near = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return {x: sum(b in near[a] for a in near[x] for b in near[x] if a < b) for x in near}


@pytest.mark.parametrize("seed", [5, 6])
def test_triangles(spark, seed):
    e = edges(seed, 20, 120)
    assert {r.node: r.triangles for r in graphs.triangles(spark.createDataFrame(e, "src int, dst int")).collect()} == corners(e)
    assert graphs.triangles(spark.createDataFrame([], "src int, dst int")).collect() == []


def test_a_hub_makes_few_wedges(spark):
    # one node is everybody's neighbour, and the others form a ring
    n = 2000
    e = [(0, k) for k in range(1, n)] + [(k, k % (n - 1) + 1) for k in range(1, n)]
    df = spark.createDataFrame(e, "src int, dst int")
    mine, whole = graphs.wedge_bound(df)
    assert mine <= 4 * len(e) and whole > 400 * mine
    got = {r.node: r.triangles for r in graphs.triangles(df).collect()}
    assert got[0] == n - 1 and {got[k] for k in range(1, n)} == {2}


def test_triangles_move_lists_and_not_pairs_of_edges(spark, monkeypatch):
    # all of 120 nodes with all: 280,840 pairs of edges that leave one node, 7140 edges
    n, rows = 120, []
    e = spark.createDataFrame([(a, b) for a in range(n) for b in range(a)], "src int, dst int")
    write = graphs.Rounds.write

    def watched(self, df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        rows.append(("array_intersect" in plan, "(x#" in plan and "y#" in plan))
        return write(self, df)

    monkeypatch.setattr(graphs.Rounds, "write", watched)
    got = {r.node: r.triangles for r in graphs.triangles(e).collect()}
    assert got == {k: (n - 1) * (n - 2) // 2 for k in range(n)}
    assert any(a for a, _ in rows) and not any(b for _, b in rows)


def test_triangles_send_lists_in_rounds(spark, monkeypatch):
    # all with all: 215,820 ids to send, 11,990 a round, so more rounds than parts that are kept apart
    n, rounds, corners_of = 110, [], graphs._corners
    e = spark.createDataFrame([(a, b) for a in range(n) for b in range(a)], "src int, dst int")
    monkeypatch.setattr(graphs, "_corners", lambda near, lists: rounds.append(near.count()) or corners_of(near, lists))
    got = {r.node: r.triangles for r in graphs.triangles(e, at_once=1).collect()}
    assert got == {k: (n - 1) * (n - 2) // 2 for k in range(n)}
    assert len(rounds) == 18 and sum(rounds) == n - 1 and max(rounds) <= 7
    some = edges(8, 40, 700)
    got = {r.node: r.triangles for r in graphs.triangles(spark.createDataFrame(some, "src int, dst int"), at_once=1).collect()}
    assert got == corners(some) and len(rounds) > 19


def test_triangles_leave_no_shuffle_files(spark):
    """Else those of all steps are on disk together until the driver collects its garbage."""
    tops = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs())
    files = lambda: {f for t in tops for _, _, fs in os.walk(t.getPath()) for f in fs if f.startswith("shuffle_")}
    e, key = spark.createDataFrame(edges(7, 40, 400), "src int, dst int"), scratch.CLEANUP
    was, old = files(), spark.conf.get(key, None)
    got = {r.node: r.triangles for r in graphs.triangles(e).collect()}
    for _ in range(50):  # they go in the background
        if not files() - was:
            break
        time.sleep(0.2)
    assert got == corners(edges(7, 40, 400)) and not files() - was
    assert spark.conf.get(key, None) == old


def test_triangles_intersect_once(spark):
    lists = spark.createDataFrame([(0, [1, 2]), (1, [2])], "u int, near array<int>")
    df = graphs._corners(lists, lists)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 1
    assert {r.id: r.c for r in df.collect()} == {0: 1, 1: 1, 2: 1}


def test_edges_in_slices(spark):
    with graphs.Rounds(spark, "slices", tidy=True) as r:
        rows, seen = [(k, k + 1) for k in range(200)] * 2, []
        e = r.write(spark.createDataFrame(rows, "a int, b int"))
        out = graphs.in_slices(e, r, lambda x: seen.append(x.count()) or x.distinct())
        assert sorted(map(tuple, out.collect())) == sorted(set(rows))
        assert len(seen) == 2 and sum(seen) == 400 and min(seen) > 100 and r.paths == [out.scratch_path]
        r.keep()

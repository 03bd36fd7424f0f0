"""Operators on small hand-made inputs, checked against plain Python."""

import random

import pytest

from kestrelq.operators import groups, joins
from kestrelq.sources import formats
from pyspark.sql import functions as F


def frames(spark, seed):
    rng = random.Random(seed)
    left = [(i, rng.randint(0, 3), rng.randint(0, 400)) for i in range(60)]
    right = [(rng.randint(0, 3), rng.randint(0, 400), i) for i in range(40)]
    when = F.timestamp_seconds(F.col("s") * 3600)
    df = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("t", when)
    return left, right, df(left, "id long, k int, s long"), df(right, "k int, s long, v long")


@pytest.mark.parametrize("f", [joins.asof, joins.asof_chunked])
@pytest.mark.parametrize("seed", [1, 2])
def test_asof(spark, f, seed):
    left, right, ldf, rdf = frames(spark, seed)
    got = {r.id: r.asof_v for r in f(ldf, rdf.select("k", "t", "v"), "k", "t", "t", ["v"]).collect()}
    want = {}
    for i, k, s in left:
        ok = [(t, v) for kk, t, v in right if kk == k and t <= s]
        want[i] = max(ok)[1] if ok else None
    assert got == want


def test_interval(spark):
    left, right, ldf, rdf = frames(spark, 3)
    got = sorted((r.id, r.r_v) for r in joins.interval(ldf, rdf, "k", "t", "t", 36_000).collect())
    assert got == sorted((i, v) for i, k, s in left for kk, t, v in right if kk == k and 0 <= t - s <= 10)


def test_salted_left_join_keeps_rows_without_partner(spark):
    a = spark.createDataFrame([(1, x) for x in range(50)] + [(9, 0)], "k int, x int")
    b = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, y string")
    assert joins.salted(a, b, "k", 4, "left").count() == 101


def test_latest_and_top_k_with_ties(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, None, "c")], "k int, t int, v string")
    assert {(r.k, r.v) for r in groups.latest(df, ["k"], ["t"]).collect()} == {(1, "b"), (2, "c")}
    assert {(r.k, r.v) for r in groups.top_k(df, ["k"], [F.desc("t"), F.col("v")], 1).collect()} == {(1, "a"), (2, "c")}


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats_keep_nulls_and_text(spark, fmt):
    rows = [(1, "a,b\"c", None), (2, None, 1.5), (3, "", -0.25)]
    df = spark.createDataFrame(rows, "i int, s string, x double")
    got = sorted(tuple(r) for r in formats.round_trip(df, fmt).collect())
    assert got == rows


def test_no_shuffle_on_buckets(spark):
    a = formats.bucketed(spark.range(1000), "kq_a", "id", 4)
    b = formats.bucketed(spark.range(500), "kq_b", "id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = a.join(b, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan


def test_pushdown_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_quantity > 10").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan and "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_top_k_prunes_before_the_shuffle(spark):
    from kestrelq import plans

    plan = plans.QUERIES["topk_per_group"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_update_mode_needs_keys(spark):
    import pytest

    from kestrelq.streaming import streams

    with pytest.raises(ValueError):
        streams.run(streams.events_stream(spark, "/root/testdata/sf0.001").groupBy("user_id").count(), "update")


def test_stream_reads_only_its_own_name(spark, tmp_path):
    from kestrelq.session import table
    from kestrelq.streaming import streams

    e = table(spark, "/root/testdata/sf0.001", "events")
    e.write.parquet(str(tmp_path / "events.parquet"))
    e.write.parquet(str(tmp_path / "events.parquet_old"))
    got = streams.run(streams.events_stream(spark, str(tmp_path)).select("event_id"), "append", "own")
    assert got.count() == e.count()


def test_bucketed_tables_leave_others_alone(spark):
    from kestrelq.sources import formats

    one, two = (formats.bucketed(spark.range(n), "same_name", "id", 2) for n in (3, 5))
    assert (one.count(), two.count()) == (3, 5)


def test_median_by_counts_with_ties_and_nulls(spark):
    from kestrelq.operators import groups

    counts = spark.createDataFrame([("a", 1.0, 2), ("a", 5.0, 2), ("b", 7.0, 1), ("c", 1.0, 1), ("c", 2.0, 5), ("c", 9.0, 1)], "k string, x double, n long")
    assert {r.k: r.m for r in groups.median(counts, "k", "x", "n", "m").collect()} == {"a": 3.0, "b": 7.0, "c": 2.0}


def test_pandas_mean_gets_blocks_and_not_groups(spark):
    from kestrelq.functions import python_functions as pf

    df = spark.range(0, 5000, 1, 2).selectExpr("id % 3 AS k", "IF(id % 7 = 0, NULL, CAST(id AS DOUBLE)) AS x").unionAll(spark.createDataFrame([(9, None)], "k long, x double"))
    got = {r.k: r.m for r in pf.mean_by_blocks(df, "k", "x", "m", 64).collect()}
    want = {k: [i for i in range(5000) if i % 3 == k and i % 7] for k in range(3)}
    assert got.pop(9) is None and got == {k: pytest.approx(sum(v) / len(v)) for k, v in want.items()}
    block = F.shiftright(F.monotonically_increasing_id(), 6)
    assert max(r["count"] for r in df.groupBy("k", block).count().collect()) <= 64


def test_dates_are_joined_in_tasks_of_bounded_size(spark, monkeypatch):
    from kestrelq import plans

    monkeypatch.setattr(joins.parts, "__defaults__", (500,))
    df = plans.QUERIES["date_difference"](spark, "/root/testdata/sf0.001")
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 13 and max(sizes) < 1000

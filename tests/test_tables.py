"""Table functions, merged schemas and bad records on small inputs."""

import pytest
from pyspark.sql import functions as F

from kestrelq.functions.table_functions import Runs
from kestrelq.sources import evolution
from kestrelq.sources.formats import shared_path


def test_runs(spark):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, None), ("a", 5, "x"), (None, 1, "y"), ("b", 7, "x")]
    df = spark.createDataFrame(rows, "k string, t int, v string").repartition(3)
    got = F.udtf(Runs)(df.asTable(), F.lit("k"), F.lit("t"), F.lit("v"))
    assert got.columns == ["k", "v", "first", "last", "n"] and got.schema["first"].dataType.simpleString() == "int"
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", "x", 1, 2, 2), ("a", None, 3, 4, 2), ("a", "x", 5, 5, 1), (None, "y", 1, 1, 1), ("b", "x", 7, 7, 1)], key=str)
    assert F.udtf(Runs)(df.where("false").asTable(), F.lit("k"), F.lit("t"), F.lit("v")).collect() == []
    with pytest.raises(Exception, match="no column"):
        F.udtf(Runs)(df.asTable(), F.lit("k"), F.lit("t"), F.lit("w")).collect()


def test_merged_columns_and_types(spark):
    a, b = shared_path(spark, "one"), shared_path(spark, "two")
    spark.range(2).selectExpr("CAST(id AS INT) AS i").write.parquet(a)
    spark.range(2).selectExpr("id + 5 AS i", "'x' AS s").write.parquet(b)
    with pytest.raises(Exception):  # of two types
        evolution.merged(spark, a, b).collect()
    spark.range(2).selectExpr("CAST(id AS INT) + 5 AS i", "'x' AS s").write.mode("overwrite").parquet(b)
    assert sorted(map(tuple, evolution.merged(spark, a, b).select("i", "s").collect()), key=str) == [(0, None), (1, None), (5, "x"), (6, "x")]


@pytest.mark.parametrize("fmt,lines", [("json", ['{"i": 1, "corrupt_record": "own"}', "{", '{"i": "a"}', '{"i": 2}', ""]), ("csv", ["1,own", "a,b", "2,"])])
def test_bad_records(spark, fmt, lines):
    path = shared_path(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    schema = spark.createDataFrame([], "i int, corrupt_record string").schema
    good, bad = evolution.split_records(spark, path, schema, fmt)
    assert sorted(tuple(r) for r in good.collect()) == [(1, "own"), (2, None)]
    assert sorted(r.record for r in bad.collect()) == sorted({"json": ["{", '{"i": "a"}'], "csv": ["a,b"]}[fmt])

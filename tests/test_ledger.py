"""The ledger connector: nothing of a failed job, nothing twice after a restart."""

import pathlib

import pytest
from pyspark.sql import functions as F

from kestrelq.sources.ledger import Ledger, LedgerSource

ROWS = [(1, "a", None), (2, None, 1.5), (3, "", -0.25)]


@pytest.fixture
def path(spark, tmp_path):
    spark.dataSource.register(LedgerSource)
    return str(tmp_path / "table")


def save(df, path, mode="append"):
    df.write.format("kestrelq_ledger").option("path", path).mode(mode).save()


def load(spark, path):
    return spark.read.format("kestrelq_ledger").option("path", path).load()


def test_round_trip_append_and_overwrite(spark, path):
    df = spark.createDataFrame(ROWS, "i int, s string, x double").repartition(2)
    save(df, path)
    save(df.where("i = 1"), path)
    assert sorted(map(tuple, load(spark, path).collect()), key=str) == sorted([*ROWS, ROWS[0]], key=str)
    save(df.where("i = 3"), path, "overwrite")
    assert load(spark, path).collect() == [(3, "", -0.25)]
    save(df.where("false"), path, "overwrite")
    assert spark.read.format("kestrelq_ledger").option("path", path).option("columns", "i int").load().collect() == []


def test_a_failed_task_leaves_no_rows_and_no_files(spark, path):
    df = spark.createDataFrame([(i,) for i in range(100)], "i int").repartition(4)
    save(df, path)
    bad = F.udf(lambda i: 1 // (i - 57), "int")
    with pytest.raises(Exception):
        save(df.select(bad("i").alias("i")), path)
    assert load(spark, path).count() == 100 and Ledger(path).entries() == [1]
    Ledger(path).vacuum()  # of tasks that ended after the job
    assert load(spark, path).count() == 100
    assert len(list(pathlib.Path(path, "data").glob("*.parquet"))) == len(Ledger(path).files(0, 9))


def run(stream, path, check, query="q"):
    q = stream.writeStream.format("kestrelq_ledger").option("path", path).option("query", query).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()


def test_streams_go_on_where_they_stopped(spark, path, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    df = spark.createDataFrame([(i,) for i in range(20)], "i int").repartition(2)
    save(df, path)
    stream = lambda: spark.readStream.format("kestrelq_ledger").option("path", path).option("columns", "i int").load()
    run(stream(), out, check)
    run(stream(), out, check)  # nothing new
    assert load(spark, out).count() == 20
    save(df.select((F.col("i") + 100).alias("i")), path)
    save(df.select((F.col("i") + 200).alias("i")), path)
    run(stream(), out, check)
    assert sorted(r.i for r in load(spark, out).collect()) == [*range(20), *range(100, 120), *range(200, 220)]


def test_a_batch_that_comes_again_is_dropped(spark, path):
    from kestrelq.sources.ledger import StreamWriter, write_file
    from pyspark.sql.types import IntegerType, StructType

    import pyarrow as pa

    schema = StructType().add("i", IntegerType())
    writer = StreamWriter(path, schema, "q")
    for batch in (0, 0, 1):
        writer.commit([write_file(path, schema, iter([pa.RecordBatch.from_pydict({"i": pa.array([batch], pa.int32())})]), "job")], batch)
    assert sorted(r.i for r in load(spark, path).collect()) == [0, 1]
    assert len(list(pathlib.Path(path, "data").glob("*"))) == 2

"""File formats, written and read back with stated schemas, and a custom connector."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kestrelq.operators.scratch import shared_path


#: Options that make a format keep what it is given: times with microseconds, nulls apart from empty strings.
OPTIONS = {
    "csv": {"header": "true", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "nullValue": "\\N"},
    "json": {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"},
    "xml": {"rowTag": "row", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"},
}


def round_trip(df: DataFrame, fmt: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written in a format and read back with its own schema (no inference pass over the data)."""
    path, options = shared_path(df.sparkSession, fmt), OPTIONS.get(fmt, {})
    df.write.format(fmt).options(**options).partitionBy(*partition_by).save(path)
    return df.sparkSession.read.format(fmt).options(**options).schema(df.schema).load(path).select(*df.columns)


def bucketed(df: DataFrame, name: str, by: str, buckets: int = 8) -> DataFrame:
    """``df`` as a new table, ``name`` and a number of its own, dealt into buckets of ``by``: joins and groupings on it
    need no shuffle. No other table is touched; the caller drops it when it is done."""
    name = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, by).sortBy(by).saveAsTable(name)
    out = df.sparkSession.table(name)
    out.table_name = name
    return out


def dropped(*tables: DataFrame) -> None:
    """Drops tables returned by ``bucketed``."""
    for t in tables:
        t.sparkSession.sql(f"DROP TABLE {t.table_name}")


class Range(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__(start)
        self.start, self.end = start, end


class SquaresReader(DataSourceReader):
    def __init__(self, options):
        self.n, self.parts = int(options.get("n", 100)), int(options.get("partitions", 4))

    def partitions(self):
        cuts = [self.n * k // self.parts for k in range(self.parts + 1)]
        return [Range(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition) -> Iterator[tuple]:
        for x in range(partition.start, partition.end):
            yield x, x * x


class Squares(DataSource):
    """A connector in Python: ``spark.read.format("kestrelq_squares").option("n", 10)``; reads in parallel."""

    @classmethod
    def name(cls):
        return "kestrelq_squares"

    def schema(self):
        return "x long, y long"

    def reader(self, schema):
        return SquaresReader(self.options)

"""Registration of a query with its oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kestrelq.session import VIEWS, register


class Cases:
    """Queries of one module and their DuckDB SQL."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def frame(self, sql: str | None = None):
        """A query built with the DataFrame API."""

        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return add

    def sql(self, name: str, tables: str, spark_sql: str, oracle: str | None = None) -> None:
        """A query as SQL text; the oracle is the same text unless the dialects differ. The tables are views under
        names of their own, so that a caller's views stay."""
        own = re.sub(rf"\b({'|'.join(tables.split())})\b", rf"{VIEWS}\1", spark_sql)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            register(spark, sf_dir, *tables.split())
            return spark.sql(own)

        run.__name__ = name
        self.queries[name] = run
        self.oracle[name] = oracle or spark_sql

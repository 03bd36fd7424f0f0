"""Per-group operators: top-k, latest row, sessions, exact money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelq.operators.scratch import free_name


def money(c: str | Column, digits: int = 2) -> Column:
    """A double as decimal: sums are exact in any order and equal in every engine."""
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{digits})")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark prunes every partition to k rows a group before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= k)


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row per group, the one with the largest ``order``: an aggregate with partial sums, no window."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("m")).select(*by, *(F.col(f"m.{c}").alias(c) for c in rest))


def sessions(df: DataFrame, by: str, time: str, gap: str) -> DataFrame:
    """Start, end and size of each run of rows less than ``gap`` apart."""
    return df.groupBy(by, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n")).select(by, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def median(counts: DataFrame, key: str, value: str, count: str, name: str) -> DataFrame:
    """Exact medians of groups from one row for each distinct value with its count: the mean of the values that hold
    the two middle places. The window sees distinct values, not rows."""
    upto, every = free_name(counts, "upto"), free_name(counts, "every")
    w = Window.partitionBy(key).orderBy(value)
    places = counts.withColumn(upto, F.sum(count).over(w)).withColumn(every, F.sum(count).over(Window.partitionBy(key)))
    at = [F.floor((F.col(every) - 1) / 2), F.floor(F.col(every) / 2)]
    held = lambda p: (p < F.col(upto)) & (p >= F.col(upto) - F.col(count))
    return places.groupBy(key).agg((sum(F.max(F.when(held(p), F.col(value))) for p in at) / 2).alias(name))

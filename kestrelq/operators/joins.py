"""Joins that Spark has no operator for, as compositions of shuffles and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Every left row with the ``values`` of the latest right row of the same key that is not later (null
    without one). Of right rows with equal times the one with the largest values wins.

    Union and one window over the key: the shuffle is linear in the input, where a join would be quadratic in
    a key's rows. A key is one window group; if single keys outgrow a task, ``asof_chunked`` cuts them by time.
    """
    both = _union(left, right, by, left_time, right_time, values)
    w = Window.partitionBy(by).orderBy("asof_t", "asof_side", "asof_v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("asof_v", ignorenulls=True).over(w)
    return _left_rows(both.withColumn("asof_last", last), left, values, F.col("asof_last"))


def _union(left, right, by, left_time, right_time, values):
    r = right.select(F.col(by), F.col(right_time).alias("asof_t"), F.lit(0).alias("asof_side"), F.struct(*values).alias("asof_v"))
    l = left.select(F.col(by), F.col(left_time).alias("asof_t"), F.lit(1).alias("asof_side"), F.struct(*left.columns).alias("asof_row"))  # noqa: E741
    return l.unionByName(r, allowMissingColumns=True)


def _left_rows(df: DataFrame, left: DataFrame, values: list[str], found: Column) -> DataFrame:
    return df.where("asof_side = 1").select(*(F.col(f"asof_row.{c}").alias(c) for c in left.columns), *(found[v].alias(f"asof_{v}") for v in values))


def asof_chunked(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str], step: str = "1 day") -> DataFrame:
    """``asof`` for hot keys: groups are (key, time chunk); each chunk starts from the last right row before
    it, which a window over one row per key and chunk finds."""
    both = _union(left, right, by, left_time, right_time, values).withColumn("asof_chunk", F.window(F.col("asof_t"), step).start)
    # the largest (time, values) of every chunk, then the running one over the chunks before
    tops = both.where("asof_side = 0").groupBy(by, "asof_chunk").agg(F.max(F.struct("asof_t", "asof_v")).alias("top"))
    chunks = both.select(by, "asof_chunk").distinct().join(tops, [by, "asof_chunk"], "left")
    before = Window.partitionBy(by).orderBy("asof_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(by, "asof_chunk", F.last("top.asof_v", ignorenulls=True).over(before).alias("asof_before"))
    w = Window.partitionBy(by, "asof_chunk").orderBy("asof_t", "asof_side", "asof_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("asof_last", F.last("asof_v", ignorenulls=True).over(w))
    out = inside.where("asof_side = 1").join(carried, [by, "asof_chunk"])
    return _left_rows(out, left, values, F.coalesce("asof_last", "asof_before"))


def interval(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of equal key with ``0 <= right_time - left_time <= seconds``; columns of both sides, the right
    ones prefixed with ``r_``. Times are cut into bins of that width, so the equi-join key is (key, bin) and a
    left row meets two bins only: a hot key is spread over time."""
    micros = seconds * 1_000_000
    bin_of = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / micros)
    l = left.withColumn("bin", F.explode(F.array(bin_of(left_time), bin_of(left_time) + 1)))  # noqa: E741
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), bin_of(right_time).alias("bin"))
    lt, rt = F.col(left_time), F.col(f"r_{right_time}")
    match = (F.col(by) == F.col(f"r_{by}")) & (rt >= lt) & (rt <= lt + F.expr(f"INTERVAL {seconds} SECONDS"))
    return l.join(r.withColumnRenamed("bin", "r_bin"), match & (F.col("bin") == F.col("r_bin"))).drop("bin", "r_bin")


def salted(left: DataFrame, right: DataFrame, on: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """An equi-join whose left side has hot keys: left rows are dealt over ``salts`` copies of the right rows.
    For inner, left and semi joins; adaptive execution does this at run time where both sides are shuffles. The salt
    follows the row's place too, so equal rows are dealt over all salts; a retried task deals them in the same way."""
    l = left.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id(), *left.columns), F.lit(salts)).cast("int"))  # noqa: E741
    r = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [on, "salt"], how).drop("salt")


def parts(df: DataFrame, rows: int = 1 << 18) -> int:
    """Partitions of about ``rows`` rows each: adaptive execution merges by size on disk, not by what tasks hold."""
    return df.count() // rows + 1

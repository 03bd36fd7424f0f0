"""Python functions in Arrow batches, one of each kind that Spark offers."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def double_plus_one(x: pd.Series) -> pd.Series:
    return x * 2 + 1


@F.udf(T.StringType(), useArrow=True)
def shout(x):
    return None if x is None else x.upper()


@F.pandas_udf(T.DoubleType())
def total(x: pd.Series) -> float:
    return float(x.sum())


@F.pandas_udf(T.LongType())
def present(x: pd.Series) -> int:
    return int(x.count())


def mean_by_blocks(df: DataFrame, key: str, value: str, name: str, rows: int = 1 << 16) -> DataFrame:
    """key, ``name``: the mean of each group, null if it has no value. A pandas aggregate gets a group whole, so groups
    are cut into blocks of at most ``rows`` rows of a partition, and the blocks' sums and counts are added up."""
    block = F.shiftright(F.monotonically_increasing_id(), rows.bit_length() - 1)
    # by the number of rows, as adaptive execution would merge partitions by their small size on disk
    blocks = df.select(key, value, block.alias("block_")).repartition(df.count() // (4 * rows) + 1, key, "block_")
    parts = blocks.groupBy(key, "block_").agg(total(value).alias("sum_"), present(value).alias("n_"))
    return parts.groupBy(key).agg(F.try_divide(F.sum("sum_"), F.sum("n_")).alias(name))


@F.udtf(returnType=T.StructType().add("word", T.StringType()))
class Words:
    def eval(self, text: str, separator: str):
        for w in (text or "").split(separator):
            yield (w,)


def above_mean(g: pd.DataFrame) -> pd.DataFrame:
    """Rows of one group; the group has to fit a task."""
    return pd.DataFrame({"c_nationkey": g.c_nationkey, "c_custkey": g.c_custkey, "above": g.c_acctbal > g.c_acctbal.mean()})


def count_right(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    n = len(left) * len(right)
    return pd.DataFrame({"n_nationkey": left.k[:1], "customers": [n]}) if n else pd.DataFrame({"n_nationkey": [], "customers": []}).astype({"n_nationkey": "int32", "customers": "int64"})


def flag_big(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["o_orderkey"], pc.greater(b["o_totalprice"], 100000.0)], ["o_orderkey", "big"])

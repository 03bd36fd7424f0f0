"""Joins whose result is very many pairs: few keys, or none, and an inequality.

A plain join on few keys has a task for a key, and one on inequalities alone a task for a partition of one side. Here a
key's rows are dealt into blocks on both sides, and every pair of blocks is a cell, of BLOCK rows a side. Cells are
what is shuffled and joined, so neither the rows that a task holds nor the pairs that it makes grow with the tables;
only the number of tasks does. The pairs themselves are the result and grow as they do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a side in one cell, about; full cells of a task, and rows that it reads, about. Several small cells to a
#: task, so that a hash spreads them evenly.
BLOCK, CELLS, ROWS = 2048, 16, 1 << 19


def matched(left: DataFrame, right: DataFrame, key: tuple[str, str] | None, condition: Column, block: int = BLOCK) -> DataFrame:
    """All columns of the pairs for which the keys (left column, right column) are equal and ``condition`` holds: an
    inner join. Column names of the two sides have to differ. Without a key all rows have one."""
    l, r = (side.withColumn("key_", F.col(key[k]) if key else F.lit(0)).where("key_ IS NOT NULL") for k, side in enumerate((left, right)))  # noqa: E741
    number = lambda c: F.ceil(F.col(c) / block).cast("int")
    count = lambda side, c: side.groupBy("key_").agg(F.count("*").alias(c))
    blocks = count(l, "nl").join(count(r, "nr"), "key_").select("key_", "nl", "nr", number("nl").alias("lb"), number("nr").alias("rb"))
    work = blocks.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("lb") * F.col("rb"), F.col("nl") * F.col("nr").cast("double"), F.col("nl") * F.col("rb") + F.col("nr") * F.col("lb")))).first()
    parts = max(1, min(work[0], max(left.sparkSession.sparkContext.defaultParallelism, int(work[1] / (CELLS * block**2)) + 1, work[2] // ROWS + 1)))
    # without the constant key, which would be left out of the join and not of the partitions
    cell = ["key_", "lb_", "rb_"] if key else ["lb_", "rb_"]
    # keys of one block need no numbers; the others are fewer than the rows by the size of a block
    many = blocks.where("lb > 1 OR rb > 1").select("key_", "lb", "rb")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        # by a hash of the row's place, so that copies of a row and rows in a regular order are spread as well
        s = side.withColumn("at_", F.xxhash64(F.monotonically_increasing_id())).join(F.broadcast(many), "key_", "left")
        s = s.withColumn(f"{own}_", F.expr(f"pmod(at_, coalesce({own}, 1))")).drop("at_")
        s = s.withColumn(f"{other}_", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)).cast("long") - 1))).drop("lb", "rb")
        # a stated number of partitions, which adaptive execution leaves as it is: it would merge cells by their small size
        return (s if key else s.drop("key_")).repartition(parts, *cell)

    pairs = dealt(l, "lb", "rb").hint("merge").join(dealt(r, "rb", "lb"), cell)
    return pairs.where(condition).drop("key_", "lb_", "rb_")


def full(left: DataFrame, right: DataFrame, key: tuple[str, str], less: tuple[str, str], block: int = BLOCK) -> DataFrame:
    """The full outer join on equal keys and ``less``: the left column is smaller than the right one. A row has no
    partner if its value is not below its key's largest, or not above its smallest one, on the other side, so rows without
    partners are found without pairs."""
    (lk, rk), (lv, rv) = key, less
    pairs = matched(left, right, key, F.col(lv) < F.col(rv), block)
    top = right.groupBy(F.col(rk).alias("k_")).agg(F.max(rv).alias("v_"))
    low = left.groupBy(F.col(lk).alias("k_")).agg(F.min(lv).alias("v_"))
    alone = lambda side, k, best, has: side.join(best, F.col(k) == F.col("k_"), "left").where(~F.coalesce(has, F.lit(False))).select(*side.columns)
    out = pairs.unionByName(alone(left, lk, top, F.col(lv) < F.col("v_")), allowMissingColumns=True)
    return out.unionByName(alone(right, rk, low, F.col("v_") < F.col(rv)), allowMissingColumns=True)

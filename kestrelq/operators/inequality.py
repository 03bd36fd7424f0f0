"""Inequality joins by ranges: how many rows of the other side satisfy one or two inequalities, per row.

A join on inequalities alone compares all pairs. Here both columns are cut into blocks of about as many rows. For a
row of the left side most blocks lie wholly on one side of it, and a summary of the right side's rows by pair of blocks
settles them; only rows of its own block, in either column, are compared, in tasks of one block that sort and merge.
Every cut point is a block of its own and the blocks between are open, so a value that very many rows have is never
compared with itself, and blocks stay small however the values are distributed.

The number of blocks grows with the root of the rows, so the summary has no more cells than there are rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType, TimestampNTZType, TimestampType

from kestrelq.operators.scratch import Rounds, free_name, quoted

#: Rows in a block, about, at least.
BLOCK = 1 << 16
_WHOLE = (ByteType, ShortType, IntegerType, LongType)
#: Whether the left value has to be the smaller one, and whether equal values match.
_OPERATORS = {"<": (True, False), "<=": (True, True), ">": (False, False), ">=": (False, True)}


def number(df: DataFrame, name: str) -> Column:
    """A column that can be ordered as long or double numbers."""
    kind, c = df.schema[name].dataType, quoted(name)
    if isinstance(kind, _WHOLE):
        return c.cast("long")
    if isinstance(kind, (FloatType, DoubleType)):
        return c.cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    raise TypeError(f"{name}: inequality joins take whole numbers, doubles, dates and times, not {kind.simpleString()}")


def block_of(cuts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Even numbers between cut points, odd ones at them; the last one for NaN, the largest value."""
    below, upto = np.searchsorted(cuts, values, "left"), np.searchsorted(cuts, values, "right")
    out = below + upto
    return np.where(np.isnan(values), 2 * len(cuts) + 1, out) if values.dtype.kind == "f" else out


def matches(x: np.ndarray, y: np.ndarray, right: np.ndarray, equal_x: bool, equal_y: bool) -> np.ndarray:
    """For each left row (``right`` is 0), the sum of ``right`` over rows with a larger x and a larger y; equal ones count
    if so stated. Sorted by x, then merged level by level: a level's left halves add up to what its right halves get."""
    n = len(x)
    side = right > 0
    # from the largest x down, so that matches come before; among equal ones the side that has to come first
    order = np.lexsort((side == equal_x, _ranks(x)))[::-1]
    y, right, side = _ranks(y)[order], right[order], side[order]
    by_place = np.lexsort((side == equal_y, y))[::-1]  # the same for y
    out = np.zeros(n, np.int64)
    for level in range(max(1, (n - 1).bit_length())):
        half = by_place >> level
        run = half >> 1
        s = np.argsort(run, kind="stable")  # within a run still by y
        at, first = by_place[s], (half[s] & 1) == 0
        upto = np.cumsum(np.where(first, right[at], 0))
        start = np.concatenate(([True], run[s][1:] != run[s][:-1]))
        before = np.concatenate(([0], upto[:-1]))[start]
        got = upto - before[np.cumsum(start) - 1]
        out[at] += np.where(first, 0, got)
    back = np.zeros(n, np.int64)
    back[order] = np.where(side, 0, out)
    return back


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def count_matches(left: DataFrame, right: DataFrame, first: tuple[str, str, str], second: tuple[str, str, str] | None = None, name: str = "n", block: int = BLOCK) -> DataFrame:
    """``left`` with a column ``name``: the number of ``right`` rows for which ``first`` and ``second`` hold. A
    condition is (left column, one of ``< <= > >=``, right column), like ("a", "<", "b").

    Columns are whole numbers, doubles, dates or times; the two of a condition have to be of one kind, else TypeError is
    raised. A null in a condition's column matches nothing: such a left row gets 0. NaN equals itself and is larger than
    all other values. Repeated rows count as often as they stand there; ties are settled by the operator; an empty side
    gives zeros or no row. Columns with clashing names stay as they are; ``name`` gets a free variant if it is taken.

    The left side is written once and each side is shuffled once per condition; the summary has at most as many cells
    as there are rows. ``block``: rows that are compared in one task, about.
    """
    spark = left.sparkSession
    conditions = [c for c in (first, second) if c]
    name, columns = free_name(left, name), list(left.columns)
    values = []  # per condition: what has to be the smaller, left and right
    for a, op, b in conditions:
        smaller, equal = _OPERATORS[op]
        l, r = number(left, a), number(right, b)  # noqa: E741
        if dict(left.select(l.alias("c")).dtypes)["c"] != dict(right.select(r.alias("c")).dtypes)["c"]:
            raise TypeError(f"{a} and {b} are of different kinds")
        values.append((l, r, smaller, equal))
    if not second:  # always true
        values.append((F.lit(0).cast("long"), F.lit(1).cast("long"), True, False))
    flags = [(v[2], v[3]) for v in values]

    with Rounds(spark, "inequality") as rounds:
        own = free_name(left, "row_number")
        l = rounds.write(left.withColumn(own, F.monotonically_increasing_id()))  # noqa: E741
        sides = [
            l.select(quoted(own).alias("id"), *(v[0].alias(c) for v, c in zip(values, "xy")), F.lit(0).cast("long").alias("right")),
            right.select(F.lit(None).cast("long").alias("id"), *(v[1].alias(c) for v, c in zip(values, "xy")), F.lit(1).cast("long").alias("right")),
        ]
        both = rounds.write(sides[0].unionByName(sides[1]).where("x IS NOT NULL AND y IS NOT NULL"))
        total = both.count()
        rows = max(block, 2 * int(total**0.5))  # so that cells, the square of the blocks, are fewer than rows
        cuts = []
        for c in "xy":
            plain = both.where(~F.isnan(c)) if dict(both.dtypes)[c] == "double" else both
            blocks = max(2, -(-total // rows))
            found = plain.approxQuantile(c, [k / blocks for k in range(blocks + 1)], 1 / (4 * blocks)) if total else []
            found = np.unique(np.array(found, np.float64 if dict(both.dtypes)[c] == "double" else np.int64))
            cuts.append(found)
        shared = spark.sparkContext.broadcast(cuts)

        def placed(batches):
            for b in batches:
                is_right, extra = np.asarray(b["right"]) > 0, []
                for k, (c, (up, equal)) in enumerate(zip("xy", flags)):
                    points = shared.value[k]
                    at = block_of(points, np.asarray(b[c]))
                    single = at % 2 == 1
                    at = at if up else 2 * len(points) + 1 - at  # so that the larger block is always the one that matches
                    # all of a block of one value matches a left row there if equal values do, else none of it
                    extra += [pa.array(np.where(single & equal & ~is_right, at - 1, at)), pa.array(~single)]
                yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "x_block", "x_open", "y_block", "y_open"])

        kind = dict(both.dtypes)
        dealt = rounds.write(both.mapInArrow(placed, f"id long, x {kind['x']}, y {kind['y']}, right long, x_block long, x_open boolean, y_block long, y_open boolean"))
        rounds.drop(both)
        most = [2 * len(c) + 2 for c in cuts]

        # cells of the summary: right rows in a larger block of both columns
        cells = dealt.where("right = 1").groupBy("x_block", "y_block").agg(F.sum("right").alias("c"))
        # a left row's block may be one below the first
        every = spark.range((most[0] + 1) * (most[1] + 1)).select((F.expr(f"id DIV {most[1] + 1}") - 1).alias("x_block"), (F.expr(f"id % {most[1] + 1}") - 1).alias("y_block"))
        grid = every.join(cells, ["x_block", "y_block"], "left").fillna(0, "c")
        above = lambda by, order: F.coalesce(F.sum("c").over(Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        grid = rounds.write(grid.withColumn("c", above("x_block", "y_block")).withColumn("c", above("y_block", "x_block")).where("c > 0"))
        found = dealt.where("right = 0").join(grid, ["x_block", "y_block"]).select("id", F.col("c").alias("n"))

        # own block of x: compare x and y. Larger block of x and own block of y: compare y.
        for c, by_block in (("x", False), ("y", True)):
            found = found.unionByName(dealt.where(f"{c}_open").groupBy(f"{c}_block").applyInArrow(_inside(by_block, flags), "id long, n long"))
        found = found.groupBy("id").agg(F.sum("n").alias("n")).withColumnsRenamed({"id": own, "n": name})
        out = l.join(found, own, "left").select(*(quoted(c) for c in columns), F.coalesce(quoted(name), F.lit(0)).cast("long").alias(name))
        out = rounds.write(out)
        rounds.keep(out)
    return out


def _inside(by_block: bool, flags: list[tuple[bool, bool]]):
    """Counts inside one block; ``by_block``: x is compared by blocks, not by values."""
    (up_x, equal_x), (up_y, equal_y) = flags

    def run(t: pa.Table) -> pa.Table:
        right = np.asarray(t["right"])
        x = np.asarray(t["x_block"]) if by_block else np.asarray(t["x"])
        y = np.asarray(t["y"])
        n = matches(x if by_block or up_x else _down(x), y if up_y else _down(y), right, equal_x and not by_block, equal_y)
        some = pa.array(n > 0)
        return pa.table({"id": t["id"].filter(some), "n": pa.array(n).filter(some)})

    return run


def _down(values: np.ndarray) -> np.ndarray:
    """Ranks of the values from the largest down."""
    ranks = _ranks(values)
    return ranks.max(initial=0) - ranks

"""Exact quantiles by rank selection: histograms over value ranges, refined until a range holds one value.

``percentile`` keeps all distinct values of a group in one buffer. Here a round counts, with partial sums before
its one shuffle, how many rows fall into each of a bounded number of bins of the ranges that still hold a wanted rank;
running sums over the bins (not over values) tell which bin holds it, and that bin's smallest and largest value are the
next range. The first round bins by sign and power of two, so a range spans a factor of two at most from then on and
some six rounds reach the last bit of a double. What is kept between rounds is a row for each group and wanted rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelq.operators.scratch import Rounds, quoted

BINS = 1024


def first_bin(v: Column) -> Column:
    """Sign and power of two as a number that never falls where values rise; NaN counts as the largest value."""
    power = F.floor(F.log2(F.abs(v))) + 1100
    # log2 of the smallest numbers is about -1074; infinite values get a bin of their own
    size = F.when(v == 0, F.lit(0)).when(F.abs(v) == F.lit(float("inf")), F.lit(3000)).otherwise(power)
    return F.when(F.isnan(v), F.lit(4000)).otherwise(F.signum(v) * size).cast("long")


def next_bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Bins of equal width between two values that differ; the lowest is in the first and the highest in the last."""
    return F.when(v == high, F.lit(bins - 1)).otherwise(F.least(F.lit(bins - 2), F.floor((v - low) / (high - low) * (bins - 1)))).cast("long")


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float], bins: int = BINS) -> DataFrame:
    """A row per group of ``by`` with the exact quantiles ``wanted`` (name: share from 0 to 1) of a numeric column, as
    doubles between the two neighbouring values (``percentile``, ``quantile_cont``).

    Null values are left out; a group of nulls only has null quantiles; null keys are a group. NaN is larger than all other values.
    With an empty ``by`` the result is one row, on an empty table too (nulls). Shuffles per round: one of at most
    ``bins`` rows per range and task, whatever the number of rows; the table is read once a round, its own columns only.
    """
    if bad := [p for p in wanted.values() if not 0 <= p <= 1]:
        raise ValueError(f"shares have to be between 0 and 1: {bad}")
    keys = [f"k{i}" for i in range(len(by))]
    rows = df.select(*(quoted(c).alias(k) for c, k in zip(by, keys)), quoted(value).cast("double").alias("v"))
    rows = rows.withColumn("v", F.when(F.col("v") == 0, F.lit(0.0)).otherwise(F.col("v")))  # one zero, not two
    with Rounds(df.sparkSession, "quantiles") as rounds:
        groups = rounds.write(rows.groupBy(*keys).agg(F.count("v").alias("n")))
        place = [F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for name, p in wanted.items()]
        targets = groups.where("n > 0").select(*keys, F.explode(F.array(*place)).alias("p")).select(*keys, "p.name", "p.at", F.explode(F.array(F.floor("p.at"), F.ceil("p.at"))).alias("rank"))
        ranks = targets.select(*keys, "rank").distinct()

        bin_of = rows.where("v IS NOT NULL").withColumn("bin", first_bin(F.col("v")))
        histogram = bin_of.groupBy(*keys, "bin").agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        state = rounds.write(_chosen(histogram, keys, ranks.withColumn("base", F.lit(0).cast("long"))))
        while state.where(_open()).limit(1).count():
            # ranks in one bin share its range
            ranges = state.where(_open()).select(*(F.col(k).alias(f"r{k}") for k in keys), F.col("low").alias("from"), F.col("high").alias("to")).distinct()
            inside = (F.col("v") >= F.col("from")) & (F.col("v") <= F.col("to"))
            for k in keys:
                inside &= F.col(k).eqNullSafe(F.col(f"r{k}"))
            bin_of = rows.where("v IS NOT NULL").join(ranges, inside).withColumn("bin", next_bin(F.col("v"), F.col("from"), F.col("to"), bins))
            histogram = bin_of.groupBy(*keys, "from", "bin").agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
            left = state.where(_open()).select(*keys, F.col("low").alias("from"), "rank", "base")
            later = rounds.write(_chosen(histogram, [*keys, "from"], left).drop("from").unionByName(state.where(~_open())))
            rounds.drop(state)
            state = later
        values = state.select(*(F.col(k).alias(f"r{k}") for k in keys), F.col("rank").alias("r"), F.col("low").alias("x"))
        found = targets.join(values, _same(keys, F.col("rank") == F.col("r"))).groupBy(*keys, "name").agg(F.min_by("x", "rank").alias("a"), F.max_by("x", "rank").alias("b"), F.first("at").alias("at"))
        share = F.col("at") - F.floor("at")
        between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - share) + F.col("b") * share)
        wide = found.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, between)).alias(f"q{i}") for i, name in enumerate(wanted)))
        wide = wide.select(*(F.col(k).alias(f"r{k}") for k in keys), *(f"q{i}" for i in range(len(wanted))))
        out = groups.join(wide, _same(keys), "left") if keys else groups.join(wide, F.lit(True), "left")
        out = rounds.write(out.select(*(F.col(k).alias(c) for k, c in zip(keys, by)), *(F.col(f"q{i}").alias(name) for i, name in enumerate(wanted))))
        rounds.keep(out)
    return out


def _open() -> Column:
    """Ranges that hold more than one value."""
    return F.col("low") < F.col("high")


def _same(keys: list[str], first: Column | None = None) -> Column:
    on = F.lit(True) if first is None else first
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"r{k}"))
    return on


def _chosen(histogram: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """keys, rank, low, high, base: of each rank the bin that holds it, and the rows of its group below that bin.
    ``histogram``: keys, bin, c, low, high. ``ranks``: keys, rank, base (rows of the group below the range)."""
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # bins, not values
    bins = histogram.withColumn("upto", upto).select(*(F.col(k).alias(f"r{k}") for k in keys), "c", "upto", "low", "high")
    inside = _same(keys, (F.col("rank") - F.col("base") < F.col("upto")) & (F.col("rank") - F.col("base") >= F.col("upto") - F.col("c")))
    return ranks.join(bins, inside).select(*keys, "rank", "low", "high", (F.col("base") + F.col("upto") - F.col("c")).alias("base"))

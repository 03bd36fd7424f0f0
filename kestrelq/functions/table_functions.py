"""Python table functions over whole tables: partitioned, ordered, with columns that follow their arguments."""

from __future__ import annotations

from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class Runs:
    """``runs(TABLE(t), key, order, value)``: for each key, in the order of a column, the runs of equal values: the key,
    the value, the first and the last place of the run in the order column, and its length.

    The function states itself how the table is to be partitioned and ordered, so a call needs no clause for it; the
    types of its columns are those of the table's. Rows of a key stream through one worker, which keeps one run. Null
    values are equal to each other; equal places come in the order of the value; an empty table has no run.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        names = {k: a.value for k, a in (("key", key), ("order", order), ("value", value))}
        fields = {f.name: f for f in table.dataType.fields}
        for k, n in names.items():
            if n not in fields:
                raise ValueError(f"the table has no column {n} ({k})")
        schema = StructType()
        for name, source in ((names["key"], "key"), (names["value"], "value"), ("first", "order"), ("last", "order")):
            schema = schema.add(name, fields[names[source]].dataType)
        return AnalyzeResult(schema.add("n", LongType()), partitionBy=[PartitioningColumn(names["key"])], orderBy=[OrderingColumn(names["order"]), OrderingColumn(names["value"])])

    def __init__(self):
        self.run = None

    def eval(self, row, key: str, order: str, value: str):
        k, o, v = row[key], row[order], row[value]
        if self.run and self.run[1] == v:
            self.run[3], self.run[4] = o, self.run[4] + 1
            return
        if self.run:
            yield tuple(self.run)
        self.run = [k, v, o, o, 1]

    def terminate(self):
        if self.run:
            yield tuple(self.run)

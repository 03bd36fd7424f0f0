"""Tables whose files differ in columns, and text files with records that do not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from kestrelq.operators.scratch import quoted


def merged(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files of one table whose columns have grown over time: the union of their columns by name, null where a
    file has none. The schemas are read from the footers by the cluster. A column of two types raises an error."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def split_records(spark: SparkSession, path: str, schema: StructType, fmt: str = "json", **options: str) -> tuple[DataFrame, DataFrame]:
    """Records that fit ``schema``, and the text of those that do not, in a column ``record``. One pass over the files
    each: the parser puts a bad record's text into a column of its own and goes on. Empty lines are no records."""
    held = "corrupt_record"
    while held in schema.fieldNames():
        held += "_"
    whole = spark.read.format(fmt).options(**options).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", held).schema(StructType([*schema.fields]).add(held, StringType())).load(path)
    good = whole.where(F.col(held).isNull()).select(*schema.fieldNames())
    # the text column may not be read alone, so a condition that always holds reads another one too
    other = F.coalesce(quoted(schema.fieldNames()[0]).cast("string"), F.lit("")) >= F.lit("")
    bad = whole.where(F.col(held).isNotNull() & other).select(F.col(held).alias("record"))
    return good, bad

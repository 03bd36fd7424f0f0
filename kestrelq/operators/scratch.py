"""Tables written between the rounds of iterative operators, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, else that of setCheckpointDir. A local session without either gets a
    temporary one; on a cluster that is an error, as executors would not share it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that driver and executors share.")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="kestrelq-checkpoint-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark then removes the shuffle files of an execution when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Rounds:
    """Writes tables so that no lineage grows from round to round; ``keep`` removes all others when the work is done
    (and all of them if it fails). With ``tidy`` the shuffle files of each table go once it is written."""

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.name, self.tidy, self.paths, self.tables = spark, name, tidy, [], {}

    def __enter__(self) -> Rounds:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is not None:
            self.remove(self.paths)

    @contextmanager
    def tidied(self) -> Iterator[None]:
        """For executions whose frames are not used again."""
        old = self.spark.conf.get(CLEANUP, None)
        if self.tidy:
            self.spark.conf.set(CLEANUP, "true")
        try:
            yield
        finally:
            if self.tidy:
                self.spark.conf.unset(CLEANUP) if old is None else self.spark.conf.set(CLEANUP, old)

    def write(self, df: DataFrame) -> DataFrame:
        path = shared_path(self.spark, self.name)
        with self.tidied():
            df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def append(self, to: DataFrame, df: DataFrame) -> DataFrame:
        """The written table ``to`` with the rows of ``df``, in its place."""
        with self.tidied():
            df.write.option("compression", "zstd").mode("append").parquet(to.scratch_path)
        out = self.spark.read.schema(to.schema).parquet(to.scratch_path)
        out.scratch_path = to.scratch_path
        return out

    def bucketed(self, df: DataFrame, by: str, buckets: int) -> DataFrame:
        """Written in buckets of ``by``: joins and groupings by it move nothing. Not to be kept: its entry in the
        catalog goes with its files."""
        path = shared_path(self.spark, self.name)
        name = "kestrelq_" + path.rsplit("/", 1)[1].replace("-", "_")
        self.paths.append(path)
        self.tables[path] = name
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, by).sortBy(by).saveAsTable(name)
        out = self.spark.table(name)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that no result needs any more; others than written ones are left alone."""
        self.remove([t.scratch_path for t in tables if hasattr(t, "scratch_path")])

    def keep(self, *tables: DataFrame) -> None:
        kept = {t.scratch_path for t in tables}
        self.remove([p for p in self.paths if p not in kept])

    def remove(self, paths: Iterable[str]) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for path in list(paths):
            if path in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(path)}")
            place = hadoop.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
            if path in self.paths:
                self.paths.remove(path)


def free_name(df: DataFrame, want: str) -> str:
    """``want``, or a variant that no column of ``df`` has (names clash case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want += "_"
    return want


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")

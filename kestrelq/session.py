"""Session defaults and the table loader.

The driver hands over a ready session, so nothing here depends on settings that
must precede session creation. ``local_session`` is for tests and the bench.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with UTC, AQE and a shared checkpoint folder."""
    shared = os.environ.get("KESTRELQ_SHARED") or tempfile.mkdtemp(prefix="kestrelq-")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kestrelq")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .config("spark.checkpoint.dir", f"file://{shared}/checkpoint")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the named Parquet tables under ``sf_dir``; any URI Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What the names of temporary views begin with.
VIEWS = "kestrelq_view_"


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temp views for SQL text. Lazy: no data is read before a query runs."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(VIEWS + name)

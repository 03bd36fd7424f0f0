"""Structured Streaming over event files: bounded runs that return finished tables.

Event time in the tables has no zone, while a watermark needs an instant, so it is cast first. A run reads all
files there are (availableNow) and stops. Complete mode gives a query's final state; append mode gives what the
watermark has closed. Sinks are Parquet files with a checkpoint, so a restart goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kestrelq.sources.formats import shared_path


def events_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The events as a stream, one file a trigger; works for a file or a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a glob is needed for a single file; this one matches the name itself, be it a file or a folder of parts
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{path[:-1]}[{path[-1]}]")
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str = "append", name: str = "stream", keys: tuple[str, ...] = (), once: bool = False) -> DataFrame:
    """Runs a stream to the end of its input. Append goes to files, in a checkpointed sink; complete mode's
    table is written anew by every trigger, and the last one stands; update mode's changes are kept by trigger, and
    the last one of each of ``keys`` stands. ``once``: one trigger, for state that follows the clock, whose stream would
    go on for ever."""
    out, check = shared_path(stream.sparkSession, f"{name}-out"), shared_path(stream.sparkSession, f"{name}-state")
    write(stream, mode, out, check, keys, once)
    return result(stream, mode, out, keys)


def write(stream: DataFrame, mode: str, out: str, check: str, keys: tuple[str, ...] = (), once: bool = False) -> None:
    """One run over the input that there is and that no run with this checkpoint has taken."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(**({"once": True} if once else {"availableNow": True}))
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    elif mode == "complete":
        writer = writer.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(out))
    elif keys:  # a retried trigger writes its own folder anew
        writer = writer.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/trigger={k}"))
    else:
        raise ValueError("update mode needs the keys by which changes replace each other")
    writer.start().awaitTermination()


def result(stream: DataFrame, mode: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    read = stream.sparkSession.read.schema(stream.schema)
    if mode != "update":
        return read.parquet(out)
    changes = stream.sparkSession.read.schema(f"{stream.schema.toDDL()}, trigger long").parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "trigger").alias("last"))
    return last.select(*(F.col(c) if c in keys else F.col(f"last.{c}") for c in stream.columns))


def fed(parts: list[DataFrame], build, mode: str = "append", name: str = "fed") -> DataFrame:
    """The stream ``build`` makes of a folder that receives ``parts`` one after the other, with a run after each: a
    watermark moves between runs, and every run goes on from the checkpoint of the one before."""
    spark = parts[0].sparkSession
    folder, out, check = (shared_path(spark, f"{name}-{x}") for x in ("in", "out", "state"))
    for part in parts:
        part.write.mode("append").parquet(folder)
        source = spark.readStream.schema(parts[0].schema).parquet(folder)
        stream = build(source)
        write(stream, mode, out, check)
    return result(stream, mode, out)


def closing(events: DataFrame, days: int = 60) -> DataFrame:
    """One row of no event, so much later than all that a watermark closes what is open."""
    last = events.agg((F.max("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("ts"))
    return last.select(*(F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema))


class Totals(StatefulProcessor):
    """Per user: rows and sum so far, in a value state (transformWithStateInPandas)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", "n long, total double")

    def handleInputRows(self, key, rows, timer_values):
        import pandas as pd

        n, total = self.state.get() if self.state.exists() else (0, 0.0)
        for b in rows:
            n, total = n + len(b), total + float(b["value"].sum())
        self.state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


def running_totals(key, batches, state):
    """Per key across triggers: rows and sum so far (applyInPandasWithState)."""
    import pandas as pd

    n, total = state.get if state.exists else (0, 0.0)
    for b in batches:
        n, total = n + len(b), total + float(b.value.sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

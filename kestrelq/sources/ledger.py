"""A table of Parquet files with a ledger of commits, as a connector: sink and source, for batches and streams.

    df.write.format("kestrelq_ledger").option("path", path).mode("append").save()
    spark.readStream.format("kestrelq_ledger").option("path", path).load()

Tasks write files that nobody reads yet; the driver then adds one entry to the ledger, which names them. So a failed
task or job leaves no rows, and its files are removed. A stream's entry carries its query and batch: a batch that is
written again after a restart is found in the ledger and dropped. A reading stream's offset is a number of entries, and
each file of the entries between two offsets is a partition, so every row is read once. One writer at a time.

``path`` is a folder that driver and executors share, as any address that Arrow's file systems open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage


class Ledger:
    """Entries in order; entry k is the file k.json, a list of data files and who wrote them."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, root = (fs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else fs.FileSystem.from_uri(path)
        self.root = root.rstrip("/")

    def entries(self) -> list[int]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/ledger", allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def entry(self, k: int) -> dict:
        with self.fs.open_input_stream(f"{self.root}/ledger/{k:010d}.json") as f:
            return json.loads(f.read())

    def add(self, files: list[str], by: str) -> None:
        """A new entry, whole or not at all: it is written under another name first."""
        k = (self.entries() or [0])[-1] + 1
        self.fs.create_dir(f"{self.root}/ledger")
        temporary = f"{self.root}/ledger/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temporary) as f:
            f.write(json.dumps({"files": files, "by": by}).encode())
        self.fs.move(temporary, f"{self.root}/ledger/{k:010d}.json")

    def files(self, start: int, end: int) -> list[str]:
        return [f for k in self.entries() if start < k <= end for f in self.entry(k)["files"]]

    def remove(self, files: list[str]) -> None:
        for f in files:
            try:
                self.fs.delete_file(f"{self.root}/{f}")
            except FileNotFoundError:
                pass

    def vacuum(self, job: str = "") -> None:
        """Removes data files that no entry names: all, or those of one job. For when nobody is writing."""
        from pyarrow import fs

        named = set(self.files(0, 1 << 62))
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/data", allow_not_found=True))
        self.remove([f"data/{f.base_name}" for f in found if f.base_name.startswith(job) and f"data/{f.base_name}" not in named])

    def clear(self) -> None:
        old = self.files(0, 1 << 62)
        for k in self.entries():
            self.fs.delete_file(f"{self.root}/ledger/{k:010d}.json")
        self.remove(old)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def write_file(path: str, schema, batches: Iterator[pa.RecordBatch], job: str) -> Written:
    """One task's rows as one file of a job; none without rows. A task that fails removes what it has written."""
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import to_arrow_schema

    ledger, name, writer = Ledger(path), f"data/{job}-{uuid.uuid4().hex}.parquet", None
    try:
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                ledger.fs.create_dir(f"{ledger.root}/data")
                writer = pq.ParquetWriter(f"{ledger.root}/{name}", to_arrow_schema(schema), filesystem=ledger.fs)
            writer.write_table(pa.Table.from_batches([b]).cast(to_arrow_schema(schema)))
        if writer is None:
            return Written([])
        writer.close()
        return Written([name])
    except BaseException:
        if writer is not None:
            writer.close()
            ledger.remove([name])
        raise


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema, overwrite: bool):
        self.path, self.table, self.overwrite, self.job = path, schema, overwrite, uuid.uuid4().hex

    def write(self, iterator):
        return write_file(self.path, self.table, iterator, self.job)

    def commit(self, messages):
        ledger = Ledger(self.path)
        if self.overwrite:
            ledger.clear()
        ledger.add([f for m in messages if m for f in m.files], "batch")

    def abort(self, messages):
        """Not every task that has written tells so; what one writes after this stays unread until ``vacuum``."""
        Ledger(self.path).vacuum(self.job)


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, schema, query: str):
        self.path, self.table, self.query, self.job = path, schema, query, uuid.uuid4().hex

    def write(self, iterator):
        return write_file(self.path, self.table, iterator, self.job)

    def commit(self, messages, batchId):
        ledger, files = Ledger(self.path), [f for m in messages if m for f in m.files]
        by = f"{self.query}:{batchId}"
        if any(ledger.entry(k)["by"] == by for k in reversed(ledger.entries())):  # written before a restart
            ledger.remove(files)
        else:
            ledger.add(files, by)

    def abort(self, messages, batchId):
        Ledger(self.path).vacuum(self.job)


class File(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


def read_file(path: str, name: str, schema) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    ledger = Ledger(path)
    with ledger.fs.open_input_file(f"{ledger.root}/{name}") as f:
        yield from pq.ParquetFile(f).iter_batches(columns=schema.names)


class BatchReader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.table = path, schema

    def partitions(self):
        return [File(f) for f in Ledger(self.path).files(0, 1 << 62)] or [File("")]

    def read(self, partition):
        return read_file(self.path, partition.name, self.table) if partition.name else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, schema):
        self.path, self.table = path, schema

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        return {"entries": (Ledger(self.path).entries() or [0])[-1]}

    def partitions(self, start: dict, end: dict):
        return [File(f) for f in Ledger(self.path).files(start["entries"], end["entries"])]

    def read(self, partition):
        return read_file(self.path, partition.name, self.table)

    def commit(self, end: dict) -> None:
        """Entries stay: other readers may not have come so far."""


class LedgerSource(DataSource):
    """Options: path; for reading, columns (a schema as DDL) unless the reader states one; for a writing stream, query
    (a name by which it is known after a restart)."""

    @classmethod
    def name(cls):
        return "kestrelq_ledger"

    def schema(self):
        if "columns" in self.options:
            return self.options["columns"]
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        ledger = Ledger(self.options["path"])
        files = ledger.files(0, 1 << 62)
        if not files:
            raise ValueError("An empty ledger has no columns: state them by .schema(..) or option columns.")
        with ledger.fs.open_input_file(f"{ledger.root}/{files[0]}") as f:
            return from_arrow_schema(pq.read_schema(f))

    def reader(self, schema):
        return BatchReader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        return BatchWriter(self.options["path"], schema, overwrite)

    def streamReader(self, schema):
        return StreamReader(self.options["path"], schema)

    def streamWriter(self, schema, overwrite):
        return StreamWriter(self.options["path"], schema, self.options.get("query", "stream"))

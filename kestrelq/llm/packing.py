"""Packing: concatenate all documents' ids and cut the stream into fixed windows.

Pass 1 tokenizes and writes the ids with each document's offset inside its partition. The partition
totals, one number each, are summed up in order on the driver. Pass 2 adds a partition's base to its
documents' offsets and cuts where a multiple of the window falls, each row on its own.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelq.llm.common import Segments, arrow_map, pieces, quoted, written

#: Columns of a piece beside its document id.
PIECE_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def padded(length: int, window: int = 2048) -> int:
    """Length of a stored sequence of ``length`` ids: a power of two stays, others are padded to the window."""
    return length if length > 0 and length & (length - 1) == 0 else window


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, as
    little-endian unsigned 32-bit numbers, if asked for).

    Documents follow each other in the order of partitions and rows; every sequence but the last is
    full, so padding is less than one window in all. A null or empty text is the end id alone. Repeated
    rows and null ids are documents of their own. Other columns are not read. An empty table has no piece.
    """
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def tokenize(batches):
        import struct

        segments, at, part = Segments.load(path, False, False), 0, None
        end = struct.pack("<I", end_id)
        for batch in batches:
            for b in pieces(batch, "text"):
                part = b["part"]
                out = [b"".join(v) + end for v in segments.of(b["text"].to_pylist())]
                n = np.fromiter(map(len, out), np.int64, len(out)) // 4
                first = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([b["id"], part, pa.array(first), pa.array(n), pa.array([shrink(x) for x in out], pa.binary())], ["id", "part", "first", "n", "ids"])

    def shrink(x: bytes) -> bytes:
        a = np.frombuffer(x, "<u4")
        return a.astype("<u2").tobytes() if a.max() < 65536 else x

    tokens = written(rows.withColumn("part", F.spark_partition_id()).mapInArrow(tokenize, f"id {kind}, part int, first long, n long, ids binary"), "pack")
    totals = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one number a partition
    order = sorted(totals)
    base = dict(zip(order, itertools.accumulate([0] + [totals[p] for p in order])))
    base = tokens.sparkSession.sparkContext.broadcast(base)

    def cut(b: pa.RecordBatch):
        cols: list[list] = [[] for _ in range(8)]
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        for doc, part, first, n, raw in zip(b["id"].to_pylist(), b["part"].to_pylist(), b["first"].to_pylist(), b["n"].to_pylist(), b["ids"].to_pylist()):
            at, start = base.value[part] + first, 0
            whole = memoryview(np.frombuffer(raw, "<u2").astype("<u4").tobytes() if len(raw) == 2 * n else raw)
            while start < n:
                seq, off = divmod(at + start, window)
                size = min(window - off, n - start)
                piece = whole[4 * start : 4 * (start + size)]
                for c, v in zip(cols, (doc, start, size, zlib.crc32(piece), n, seq, off, bytes(piece) if ids else None)):
                    c.append(v)
                start += size
        arrays = [pa.array(cols[0], b["id"].type), *(pa.array(c, pa.int64()) for c in cols[1:7])]
        yield pa.RecordBatch.from_arrays(arrays + [pa.array(cols[7], pa.binary())] * ids, names[: 7 + ids])

    return tokens.mapInArrow(arrow_map(cut, "ids"), f"`{id_col}` {kind}, {PIECE_SCHEMA}" + ", ids binary" * ids)

"""WARC archives: a writer with revisit records, and a reader that splits files by byte range.

Every record is a gzip member of its own. A reading task scans its range for gzip magic, takes a place for
a member's start if the bytes there decode to a WARC version line, and owns the records that start inside
its range; it reads on past the end for the last of them.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelq.llm.common import BATCH_BYTES, body, quoted, scratch, written

#: Fixed by the format: the start of a gzip member with deflate data, and of a WARC record.
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: Payloads below this are always stored; file bytes of a reading task; bytes of one read.
REVISIT_BYTES, SPLIT_BYTES, READ_BYTES = 100, 4 << 20, 1 << 20
#: Ranges that a reading task takes when there are many; up to SPREAD_TASKS tasks have one each.
RANGES_A_TASK, SPREAD_TASKS = 32, 200
#: Characters of an address that are stored as they are: what ASCII prints, but for the sign that begins an escape.
PLAIN = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, ...) and the path in it; a bare path is local."""
    if uri.startswith(("file:/", "/")):
        return pyarrow.fs.LocalFileSystem(), urllib.parse.unquote(urllib.parse.urlparse(uri).path)
    return pyarrow.fs.FileSystem.from_uri(uri)


def record(kind: str, page_id, url: str | None, digest: str, length: int, payload: bytes, refers_to=None, level: int = 1) -> bytes:
    """One gzip member. A revisit has the headers of its payload but no payload."""
    block = HTTP + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {length}",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe=PLAIN))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    plain = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(plain) + z.flush()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes one archive per task into ``folder`` and returns the manifest (path, size, records).

    Of records with equal payloads of REVISIT_BYTES or more, that with the smallest id is a response (all
    rows with that id, if it repeats) and the others revisit it. A null html is an empty payload, a null url stays
    null; a row with a null id is a response, as it can't be told from others. Very long payloads are one record.
    An empty table has an empty manifest; other columns, whatever their names, are not read. A retried task writes
    a file of another name; files that no manifest row names are never read.

    Payloads stay where they are while the table of repeated digests, which is written first, is below Spark's
    broadcast threshold; beyond it Spark joins by a shuffle.
    """
    rows = pages.select(quoted(id_col).cast("long").alias("id"), quoted(url_col).cast("string").alias("url"), body(html_col).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    # digests and ids only: the payloads do not move for this
    first = rows.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count("id").alias("copies")).where("copies > 1").select(F.col("digest").alias("key"), "first")
    first = written(first, "warc-repeats")  # its size is known when the join is planned
    # payloads that are always stored have no partner, and keys that do not meet
    key = F.when(F.octet_length("html") >= REVISIT_BYTES, F.col("digest")).otherwise(F.concat(F.lit("-"), F.pmod(F.monotonically_increasing_id(), F.lit(4096))))
    rows = rows.withColumn("key", key).join(first, "key", "left").drop("key")

    def run(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        size = n = 0
        out = None
        for b in batches:
            for i, url, html, digest, to in zip(*(b[c].to_pylist() for c in ("id", "url", "html", "digest", "first"))):
                kind = "response" if to is None or i is None or i == to else "revisit"
                out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                data = record(kind, i, url, digest, len(html), html, to)
                out.write(data)
                size += len(data)
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "size": [size], "records": [n]})

    return written(rows.mapInArrow(run, "path string, size long, records long"), "warc-manifest")


def inflate_record(data) -> tuple[bytes, bytes] | None:
    """Head and block of the member whose bytes ``data`` yields; None if it is no WARC record."""
    z = zlib.decompressobj(31)
    plain = bytearray()
    try:
        for chunk in data:
            plain += z.decompress(chunk)
            if len(plain) >= len(VERSION) and not plain.startswith(VERSION):
                return None
            if z.eof:
                break
    except zlib.error:
        return None
    if not z.eof or not plain.startswith(VERSION):
        return None
    head, _, block = bytes(plain).partition(b"\r\n\r\n")
    return head, block


def starts_record(peek: bytes) -> bool:
    """Whether a member's first bytes decode to a WARC version line."""
    try:
        return zlib.decompressobj(31).decompress(peek, 64).startswith(VERSION)
    except zlib.error:
        return False


def read_range(file, size: int, start: int, end: int):
    """(head, block) of the records that start in [start, end)."""

    def at(offset: int, n: int) -> bytes:
        file.seek(offset)
        return file.read(min(n, size - offset))

    def chunks(offset: int):
        step = 1 << 16
        while offset < size:
            yield (c := at(offset, step))
            offset += len(c)
            step = READ_BYTES

    here = start
    while here < end:
        window = at(here, min(READ_BYTES, end - here) + len(MAGIC) - 1)
        k, next_here = 0, here + min(READ_BYTES, end - here)
        while (k := window.find(MAGIC, k)) >= 0:
            peek = window[k : k + 512]
            if len(peek) < 512:
                peek = at(here + k, 512)
            if starts_record(peek) and (found := inflate_record(chunks(here + k))):
                yield found
            k += len(MAGIC)
        here = next_here


def read(manifest: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload per record of the
    manifest's files. A revisit's digest and length are those of the payload that it refers to. A record longer than
    a range is read past its end by the task in whose range it starts; an empty manifest has no record."""
    ranges = manifest.select("path", "size", F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {split}L)")).alias("start"))
    n = max(1, ranges.count())  # files and ranges are few beside records
    ranges = ranges.repartition(min(n, max(SPREAD_TASKS, n // RANGES_A_TASK)), "path", "start")

    def run(batches):
        names = ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        for b in batches:
            for path, size, start in zip(*(b[c].to_pylist() for c in ("path", "size", "start"))):
                rows, held = [], 0
                fs, place = file_system(path)
                with fs.open_input_file(place) as file:
                    for head, block in read_range(file, size, start, min(size, start + split)):
                        rows.append(parsed(head, block))
                        held += len(block)
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return ranges.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def parsed(head: bytes, block: bytes) -> tuple:
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        k, _, v = line.partition(": ")
        fields[k] = v
    number = lambda k: int(fields[k]) if k in fields else None
    block = block[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    kind, url = fields["WARC-Type"], fields.get("WARC-Target-URI")
    url = None if url is None else urllib.parse.unquote(url)
    if kind == "response":
        return number("X-Page-ID"), url, kind, None, hashlib.sha256(payload).hexdigest(), len(payload), payload
    return number("X-Page-ID"), url, kind, number("X-Refers-To-Page"), fields["WARC-Payload-Digest"].partition(":")[2], number("X-Payload-Length"), None


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes ``pages`` to new archives in the shared folder and returns the records read back."""
    return read(write(pages, scratch(pages.sparkSession, "warc"), id_col, url_col, html_col))

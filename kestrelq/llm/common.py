"""What the corpus operators share: the scratch folder, written stages, byte-level words."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte tables for bytes.translate. LOWER folds A-Z only. WORDS also turns every ASCII byte that is
#: neither letter nor digit into a blank, so that split() gives [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORDS = bytes(c if (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) else 32 for c in LOWER)

#: Bytes of text that a worker keeps in one output batch at most, beside the row that passes it.
BATCH_BYTES = 2 << 20


#: Tables that this process has written to the shared folder and not removed, in order.
_held: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder: that of spark.checkpoint.dir, else of setCheckpointDir. A local session
    without either (tests) gets a temporary folder of its own; on a cluster that is an error, as executors would
    not share it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that driver and executors share.")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="kestrelq-checkpoint-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder. Cuts the lineage: lost executors cost no recomputation
    beyond it, and values that depend on task order are fixed from here on."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    _held.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes tables that no result needs any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in _held:
            _held.remove(path)


def released(*tables: DataFrame) -> None:
    """Deletes tables returned by ``written``; others are left alone."""
    for t in tables:
        if hasattr(t, "scratch_path"):
            remove(t.sparkSession, [t.scratch_path])


def settled_table(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """``written(build(), name)``, without the tables that were written on the way to it."""
    before = set(_held)
    out = written(build(), name)
    remove(out.sparkSession, [p for p in _held if p not in before and p != out.scratch_path])
    return out


def cleanup(spark: SparkSession) -> None:
    """Deletes all tables of this process in the shared folder; results that are not computed yet are lost."""
    remove(spark, list(_held))


def body(col: str) -> F.Column:
    """A text column as UTF-8 bytes, null as no bytes."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b"").cast("binary"))


def free_name(df: DataFrame, want: str) -> str:
    """``want``, or a variant that no column of ``df`` has (names clash case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want += "_"
    return want


def quoted(name: str) -> F.Column:
    return F.col("`" + name.replace("`", "``") + "`")


def pieces(batch: pa.RecordBatch, col: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part has about ``limit`` bytes in ``col``, one row at least."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch[col]), 0), dtype=np.int64)
    if not len(lengths):
        return
    part = np.cumsum(lengths) // limit
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(lengths)]):
        yield batch.slice(int(a), int(b - a))


@functools.cache
def one_thread() -> None:
    """Keeps matrix products of this worker process on the task's one core: the library's other threads would
    spin there and speed nothing up at these sizes. Does nothing where the library can't be told."""
    try:
        with open("/proc/self/maps") as maps:
            paths = {line.split()[-1] for line in maps if "openblas" in line}
    except OSError:
        return
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def arrow_map(f: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], col: str) -> Callable:
    """``f`` per byte-balanced part of every incoming batch, for mapInArrow."""

    def run(batches):
        one_thread()
        for batch in batches:
            for part in pieces(batch, col):
                yield from f(part)

    return run


def held_out(id_col: str, mod: int, remainder: int) -> F.Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as not held out."""
    return F.coalesce(F.pmod(F.crc32(quoted(id_col).cast("string").cast("binary")), F.lit(mod)) == remainder, F.lit(False))


class _Table(dict):
    """Answers by key in two generations. An unknown key gets an empty answer, which is filled later, and
    stands in ``pending``."""

    def __init__(self, older: dict):
        super().__init__()
        self.older, self.pending = older, []

    def __missing__(self, key):
        if (value := self.older.get(key)) is None:
            value = bytearray()
            self.pending.append(key)
        self[key] = value
        return value


class Segments:
    """Text cut at safe boundaries, each distinct segment encoded once.

    With ``blanks`` (byte-level vocabularies) a cut falls before a single blank between two characters
    that are not white space; without it (vocabularies that fold case and drop white space) at any white
    space, and between a word and the full stop or comma that ends it. The pre-tokenizers always break
    there and no special token holds such a place, so the tokens of a text are those of its segments in
    order. Prose repeats its segments; the table of answers is bounded: it has two generations, and what
    the younger one does not ask for goes with the older.
    """

    #: Segments in a generation at most. Longer ones are encoded anew each time.
    KEPT, LONG = 250_000, 64
    #: Characters in one call of the library at most, beside the text that passes it; words joined into one
    #: text, such texts in one call.
    CALL_CHARS, JOINED, LISTS = 1 << 17, 500, 8
    #: Control characters that str.split takes for white space and the vocabularies do not.
    ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
    #: All other white space but blank and line feed.
    SPACES = (*"\t\r\x0b\x0c\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))

    #: Of this worker process, by their arguments: tasks that follow find the table filled.
    _loaded: dict[tuple, Segments] = {}

    @classmethod
    def load(cls, path: str, counts: bool, blanks: bool) -> Segments:
        """A segment's value is a byte array: its ids as little-endian unsigned 32-bit numbers, or with
        ``counts`` a byte for each."""
        key = (path, counts, blanks)
        if key not in cls._loaded:
            cls._loaded[key] = cls(path, counts, blanks)
        return cls._loaded[key]

    def __init__(self, path: str, counts: bool, blanks: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.counts, self.blanks, self.known = Tokenizer.from_file(path), counts, blanks, _Table({})
        suffix = None if blanks else self.tokenizer.model.end_of_word_suffix
        self.ends = None
        if suffix:  # ids that end a word
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True

    # With blanks, a key that starts with one stands for the rest of it, any other key for itself after a blank.
    def text_of(self, key: str) -> str:
        return key if not self.blanks else key[1:] if key[:1] == " " else " " + key

    @staticmethod
    def key_of(segment: str) -> str:
        return segment[1:] if segment[:1] == " " and segment[1:2] not in ("", " ") else " " + segment

    def cut(self, text: str) -> list[str]:
        """Keys of the segments in order."""
        odd = any(c in text for c in self.ODD)
        if not self.blanks:
            if odd:
                return [text]
            # no special token whose case matters, no combining mark
            return (text.lower() if "<|" not in text and latin(text) else text).split()
        parts = text.split(" ")
        if not (odd or "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in self.SPACES)):
            parts[0] = " " + parts[0]
            return parts
        out = [parts[0]]
        for p in parts[1:]:
            if p and not p[0].isspace() and out[-1] and not out[-1][-1].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return [self.key_of(x) for x in out]

    def encode(self, keys: list[str]) -> None:
        """Fills the answers of ``keys``."""
        known, ends = self.known, self.ends
        stops = []
        if ends is not None:
            stops = [k for k in keys if k[-1:] in (".", ",") and k[-2:-1].isalnum() and latin(k)]
            for k in stops:
                known[k[:-1]], known[k[-1]]  # asks for the word and the stop
            done = set(stops)
            keys = [k for k in keys if k not in done] + known.pending
            known.pending = []
            # words of letters only are one pre-token each: many in one text, told apart by their last ids
            words = [k for k in keys if k.isalpha() and latin(k)]
            keys = [k for k in keys if not (k.isalpha() and latin(k))]
            for at in range(0, len(words), self.JOINED * self.LISTS):  # few at a time: an answer of the library is large
                lists = [words[a : a + self.JOINED] for a in range(at, min(at + self.JOINED * self.LISTS, len(words)), self.JOINED)]
                for some, e in zip(lists, self.tokenizer.encode_batch_fast([" ".join(x) for x in lists], add_special_tokens=False)):
                    ids = np.array(e.ids, "<u4")
                    end = np.flatnonzero(ends[ids]) + 1
                    if len(end) != len(some):
                        keys += some
                        continue
                    raw, size = (bytes(len(ids)), 1) if self.counts else (ids.tobytes(), 4)
                    cuts = (size * end).tolist()
                    for w, a, b in zip(some, [0, *cuts], cuts):
                        known[w][:] = raw[a:b]
        call, size = [], 0
        for k in [*keys, None]:
            if call and (k is None or size + len(k) > self.CALL_CHARS):
                for x, e in zip(call, self.tokenizer.encode_batch_fast([self.text_of(x) for x in call], add_special_tokens=False)):
                    known[x][:] = bytes(len(e)) if self.counts else np.array(e.ids, "<u4").tobytes()
                call, size = [], 0
            if k is not None:
                call.append(k)
                size += len(k)
        for k in stops:
            known[k][:] = known[k[:-1]] + known[k[-1]]

    def of(self, texts: list[str]) -> list[list[bytearray]]:
        """For every text, the values of its segments in order."""
        known = self.known
        get = known.__getitem__
        collecting = gc.isenabled()
        gc.disable()  # many lists and no cycles
        try:
            out = [list(map(get, self.cut(t))) for t in texts]
            missing, known.pending = known.pending, []
            self.encode(missing)
        finally:
            if collecting:
                gc.enable()
        for k in missing:
            if len(k) > self.LONG:
                del known[k]
        if len(known) > self.KEPT:
            known.older = {}
            self.known = _Table(known)
        return out


def latin(text: str) -> bool:
    """Whether all characters are below 256."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True

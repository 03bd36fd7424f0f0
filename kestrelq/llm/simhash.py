"""SimHash near duplicates: fingerprints of 64 bits, joined through Golay codes.

1. Every text gets a fingerprint, the bitwise majority of its shingles' hashes. Equal fingerprints become one node.
2. A fingerprint is cut into three segments of 21 or 22 bits, each read as a word of the perfect Golay code of
   length 23. Its nearest codeword is at distance 3 at most; its *options* are the codewords within distance 4, one or
   six of them. Of two words that differ in one bit at most, the nearest codeword of one is an option of the other.
3. Pigeonhole: of three differing bits at most, two segments hold one each or none. So for each pair of segments a
   fingerprint is stored once, under its nearest codewords, and asks for all pairs of its options: no link is missed.
   With very many fingerprints longer keys are taken (``DEEP``): either all segments hold one differing bit at most,
   or one holds none and another one at most.
4. Keys are joined by a shuffle. Those that can be hot are found by a histogram of fixed size and dealt into blocks
   on both sides. A task compares fingerprints exactly, and returns an edge from each linked one to the smallest that
   it is connected with there, never all pairs.
5. Connected components of these edges give the classes.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelq.llm.common import LOWER, arrow_map, body, quoted, released, written
from kestrelq.llm.ngram_join import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: First bit and number of bits of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Ways to make a key: the segments taken by their codeword, and those taken as they are.
SHALLOW = (((0, 1), ()), ((0, 2), ()), ((1, 2), ()))
DEEP = (((0, 1, 2), ()), *(((j,), (i,)) for i in range(3) for j in range(3) if i != j))
#: Fingerprints above which keys of 24 bits would meet too many others.
MANY = 1 << 26
#: Bits of a key's bin, and rows of a bin above which its keys are dealt into blocks of that many.
BIN_BITS, BLOCK = 16, 4096
#: Bytes of text that are split into words at once; pairs that are compared at once; fingerprints whose keys are made at once.
CHUNK, PAIRS, SOME = 1 << 20, 1 << 20, 2048

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class Golay:
    """The binary Golay code of length 23: 12 message bits above 11 check bits. Every word is within distance 3 of
    exactly one codeword; one at distance 3 has five more at distance 4."""

    GENERATOR = 0b110001110101

    def __init__(self):
        syndrome = [1 << i for i in range(11)]
        for _ in range(12):  # of the message bits: the remainder of x^i
            r = syndrome[-1] << 1
            syndrome.append(r ^ self.GENERATOR if r >> 11 else r)
        high = np.zeros(1 << 12, np.int32)
        for i in range(12):
            high[1 << i : 2 << i] = high[: 1 << i] ^ syndrome[11 + i]
        self.high = high
        # of every syndrome: the error of the nearest codeword, then the errors of weight 4, where there are any
        self.errors = np.full((1 << 11, 6), -1, np.int32)
        filled = np.zeros(1 << 11, np.int64)
        for weight in range(5):
            for bits in itertools.combinations(range(23), weight):
                s = 0
                for b in bits:
                    s ^= syndrome[b]
                if weight < 4 or filled[s] >= 1 and self.errors[s, 0].bit_count() == 3:
                    self.errors[s, filled[s]] = sum(1 << b for b in bits)
                    filled[s] += 1

    def options(self, words: np.ndarray) -> np.ndarray:
        """Message bits of the codewords within distance 4, the nearest first; -1 where there are fewer than six."""
        errors = self.errors[self.high[words >> 11] ^ (words & 0x7FF)]
        return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11).astype(np.int64)


def keys(fps: np.ndarray, ways, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which fingerprints are stored, (rows, ways), and for which they ask, (rows, many) with -1 for none."""
    segments = [((fps >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    options = [golay.options(s) for s in segments]
    stored, asked = [], []
    for number, (coded, plain) in enumerate(ways):
        own = np.full(len(fps), number, np.int64)
        for k in plain:
            own = own << 22 | segments[k]
        many, ok = own[:, None], np.ones((len(fps), 1), bool)
        for k in coded:
            many = (many[:, :, None] << 12 | np.maximum(options[k], 0)[:, None, :]).reshape(len(fps), -1)
            ok = (ok[:, :, None] & (options[k] >= 0)[:, None, :]).reshape(len(fps), -1)
        stored.append(many[:, 0])
        asked.append(np.where(ok, many, -1))
    return np.stack(stored, 1), np.concatenate(asked, 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def bins(key: np.ndarray) -> np.ndarray:
    return (mixed(key) >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def split(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, folded, in lists of about CHUNK bytes."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > CHUNK and (m := _SPACE.search(text, at + CHUNK)):
            end = m.start()
        yield text[at:end].translate(LOWER).split()
        at = end


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """64-bit hashes of the word shingles, repeats included, in parts. Fewer words than a shingle are one."""
    import xxhash

    digest, last, none = xxhash.xxh64_intdigest, [], True
    for words in split(text):
        words = last + words
        if len(words) < SHINGLE:
            last = words
            continue
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size + 1) - size - 1
        plain = b" ".join(words)
        ends = (start + size)[SHINGLE - 1 :].tolist()
        yield np.array([digest(plain[a:b], SEED) for a, b in zip(start.tolist(), ends)], np.uint64)
        none, last = False, words[1 - SHINGLE :]
    if none and last:
        yield np.array([digest(b" ".join(last), SEED)], np.uint64)


def majority(parts: Iterator[np.ndarray]) -> int:
    """Bits that more than half of the hashes have; 0 without any."""
    total, n = np.zeros(64, np.int64), 0
    for h in parts:
        for a in range(0, len(h), 1 << 14):
            some = h[a : a + (1 << 14)].astype("<u8", copy=False)
            total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint as a signed long) per row of ``docs``. A null text has no word, so fingerprint 0;
    long texts are read whole, in parts."""
    rows = docs.select(quoted(id_col).alias("id"), body(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(b: pa.RecordBatch):
        fps = np.array([majority(shingle_hashes(t)) for t in b["text"].to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b["id"], pa.array(fps.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(arrow_map(run, "text"), f"id {kind}, fp long")


def some_at_a_time(batches) -> Iterator[np.ndarray]:
    for b in batches:
        fps = np.asarray(b["fp"]).view(np.uint64)
        for a in range(0, len(fps), SOME):
            yield fps[a : a + SOME]


def joined_in_task(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the edges (u, v): every node but the smallest of its component, and that smallest one."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, label = ends[: len(u)], ends[len(u) :], np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    away = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[away], nodes[label[away]]


def linked(batches) -> Iterator[pa.RecordBatch]:
    """Edges from rows in order of key, block and side: stored rows of a group (side 0) come before those that ask
    (side 1), so only a block of stored ones is kept from one batch to the next."""
    kept = None
    for b in batches:
        if not b.num_rows:
            continue
        group = np.stack((np.asarray(b["key"]), np.asarray(b["part"]).astype(np.int64)), 1)
        side, fp = np.asarray(b["side"]), np.asarray(b["fp"])
        if kept is not None:
            group, side, fp = np.concatenate((kept[0], group)), np.concatenate((np.zeros(len(kept[1]), side.dtype), side)), np.concatenate((kept[1], fp))
        change = np.concatenate(([True], (group[1:] != group[:-1]).any(axis=1)))
        start = np.flatnonzero(change)
        number = np.cumsum(change) - 1
        stored = np.add.reduceat((side == 0).astype(np.int64), start)
        ask = np.flatnonzero(side == 1)
        n = stored[number[ask]]
        ask, n = ask[n > 0], n[n > 0]
        upto = np.cumsum(n)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        a = 0
        while a < len(ask):
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
            m = n[a:z]
            first = np.cumsum(m) - m
            i = np.repeat(start[number[ask[a:z]]] - first, m) + np.arange(int(m.sum()))
            x, y = fp[i], np.repeat(fp[ask[a:z]], m)
            ok = (np.bitwise_count((x ^ y).view(np.uint64)) <= DISTANCE) & (x != y)
            if ok.any():
                found.append(joined_in_task(x[ok], y[ok]))
            a = z
        if found:
            u, v = joined_in_task(*(np.concatenate(c) for c in zip(*found)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        last = slice(int(start[-1]), int(start[-1] + stored[-1]))
        kept = group[last], fp[last]


def edges(distinct: DataFrame, ways, block: int = BLOCK) -> DataFrame:
    """(u, v): links between the fingerprints in column ``fp``, reduced to forests; the same components."""
    spark = distinct.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    only = distinct.select("fp").repartition(n)  # small rows that become many: spread over all tasks

    def counted(batches):
        golay, total = Golay(), np.zeros((2, 1 << BIN_BITS), np.int64)
        for fps in some_at_a_time(batches):
            stored, asked = keys(fps, ways, golay)
            total[0] += np.bincount(bins(stored.ravel()), minlength=1 << BIN_BITS)
            total[1] += np.bincount(bins(asked[asked >= 0]), minlength=1 << BIN_BITS)
        some = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], ["bin", "stored", "asked"])

    # 2^BIN_BITS rows at most
    histogram = only.mapInArrow(counted, "bin long, stored long, asked long").groupBy("bin").agg(F.sum("stored").alias("stored"), F.sum("asked").alias("asked")).toPandas()
    blocks = np.ones((2, 1 << BIN_BITS), np.int32)
    for k, c in enumerate(("stored", "asked")):
        most = max(block, 4 * int(histogram[c].sum()) >> BIN_BITS)
        blocks[k, histogram["bin"]] = np.minimum(-(-histogram[c] // most), 1 << 15)
    shared = spark.sparkContext.broadcast(blocks)

    def dealt(batches):
        golay, blocks = Golay(), shared.value
        for fps in some_at_a_time(batches):
            place = (mixed(fps ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(33)).astype(np.int64)
            stored, asked = keys(fps, ways, golay)
            for side, key in enumerate((stored, asked)):
                row, column = np.nonzero(key >= 0)
                key = key[row, column]
                bin_of = bins(key)
                own, other = blocks[side, bin_of].astype(np.int64), blocks[1 - side, bin_of].astype(np.int64)
                mine = place[row] % own
                if other.max(initial=1) > 1:  # a copy for each block of the other side
                    at = np.repeat(np.arange(len(key)), other)
                    theirs = np.arange(len(at)) - np.repeat(np.cumsum(other) - other, other)
                    row, key, mine = row[at], key[at], mine[at]
                else:
                    theirs = np.zeros(len(key), np.int64)
                part = (mine << 15 | theirs) if side == 0 else (theirs << 15 | mine)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part.astype(np.int32)), pa.array(np.full(len(key), side, np.int8)), pa.array(fps[row].view(np.int64))], ["key", "part", "side", "fp"])

    rows = only.mapInArrow(dealt, "key long, part int, side byte, fp long")
    return rows.repartition(n, "key", "part").sortWithinPartitions("key", "part", "side").mapInArrow(linked, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z folded, three a shingle; a bit of the fingerprint is set if more than
    half of the shingles' hashes have it. Fingerprints link at three differing bits or fewer; component_id is the
    smallest id that links reach. A null text and one without words have fingerprint 0, which links like any other.
    A repeated row is a copy of the other; null ids get a row each and count only where a component has no other id. Long
    texts are read whole; an empty table has no row; other columns are not read.

    A key's m fingerprints cost time in m^2 / 2 comparisons of numbers, dealt over tasks, and rows in m^2 / BLOCK.
    """
    rows = written(fingerprints(docs, id_col, text_col), "simhash-rows")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    linked_pairs = written(edges(distinct, DEEP if distinct.count() > many else SHALLOW), "simhash-edges")
    labels = components(linked_pairs)
    # written, so that the joins below are plain shuffles and a large component or group of copies can be split
    nodes = written(distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "simhash-nodes")
    released(linked_pairs, distinct)
    smallest = written(nodes.groupBy("label").agg(F.min("first").alias("component_id")), "simhash-smallest")
    info = written(nodes.join(smallest, "label").select("fp", "component_id"), "simhash-components")
    released(nodes, smallest)
    return rows.join(info, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

1. Texts with equal words become one representative with a number of copies.
2. Every representative gets HASHES MinHash values of its word shingles, and keys of a few values each (4 at
   similarity 0.8, ``rows_for``). Representatives that share a key are candidates: at similarity 0.8 a pair shares
   none with probability (1 - 0.8^4)^30 < 2e-7.
3. The members of a key are dealt into blocks, and pairs of blocks into tasks, so that a key of m members makes
   about m^1.5 / 2 rows at most; memory is bounded by a block's size. A task compares
   the values of its pairs a few hashes at a time and drops a pair when the posterior probability of
   reaching the threshold falls below TOLERANCE. A pair belongs to the first key it shares, so it is judged
   once. What leaves the task are members that have a surviving pair, never pairs.
4. The same tasks, with the surviving members' words, compute exact similarities, and return per member its
   number of links and an edge to the smallest member it is connected with there.
5. Connected components of these edges give classes.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from kestrelq.llm.common import WORDS, arrow_map, body, free_name, one_thread, quoted, released, written

SHINGLE, THRESHOLD = 5, 0.8
HASHES = 120
#: Probability at which a pair at the threshold may share no key.
MISSED = 1e-6
#: Hashes compared between two looks at the posterior, and the probability at which a pair is dropped.
LOOK, TOLERANCE = 20, 1e-6
#: Members of a block: this many, or SPREAD times the root of the key's members if that is more; at most so many.
BLOCK_MEMBERS, SPREAD, BLOCK_LARGEST = 64, 2, 8192
#: Members on either side of the pairs that are compared at once.
TILE = 512
#: Shingles of a block at most (a longer text is a block's own excess).
BLOCK_SHINGLES = 400_000

_rng = np.random.default_rng(20240917)
_MULTIPLY = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * 2 + 1)[:, None]
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
_PLACE = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rows_for(threshold: float) -> int:
    """Values in a key: the most of 4, 3, 2, 1 with which a pair at the threshold shares a key but for MISSED."""
    for rows in (4, 3, 2, 1):
        if (1 - threshold**rows) ** (HASHES // rows) < MISSED:
            return rows
    raise ValueError(f"threshold {threshold} is too low for {HASHES} MinHash values")


class WordHashes(dict):
    """64-bit hashes of words; remembers the first ones it meets, a bounded number."""

    KEPT = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) < self.KEPT and len(word) <= 64:
            self[word] = h
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """64-bit hashes of the word shingles, repeats included; fewer words than a shingle are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        h = np.concatenate((h, np.zeros(SHINGLE - len(h), np.uint64)))
    out = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        out += h[k : k + len(out)] * _PLACE[k]
    return mixed(out)


def signature(shingle_hashes: np.ndarray) -> np.ndarray:
    """MinHash values, the low 16 bits of each."""
    h = (shingle_hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(h), 2048):
        np.minimum(best, (_MULTIPLY * h[a : a + 2048] + _ADD).min(axis=1), out=best)
    return best.astype(np.uint16)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One key for every ``rows`` values, their place in it."""
    x = ((sig.astype(np.uint64) + np.uint64(1)) * _BAND).reshape(-1, rows).sum(axis=1, dtype=np.uint64)
    return mixed(x).view(np.int64)


@lru_cache
def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Matches of ``n`` hashes below which P(similarity >= threshold) < tolerance, from a uniform prior:
    the posterior is Beta(m + 1, n - m + 1), whose upper tail is P(Binomial(n + 1, threshold) <= m)."""
    total, m = 0.0, -1
    while total < tolerance:
        m += 1
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
    return m


def surviving(sigs: np.ndarray, i: np.ndarray, j: np.ndarray, band: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Numbers of the pairs (i, j) whose first common key is of ``band`` and which no look has dropped."""
    left, matches = np.arange(len(i)), np.zeros(len(i), np.int64)
    for n in range(LOOK, HASHES + 1, LOOK):
        equal = sigs[i[left], n - LOOK : n] == sigs[j[left], n - LOOK : n]
        matches = matches + equal.sum(axis=1)
        ok = matches >= least_matches(n, threshold)
        left, matches = left[ok], matches[ok]
        if not len(left):
            return left
    first, rows = np.empty(len(left), np.int64), rows_for(threshold)
    for a in range(0, len(left), 1 << 16):
        part = left[a : a + (1 << 16)]
        first[a : a + (1 << 16)] = (sigs[i[part]] == sigs[j[part]]).reshape(-1, HASHES // rows, rows).all(axis=2).argmax(axis=1)
    return left[first == band[left]]


def prepared(docs: DataFrame, text_col: str, keep: list[str], band_rows: int) -> tuple[DataFrame, list[str]]:
    """``keep`` columns of ``docs``, and as columns of the returned names rid (a number per row), fp (digest of the words, null without any),
    n_sh, sig, bands, body (compressed words). Written, so that rid is fixed."""
    text = free_name(docs, "words_text")
    rows = docs.select(*(quoted(c) for c in keep), body(text_col).alias(text))
    schema = StructType([docs.schema[c] for c in keep])
    own = [free_name(docs, c) for c in ("rid", "fp", "n_sh", "sig", "bands", "body")]
    for name, kind in zip(own, (LongType(), BinaryType(), LongType(), BinaryType(), ArrayType(LongType()), BinaryType())):
        schema = schema.add(name, kind)

    def run(batches):
        import xxhash
        import zstandard
        from pyspark import TaskContext

        hashes, press = WordHashes(), zstandard.ZstdCompressor(level=1)
        count = TaskContext.get().partitionId() << 36

        def part(b: pa.RecordBatch):
            nonlocal count
            cols: list[list] = [[] for _ in own]
            for t in b[text].to_pylist():
                words = t.translate(WORDS).split()
                plain = b" ".join(words)
                h = shingles(words, hashes)
                sig = signature(h)
                values = (count, xxhash.xxh3_128_digest(plain), len(h), sig.tobytes(), band_keys(sig, band_rows), press.compress(plain)) if words else (count, None, 0, None, None, None)
                for c, v in zip(cols, values):
                    c.append(v)
                count += 1
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *(pa.array(c, k) for c, k in zip(cols, kinds))], [*keep, *own])

        yield from arrow_map(part, text)(batches)

    return written(rows.mapInArrow(run, schema), "ngram-rows"), own


def grouped(batches, keys: tuple[str, ...]):
    """Record batches regrouped so that each holds whole groups of consecutive equal keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([np.asarray(b[c]) for c in keys], 1)
        last = int(np.flatnonzero((k != k[-1]).any(axis=1))[-1]) + 1 if (k != k[-1]).any() else 0
        if held:
            same = tuple(held[-1][c][-1].as_py() for c in keys) == tuple(k[0].tolist())
            if last == 0 and same:
                held.append(b)
                continue
            if not same:
                yield pa.Table.from_batches(held)
                held = []
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def candidate_pairs(key, x, y, block):
    """Index arrays (i, j) of the pairs in consecutive groups: within a block, or across the two."""
    n = len(key)
    cut = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
    for a, b in zip([0, *cut], [*cut, n]):
        if b - a == 2 and x[a] == y[a]:
            yield np.array([a]), np.array([a + 1])
            continue
        one = np.flatnonzero(block[a:b] == x[a]) + a
        two = np.flatnonzero(block[a:b] == y[a]) + a
        for c in range(0, len(one), TILE):  # tiles, so that a large block's pairs are never all in memory
            for d in range(c if x[a] == y[a] else 0, len(two), TILE):
                i, j = one[c : c + TILE], two[d : d + TILE]
                i, j = np.repeat(i, len(j)), np.tile(j, len(i))
                if x[a] == y[a] and c == d:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield i, j


def batched_pairs(groups, limit: int = 1 << 17):
    """Pairs of several groups together, about ``limit`` at a time."""
    i, j, size = [], [], 0
    for a, b in groups:
        i.append(a)
        j.append(b)
        size += len(a)
        if size >= limit:
            yield np.concatenate(i), np.concatenate(j)
            i, j, size = [], [], 0
    if i:
        yield np.concatenate(i), np.concatenate(j)


TASK = ("key", "x", "y")


def sigs_of(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, HASHES)


def pruned(threshold: float):
    """Members of tasks that have a surviving pair."""

    def run(batches):
        for t in grouped(batches, TASK):
            key, x, y, block, band = (np.asarray(t[c]) for c in (*TASK, "block", "band"))
            sigs, alive = sigs_of(t), np.zeros(len(key), bool)
            for i, j in batched_pairs(candidate_pairs(key, x, y, block)):
                s = surviving(sigs, i, j, band[i], threshold)
                alive[i[s]] = True
                alive[j[s]] = True
            t = t.select(["rid", "n_sh", "copies", "sig", "key", "band", "block", "x", "y"]).filter(pa.array(alive))
            yield from t.combine_chunks().to_batches()

    return run


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs; many pairs of few sets by products of incidence matrices."""
    used = np.unique(np.concatenate((i, j)))
    if len(i) <= 3 * len(used):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    at = np.zeros(len(sets), np.int64)
    at[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    values, inverse, counts = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    owner, column = owner[keep], shared[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(used), len(used)), np.float32)
    width = 4096
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        m = np.zeros((len(used), width), np.float32)
        m[owner[a:b], column[a:b] - k * width] = 1
        total += m @ m.T
    return total[at[i], at[j]].astype(np.int64)


def verified(threshold: float):
    """Per member of a task with links there: rid, root (smallest member connected with it), links to
    other texts, and to documents (a text counts once per copy)."""

    def run(batches):
        import zstandard

        one_thread()
        hashes, press = WordHashes(), zstandard.ZstdDecompressor()
        for t in grouped(batches, TASK):
            key, x, y, block, band, rid, copies = (np.asarray(t[c]) for c in (*TASK, "block", "band", "rid", "copies"))
            sigs, bodies = sigs_of(t), t["body"]
            n = len(key)
            texts, docs, parent = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)

            def root(k):
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            for i, j in candidate_pairs(key, x, y, block):
                s = surviving(sigs, i, j, band[i], threshold)
                if not len(s):
                    continue
                i, j = i[s], j[s]
                used = np.unique(np.concatenate((i, j)))
                at = dict(zip(used.tolist(), range(len(used))))
                sets = [np.unique(shingles(press.decompress(bodies[int(k)].as_py()).split(b" "), hashes)) for k in used]
                a, b = np.array([at[k] for k in i.tolist()]), np.array([at[k] for k in j.tolist()])
                size = np.array([len(x) for x in sets])
                both = overlaps(sets, a, b)
                ok = both >= threshold * (size[a] + size[b] - both) - 1e-9
                i, j = i[ok], j[ok]
                np.add.at(texts, i, 1)
                np.add.at(texts, j, 1)
                np.add.at(docs, i, copies[j])
                np.add.at(docs, j, copies[i])
                for p, q in zip(i.tolist(), j.tolist()):
                    p, q = root(p), root(q)
                    if p != q:
                        if rid[p] < rid[q]:
                            parent[q] = p
                        else:
                            parent[p] = q
            has = np.flatnonzero(texts)
            roots = rid[[root(int(k)) for k in has]] if len(has) else rid[:0]
            yield pa.RecordBatch.from_arrays([pa.array(rid[has]), pa.array(roots), pa.array(texts[has]), pa.array(docs[has])], ["rid", "root", "texts", "docs"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes with an edge but the labels themselves; label: the smallest node of the
    component. edges: columns u, v. Alternating large-star and small-star rounds, each written; so are the
    nodes' minima, so that the join that gives them back can split a node with very many edges."""
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        old = e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        e = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e = written(e, "edges")
        released(old, low)
        old, low = e, written(e.groupBy("u").agg(F.min("v").alias("m")), "minima")
        e = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = written(e, "edges")
        released(old, low)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``keep`` columns (the id by default), class_id, n_links, n_text_links,
    n_copies, first_of_class.

    Two texts are linked if the Jaccard similarity of their shingle sets is at least ``threshold``; words are
    the lower-case [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, five a shingle, a shorter text is one shingle. Equal
    words are copies. n_links: other documents linked with this one, copies included; n_text_links: other
    texts linked; class_id: the smallest id connected by links (nulls last). A text that is null or has no
    word has no links and is a class of its own. Repeated rows are copies; the first row of a class is that
    with the smallest id, then the earliest. Very long texts are compared whole; an empty table has no row; columns
    of ``docs`` with the names of added ones stay, and the added ones get free names. A ``threshold`` below 0.8 takes
    shorter keys; one too low for HASHES values raises ValueError.

    A key of m different texts costs m^1.5 / 2 rows of shuffle and time in m^2, as the exact number of links of m
    texts that are all alike is that of their pairs.
    """
    keep = [id_col] if keep is None else keep
    rows, own = prepared(docs, text_col, keep, rows_for(threshold))
    rid, fp, n_sh, sig, bands, words = own
    base = rows.select(quoted(rid).alias("rid"), quoted(fp).alias("fp"), quoted(id_col).alias("id"))
    multiple = base.where("fp IS NOT NULL").groupBy("fp").agg(F.min("rid").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    multiple = written(multiple, "ngram-copies")  # so that the join can split a large group of copies
    members = written(base.join(multiple, "fp", "left").select("rid", "id", F.coalesce("rep", "rid").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")), "ngram-members")
    reps = members.where("rid = rep").select("rid", "copies")

    data = rows.where(quoted(fp).isNotNull()).select(quoted(rid).alias("rid"), quoted(n_sh).alias("n_sh"), quoted(bands).alias("bands"))
    keyed = written(data.join(reps, "rid").select("rid", "n_sh", "copies", F.posexplode("bands").alias("band", "key")), "ngram-keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("m"), F.sum("n_sh").alias("total")).where("m > 1")
    size = F.least(F.greatest(F.lit(BLOCK_MEMBERS), SPREAD * F.sqrt("m")), F.lit(BLOCK_LARGEST))
    blocks = F.greatest(F.ceil(F.col("m") / size), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    dealt = keyed.join(shared, "key").select("rid", "n_sh", "copies", "band", "key", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("rid", "key"), F.col("blocks")).cast("int"))
    sigs = rows.where(quoted(fp).isNotNull()).select(quoted(rid).alias("rid"), quoted(sig).alias("sig"))
    dealt = written(dealt, "ngram-dealt")
    released(keyed)
    tasks = dealt.join(sigs, "rid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select("rid", "n_sh", "copies", "sig", "key", "band", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "rid long, n_sh long, copies long, sig binary, key long, band int, block int, x int, y int"
    alive = written(tasks.repartition(n, *TASK).sortWithinPartitions(*TASK).mapInArrow(pruned(threshold), schema), "ngram-alive")
    released(dealt)

    bodies = rows.where(quoted(fp).isNotNull()).select(quoted(rid).alias("rid"), quoted(words).alias("body"))
    linked = alive.join(bodies, "rid").repartition(n, *TASK).sortWithinPartitions(*TASK).mapInArrow(verified(threshold), "rid long, root long, texts long, docs long")
    linked = written(linked, "ngram-links")
    released(alive)

    labels = components(linked.select(F.col("rid").alias("u"), F.col("root").alias("v")))
    counts = linked.groupBy("rid").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    # one row per linked representative, written so that the join with the members can split a large group
    info = written(counts.join(labels.withColumnRenamed("node", "rid"), "rid", "left").withColumnRenamed("rid", "rep"), "ngram-linked")
    released(linked)
    out = members.join(info, "rep", "left")
    out = out.withColumn("label", F.coalesce("label", "rep"))
    out = written(out, "ngram-classes")
    released(info, multiple)
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("rid"))
    first = out.groupBy("label").agg(F.min(order).alias("first"))
    # written, so that both sides of the join below are plain shuffles and a large class can be split
    first = written(first, "ngram-firsts").select("label", F.col("first.id").alias("class_id"), F.col("first.rid").alias("first_rid"))
    out = out.join(first, "label").select(
        "rid",
        "class_id",
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_text_links"),
        F.col("copies").alias("n_copies"),
        (F.col("rid") == F.col("first_rid")).alias("first_of_class"),
    )
    if keep == [id_col]:
        ids = members.select("rid", F.col("id").alias(id_col))
        return ids.join(out, "rid").drop("rid")
    added = {c: free_name(docs, c) for c in ("class_id", "n_links", "n_text_links", "n_copies", "first_of_class")}
    out = out.select(F.col("rid").alias(rid), *(F.col(c).alias(a) for c, a in added.items()))
    return rows.select(*(quoted(c) for c in keep), quoted(rid)).join(out, rid).drop(rid)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class of near duplicates: that with the smallest id. All columns stay."""
    names = list(docs.columns)
    out = near_duplicates(docs, id_col, text_col, threshold, keep=names)
    first = next(c for c in out.columns if c not in names and c.startswith("first_of_class"))
    return out.where(quoted(first)).select(*(quoted(c) for c in names))

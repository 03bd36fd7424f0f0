"""Benchmark decontamination by a generalised suffix automaton over the test items' words.

The automaton accepts exactly the word runs that occur in some item, and its states carry the items: a state knows
which items hold the window of n words that its strings end with, and which short items are one of its strings. A
document's words are streamed through it; state and longest matching length tell, at each position, the windows
that end there and whose they are. A filter on word pairs, computed for whole documents at once, skips the stretches
that can hold no window: every window of w words needs w - 1 consecutive pairs that stand in items. The filter
drops no match.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from kestrelq.llm.common import WORDS, arrow_map, body, free_name, quoted, written

#: Bytes of item text in one automaton (about 250 bytes of memory each). More items are dealt into shards with an
#: automaton each; only the stretches of documents that pass the pair filter of all items meet these.
SHARD_BYTES = 1 << 20


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class SuffixAutomaton:
    """Online construction over several sequences; ``link`` and ``length`` are the usual suffix links and
    longest lengths of the states."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:  # known already from an earlier item
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            cur, p = self._new(self.length[last] + 1, {}, 0), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = cur

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        """The state and the longest matching length after one more word."""
        while state and c not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        q = self.next[state].get(c)
        return (0, 0) if q is None else (q, matched + 1)


class PairFilter:
    """Vocabulary, word pairs and window sizes of items."""

    def __init__(self, n: int):
        self.n, self.vocabulary, self.lengths = n, {}, set()
        self.pairs = np.empty(0, np.int64)

    def add(self, texts: list[bytes]) -> list[list[int]]:
        """Numbers of the words of each item."""
        out, pairs = [], set()
        for text in texts:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            out.append(ids)
            if ids:
                self.lengths.add(min(self.n, len(ids)))
                pairs.update(a << 32 | b for a, b in zip(ids, ids[1:]))
        self.pairs = np.union1d(self.pairs, np.fromiter(pairs, np.int64, len(pairs)))
        return out

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        """Numbers of a document's words; -1 is unknown."""
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches [a, b) in which every pair is known, of as many words as the smallest window at least."""
        least = min(self.lengths, default=0)
        if not least or len(ids) < least:
            return []
        if least == 1:
            ok = ids >= 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
            return list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        code = ids[at] << 32 | ids[at + 1]
        where = np.searchsorted(self.pairs, code)
        where[where == len(self.pairs)] = 0
        at = at[self.pairs[where] == code] if len(self.pairs) else at[:0]
        if not len(at):
            return []
        cut = np.flatnonzero(np.diff(at) > 1) + 1
        return [(int(r[0]), int(r[-1]) + 2) for r in np.split(at, cut) if len(r) + 1 >= least]


class Matcher:
    """Windows of ``n`` words of every item (the whole item where it is shorter), found in documents."""

    #: Of this worker process: the latest matchers by name, so that tasks that follow need not build them.
    _built: dict[str, Matcher] = {}

    @classmethod
    def load(cls, key: str, items: list[tuple[str, bytes]], n: int) -> Matcher:
        if key not in cls._built:
            if len(cls._built) >= 2:
                cls._built.clear()
            cls._built[key] = cls(items, n)
        return cls._built[key]

    def __init__(self, items: list[tuple[str, bytes]], n: int = 10):
        self.n, self.filter, self.auto = n, PairFilter(n), SuffixAutomaton()
        numbered = self.filter.add([text for _, text in items])
        for ids in numbered:
            self.auto.add(ids)
        link, length = self.auto.link, self.auto.length
        #: Of every state: itself or the nearest state up its links that holds strings of n words.
        self.window_state = [-1] * len(link)
        order = sorted(range(1, len(link)), key=length.__getitem__)
        for s in order:
            if length[s] >= n:
                self.window_state[s] = s if length[link[s]] < n else self.window_state[link[s]]
        self.windows: dict[int, set] = {}  # items with the window of n words that the state holds
        self.whole: dict[int, dict[int, set]] = {}  # shorter items that are a string of the state, by size
        for (name, _), ids in zip(items, numbered):
            state = matched = 0
            for c in ids:
                state, matched = self.auto.step(state, matched, c)
                if matched >= n:
                    self.windows.setdefault(self.window_state[state], set()).add(name)
            if 0 < len(ids) < n:
                self.whole.setdefault(state, {}).setdefault(len(ids), set()).add(name)
        #: Of every state: itself or the nearest state up its links with short items, 0 for none.
        self.short_state = [0] * len(link)
        for s in order:
            self.short_state[s] = s if s in self.whole else self.short_state[link[s]]

    def ending(self, state: int, matched: int):
        """(size, items) of the windows that end where the automaton is in ``state`` after ``matched`` words."""
        if matched >= self.n:
            yield self.n, self.windows[self.window_state[state]]
        s = self.short_state[state]
        while s:
            for size, items in self.whole[s].items():
                if size <= matched:
                    yield size, items
            s = self.short_state[self.auto.link[s]]

    def match(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of words inside occurring windows, and the items these come from."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        ids = self.filter.ids(tokens)
        for a, b in self.filter.runs(ids):
            state = matched = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                state, matched = self.auto.step(state, matched, c)
                for size, items in self.ending(state, matched):
                    found |= items
                    start = i - size
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, found


def scan(docs: DataFrame, benchmark: DataFrame, n: int, text_col: str, item_id: str, item_text: str, finish, schema: str) -> DataFrame:
    """``finish(batch, tokens, spans, items)`` over ``docs`` once every item has been looked for.

    tokens: words of each text; spans: its merged hit spans; items: ids of the items found, as strings. Items in
    one automaton take one pass over the documents. With more, the documents are read and written once, with the
    stretches that pass the filter of all items (8 bytes a distinct pair, and the vocabulary, are broadcast); the
    stretches alone meet the automata, and a join brings the hits back.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(quoted(item_id).cast("string"), F.lit("")).alias("id"), body(item_text).alias("text")).distinct()
    shards = 1 + (items.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_BYTES
    names, pairs, held, run_id = list(docs.columns), PairFilter(n), [], uuid.uuid4().hex
    for k in range(shards):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k).collect()  # SHARD_BYTES, give or take an item
        part = sorted((r["id"], bytes(r["text"])) for r in part)
        if shards > 1:
            pairs.add([text for _, text in part])
        held.append(spark.sparkContext.broadcast(part))

    def tokens_in(b: pa.RecordBatch) -> list[list[bytes]]:
        return [words(t.encode() if isinstance(t, str) else t or b"") for t in b[text_col].to_pylist()]

    if shards == 1:

        def run(batches):
            matcher = Matcher.load(run_id, held[0].value, n)

            def part(b: pa.RecordBatch):
                tokens = tokens_in(b)
                found = [matcher.match(t) for t in tokens]
                yield finish(b, tokens, [s for s, _ in found], [sorted(f) for _, f in found])

            yield from arrow_map(part, text_col)(batches)

        return docs.mapInArrow(run, schema)

    every = spark.sparkContext.broadcast(pairs)
    row_col, run_col, spans_col, found_col = (free_name(docs, c) for c in ("hit_row", "hit_runs", "hit_spans", "hit_items"))
    kinds = pa.list_(pa.struct([("at", pa.int64()), ("words", pa.binary())]))

    def stretches(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36

        def part(b: pa.RecordBatch):
            nonlocal row
            out = []
            for t in tokens_in(b):
                out.append([{"at": x, "words": b" ".join(t[x:y])} for x, y in every.value.runs(every.value.ids(t))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(row, row + b.num_rows)), pa.array(out, kinds)], [*names, row_col, run_col])
            row += b.num_rows

        yield from arrow_map(part, text_col)(batches)

    run_type = ArrayType(StructType().add("at", LongType()).add("words", BinaryType()))
    with_runs = StructType([*docs.schema.fields]).add(row_col, LongType()).add(run_col, run_type)
    rows = written(docs.mapInArrow(stretches, with_runs), "decontaminate")
    some = rows.where(F.size(quoted(run_col)) > 0).select(quoted(row_col).alias("row"), F.explode(quoted(run_col)).alias("run")).select("row", "run.at", "run.words")

    def one_shard(k: int) -> DataFrame:
        def run(batches):
            matcher = Matcher.load(f"{run_id}-{k}", held[k].value, n)

            def part(b: pa.RecordBatch):
                found = [(row, at, *matcher.match(w.split(b" "))) for row, at, w in zip(*(b[c].to_pylist() for c in ("row", "at", "words")))]
                found = [x for x in found if x[2]]
                spans = [[v + at for s in s1 for v in s] for _, at, s1, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(x[3]) for x in found], pa.list_(pa.string()))], ["row", "spans", "items"])

            yield from arrow_map(part, "words")(batches)

        return some.mapInArrow(run, "row long, spans array<long>, items array<string>")

    hits = functools.reduce(DataFrame.unionByName, map(one_shard, range(shards)))
    hits = hits.groupBy(F.col("row").alias(row_col)).agg(F.flatten(F.collect_list("spans")).alias(spans_col), F.array_distinct(F.flatten(F.collect_list("items"))).alias(found_col))
    together = rows.drop(run_col).join(hits, row_col, "left")

    def last(b: pa.RecordBatch):
        spans = [merged(list(zip(s[::2], s[1::2]))) for s in (x or () for x in b[spans_col].to_pylist())]
        yield finish(b.select(names), tokens_in(b), spans, [sorted(x or ()) for x in b[found_col].to_pylist()])

    return together.mapInArrow(arrow_map(last, text_col), schema)


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated per row of ``docs``.

    A null or empty text (document or item) has no words, an item without words has no window; items
    that repeat count once by id. Item ids sort as strings; a null item id is the empty string. A very long text is
    one row's words in memory. Repeated documents give a row each; an empty table has no row, empty items have no
    hit. Other columns, whatever their names, are not read.
    """
    rows = docs.select(quoted(id_col).alias("id"), body(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def finish(b, tokens, spans, found):
        hit = [covered(s) for s in spans]
        longs = [pa.array(x, pa.int64()) for x in (list(map(len, tokens)), hit, list(map(len, found)))]
        sha = [hashlib.sha256(",".join(f).encode()).hexdigest() for f in found]
        return pa.RecordBatch.from_arrays([b["id"], *longs, pa.array(sha, pa.string()), pa.array([x > 0 for x in hit], pa.bool_())], [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return scan(rows, benchmark, n, "text", item_id, item_text, finish, f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def covered(spans: list[tuple[int, int]]) -> int:
    total, end = 0, -1
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def removed(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans`` and what stands between them; each gap becomes one blank."""
    plain = text.translate(WORDS)
    at, ends, starts = 0, [], []
    for w in plain.split():
        at = plain.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out, last = [], 0
    for a, b in merged(spans):
        out.append(text[last : starts[a]])
        last = ends[b - 1]
    return b" ".join([*(x.strip() for x in out), text[last:].strip()]).strip() if out else text


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, coverage: float = 0.5, text_col: str = "text", count_col: str = "n_chars", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the benchmark's windows: matched spans are cut out of a text, and a document of
    whose words a share above ``coverage`` is matched is dropped. Untouched texts stay as they are; a null
    text stays null. ``count_col``, if the table has it, becomes a changed text's length. All columns stay, whatever
    their names. Texts of any length are handled whole; repeated rows are treated alike; an empty table stays so."""
    names = list(docs.columns)

    def finish(b, tokens, spans, found):
        texts, keep = b[text_col].to_pylist(), [covered(s) <= coverage * len(t) for t, s in zip(tokens, spans)]
        counts = b[count_col].to_pylist() if count_col in names else None
        for i, s in enumerate(spans):
            if s and keep[i]:
                texts[i] = removed(texts[i].encode(), s).decode()
                if counts:
                    counts[i] = len(texts[i])
        new = {text_col: texts} | ({count_col: counts} if counts else {})
        cols = [pa.array(new[c], b[c].type) if c in new else b[c] for c in names]
        return pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep, pa.bool_()))

    return scan(docs, benchmark, n, text_col, item_id, item_text, finish, docs.schema)

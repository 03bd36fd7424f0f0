"""Cross-tokenizer alignment: where the tokens of two vocabularies end together.

A text's token ends are bits at its byte offsets, one set for each vocabulary. The AND of both sets has the shared
cuts; ranks by popcount turn a cut into the number of tokens of either side that end up to it, so neighbouring cuts
give the token ranges of a group, and the last token of each range is linked with the other's.

Texts are cut before single blanks between characters that are not white space. Both vocabularies always break there
(checked for the second one on its pieces), so every such place is a shared cut, a text's groups are those of its
segments in order, and each distinct segment is encoded and aligned once.

Two tokens that end together are each a suffix of the other, or equal. So the id pairs that can be linked are known
from the vocabularies alone (``Pairs``): a token has no more of them than its bytes have suffixes. They are numbered,
documents carry the numbers of their links, and corpus-wide counts are one number for each, however large the corpus.
"""

from __future__ import annotations

import gc
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelq.llm.common import Segments, arrow_map, pieces, quoted, written

#: Characters of a text that are cut into segments at once, beside the segment that passes it.
CHUNK = 1 << 19


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pairs:
    """The vocabularies, their tokens' bytes, and numbers for all id pairs that can end together."""

    _loaded: dict[tuple, Pairs] = {}

    @classmethod
    def load(cls, path_a: str, path_b: str) -> Pairs:
        if (path_a, path_b) not in cls._loaded:
            cls._loaded[path_a, path_b] = cls(path_a, path_b)
        return cls._loaded[path_a, path_b]

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = SentencePieceProcessor(model_file=path_b)
        plain = byte_of_char()
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for w, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = bytes(plain[c] for c in w) if all(c in plain for c in w) else w.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: Whether no piece goes on after a blank, so that a text may be cut there.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        at_a, at_b = {}, {}
        for own, at in ((self.bytes_a, at_a), (self.bytes_b, at_b)):
            for i, w in enumerate(own):
                at.setdefault(w, []).append(i)
        keys = [i << 32 | j for i, w in enumerate(self.bytes_a) for k in range(len(w)) for j in at_b.get(w[k:], ())]
        keys += [i << 32 | j for j, w in enumerate(self.bytes_b) for k in range(1, len(w)) for i in at_a.get(w[k:], ())]
        self.keys = np.unique(np.array(keys, np.int64))
        self.size_a, self.size_b = (np.array([len(w) for w in x], np.int64) for x in (self.bytes_a, self.bytes_b))

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a << 32 | b).astype("<u4")

    def best(self, counts: np.ndarray) -> np.ndarray:
        """Whether a pair's count is the highest of its second id."""
        b = self.keys & 0xFFFFFFFF
        most = np.zeros(len(self.bytes_b), np.int64)
        np.maximum.at(most, b, counts)
        return counts == most[b]


class BitSet:
    """A packed set of byte offsets with ranks."""

    def __init__(self, places: np.ndarray, size: int):
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[places] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)

    def __and__(self, other: BitSet) -> np.ndarray:
        """Places in both sets, in order (select)."""
        return np.flatnonzero(np.unpackbits((self.words & other.words).view(np.uint8), bitorder="little"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Members up to each place, itself included."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        upto = self.words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit))
        return self.before[word] + np.bitwise_count(upto)


def shared_cuts(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets at which tokens of both sides end, and how many tokens of either side end up to each. The sizes
    are those of the tokens in bytes, none of them 0, and add up to the same."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    size = int(end_a[-1]) if len(end_a) else 0
    a, b = BitSet(end_a - 1, size), BitSet(end_b - 1, size)
    places = a & b
    return places + 1, a.rank(places), b.rank(places)


class Aligner:
    """Values of segments: (groups as text, pair numbers, tokens of either side), or None if the tokens of either
    side do not spell it. The table of answers is bounded: it has two generations, and what the younger one does not
    ask for goes with the older."""

    KEPT, LONG, CALL_CHARS = 150_000, 64, 1 << 17
    _loaded: dict[tuple, Aligner] = {}

    @classmethod
    def load(cls, path_a: str, path_b: str) -> Aligner:
        if (path_a, path_b) not in cls._loaded:
            cls._loaded[path_a, path_b] = cls(path_a, path_b)
        return cls._loaded[path_a, path_b]

    def __init__(self, path_a: str, path_b: str):
        self.pairs, self.known, self.cutter = Pairs.load(path_a, path_b), {}, Segments.load(path_a, True, True)
        self.older: dict = {}

    def parts(self, text: str):
        """Stretches of a text, each to be read after a blank; cut like segments are."""
        at = 0
        while at < len(text):
            end = len(text)
            if self.pairs.cuts and end - at > CHUNK:
                p = text.find(" ", at + CHUNK)
                while 0 <= p < len(text) - 1 and (text[p - 1].isspace() or text[p + 1].isspace()):
                    p = text.find(" ", p + 1)
                if 0 < p < len(text) - 1:
                    end = p
            yield text[at:end]
            at = end + 1 if end < len(text) else end

    def segments(self, part: str) -> list[str]:
        """The part after a blank, cut; every segment without the blank that it begins with."""
        if not self.pairs.cuts:
            return [part]
        keys = self.cutter.cut(part)
        # a key that begins with a blank is the rest as it stands, any other one stands after a blank
        first, rest = keys[0], keys[1:]
        return [first[1:] if first[:1] == " " else " " + first, *(k[2:] if k[:1] == " " else k for k in rest)]

    def evaluate(self, segments: list[str]) -> list[tuple | None]:
        """Values of segments, each read after a blank."""
        p = self.pairs
        ids_a = [e.ids for e in p.a.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)]
        ids_b = p.b.encode(segments, num_threads=1)
        ok = []
        for s, a, b in zip(segments, ids_a, ids_b):
            raw = b" " + s.encode()
            ok.append(b"".join([p.bytes_a[i] for i in a]) == raw and b"".join([p.bytes_b[i] for i in b]) == raw)
        out: list[tuple | None] = [None] * len(segments)
        some = [k for k, x in enumerate(ok) if x]
        if not some:
            return out
        a = np.array([i for k in some for i in ids_a[k]], np.int64)
        b = np.array([i for k in some for i in ids_b[k]], np.int64)
        _, upto_a, upto_b = shared_cuts(p.size_a[a], p.size_b[b])
        numbers = p.numbers(a[upto_a - 1], b[upto_b - 1]).tobytes()
        word_a, word_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        x, y = [0, *upto_a.tolist()], [0, *upto_b.tolist()]
        groups = [f"{','.join(word_a[i:j])}|{','.join(word_b[m:n])}" for i, j, m, n in zip(x, x[1:], y, y[1:])]
        g, done = 0, 0
        for k in some:  # a segment's end is a shared cut
            done += len(ids_a[k])
            h = g
            while x[h] < done:
                h += 1
            out[k] = (";".join(groups[g:h]).encode(), numbers[4 * g : 4 * h], len(ids_a[k]), len(ids_b[k]))
            g = h
        return out

    def of(self, segments: list[str]) -> list[tuple | None]:
        known, older = self.known, self.older
        missing = []
        for s in dict.fromkeys(segments):
            if s not in known:
                if s in older:
                    known[s] = older[s]
                else:
                    missing.append(s)
        call, size = [], 0
        for s in [*missing, None]:
            if call and (s is None or size + len(s) > self.CALL_CHARS):
                known.update(zip(call, self.evaluate(call)))
                call, size = [], 0
            if s is not None:
                call.append(s)
                size += len(s)
        out = [known[s] for s in segments]
        for s in missing:
            if len(s) > self.LONG:
                del known[s]
        if len(known) > self.KEPT:
            self.known, self.older = {}, known
        return out

    def align(self, text: str, detail: bool) -> tuple[int, int, str, bytes, str | None]:
        """Tokens of either side, digest of the groups, pair numbers, and the groups if asked for."""
        digest, numbers, groups, n_a, n_b = hashlib.sha256(), [], [], 0, 0
        nothing = (0, 0, "", b"", "" if detail else None)
        for part in self.parts(text):
            values = self.of(self.segments(part))
            if None in values:  # what the tokens spell may still be the whole text
                value = self.evaluate([text])[0]
                if value is None:
                    return nothing
                return value[2], value[3], hashlib.sha256(value[0]).hexdigest(), value[1], value[0].decode() if detail else None
            some = b";".join([v[0] for v in values])
            if numbers:
                digest.update(b";")
            digest.update(some)
            if detail:
                groups.append(some.decode())
            numbers.append(b"".join([v[1] for v in values]))
            n_a += sum([v[2] for v in values])
            n_b += sum([v[3] for v in values])
        if not numbers:
            return nothing
        return n_a, n_b, digest.hexdigest(), b"".join(numbers), ";".join(groups) if detail else None


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row of ``docs`` (and groups, as
    ``a1,a2|b1;a3|b2,b3``, if asked for).

    ``path_a``: a byte-level tokenizers file, which reads a blank and the text; ``path_b``: a sentencepiece model, which
    adds that blank itself. Offsets at which tokens of both end cut them into groups; two tokens that end together are
    linked. An id pair's count is its number of links in all of ``docs``; n_best: links whose count is the highest of
    their second id, ties included; count_sum: counts added up over the links. A null or empty text, or one that either
    side's tokens do not spell (as with U+2581 in it), has no tokens: zeros, and '' for the digest. Long texts are read
    whole, in parts; repeated rows count as often as they stand there; null ids give a row each; other columns are not
    read; an empty table has no row.
    """
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def tokens(b: pa.RecordBatch):
        aligner = Aligner.load(path_a, path_b)
        collecting = gc.isenabled()
        gc.disable()  # many lists and no cycles
        try:
            out = [aligner.align(t, groups) for t in b["text"].to_pylist()]
        finally:
            if collecting:
                gc.enable()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([b["id"], *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], ["id", "n_a", "n_b", "groups_sha256", "links", "groups"])

    table = written(rows.mapInArrow(arrow_map(tokens, "text"), f"id {kind}, n_a long, n_b long, groups_sha256 string, links binary, groups string"), "alignment")

    def counted(batches):
        total = np.zeros(len(Pairs.load(path_a, path_b).keys), np.int64)
        for batch in batches:
            for b in pieces(batch, "links"):
                for raw in b["links"].to_pylist():
                    np.add.at(total, np.frombuffer(raw, "<u4"), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    # a number for each id pair that can be linked; the vocabularies bound them
    found = table.select("links").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs = Pairs.load(path_a, path_b)
    counts = np.zeros(len(pairs.keys), np.int64)
    counts[found["pair"]] = found["n"]
    shared = docs.sparkSession.sparkContext.broadcast((counts, pairs.best(counts)))

    def scored(b: pa.RecordBatch):
        counts, best = shared.value
        links = [np.frombuffer(raw, "<u4") for raw in b["links"].to_pylist()]
        n = pa.array([len(x) for x in links], pa.int64())
        sums = [pa.array([int(of[x].sum()) for x in links], pa.int64()) for of in (best, counts)]
        arrays = [b["id"], b["n_a"], b["n_b"], n, n, *sums, b["groups_sha256"]]
        yield pa.RecordBatch.from_arrays(arrays + [b["groups"]] * groups, [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * groups)

    schema = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return table.mapInArrow(arrow_map(scored, "links"), schema + ", groups string" * groups)

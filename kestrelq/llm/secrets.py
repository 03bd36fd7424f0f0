"""Secret scans: three base patterns, and character Markov models for what has no pattern.

Two models over characters are trained from labelled samples: one of random strings over the alphabets that keys
use, and one of ordinary words and identifiers, the corpus' own among them. Every character of a run of token
characters has a log-likelihood ratio of random against ordinary, given the two before it. Stretches in which
the ratio adds up are found, widened to whole pieces between separators, and taken for secrets if they are long
enough, their mean ratio passes a margin, and a third of them or more are pieces that mix letters and digits as keys do
(``keylike``): slugs, paths, camel case, numbers, times, UUIDs and letters alone are ordinary text.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelq.llm.common import LOWER, arrow_map, body, quoted, released, written

#: Fixed patterns of the base kinds, in the order in which kinds sort at equal starts.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "markov")
WORD_PARTS = (b"password", b"passwd", b"secret", b"token", b"api")

HEX_TABLE = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
TOKEN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN_TABLE = bytes(120 if chr(b) in TOKEN_CHARS else 32 for b in range(256))
CODE = np.full(256, -1, np.int64)
for _i, _c in enumerate(TOKEN_CHARS):
    CODE[ord(_c)] = _i

#: Characters of the shortest stretch that the models take for a secret, the mean ratio a character that it has to
#: pass (natural log), and the fall of the summed ratio at which a stretch has ended.
SHORTEST, MARGIN, DROP = 16, 0.9, 12.0
#: Characters of the longest mixed piece of a key, its letters, and changes between letters and digits, at least.
MIXED, LETTERS, CHANGES = 8, 4, 2
#: Pieces that mix letters and digits in ordinary text: a word and a number, a number and a unit.
NUMBERED = re.compile(rb"[A-Za-z]+[0-9]{1,4}|[0-9]+[A-Za-z]{1,3}")
UUID = re.compile(rb"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
PIECE, CHANGE = re.compile(rb"[A-Za-z0-9]+"), re.compile(rb"(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]")
SWITCH = re.compile(rb"(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")
#: Labelled samples: generated random strings and identifiers; documents and distinct ordinary words from them,
#: at most, those of the smallest hashes.
RANDOM_SAMPLES, ROW_SAMPLES, WORD_SAMPLES = 4000, 4000, 20_000
#: Bits of a hash by whose histogram the smallest ones are found.
BIN_BITS = 16


def long_runs(text: bytes, table: bytes, least: int):
    """Maximal runs of a character set with ``least`` bytes or more."""
    plain, run, at = text.translate(table), b"x" * least, 0
    while (at := plain.find(run, at)) >= 0:
        end = plain.find(b" ", at)
        end = len(plain) if end < 0 else end
        yield at, end
        at = end


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind number) in bytes, by start, then kind."""
    out = []
    if b":" in text or b"=" in text:
        low = text.translate(LOWER)
        if any(w in low for w in WORD_PARTS):
            out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(a, b, 2) for a, b in long_runs(text, HEX_TABLE, 24)]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


class Markov:
    """Transition model of order 2 over the token characters: counts, smoothed by those of order 1, and these by
    those of order 0. ``log[a, b, c]``: of c after a and b; number N stands for the start."""

    N = len(TOKEN_CHARS)

    def __init__(self, samples: list[bytes]):
        n = self.N
        triple = np.zeros((n + 1, n + 1, n))
        for s in samples:
            c = CODE[np.frombuffer(s, np.uint8)]
            c = np.concatenate(([n, n], c[c >= 0]))
            np.add.at(triple, (c[:-2], c[1:-1], c[2:]), 1)
        pair = triple.sum(0)
        single = pair.sum(0) + 0.5
        one = (pair + 5 * single / single.sum()) / (pair.sum(1, keepdims=True) + 5)
        self.log = np.log((triple + 5 * one) / (triple.sum(2, keepdims=True) + 5))


def random_samples(n: int = RANDOM_SAMPLES, seed: int = 11) -> list[bytes]:
    """Labelled 'random': strings over both kinds of base 64, letters and digits, upper case and digits, and hex."""
    rng = random.Random(seed)
    upper, lower, digit = TOKEN_CHARS[:26], TOKEN_CHARS[26:52], TOKEN_CHARS[52:62]
    sets = (upper + lower + digit + "+/", upper + lower + digit + "-_", upper + lower + digit, upper + digit, lower + digit, digit + "abcdef")
    return ["".join(rng.choices(sets[i % len(sets)], k=rng.randint(20, 48))).encode() for i in range(n)]


#: Labelled 'ordinary' forms that the corpus may not show: identifiers as programmers write them.
IDENTIFIER_PARTS = "get set user name value index count file path request response handler manager service config default message string number array table column record buffer thread process event listener factory builder context session update delete insert select create remove version timestamp".split()


def identifier_samples(n: int = 4000, seed: int = 12) -> list[bytes]:
    rng, out = random.Random(seed), []
    for i in range(n):
        parts = rng.choices(IDENTIFIER_PARTS, k=rng.randint(3, 6))
        joined = ("_".join(parts), "-".join(parts), "".join(p.title() for p in parts), "/" + "/".join(parts), "_".join(parts).upper())[i % 5]
        out.append(joined.encode() + (str(rng.randint(0, 99)).encode() if i % 4 == 0 else b""))
    return out + [c.encode() * rng.randint(3, 60) for c in "-=_+/" for _ in range(n // 100)]  # rules across a page


def smallest(df: DataFrame, hash_col: str, n: int) -> F.Column:
    """Condition for ``n`` rows, at most, of the smallest non-negative hashes; all of a bin of hashes or none.
    A histogram is counted, so nothing but its 2^BIN_BITS numbers reaches the driver."""
    bins = df.groupBy(F.shiftright(hash_col, 63 - BIN_BITS).alias("bin")).count().toPandas().sort_values("bin")
    inside = bins["bin"][bins["count"].cumsum() <= n]
    limit = 1 + int(inside.max()) if len(inside) else 0
    return F.shiftright(hash_col, 63 - BIN_BITS) < limit


def ordinary(word: bytes) -> bool:
    """Label of a corpus word: no base span, few digits, and capitals at the start, throughout or few."""
    digits, capitals = sum(48 <= c <= 57 for c in word), sum(65 <= c <= 90 for c in word[1:])
    return digits * 8 <= len(word) and (capitals * 5 <= len(word) or word.isupper()) and not base_spans(word)


def ordinary_samples(docs: DataFrame, text_col: str) -> list[bytes]:
    """Distinct ``ordinary`` words of 5 to 64 token characters, WORD_SAMPLES at most, from ROW_SAMPLES documents at most: those of the smallest hashes. Equal texts are drawn together or not at all."""

    def run(b: pa.RecordBatch):
        import xxhash

        found = {w for text in b["text"].to_pylist() for w in text.translate(keep).split() if 5 <= len(w) <= 64}
        kept = [w for w in found if ordinary(w)]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), pa.array([xxhash.xxh64_intdigest(w) >> 1 for w in kept], pa.int64())], ["w", "h"])

    keep = bytes(c if chr(c) in TOKEN_CHARS else 32 for c in range(256))
    rows = docs.select(body(text_col).alias("text"))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1))
    few = rows.where(smallest(rows, "h", ROW_SAMPLES)).select("text")
    found = written(few.mapInArrow(arrow_map(run, "text"), "w binary, h long").distinct(), "secret-words")
    words = sorted(bytes(r["w"]) for r in found.where(smallest(found, "h", WORD_SAMPLES)).collect())
    released(found)
    return words


def jumbled(piece: bytes) -> bool:
    """Whether letters change their case at two places of five or more: camel case does so at one of three at most."""
    return len(piece) >= MIXED and piece.isalpha() and 5 * len(SWITCH.findall(piece)) >= 2 * (len(piece) - 1)


def keylike(token: bytes) -> list[tuple[int, int]]:
    """Places of the pieces of a stretch that mix letters and digits, or cases, as keys do; none if they are less than a third of
    its letters and digits, or have too few letters or changes between both, or if it is a UUID."""
    if UUID.fullmatch(token):
        return []
    pieces = [m.span() for m in PIECE.finditer(token)]
    jumbles = [(a, b) for a, b in pieces if jumbled(token[a:b])]
    mixed = [(a, b) for a, b in pieces if CHANGE.search(token[a:b]) and not NUMBERED.fullmatch(token[a:b])] + jumbles
    size = sum(b - a for a, b in mixed)
    if max((b - a for a, b in mixed), default=0) < MIXED or 3 * size < sum(b - a for a, b in pieces):
        return []
    if not jumbles and sum(len(CHANGE.findall(token[a:b])) for a, b in mixed) < CHANGES or sum(c > 57 for a, b in mixed for c in token[a:b]) < LETTERS:
        return []
    return mixed


class Scanner:
    def __init__(self, ordinary: list[bytes], margin: float = MARGIN):
        self.gain, self.margin = Markov(random_samples()).log - Markov(ordinary + identifier_samples()).log, margin

    def ratios(self, token: bytes) -> np.ndarray:
        """Log-likelihood ratio of random against ordinary of each character."""
        c = np.concatenate(([Markov.N, Markov.N], CODE[np.frombuffer(token, np.uint8)]))
        return self.gain[c[:-2], c[1:-1], c[2:]]

    def ratio(self, token: bytes) -> float:
        """The mean over the characters."""
        return float(self.ratios(token).mean())

    def stretches(self, token: bytes) -> list[tuple[int, int]]:
        """Parts of a run of token characters that are taken for secrets, in one pass over the run."""
        out: list[tuple[int, int]] = []
        ratios = self.ratios(token)
        total = best = 0.0
        start = end = last = 0

        def close():
            nonlocal last
            a, b = start, end
            while a > last and token[a - 1 : a].isalnum():
                a -= 1
            while b < len(token) and token[b : b + 1].isalnum():
                b += 1
            # pieces at either end that speak for ordinary text go
            cuts = [a, *(x for x in range(a, b) if not token[x : x + 1].isalnum()), b]
            cuts = [x for k, x in enumerate(cuts) if not k or x > cuts[k - 1]]
            while len(cuts) > 1 and ratios[cuts[0] : cuts[1]].mean() <= self.margin / 2:
                del cuts[0]
            while len(cuts) > 1 and ratios[cuts[-2] : cuts[-1]].mean() <= self.margin / 2:
                del cuts[-1]
            a, b = cuts[0], cuts[-1]
            a += a < b and token[a : a + 1] in b"-_="
            if b - a >= SHORTEST and ratios[a:b].mean() > self.margin and (mixed := keylike(token[a:b])):
                if np.concatenate([ratios[a + x : a + y] for x, y in mixed]).mean() > self.margin:
                    out.append((a, b))
                    last = b

        for i, x in enumerate(ratios.tolist(), 1):
            total += x - self.margin / 2
            if total <= 0 or total < best - DROP:
                if best > 0:
                    close()
                total = best = 0.0
                start = end = max(i, last)
            elif total > best:
                best, end = total, i
        if best > 0:
            close()
        return out

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """Base spans, and the stretches between them that the models take for secrets. Bytes; by start, then kind."""
        base = base_spans(text)
        out, k = list(base), 0
        for a, b in long_runs(text, TOKEN_TABLE, SHORTEST):
            while k < len(base) and base[k][1] <= a:
                k += 1
            at, j = a, k
            parts = []
            while j < len(base) and base[j][0] < b:
                parts.append((at, base[j][0]))
                at = max(at, base[j][1])
                j += 1
            for c, d in (*parts, (at, b)):
                if d - c >= SHORTEST:
                    out += [(c + x, c + y, 3) for x, y in self.stretches(text[c:d])]
        return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in code points (UTF-8 bytes that continue a character do not count)."""
    if not spans:
        return []
    starts = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(starts[a]), int(starts[b]), k) for a, b, k in spans]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, n_markov, base_sha256, spans per row of ``docs``.

    A null or empty text has no span (the digest is that of no bytes). Very long texts are scanned whole, in linear
    time. Spans that start at one place stand in the order of KINDS. Repeated rows and null ids give a row each, an
    empty table none; other columns, whatever their names, are not read. The models are fitted once, on a bounded
    sample of the corpus' words (``ordinary_samples``) and generated strings.
    """
    rows = docs.select(quoted(id_col).alias("id"), body(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(ordinary_samples(docs, text_col)))

    def run(batches):
        find_in = scanner.value.spans

        def part(b: pa.RecordBatch):
            out = []
            for text in b["text"].to_pylist():
                spans = code_points(text, find_in(text))
                base = [s for s in spans if s[2] < 3]
                out.append((*(sum(s[2] == k for s in spans) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = [pa.array([r[i] for r in out], pa.int64() if i < 4 else pa.string()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([b["id"], *cols], [id_col, "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

        yield from arrow_map(part, "text")(batches)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def mask(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars", word: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``word``; an assignment keeps its key and loses its value. No
    row is dropped, untouched, empty and null texts stay as they are, ``count_col`` becomes a changed text's length.
    Long texts are scanned whole; repeated rows are treated alike; all columns stay, whatever their names."""
    names = list(docs.columns)
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(ordinary_samples(docs, text_col)))

    def run(batches):
        find_in = scanner.value.spans

        def part(b: pa.RecordBatch):
            texts = b[text_col].to_pylist()
            counts = b[count_col].to_pylist() if count_col in names else None
            for i, t in enumerate(texts):
                if not t:
                    continue
                raw = t.encode()
                if spans := find_in(raw):
                    texts[i] = masked(raw, spans, word.encode()).decode()
                    if counts:
                        counts[i] = len(texts[i])
            new = {text_col: texts} | ({count_col: counts} if counts else {})
            yield pa.RecordBatch.from_arrays([pa.array(new[c], b[c].type) if c in new else b[c] for c in names], names)

        yield from arrow_map(part, text_col)(batches)

    return docs.mapInArrow(run, docs.schema)


def masked(text: bytes, spans: list[tuple[int, int, int]], word: bytes) -> bytes:
    out, last = [], 0
    for a, b, k in spans:
        if k == 0:
            a += ASSIGN.match(text[a:b]).start(2)
        if a < last:  # inside the span before it
            if b > last:
                last = b
            continue
        out += [text[last:a], word]
        last = b
    return b"".join([*out, text[last:]])

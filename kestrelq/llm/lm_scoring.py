"""LM scoring: a log-bilinear neural model trained with noise-contrastive estimation.

Every word that occurs often enough (``threshold``; their number grows with the corpus) has a target vector and a
context vector of its own. The WORDS most frequent ones are classes, the others are members of surface classes
(last letters, punctuation, script), and so is the rest of each class, inside which a rare word has its
add-one share of the counts. With x, y the two words before a position,

    h = C1 v[x] + C2 v[y],   v[x] = r[class of x] + d[x],   d = 0 for the rare rest,
    P(class | h) = softmax of h . q[class] + b[class],   P(member | class, h) = softmax of h . t[member] + u[member],

and a token's probability is P(class) * P(member) * share in the rest, which sums to one over the known words
and an unknown one in each surface class. Normalisers are exact; those of contexts without an own d are looked
up, as there are only SYMBOLS^2 of them.

Training is synchronous: in each of ROUNDS rounds all tasks add up the gradient of one slice of the texts (by a
hash of the row) at common parameters, the cluster sums them, and the driver makes one step. All training texts
are learnt from, once. A sum does not depend on how rows lie in partitions, so neither does the model, but for the
noise samples and rounding. Counts of words outside the HEAD most frequent ones and the own ones never leave the
cluster; they are joined.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from kestrelq.llm.common import LOWER, arrow_map, body, held_out, one_thread, pieces, quoted, written

#: Words with a class of their own, surface classes, words with broadcast counts (of LONG bytes at most).
WORDS, SURFACES, HEAD, LONG = 127, 180, 262_144, 64
SYMBOLS = WORDS + SURFACES
#: An own word's least count, and the same as a share of the square root of the tokens, whichever is more.
OWN, OWN_SHARE = 20, 0.08
#: Dimensions, noise samples a batch of positions, positions a batch, batches whose gradients are added up at once.
DIM, NOISE, BATCH, TOGETHER = 16, 24, 768, 8
#: Synchronous rounds, longest step of a parameter, rounds over which the step grows to it (it falls as a cosine
#: later), memory of the gradient's mean and of its square, size of a summed gradient that counts as evidence.
ROUNDS, STEP, WARM, MEAN, SQUARE, EVIDENCE = 24, 0.4, 4, 0.3, 0.8, 10.0
#: Share of the step for C1 and C2, on which every position pulls; longest move of a row in a round.
SHARED, LONGEST = 0.1, 0.5
#: Tokens of a training task for each row of parameters that it may return, so that sums stay small beside texts.
TOKENS_A_ROW = 32
#: Rows of a page in the files of encoded texts: pages of other slices are passed over when a round reads its own.
PAGE_ROWS = 200
#: Positions whose scores are computed at once.
BLOCK = 1 << 17
#: Numbers whose factors of normalisers a scoring worker holds at most (2.5 KB each); with more, positions compute theirs.
FACTORS = 1 << 15
#: Distinct words that a counting worker holds before it passes them on.
HELD = 150_000

END = b""  # no word is empty
BEGIN = SYMBOLS  # a context only


def key_of(word: bytes) -> bytes:
    """The word, or for a very long one a digest of it behind a byte that UTF-8 never has."""
    if len(word) <= LONG:
        return word
    import hashlib

    return b"\xff" + hashlib.sha256(word).digest()


def surface(word: bytes) -> int:
    """Class of a word by its surface: punctuation at the end, and the last two letters or the script."""
    last = word[-1:]
    if last not in b".,;:!?" or not word:
        end, tail = 0, word[-3:]
    else:
        end, tail = 1 if last == b"," else 2, word[-4:-1]
    each = SURFACES // 3
    return end * each + (tail[0] * 31 + tail[-1] * 7 + len(tail) + 5 * (not tail.isascii())) % each if tail else end * each


class Vocabulary:
    """Head words' counts and classes, and the totals of the surface classes."""

    def __init__(self, head: list[tuple[bytes, int]], totals: dict[int, tuple[int, int]], n: int, v: int):
        self.n, self.v, self._lookup = n, v, None
        words = [w for w, _ in head[:WORDS]]
        if END not in words and any(w == END for w, _ in head):
            words[-1] = END
        self.symbol = {w: i for i, w in enumerate(words)}
        self.words = words
        self.count = dict(head)
        self.totals = np.zeros((SURFACES, 2))
        for s, t in totals.items():
            self.totals[s] = t
        self.others = [w for w, c in head if c >= threshold(n) and w not in self.symbol]
        self.members = np.bincount([surface(w) for w in self.others], [self.count[w] for w in self.others], SURFACES)
        self.share_base = np.log10(self.totals.sum(1) + 1)  # add-one over the class' words and an unknown one

    def lookup(self) -> Lookup:
        """Built once in a worker process, which keeps broadcast objects over its tasks."""
        if self._lookup is None:
            self._lookup = Lookup(self)
        return self._lookup


def threshold(n: int) -> float:
    """Least count of a word with vectors of its own, among ``n`` tokens."""
    return max(OWN, OWN_SHARE * math.sqrt(n))


def tokens_of(text: bytes) -> list[bytes]:
    """Keys of the words in order: the words, or for very long ones their digests."""
    words = text.translate(LOWER).split()
    if max(map(len, words), default=0) > LONG:
        words = list(map(key_of, words))
    return words


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, c): every token of the texts with its count, the end of a text included."""

    def run(batches):
        held: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["w", "c"])

        for b in batches:
            texts = b["text"].to_pylist()
            held[END] += len(texts)
            for t in texts:
                held.update(tokens_of(t))
                if len(held) > HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    rows = docs.select(body(text_col).alias("text"))
    return rows.mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def head_words(counts: DataFrame, own: float = math.inf) -> list[tuple[bytes, int]]:
    """Words by falling count, HEAD at most and all that occur ``own`` times: those of the highest counts that together fit. A histogram of
    counts (exact below 1024, then 64 steps to a doubling) finds the limit, so no task sends more than it has
    of these words. Keys have LONG bytes at most."""
    step = F.when(F.col("c") < 1024, F.col("c")).otherwise(F.floor(F.log2("c") * 64) + 384)
    bins = counts.groupBy(step.cast("long").alias("k")).agg(F.count("*").alias("n"), F.min("c").alias("low")).orderBy(F.desc("k")).collect()
    total, low = 0, None
    for r in bins:
        total += r["n"]
        if total > HEAD:
            break
        low = r["low"]
    low = own if low is None else min(low, own)
    if low == math.inf:
        return []
    return sorted(((bytes(r["w"]), r["c"]) for r in counts.where(F.col("c") >= low).collect()), key=lambda x: (-x[1], x[0]))


def surface_totals(counts: DataFrame, words: set[bytes]) -> dict[int, tuple[int, int]]:
    """Tokens and words of each surface class, over the words without vectors of their own."""
    shared = counts.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        own = shared.value
        total = np.zeros((SURFACES, 2), np.int64)
        for b in batches:
            for w, c in zip(b["w"].to_pylist(), b["c"].to_pylist()):
                if w not in own:
                    total[surface(w)] += (c, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SURFACES)), pa.array(total[:, 0]), pa.array(total[:, 1])], ["s", "c", "v"])

    rows = counts.mapInArrow(run, "s long, c long, v long").groupBy("s").agg(F.sum("c"), F.sum("v")).collect()  # SURFACES rows
    return {r[0]: (r[1], r[2]) for r in rows}


class Lookup:
    """Numbers of words: head words by rank; others have none, and get their surface class one by one. A class
    is its own number, BEGIN follows, and then the own words that are no class."""

    def __init__(self, vocabulary: Vocabulary):
        self.words = pa.array(list(vocabulary.count), pa.binary())
        own = vocabulary.symbol | {w: BEGIN + 1 + i for i, w in enumerate(vocabulary.others)}
        self.known = {w: surface(w) for w in vocabulary.others}
        m = len(vocabulary.others)
        #: Type of a stored number.
        self.kind = np.dtype("<u2" if m + BEGIN + 1 < 1 << 16 else "<u4")
        #: Of every number: its class, and its row among the members and the rests (the one behind them: none).
        self.group = np.array([*range(BEGIN + 1), *(WORDS + self.known[w] for w in vocabulary.others)], np.int64)
        #: Rows of each surface class: its members and its rest.
        self.inner = [np.append(np.flatnonzero(self.group[BEGIN + 1 :] == WORDS + s), m + s) for s in range(SURFACES)]
        self.row = np.concatenate((np.full(WORDS, m + SURFACES), m + np.arange(SURFACES), [m + SURFACES], np.arange(m)))
        self.symbol = np.array([own[w] if w in own else WORDS + surface(w) for w in vocabulary.count], np.int64)
        self.logs = np.log10(np.array(list(vocabulary.count.values()), np.float64) + 1)

    def ranks(self, words: pa.Array) -> np.ndarray:
        """Ranks of the words; -1 without one."""
        found = pa.compute.index_in(words, value_set=self.words)
        return np.asarray(found.fill_null(-1), np.int64)

    def symbols(self, words: pa.Array, ranks: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Numbers of the words, and the words without a rank."""
        rest = np.flatnonzero(ranks < 0)
        tail = words.take(pa.array(rest))
        out = self.symbol[ranks] if len(self.symbol) else np.empty(len(ranks), np.int64)
        if len(rest):
            out[rest] = [WORDS + surface(w) for w in tail.to_pylist()]
        return out, tail


def split_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Keys of the words of all texts in order, each text followed by its end; the number of keys of each."""
    lists = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts.cast(pa.string())))
    words, sizes = lists.flatten().cast(pa.binary()), np.asarray(pa.compute.list_value_length(lists), np.int64)
    lengths = np.asarray(pa.compute.binary_length(words), np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    if not lengths.all():  # blanks at a text's start and end
        words, owner, lengths = words.filter(pa.array(lengths > 0)), owner[lengths > 0], lengths[lengths > 0]
    if len(lengths) and lengths.max() > LONG:
        words = pa.array([key_of(w) for w in words.to_pylist()], pa.binary())
    sizes = np.bincount(owner, minlength=len(texts))
    at = np.arange(len(owner)) + owner  # every text before has an end
    place = np.full(len(owner) + len(texts), len(words))
    place[at] = np.arange(len(words))
    return pa.concat_arrays([words, pa.array([END], pa.binary())]).take(pa.array(place)), sizes + 1


class Model:
    """Parameters as views of one array ``p`` with a row per vector and its bias in the last column: r, q and b,
    c1, c2, then d and t and u of the m own words that are no class (and t, u of the rests)."""

    def __init__(self, p: np.ndarray, m: int):
        self.p, self.m, self._sides, self._factors = p, m, None, None
        ends = np.cumsum([0, SYMBOLS + 1, SYMBOLS, DIM, DIM, m, m + SURFACES])
        self.at = dict(zip(("r", "q", "c1", "c2", "d", "t"), map(slice, ends, ends[1:])))
        self.r, self.q, self.c1, self.c2, self.d, self.t = (p[s, :DIM] for s in self.at.values())
        self.b, self.u = p[self.at["q"], DIM], p[self.at["t"], DIM]

    @staticmethod
    def rows(m: int) -> int:
        return 2 * SYMBOLS + 1 + 2 * DIM + 2 * m + SURFACES

    @classmethod
    def start(cls, unigram: np.ndarray, members: np.ndarray | None = None) -> Model:
        """Close to the unigram, and to the members' shares (even ones without ``members``)."""
        m = 0 if members is None else len(members) - SURFACES
        rng, out = np.random.default_rng(5), cls(np.zeros((cls.rows(m), DIM + 1), np.float32), m)
        out.r[:] = rng.normal(0, 0.3, out.r.shape)
        out.q[:] = rng.normal(0, 0.03, out.q.shape)
        out.c1[:], out.c2[:] = np.eye(DIM), 0.5 * np.eye(DIM)
        out.b[:] = np.log(unigram)
        if members is not None:
            out.t[:] = rng.normal(0, 0.03, out.t.shape)
            out.u[:] = np.log(members / members.sum())
        return out

    def vectors(self, group: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The context vector of every number, by its class and row (m and more: no vector of its own)."""
        own = np.flatnonzero(row < self.m)
        v = self.r[group]
        v[own] += self.d[row[own]]
        return v

    def sides(self, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
        """What every number adds to h as the first and as the second context; there are far fewer numbers than
        positions, so h is one sum of two rows."""
        if self._sides is None:
            v = self.vectors(lookup.group, lookup.row)
            self._sides = v @ self.c1, v @ self.c2
        return self._sides

    def factors(self, lookup: Lookup) -> tuple[np.ndarray, ...]:
        """Of every number as first and as second context: exp of its scores of the classes below their highest, and
        that; a normaliser is then a product of two rows, without an exp for each position and class."""
        if self._factors is None:
            first, second = self.sides(lookup)
            a, z = first @ self.q.T + self.b, second @ self.q.T
            tops = a.max(1), z.max(1)
            self._factors = np.exp(a - tops[0][:, None]), np.exp(z - tops[1][:, None]), *tops
        return self._factors

    def normalisers(self, lookup: Lookup, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log normalisers of the classes after contexts with the numbers x and y, in blocks of bounded size."""
        a, z, top_a, top_z = self.factors(lookup)
        out, size = np.empty(len(x), np.float32), max(1, (1 << 17) // SYMBOLS)
        for k in range(0, len(x), size):
            out[k : k + size] = np.einsum("nd,nd->n", a.take(x[k : k + size], 0), z.take(y[k : k + size], 0))
        far = np.flatnonzero(out < 1e-25)  # near the end of single precision
        with np.errstate(divide="ignore"):
            out = np.log(out) + top_a.take(x) + top_z.take(y)
        if len(far):
            first, second = self.sides(lookup)
            out[far] = log_sums(first[x[far]] + second[y[far]], self.q, self.b)
        return out

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by the first and by the second context (bias in the first), and log normalisers of all
        contexts, from products of matrices; natural logarithms."""
        a = (self.r @ self.c1) @ self.q.T + self.b
        z = (self.r @ self.c2) @ self.q.T
        top_a, top_z = a.max(1, keepdims=True), z.max(1, keepdims=True)
        norm = np.log(np.exp(a - top_a) @ np.exp(z - top_z).T) + top_a + top_z.T
        return a, z, norm


class Noise:
    """Noise targets drawn by a distribution, and the logarithms of how many of each are expected."""

    def __init__(self, share: np.ndarray):
        self.cdf = np.cumsum(share)
        self.log = np.log(share * NOISE).astype(np.float32)

    def drawn(self, rng: np.random.Generator) -> np.ndarray:
        return np.minimum(np.searchsorted(self.cdf, rng.random(NOISE) * self.cdf[-1]), len(self.cdf) - 1)


def contrast(h: np.ndarray, w: np.ndarray, p: np.ndarray, noise: np.ndarray, log_noise: np.ndarray, grad: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The gradient at h (whose last column is 1) of the positions' log-likelihood ratio, where a target w is told
    from NOISE drawn ones by s - log(expected noise); that at the targets' rows of p goes to ``own``, a row for each
    position, that at the drawn ones' to ``grad``."""
    rows, drawn = p.take(w, 0), p.take(noise, 0)
    miss = 1 / (1 + np.exp(np.einsum("nd,nd->n", h, rows) - log_noise.take(w)))
    minus = -drawn
    minus[:, DIM] += log_noise[noise]
    hit = h @ minus.T
    np.exp(hit, out=hit)
    hit += 1
    np.reciprocal(hit, out=hit)
    np.multiply(miss[:, None], h, out=own)
    np.subtract.at(grad, noise, hit.T @ h)
    return miss[:, None] * rows[:, :DIM] - hit @ drawn[:, :DIM]


def add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """out[at] += rows with repeats, by sorted segments. An even number of columns, two added at once as a complex
    number."""
    order = np.argsort(at.astype(np.uint16) if len(out) < 1 << 16 else at, kind="stable")
    s = at[order]
    start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    out[s[start]] += np.add.reduceat(rows.take(order, 0).view(np.complex64), start, axis=0).view(np.float32)


class Gradient:
    """The gradient of many positions at common parameters. What pulls on a number, as target, as member and as either
    context, is summed by number in one pass over the places of a text, and meets the parameters once, in ``total``."""

    TARGET, MEMBER, FIRST, SECOND = (slice(a, b) for a, b in zip((0, DIM + 1, 2 * DIM + 2, 3 * DIM + 2), (DIM + 1, 2 * DIM + 2, 3 * DIM + 2, 4 * DIM + 2)))

    def __init__(self, model: Model, group: np.ndarray, row: np.ndarray, noises: tuple[Noise, Noise]):
        self.model, self.group, self.row, self.noises = model, group, row, noises
        self.v = model.vectors(group, row)
        self.first, self.second = self.v @ model.c1, self.v @ model.c2
        self.grad = Model(np.zeros_like(model.p), model.m)
        self.sums = np.zeros((len(group), 4 * DIM + 2), np.float32)

    def add(self, ids: list[np.ndarray], rng: np.random.Generator) -> None:
        """Adds the positions of several texts, in batches that share their noise."""
        flat, at = places(ids)
        with np.errstate(over="ignore"):  # exp of a very unlikely score: the share is 0
            for a in range(0, len(at), TOGETHER * BATCH):
                self.batches(flat, at[a : a + TOGETHER * BATCH], rng)

    def batches(self, flat: np.ndarray, at: np.ndarray, rng: np.random.Generator) -> None:
        m, grad, (noise, even) = self.model, self.grad, self.noises
        low = at[0] - 2  # the first position's contexts
        pulls = np.zeros((at[-1] + 1 - low, self.sums.shape[1]), np.float32)
        for a in range(0, len(at), BATCH):
            p = at[a : a + BATCH]
            w, p0 = flat.take(p), p - low
            h = np.ones((len(p), DIM + 1), np.float32)
            np.add(self.first.take(flat.take(p - 1), 0), self.second.take(flat.take(p - 2), 0), out=h[:, :DIM])
            own, kinds = np.zeros((len(p), 2 * DIM + 2), np.float32), self.group.take(w)
            g = contrast(h, kinds, m.p[m.at["q"]], noise.drawn(rng), noise.log, grad.p[grad.at["q"]], own[:, self.TARGET])
            i = np.flatnonzero(kinds >= WORDS)
            if m.m and len(i):
                member = np.empty((len(i), DIM + 1), np.float32)
                g[i] += contrast(h.take(i, 0), self.row.take(w.take(i)), m.p[m.at["t"]], even.drawn(rng), even.log, grad.p[grad.at["t"]], member)
                own[i, self.MEMBER] = member
            pulls[p0, : 2 * DIM + 2] = own
            pulls[p0 - 1, self.FIRST] = g
            pulls[p0 - 2, self.SECOND] = g
        add_rows(self.sums, flat[low : at[-1] + 1], pulls)

    def total(self) -> np.ndarray:
        """The gradient at all rows of the parameters."""
        m, grad, sums = self.model, self.grad, self.sums
        target, member = np.flatnonzero(self.group != BEGIN), np.flatnonzero((self.group >= WORDS) & (self.group != BEGIN))
        np.add.at(grad.p[grad.at["q"]], self.group[target], sums[target, self.TARGET])
        if m.m:
            grad.p[grad.at["t"]][self.row[member]] += sums[member, self.MEMBER]  # every member has a row of its own
        g = sums[:, self.FIRST] @ m.c1.T + sums[:, self.SECOND] @ m.c2.T
        np.add.at(grad.r, self.group, g)
        own = np.flatnonzero(self.row < m.m)
        grad.d[self.row[own]] += g[own]
        grad.c1 += self.v.T @ sums[:, self.FIRST]
        grad.c2 += self.v.T @ sums[:, self.SECOND]
        return grad.p


def log_sums(h: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the sum of exp(h . q + b) over the rows of q, in blocks of bounded size."""
    out, size = np.empty(len(h), np.float32), max(1, (1 << 17) // len(q))
    h = np.concatenate((h, np.ones((len(h), 1), np.float32)), 1)
    q = np.concatenate((q, b[:, None]), 1).T.copy()
    ones = np.ones(q.shape[1], np.float32)
    with np.errstate(over="ignore", divide="ignore"):
        for k in range(0, len(h), size):
            s = h[k : k + size] @ q
            np.exp(s, out=s)
            out[k : k + size] = np.log(s @ ones)
    for k in np.flatnonzero(~np.isfinite(out)):  # beyond the range of single precision
        s = (h[k] @ q).astype(np.float64)
        out[k] = s.max() + np.log(np.exp(s - s.max()).sum())
    return out


def places(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of several texts in a row, each behind two of BEGIN, and where their positions stand."""
    pad = np.array([BEGIN, BEGIN])
    flat = np.concatenate([x for t in ids for x in (pad, t)])
    return flat, np.flatnonzero(flat != BEGIN)


def contexts(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, number before, number before that) of all positions of several texts."""
    flat, at = places(ids)
    return flat[at], flat[at - 1], flat[at - 2]


def trained(encoded: DataFrame, lookup: Lookup, unigram: np.ndarray, members: np.ndarray, n: int) -> Model:
    """ROUNDS synchronous steps over the training rows of ``encoded``. A task returns the rows of its gradient that
    are not zero, the cluster adds them up, and one sum of each row reaches the driver."""
    spark, m = encoded.sparkSession, len(members) - SURFACES
    uses = members / members.sum()
    model = Model.start(unigram, uses)
    # half of the members' noise is even, so that a rare one is no rarer as noise than as a target
    fixed = spark.sparkContext.broadcast((lookup.group, lookup.row, unigram, 0.5 * uses + 0.5 / len(uses)))
    width, kind = DIM + 1, lookup.kind
    columns = [f"x{k}" for k in range(width)]
    rows = encoded.where(~F.col("held")).select("slice", "ids")
    # fewer tasks than partitions where a task would return more than it reads, but one for every core at least
    tasks = max(spark.sparkContext.defaultParallelism, int(n / ROUNDS / (TOKENS_A_ROW * Model.rows(m))) + 1)
    mean, square = np.zeros_like(model.p), np.zeros_like(model.p)
    for k in range(ROUNDS):
        begin = spark.sparkContext.broadcast(model.p)

        def run(batches, begin=begin, k=k):
            one_thread()
            now, (group, row, one, two) = Model(begin.value, m), fixed.value
            grad, seen = Gradient(now, group, row, (Noise(one), Noise(two))), 0

            def learn(raw: list[bytes]):
                rng = np.random.default_rng((k, zlib.crc32(raw[0])))  # a retried task draws the same
                grad.add([np.frombuffer(x, kind) for x in raw], rng)

            for b in batches:
                for part in pieces(b, "ids", BLOCK * kind.itemsize):
                    learn(part["ids"].to_pylist())
                    seen += 1
            if seen:
                total = grad.total()
                at = np.flatnonzero(total.any(1))
                for a in range(0, len(at), 8192):
                    x = np.ascontiguousarray(total[at[a : a + 8192]].T)
                    yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 8192]), *map(pa.array, x)], ["i", *columns])

        part = rows.where(F.col("slice") == k).select("ids").coalesce(tasks)
        moves = part.mapInArrow(run, f"i long, {', '.join(f'{c} float' for c in columns)}")
        got = moves.groupBy("i").agg(*(F.sum(c).cast("float").alias(c) for c in columns)).toArrow()
        begin.destroy()
        g = np.zeros_like(model.p)
        if len(got):
            g[np.asarray(got["i"])] = np.stack([np.asarray(got[c]) for c in columns], 1)
        mean += (1 - MEAN) * (g - mean)
        square += (1 - SQUARE) * (g * g - square)
        step = STEP * min(1, (k + 1) / WARM) * (0.05 + 0.95 * (0.5 + 0.5 * math.cos(math.pi * k / ROUNDS)))
        move = step * mean / (1 - MEAN ** (k + 1)) / (np.sqrt(square / (1 - SQUARE ** (k + 1))) + EVIDENCE)
        for c in ("c1", "c2"):
            move[model.at[c]] *= SHARED
        move *= np.minimum(1, LONGEST / np.maximum(np.sqrt((move * move).sum(1, keepdims=True)), 1e-12))
        model = Model(model.p + move.astype(np.float32), m)
    return model


def log_probabilities(m: Model, norm: np.ndarray, lookup: Lookup, numbers: tuple[np.ndarray, ...]) -> np.ndarray:
    """Natural logarithms, at every position, of P(class) * P(member); numbers as from ``contexts``, norm as
    from ``Model.tables``."""
    (w, a, z), dw = (lookup.group.take(i) for i in numbers), lookup.row.take(numbers[0])
    first, second = m.sides(lookup)
    h = first.take(numbers[1], 0) + second.take(numbers[2], 0)
    out = (np.einsum("nd,nd->n", h, m.q.take(w, 0)) + m.b.take(w)).astype(np.float64)
    own = (numbers[1] > BEGIN) | (numbers[2] > BEGIN)
    out[~own] -= norm[a[~own], z[~own]]
    if len(lookup.group) <= FACTORS:
        out[own] -= m.normalisers(lookup, numbers[1][own], numbers[2][own])
    else:
        out[own] -= log_sums(h[own], m.q, m.b)
    order = np.argsort(w.astype(np.int16), kind="stable")
    ends = np.searchsorted(w[order], np.arange(WORDS, SYMBOLS + 1))
    for s, among in enumerate(lookup.inner):
        at = order[ends[s] : ends[s + 1]]
        if len(at) and len(among) > 1:
            here, of = h.take(at, 0), dw.take(at)
            out[at] += np.einsum("nd,nd->n", here, m.t.take(of, 0)) + m.u.take(of) - log_sums(here, m.t[among], m.u[among])
    return out


def score(docs: DataFrame, held: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of ``docs``; rows where
    ``held`` is false are learnt from.

    A null or empty text is its end alone. Repeated rows count as often as they stand there. A very long text is
    scored whole, in blocks of positions; a very long word is told from others by its digest. Words of equal
    counts rank by their bytes. With no training row every token is unknown: the base is log10(1/1) and the model's
    classes are even. An empty table has no row. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).alias("id"), held.alias("held"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("id", "text"), F.lit(ROUNDS)).cast("int"))
    counts = written(word_counts(rows.where(~F.col("held")), "text"), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = head_words(counts, threshold(n))
    plain = Vocabulary(head, {}, n, v)
    own = plain.symbol
    vocabulary = Vocabulary(head, surface_totals(counts, {*own, *plain.others}), n, v)
    lookup = Lookup(vocabulary)
    unigram = np.concatenate(([vocabulary.count[w] for w in vocabulary.words], np.zeros(WORDS - len(own)), vocabulary.totals[:, 0] + vocabulary.members)) + 0.5
    members = np.concatenate(([vocabulary.count[w] for w in vocabulary.others], vocabulary.totals[:, 0])) + 0.5
    encoded = written(encode(rows, vocabulary, lookup.kind), "lm-encoded", **{"parquet.page.row.count.limit": str(PAGE_ROWS)})
    model = trained(encoded, lookup, unigram / unigram.sum(), members, n) if n else Model.start(unigram / unigram.sum(), members)
    lookup.words = None  # not needed any more
    fixed = spark.sparkContext.broadcast((model.p, model.m, model.tables()[2].astype(np.float32), lookup))

    def run(batches):
        p, own, norm, lookup = fixed.value
        m = Model(p, own)

        def part(b: pa.RecordBatch):
            ids = [np.frombuffer(x, lookup.kind) for x in b["ids"].to_pylist()]
            numbers = contexts(ids)
            lm = np.concatenate([log_probabilities(m, norm, lookup, tuple(x[a : a + BLOCK] for x in numbers)) for a in range(0, len(numbers[0]), BLOCK)])
            sums = np.add.reduceat(lm / math.log(10), np.cumsum([0, *map(len, ids[:-1])]))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(sums)], [*kept, "lm"])

        yield from arrow_map(part, "ids")(batches)

    kept = [c for c in encoded.columns if c not in ("ids", "rest", "slice")]
    texts = encoded.drop("rest", "slice")
    schema = StructType([texts.schema[c] for c in kept]).add("lm", DoubleType())
    scored = texts.mapInArrow(run, schema)
    # words outside the head meet their counts on the cluster; an unknown one adds log10(0 + 1)
    logs = F.log10(F.col("c") + 1.0)
    rest = encoded.select("row", F.explode("rest").alias("w")).join(counts, "w").groupBy("row").agg(F.count("*").alias("found"), F.sum(logs).alias("logs"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(rest, "row", "left").select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("known") + zero(F.col("found"))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + zero(F.col("logs"))).alias("base_score"),
        (F.col("lm") + F.col("inside") + zero(F.col("logs"))).alias("score"),
    )


def encode(rows: DataFrame, vocabulary: Vocabulary, number: np.dtype) -> DataFrame:
    """Per text, beside id, held and slice: a number of the row, n_tokens, known words in the head, the head's part
    of the base score, that of the shares in the rests, the tokens' numbers, and the words outside the head."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "held", "slice", "row", "n_tokens", "known", "base", "inside", "ids", "rest"]

    def run(batches):
        from pyspark import TaskContext

        voc = shared.value
        lookup = voc.lookup()
        row = TaskContext.get().partitionId() << 36
        log_v = math.log10(voc.n + voc.v + 1)
        logs = np.append(lookup.logs, 0.0)  # -1: no rank
        own_logs, shares = np.zeros(len(lookup.group)), np.zeros(len(lookup.group))
        own = (lookup.symbol < WORDS) | (lookup.symbol > BEGIN)
        own_logs[lookup.symbol[own]] = lookup.logs[own]
        shares[WORDS:BEGIN] = voc.share_base
        minus = own_logs + shares  # a rare word's share in its class' rest, but for log10(count + 1)

        def part(b: pa.RecordBatch):
            nonlocal row
            words, sizes = split_texts(b["text"])
            ranks = lookup.ranks(words)
            numbers, tail = lookup.symbols(words, ranks)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            unknown = np.add.reduceat((ranks < 0).astype(np.int64), starts)
            head = np.add.reduceat(logs[ranks], starts)
            inside = head - np.add.reduceat(minus[numbers], starts)
            raw = numbers.astype(number)
            ids = [raw[x:y].tobytes() for x, y in zip(starts.tolist(), ends.tolist())]
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(unknown))), pa.int32()), tail)
            longs = [pa.array(np.arange(row, row + b.num_rows)), pa.array(sizes), pa.array(sizes - unknown)]
            yield pa.RecordBatch.from_arrays([b["id"], b["held"], b["slice"], *longs, pa.array(head - sizes * log_v), pa.array(inside), pa.array(ids, pa.binary()), rest], names)
            row += b.num_rows

        yield from arrow_map(part, "text")(batches)

    texts = rows.select("id", "held", "slice", body("text").alias("text"))
    schema = f"id {kind}, held boolean, slice int, row long, n_tokens long, known long, base double, inside double, ids binary, rest array<binary>"
    # in order of the slices, so that a round reads its own pages of the files
    return texts.mapInArrow(run, schema).sortWithinPartitions("slice")


def score_fold(docs: DataFrame, mod: int = 7, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` with the rows held out whose crc32 of the id, as text, has that remainder."""
    return score(docs, held_out(id_col, mod, remainder), id_col, text_col)

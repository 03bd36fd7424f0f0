"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Every word enters as a vector of word inputs (an embedding, and the word's log-odds in the labelled sample)
and character inputs (embeddings and log-odds of its character n-grams, so that unseen words of a known make
count). Windows of WINDOW words overlap by half and cover the whole text; a text's score is that of its
highest window, and training takes a toxic text's highest window as its example.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from kestrelq.llm.common import WORDS, arrow_map, body, free_name, held_out, quoted

#: Words of a window and between window starts; hidden units a direction; embedding widths.
WINDOW, STRIDE, HIDDEN, WORD_DIM, GRAM_DIM = 48, 24, 8, 6, 6
INPUT = WORD_DIM + GRAM_DIM + 3
#: Labelled sample: rows of each label at most, those of the smallest hashes of the id. Their texts are learnt from
#: in all their windows, however long they are.
SAMPLE = 1500
#: Words and character n-grams with embeddings and log-odds, at most: those that tell the labels apart best.
VOCABULARY, GRAMS = 4000, 6000
ROUNDS, STEPS, BATCH, RATE, SEED = 4, 80, 128, 0.01, 3
#: Buckets of hashed character n-grams.
BUCKET_BITS = 21
#: Windows in one forward pass, words that a scoring worker remembers.
CHUNK, KEPT = 2048, 60_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of the byte n-grams (3 to 5) of each word between boundary marks."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.frombuffer(b"<" + b"><".join(words) + b">   ", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.append(np.repeat(np.arange(len(words)), sizes), (-1, -2, -3))
    code, owners, buckets = text.astype(np.uint64), [], []
    for n in range(2, 6):
        code = code[:-1] * np.uint64(257) + text[n - 1 :]
        if n > 2:
            inside = owner[: len(code)] == owner[n - 1 :]
            owners.append(owner[: len(code)][inside])
            buckets.append(((code[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def odds_of(c0, c1, n0: int, n1: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the ``most`` features that tell the labels apart best, and their smoothed log-odds of
    presence in a text; features of fewer than 3 texts are left out."""
    p0, p1 = (c0 + 0.5) / (n0 + 1), (c1 + 0.5) / (n1 + 1)
    odds = np.log(p1 / p0)
    worth = np.where(c0 + c1 >= 3, np.abs(odds) * np.sqrt(p0 + p1), -1)
    best = np.argsort(-worth, kind="stable")[:most]
    best = np.sort(best[worth[best] > 0])
    return best, odds[best].astype(np.float32)


def word_odds_of(texts: list[list[bytes]], labels: np.ndarray) -> tuple[dict[bytes, int], np.ndarray]:
    count = (Counter(), Counter())
    for words, y in zip(texts, labels):
        count[int(y)].update(set(words))
    names = sorted(count[0].keys() | count[1].keys())
    c = np.array([[k[w] for w in names] for k in count], np.float64).reshape(2, -1)
    best, odds = odds_of(c[0], c[1], int((labels == 0).sum()), int((labels == 1).sum()), VOCABULARY)
    return {names[b]: i for i, b in enumerate(best)}, odds


def gram_odds_of(texts: list[list[bytes]], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each bucket, the number of features where it has none, and the features' log-odds."""
    count = np.zeros((2, 1 << BUCKET_BITS), np.int32)
    for words, y in zip(texts, labels):
        count[int(y), np.unique(grams_of(sorted(set(words)))[1])] += 1
    best, odds = odds_of(count[0], count[1], int((labels == 0).sum()), int((labels == 1).sum()), GRAMS)
    number = np.full(1 << BUCKET_BITS, len(best), np.int16)
    number[best] = np.arange(len(best))
    return number, odds


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Features(NamedTuple):
    """Of several words: number of the word, (owner, gram) of its known n-grams, scale of their sum, and fixed
    inputs: log-odds of the word, highest and mean log-odds of its n-grams."""

    number: np.ndarray
    owner: np.ndarray
    gram: np.ndarray
    scale: np.ndarray
    fixed: np.ndarray


class Network:
    """Parameters by name; dir 0 reads forward, dir 1 backward."""

    def __init__(self, words: dict[bytes, int], word_odds: np.ndarray, buckets: np.ndarray, gram_odds: np.ndarray):
        self.words, self.word_odds = words, np.append(word_odds, np.float32(0))
        self.buckets, self.gram_odds = buckets, gram_odds
        rng = np.random.default_rng(SEED)
        rand = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {
            "E": rng.normal(0, 0.1, (len(words) + 1, WORD_DIM)).astype(np.float32),
            "G": rng.normal(0, 0.1, (len(gram_odds), GRAM_DIM)).astype(np.float32),
            "A": rand(2 * HIDDEN, HIDDEN), "a": np.zeros(HIDDEN, np.float32), "v": rand(HIDDEN),
            "o": rand(2 * HIDDEN), "c": np.zeros(1, np.float32),
        }
        for d in (0, 1):
            self.p |= {f"W{d}": rand(INPUT, 3 * HIDDEN), f"U{d}": rand(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def features(self, words: list[bytes]) -> Features:
        owner, bucket = grams_of(words)
        gram = self.buckets[bucket].astype(np.int64)
        known = gram < len(self.gram_odds)
        owner, gram = owner[known], gram[known]
        n, odds = len(words), self.gram_odds[gram]
        count = np.bincount(owner, minlength=n)
        high = np.zeros(n, np.float32)
        np.maximum.at(high, owner, odds)
        mean = np.bincount(owner, odds, n) / np.maximum(count, 1)
        number = np.fromiter((self.words.get(w, len(self.words)) for w in words), np.int64, n)
        fixed = np.stack((self.word_odds[number], high, mean), 1).astype(np.float32) / 3
        return Features(number, owner, gram, (1 / np.sqrt(count + 1)).astype(np.float32), fixed)

    def vectors(self, f: Features) -> np.ndarray:
        e = self.p["E"][f.number] * (f.number < len(self.words))[:, None]
        g = np.stack([np.bincount(f.owner, c[f.gram], len(f.number)) for c in self.p["G"].T], 1) * f.scale[:, None]
        return np.concatenate((e, g, f.fixed), 1).astype(np.float32)

    def run(self, inputs: list[np.ndarray], index: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Probability per window. inputs: gate inputs of the words, by direction; index: (windows, steps)
        word numbers; lengths: words of each window, the first ones."""
        p, (n, steps) = self.p, index.shape
        short = lengths.min() < steps if n else False
        states, saved = [], []
        for d in (0, 1):
            h = np.zeros((n, HIDDEN), np.float32)
            out = np.empty((steps, n, HIDDEN), np.float32)
            memory = []
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                x, u = inputs[d][index[:, t]], h @ p[f"U{d}"]
                zr = x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z, r, uc = zr[:, :HIDDEN], zr[:, HIDDEN:], u[:, 2 * HIDDEN :]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * uc)
                if short:
                    z = z * (t < lengths)[:, None]
                new = h + z * (c - h)
                if keep:
                    memory.append((t, h, z, r, c, uc))
                out[t] = h = new
            states.append(out)
            saved.append(memory)
        s = np.concatenate(states, 2)  # steps, windows, 2 * HIDDEN
        k = np.tanh(s @ p["A"] + p["a"])
        score = k @ p["v"]
        if short:
            score = np.where(np.arange(steps)[:, None] < np.maximum(lengths, 1), score, -1e9)
        w = np.exp(score - score.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tn,tnh->nh", w, s)
        y = sigmoid(pooled @ p["o"] + p["c"][0])
        return (y, s, k, w, pooled, saved) if keep else y

    def step(self, feats: Features, index: np.ndarray, lengths: np.ndarray, labels: np.ndarray, adam: dict, n_step: int) -> None:
        """One Adam step on the cross-entropy of a batch of windows over the words ``feats``."""
        p, n = self.p, len(labels)
        x = self.vectors(feats)
        y, s, k, w, pooled, saved = self.run([x @ p[f"W{d}"] + p[f"b{d}"] for d in (0, 1)], index, lengths, keep=True)
        grad = {name: np.zeros_like(v) for name, v in p.items()}
        dy = ((y - labels) / n).astype(np.float32)
        grad["o"], grad["c"] = pooled.T @ dy, np.array([dy.sum()], np.float32)
        dpool = dy[:, None] * p["o"]
        ds = w[:, :, None] * dpool
        dw = np.einsum("tnh,nh->tn", s, dpool)
        dscore = w * (dw - (w * dw).sum(0))
        dk = dscore[:, :, None] * p["v"] * (1 - k * k)
        grad["v"] = np.einsum("tn,tnh->h", dscore, k)
        grad["A"], grad["a"] = np.einsum("tni,tnj->ij", s, dk), dk.sum((0, 1))
        ds += dk @ p["A"].T
        dx = np.zeros_like(x)
        for d in (0, 1):
            dh, u = np.zeros((n, HIDDEN), np.float32), p[f"U{d}"]
            dgates = np.zeros((len(x), 3 * HIDDEN), np.float32)
            for t, h, z, r, c, uc in reversed(saved[d]):
                dh = dh + ds[t][:, d * HIDDEN : (d + 1) * HIDDEN]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * z * (1 - z)
                dr = dc * uc * r * (1 - r)
                gates = np.concatenate((dz, dr, dc), 1)
                gu = np.concatenate((dz, dr, dc * r), 1)
                grad[f"U{d}"] += h.T @ gu
                np.add.at(dgates, index[:, t], gates)
                dh = dh * (1 - z) + gu @ u.T
            grad[f"W{d}"], grad[f"b{d}"] = x.T @ dgates, dgates.sum(0)
            dx += dgates @ p[f"W{d}"].T
        np.add.at(grad["E"], feats.number, dx[:, :WORD_DIM])
        grad["E"][len(self.words)] = 0
        dg = dx[:, WORD_DIM : WORD_DIM + GRAM_DIM] * feats.scale[:, None]
        grad["G"] = np.stack([np.bincount(feats.gram, c[feats.owner], len(self.gram_odds)) for c in dg.T], 1).astype(np.float32)
        for name, g in grad.items():
            m, v = adam.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p[name] -= RATE * (m / (1 - 0.9**n_step)) / (np.sqrt(v / (1 - 0.99**n_step)) + 1e-6)


def windows(n: int) -> list[tuple[int, int]]:
    """Starts and ends of the overlapping windows over n words; one window at least, the last ends at n."""
    if n <= WINDOW:
        return [(0, n)]
    starts = [*range(0, n - WINDOW, STRIDE), n - WINDOW]
    return [(a, a + WINDOW) for a in starts]


class Scorer:
    """Scores texts; remembers the gate inputs of a bounded number of words."""

    def __init__(self, net: Network):
        self.net = net
        self.reset()

    def reset(self):
        # number 0 is padding and the word of an empty text
        self.known, self.gates = {b"": 0}, [np.zeros((0, 3 * HIDDEN), np.float32)] * 2
        self.add([b""])

    def add(self, new: list[bytes]):
        x = self.net.vectors(self.net.features(new))
        self.gates = [np.concatenate((g, x @ self.net.p[f"W{d}"] + self.net.p[f"b{d}"])) for d, g in enumerate(self.gates)]

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        """The highest window's probability of each text."""
        wanted: set[bytes] = set()
        for t in texts:
            wanted.update(t)
        if len(self.known) + len(wanted - self.known.keys()) > KEPT:
            self.reset()
        new = sorted(wanted - self.known.keys())
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.add(new)
        get, owner, index, lengths = self.known.__getitem__, [], [], []
        for k, t in enumerate(texts):
            ids = np.fromiter(map(get, t), np.int64, len(t))
            if len(ids) < WINDOW:
                ids = np.concatenate((ids, np.zeros(WINDOW - len(ids), np.int64)))
            w = windows(len(t))
            index.append(np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[[a for a, _ in w]])
            lengths += [b - a for a, b in w]
            owner += [k] * len(w)
        index, lengths, owner = np.concatenate(index), np.array(lengths), np.array(owner)
        y = np.empty(len(index), np.float64)
        order = np.argsort(lengths < WINDOW, kind="stable")  # whole windows first: they need no masks
        for a in range(0, len(order), CHUNK):
            part = order[a : a + CHUNK]
            y[part] = self.net.run(self.gates, index[part], lengths[part])
        out = np.zeros(len(texts))
        np.maximum.at(out, owner, y)
        return out


def fit(texts: list[bytes], labels: list[int]) -> Network | None:
    """The network trained on labelled texts; None without examples of both labels."""
    y = np.array(labels, np.int64)
    if not (y == 0).any() or not (y == 1).any():
        return None
    rng = np.random.default_rng(SEED)
    split = [words_of(t) for t in texts]
    net, adam = Network(*word_odds_of(split, y), *gram_odds_of(split, y)), {}
    names = sorted({w for t in split for w in t})
    evidence = dict(zip(names, np.maximum(net.features(names).fixed, 0).sum(1).tolist()))
    spans = [windows(len(t)) for t in split]
    # a text's window before the first round: the one with the most evidence; later the highest scored one
    chosen = [max(s, key=lambda ab, t=t: sum(sorted((evidence[w] for w in t[ab[0] : ab[1]]), reverse=True)[:3])) for s, t in zip(spans, split)]
    done = 0
    for part in range(ROUNDS):
        if part:
            scorer = Scorer(net)
            for a in range(0, len(split), 128):
                several = [k for k in range(a, min(a + 128, len(split))) if len(spans[k]) > 1]
                parts = scorer.scores([split[k][s:e] for k in several for s, e in spans[k]]) if several else ()
                at = 0
                for k in several:
                    chosen[k] = spans[k][int(parts[at : at + len(spans[k])].argmax())]
                    at += len(spans[k])
        # clean texts: the highest window, and one at random
        examples = [(k, *chosen[k], int(y[k])) for k in range(len(split))]
        order: list[int] = []
        while done < STEPS * (part + 1):
            if not order:
                random = [(k, *spans[k][rng.integers(len(spans[k]))], 0) for k in range(len(split)) if not y[k]]
                pool = examples + random
                order = rng.permutation(len(pool)).tolist()
            batch, order = [pool[i] for i in order[:BATCH]], order[BATCH:]
            number: dict[bytes, int] = {b"": 0}
            index, lengths = np.zeros((len(batch), WINDOW), np.int64), np.zeros(len(batch), np.int64)
            for i, (k, s, e, _) in enumerate(batch):
                ids = [number.setdefault(w, len(number)) for w in split[k][s:e]]
                index[i, : len(ids)], lengths[i] = ids, len(ids)
            done += 1
            net.step(net.features(list(number)), index, lengths, np.array([x[3] for x in batch], np.float32), adam, done)
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, mod: int, remainder: int) -> tuple[list[bytes], list[int]]:
    """At most SAMPLE training rows of each label, with their whole texts. Ids are drawn from the labels alone; the
    texts of these few then come by a join that broadcasts at most twice SAMPLE ids."""
    ids = labels.where(quoted(label_col).isin(0, 1) & quoted(id_col).isNotNull() & ~held_out(id_col, mod, remainder)).groupBy(quoted(id_col).alias("id")).agg(F.max(quoted(label_col)).alias("y"))
    spark, drawn = docs.sparkSession, []
    for y in (0, 1):
        drawn += [(r["id"], y) for r in ids.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    if not drawn:
        return [], []
    few = spark.createDataFrame(drawn, StructType([docs.schema[id_col]]).add("y", IntegerType()))
    rows = docs.select(quoted(id_col), body(text_col).alias("x")).join(F.broadcast(few), id_col)
    got = sorted({(bytes(r["x"]), r["y"]) for r in rows.collect()})
    return [t for t, _ in got], [y for _, y in got]


def scored(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str, text_col: str, label_col: str, mod: int, remainder: int, name: str) -> DataFrame:
    """``keep`` columns of ``docs`` and the score under ``name``."""
    net = docs.sparkSession.sparkContext.broadcast(fit(*labelled_sample(docs, labels, id_col, text_col, label_col, mod, remainder)))
    text = free_name(docs, "score_text")
    rows = docs.select(*(quoted(c) for c in keep), body(text_col).alias(text))

    def run(batches):
        scorer = Scorer(net.value) if net.value else None

        def part(b: pa.RecordBatch):
            texts = [words_of(t) for t in b[text].to_pylist()]
            y = scorer.scores(texts) if scorer else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(y)], [*keep, name])

        yield from arrow_map(part, text)(batches)

    return rows.mapInArrow(run, StructType([docs.schema[c] for c in keep]).add(name, DoubleType()))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", mod: int = 5, remainder: int = 0) -> DataFrame:
    """id, held_out, score, predicted per row of ``docs``; labels of held-out ids are never read.

    A null or empty text is one empty window and has the network's score for it. A very long text is scored in all
    its windows; of windows of equal scores it does not matter which counts. Repeated rows have equal
    scores; an id that is labelled twice counts as toxic if either is. Without training rows of both labels
    every score is 0. An empty table has no row. Only the text enters a score; other columns, whatever their names,
    are not read.
    """
    out = scored(docs, labels, [id_col], id_col, text_col, label_col, mod, remainder, "score")
    return out.select(quoted(id_col), held_out(id_col, mod, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", mod: int = 5, remainder: int = 0) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more; nulls, long texts, repeated rows and an empty table as
    in ``score``. All columns stay, whatever their names."""
    name = free_name(docs, "toxic_score")
    out = scored(docs, labels, list(docs.columns), id_col, text_col, label_col, mod, remainder, name)
    return out.where(quoted(name) < limit).drop(name)

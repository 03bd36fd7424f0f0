"""LM scores and toxicity: exact parts by brute force, models by held-out accuracy and invariants."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kestrelq.llm import lm_scoring as L
from kestrelq.llm import toxicity as T
from tests.llm.conftest import AWKWARD

TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text):
    return [*TOKEN.findall((text or "").encode().translate(FOLD)), b""]


def check_base(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    got = L.score_fold(df).collect()
    assert len(got) == len(rows)
    want = {d: (held(d), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n) for d, t in rows}
    base = {d: sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)) for d, t in rows}
    for r in got:
        if r.doc_id is not None:
            assert tuple(r)[1:5] == want[r.doc_id]
            assert r.base_score == pytest.approx(base[r.doc_id], rel=1e-9, abs=1e-9)
        assert r.score <= 0 and math.isfinite(r.score)
    return got


def test_base(awkward, nothing):
    check_base(awkward)
    assert L.score_fold(nothing).count() == 0


def test_rare_words_meet_their_counts_on_the_cluster(make, monkeypatch):
    monkeypatch.setattr(L, "HEAD", 5)
    rng = random.Random(1)
    check_base(make([" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(80)) for _ in range(40)]))


def test_nothing_to_learn_from(make):
    df = make(["a b", "c"])
    got = L.score(df, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.base_score == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)


def test_probabilities_sum_to_one():
    m = L.Model.start(np.full(L.SYMBOLS, 1 / L.SYMBOLS))
    a, z, norm = m.tables()
    for x, y in ((3, 5), (L.BEGIN, 7), (L.BEGIN, L.BEGIN)):
        assert np.exp(a[x] + z[y] - norm[x, y]).sum() == pytest.approx(1, abs=1e-4)


def test_model_beats_base_on_held_out_texts(make):
    """Two languages that do not mix: context tells which."""
    rng = random.Random(4)
    langs = [[f"{p}{k}" for k in range(40)] for p in ("aa", "bb")]
    texts = [" ".join(rng.choices(langs[i % 2], k=400)) for i in range(1200)]
    got = [r for r in check_base(make(texts).coalesce(1)) if r.held_out]
    n = sum(r.n_tokens for r in got)
    assert sum(r.score - r.base_score for r in got) / n > 0.1


def test_own_words_have_context(make):
    """1200 words of two languages in one surface class: context tells which for every word, not for the most
    frequent ones only."""
    rng = random.Random(6)
    langs = [[f"{p}{k}ing" for k in range(600)] for p in ("aa", "bb")]
    texts = [" ".join(rng.choices(langs[i % 2], k=400)) for i in range(1200)]
    got = [r for r in L.score_fold(make(texts).coalesce(1)).collect() if r.held_out]
    n = sum(r.n_tokens for r in got)
    gain = sum(r.score - r.base_score for r in got) / n
    assert gain > 0.1  # log10(2) = 0.301 at best


def test_probabilities_of_own_words_sum_to_one():
    head = [(f"w{k}{'abc'[k % 3]}".encode(), 1000 - k) for k in range(700)]
    voc = L.Vocabulary(head, {}, 400_000, 700)
    look, rng = L.Lookup(voc), np.random.default_rng(3)
    assert len(voc.others) == 700 - L.WORDS
    m = L.Model.start(np.full(L.SYMBOLS, 1 / L.SYMBOLS), np.ones(len(voc.others) + L.SURFACES))
    m.p[:] += rng.normal(0, 0.3, m.p.shape)
    norm, w = m.tables()[2], np.array([x for x in range(len(look.group)) if x != L.BEGIN])
    for x, y in ((3, 5), (L.BEGIN, L.BEGIN), (L.BEGIN + 9, 7), (L.WORDS + 2, L.BEGIN + 40), (L.BEGIN + 1, L.BEGIN + 2)):
        got = L.log_probabilities(m, norm, look, (w, np.full(len(w), x), np.full(len(w), y)))
        assert np.exp(got).sum() == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("long", ["x" * 80, "y" * 64, "é" * 40])
def test_repeated_long_words_have_probabilities(make, long):
    """A word of more bytes than a key, so frequent that it is a class of its own, and others beside it."""
    texts = [" ".join([long] * 80)] * 60 + [f"{'z' * 70}{k} plain words {k}" for k in range(40)]
    got = check_base(make(texts))
    assert all(r.score <= 0 for r in got)
    mean = [r.score / r.n_tokens for r in got if r.n_tokens == 81]
    assert min(mean) > -0.5  # the model knows the word


def test_distribution_over_all_words_sums_to_one(make):
    """Scores of one-word texts without their ends: all known words and an unknown one in each surface class."""
    rng = random.Random(9)
    texts = [" ".join(f"w{int(rng.paretovariate(0.8))}{rng.choice('abc')}" for _ in range(60)) for _ in range(60)]
    count = Counter(w for t in texts for w in tokens(t))
    head = sorted(count.items(), key=lambda x: (-x[1], x[0]))
    n, v = sum(count.values()), len(count)
    plain = L.Vocabulary(head, {}, n, v)
    own = {*plain.symbol, *plain.others}
    totals = {}
    for w, c in count.items():
        if w not in own:
            t = totals.get(L.surface(w), (0, 0))
            totals[L.surface(w)] = (t[0] + c, t[1] + 1)
    voc = L.Vocabulary(head, totals, n, v)
    look = L.Lookup(voc)
    members = np.concatenate(([voc.count[w] for w in voc.others], voc.totals[:, 0])) + 0.5
    m = L.Model.start(np.full(L.SYMBOLS, 1 / L.SYMBOLS), members)
    m.p[:] += np.random.default_rng(2).normal(0, 0.2, m.p.shape)
    words = [*count, *(None for _ in range(L.SURFACES))]
    known = pa.array(list(count), pa.binary())
    numbers = np.append(look.symbols(known, look.ranks(known))[0], L.WORDS + np.arange(L.SURFACES))
    p = np.exp(L.log_probabilities(m, m.tables()[2], look, (numbers, np.full(len(words), 3), np.full(len(words), L.BEGIN))))
    for k, w in enumerate(words):
        if w not in own:
            p[k] *= ((count[w] if w is not None else 0) + 1) / 10 ** voc.share_base[numbers[k] - L.WORDS]
    # an add-one share over a class' words and an unknown one; classes without an own word are covered as well
    unused = [k for k in range(len(voc.symbol), L.WORDS)]
    p_unused = np.exp(L.log_probabilities(m, m.tables()[2], look, (np.array(unused, np.int64), np.full(len(unused), 3), np.full(len(unused), L.BEGIN)))).sum() if unused else 0.0
    assert p.sum() + p_unused == pytest.approx(1, abs=1e-4)


def test_gradient_is_summed_once_for_many_batches(monkeypatch):
    """Equal to sums position by position, with sums by number taken rarely: they cost most of a training task."""
    head = [(b"%d" % k, 900 - k) for k in range(300)]
    look, rng = L.Lookup(L.Vocabulary(head, {}, 100_000, 300)), np.random.default_rng(3)
    noise = L.Noise(np.ones(L.SYMBOLS) / L.SYMBOLS), L.Noise(np.ones(300 - L.WORDS + L.SURFACES))
    m = L.Model.start(np.full(L.SYMBOLS, 1 / L.SYMBOLS), np.ones(300 - L.WORDS + L.SURFACES))
    m.p += rng.normal(0, 0.3, m.p.shape).astype(np.float32)
    numbers = np.array([x for x in range(len(look.group)) if x != L.BEGIN])
    texts = [rng.choice(numbers, k) for k in (1, 900, 40, 7000)]
    calls, add_rows = [], L.add_rows
    monkeypatch.setattr(L, "add_rows", lambda *x: calls.append(0) or add_rows(*x))
    g = L.Gradient(m, look.group, look.row, noise)
    g.add(texts, np.random.default_rng(1))
    assert len(calls) == 2 and sum(map(len, texts)) > 10 * L.BATCH
    want, draw, (w, x, y) = L.Model(np.zeros(m.p.shape), m.m), np.random.default_rng(1), L.contexts(texts)
    v = m.vectors(look.group, look.row).astype(float)
    for a in range(0, len(w), L.BATCH):
        part = slice(a, a + L.BATCH)
        h = np.concatenate((v[x[part]] @ m.c1 + v[y[part]] @ m.c2, np.ones((len(w[part]), 1))), 1)
        pull = np.zeros((len(h), L.DIM))
        for side, rows, z in (("q", look.group[w[part]], noise[0]), ("t", look.row[w[part]], noise[1])):
            at = np.arange(len(h)) if side == "q" else np.flatnonzero(look.group[w[part]] >= L.WORDS)
            p, grad, drawn, rows = m.p[m.at[side]].astype(float), want.p[want.at[side]], z.drawn(draw), rows[at]
            miss = 1 / (1 + np.exp((h[at] * p[rows]).sum(1) - z.log[rows]))[:, None]
            hit = 1 / (1 + np.exp(z.log[drawn] - h[at] @ p[drawn].T))
            np.add.at(grad, rows, miss * h[at])
            np.add.at(grad, drawn, -hit.T @ h[at])
            pull[at] += miss * p[rows][:, : L.DIM] - hit @ p[drawn][:, : L.DIM]
        for of, c, into in ((x[part], m.c1, want.c1), (y[part], m.c2, want.c2)):
            back, own = pull @ c.T, np.flatnonzero(look.row[of] < m.m)
            np.add.at(want.r, look.group[of], back)
            np.add.at(want.d, look.row[of][own], back[own])
            into += v[of].T @ pull
    assert np.allclose(g.total(), want.p, rtol=1e-3, atol=0.02)


@pytest.mark.parametrize("spread", [0.3, 30.0])
def test_normalisers_are_products_of_rows(monkeypatch, spread):
    """Equal to sums over the classes at each position, far scores too, and in less time."""
    head = [(b"%d" % k, 900 - k) for k in range(300)]
    look, rng = L.Lookup(L.Vocabulary(head, {}, 100_000, 300)), np.random.default_rng(3)
    m = L.Model.start(np.full(L.SYMBOLS, 1 / L.SYMBOLS), np.ones(300 - L.WORDS + L.SURFACES))
    m.q[:] = rng.normal(0, spread, m.q.shape)
    x, y = rng.integers(0, len(look.group), (2, 3000))
    first, second = m.sides(look)
    assert np.allclose(m.normalisers(look, x, y), L.log_sums(first[x] + second[y], m.q, m.b), rtol=1e-5, atol=1e-4)
    sums, log_sums = [], L.log_sums
    monkeypatch.setattr(L, "log_sums", lambda h, q, b: sums.append(len(q)) or log_sums(h, q, b))
    L.log_probabilities(m, m.tables()[2], look, (np.zeros(3000, np.int64), x, y))
    assert spread > 1 or L.SYMBOLS not in sums


def test_split_texts_equals_the_pattern():
    texts = [t for t in AWKWARD if t is not None] + ["\x0b\x0cA\x0dB ", "a" * 65 + " b", "İ É ß"]
    words, sizes = L.split_texts(pa.array([t.encode() for t in texts], pa.binary()))
    want = [[*map(L.key_of, TOKEN.findall(t.encode().translate(FOLD))), b""] for t in texts]
    assert sizes.tolist() == list(map(len, want)) and words.to_pylist() == [w for t in want for w in t]
    assert [[*L.tokens_of(t.encode()), b""] for t in texts] == want


def test_layout_does_not_matter(make):
    """Equal texts in 1, 8 and 200 partitions: the gain on held-out texts differs by less than a tenth."""
    rng = random.Random(14)
    langs = [[f"{p}{k}ing" for k in range(60)] for p in ("aa", "bb")]
    df = make([" ".join(rng.choices(langs[i % 2], k=200)) for i in range(800)])
    gains = []
    for parts in (1, 8, 200):
        got = [r for r in L.score_fold(df.repartition(parts)).collect() if r.held_out]
        gains.append(sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got))
    assert min(gains) > 0.05 and min(gains) > 0.9 * max(gains)


def labelled(seed, n, bad=("nastyfoo", "vilebar", "awfulbaz", "nastyqux")):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "la") for b in ("ran", "tel", "min", "sor", "pul", "k")]
    texts, labels = [], []
    for i in range(n):
        w, y = rng.choices(words, k=rng.choice([5, 60, 200])), i % 4 == 0
        if y:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        labels.append(int(y))
    return texts, labels


def test_windows_cover_everything():
    for n in (0, 1, 47, 48, 49, 72, 73, 500):
        spans = T.windows(n)
        assert {i for a, b in spans for i in range(a, b)} == set(range(n)) and all(b - a <= T.WINDOW for a, b in spans)


def test_gradient_equals_differences():
    texts, labels = labelled(1, 24)
    split = [T.words_of(t.encode()) for t in texts]
    y = np.array(labels)
    net = T.Network(*T.word_odds_of(split, y), *T.gram_odds_of(split, y))
    names = sorted({w for t in split for w in t})[:40]
    f = net.features(names)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    index, lengths, target = rng.integers(0, len(names), (6, 7)), np.array([7, 3, 7, 1, 7, 5]), np.array([1, 0, 1, 0, 0, 1.0])

    def loss():
        x = net.vectors(f)
        p = net.run([x @ net.p[f"W{d}"] + net.p[f"b{d}"] for d in (0, 1)], index, lengths)
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).mean()

    before = {k: v.copy() for k, v in net.p.items()}
    adam = {}
    net.step(f, index, lengths, target, adam, 1)
    net.p = before
    for name in ("U0", "U1", "W0", "W1", "A", "v", "o", "b1"):
        g = adam[name][0] / 0.1
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        eps, old = 1e-3, net.p[name][at]
        net.p[name][at] = old + eps
        up = loss()
        net.p[name][at] = old - eps
        down = loss()
        net.p[name][at] = old
        assert (up - down) / (2 * eps) == pytest.approx(g[at], rel=0.05, abs=2e-4)


def test_toxicity_held_out(make, spark, awkward, nothing):
    texts, labels = labelled(2, 400)
    df = make(texts)
    lab = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = T.score(df, lab).collect()
    assert len(got) == 400
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held)
    assert T.score(awkward, lab).count() == awkward.count() and T.score(nothing, lab).count() == 0
    kept = T.accepted(df, lab)
    assert kept.schema == df.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted == 0}


def test_unseen_word_of_a_known_make(make):
    texts, labels = labelled(3, 400)
    net = T.fit([t.encode() for t in texts], labels)
    y = T.Scorer(net).scores([T.words_of(b"baran cetel nastyzip dimin fosor"), T.words_of(b"baran cetel dimin fosor gupul"), []])
    assert y[0] > y[1] and y[2] < 0.5


def test_one_label_only_scores_zero(make, spark):
    lab = spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic int")
    assert {r.score for r in T.score(make(["a", "b", None]), lab).collect()} == {0.0}


def test_recall_and_precision_with_passages_deep_in_long_texts(spark):
    """Long texts whose only toxic words lie anywhere in them; an answer of zeros has no recall."""
    rng = random.Random(17)
    plain, rude = [f"word{k}" for k in range(400)], [f"vile{k}" for k in range(12)]
    rows, labels = [], []
    for i in range(260):
        toxic, size = i % 3 == 0, 5000 if i % 10 < 2 else rng.randint(20, 300)
        w = rng.choices(plain, k=size)
        if toxic:
            at = rng.randrange(len(w))
            w[at:at] = rng.choices(rude, k=4) + rng.choices(plain, k=2)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    assert sum(len(t) > 30_000 and y for (_, t), (_, y) in zip(rows, labels)) > 10
    got = {r.doc_id: r for r in T.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    found, caught = sum(p for p, _ in held), sum(p and y for p, y in held)
    assert sum(y for _, y in held) > 8 and caught >= 0.9 * sum(y for _, y in held) and caught >= 0.9 * found

"""SimHash: fingerprints and links against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from kestrelq.llm import queries as Q
from kestrelq.llm import simhash as S
from kestrelq.llm.ngram_join import components

FOLD = {c: c + 32 for c in range(65, 91)}
SF = "/root/testdata/sf0.001"


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def classes(fps):
    """Smallest member that links reach, of each fingerprint."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_the_code_is_perfect():
    g, rng = S.Golay(), np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    messages = np.arange(1 << 12)
    # check bits of a message: those that make the syndrome zero
    code = messages << 11 | g.high[messages]
    options = g.options(words)
    for w, o in zip(words.tolist(), options.tolist()):
        near = np.flatnonzero(np.bitwise_count(code ^ w) <= 4)
        assert sorted(x for x in o if x >= 0) == near.tolist()
        assert int(code[o[0]] ^ w).bit_count() == min(int(c ^ w).bit_count() for c in code[near].tolist())
    assert min(int(c).bit_count() for c in code[1:].tolist()) == 7


@pytest.mark.parametrize("ways", [S.SHALLOW, S.DEEP])
def test_every_pair_shares_a_key(ways):
    g, rng = S.Golay(), random.Random(2)
    a, b = [], []
    for _ in range(4000):
        x = rng.getrandbits(64)
        a.append(x)
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            x ^= 1 << bit
        b.append(x)
    stored, _ = S.keys(np.array(a, np.uint64), ways, g)
    _, asked = S.keys(np.array(b, np.uint64), ways, g)
    assert all(set(s) & set(q) for s, q in zip(stored.tolist(), asked.tolist()))


@pytest.mark.parametrize("ways,block", [(S.SHALLOW, 4096), (S.DEEP, 4096), (S.SHALLOW, 40)])
def test_links_against_all_pairs(spark, ways, block):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for f in fps[:60]:
        for _ in range(rng.randint(1, 4)):
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << bit
            fps.append(f)
    base = rng.getrandbits(64)  # a dense group: all pairs share keys
    fps += [base ^ sum(1 << b for b in rng.sample(range(0, 20), rng.randint(0, 4))) for _ in range(400)]
    fps = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    found = S.edges(df, ways, block)
    assert found.count() < 12 * len(fps)
    labels = {r.node: r.label for r in components(found).collect()}
    want = classes([f & (1 << 64) - 1 for f in fps])
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    groups = lambda pairs: sorted(sorted(x for x, y in pairs if y == k) for k in {y for _, y in pairs})
    assert groups([(f, labels.get(f, f)) for f in fps]) == groups([(signed(f), signed(r)) for f, r in want.items()])


def test_long_texts_are_read_in_parts(monkeypatch):
    text = " ".join(f"Wörd{i % 37}" for i in range(500)) + "\x0b tail"
    want = fingerprint(text)
    for chunk in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(S, "CHUNK", chunk)
        assert S.majority(S.shingle_hashes(text.encode())) == want
    assert [S.majority(S.shingle_hashes(t.encode())) for t in ("", " \t", "one", "one two")] == [0, 0, fingerprint("one"), fingerprint("one two")]


def test_awkward_rows(spark, awkward, nothing):
    rows = awkward.collect()
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(awkward).collect()), key=str)
    root = classes([fingerprint(r.text) for r in rows])
    first = {}
    for r in rows:
        k = root[fingerprint(r.text)]
        first[k] = min((x for x in (first.get(k), r.doc_id) if x is not None), default=None)
    want = [(r.doc_id, f"{fingerprint(r.text):016x}", first[root[fingerprint(r.text)]]) for r in rows]
    assert got == sorted(want, key=str)
    assert S.near_duplicates(nothing).collect() == []


def test_long_keys_give_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(S.near_duplicates(docs, many=0).collect()) == sorted(S.near_duplicates(docs).collect())


def test_op13(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {d: fingerprint(t) for d, t in docs.items()}
    root, first = classes(fps.values()), {}
    for d, f in fps.items():
        first[root[f]] = min(d, first.get(root[f], d))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.QUERIES["op13_simhash_near_dedup"](spark, SF).collect()}
    assert got == {d: (f"{f:016x}", first[root[f]]) for d, f in fps.items()}
    assert any(c != d for d, (_, c) in got.items())

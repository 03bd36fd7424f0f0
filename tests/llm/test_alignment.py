"""Alignment against tokens of whole texts and plain loops."""

import hashlib
import random
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from kestrelq.llm import alignment as A
from kestrelq.llm import queries as Q

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ONE, TWO = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
ONE.encode_special_tokens = True
PLAIN = A.byte_of_char()


def aligned(text):
    """Ids of either side and groups as lists of ids; nothing if the tokens do not spell the text."""
    if not text:
        return [], [], []
    e, b = ONE.encode(" " + text, add_special_tokens=False), TWO.encode(text)
    raw_a = [bytes(PLAIN[c] for c in w) for w in e.tokens]
    pieces = [TWO.id_to_piece(i) for i in b]
    raw_b = [bytes([int(p[3:5], 16)]) if TWO.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
    whole = (" " + text).encode()
    if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
        return [], [], []
    groups, ends = [], []
    for side, ids, raw in ((0, e.ids, raw_a), (1, b, raw_b)):
        ends.append(list(zip(np.cumsum([len(x) for x in raw]).tolist(), ids)))
    shared = sorted({p for p, _ in ends[0]} & {p for p, _ in ends[1]})
    last, first = 0, lambda x: x[0]
    for p in shared:
        groups.append(tuple([i for _, i in side[bisect_right(side, last, key=first) : bisect_right(side, p, key=first)]] for side in ends))
        last = p
    return e.ids, b, groups


def brute(docs):
    """docs: list of (id, text), ids not unique."""
    found = [(d, *aligned(t)) for d, t in docs]
    count = Counter((x[-1], y[-1]) for *_, groups in found for x, y in groups)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for d, a, b, groups in found:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((d, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


def test_op12(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = rows(Q.QUERIES["op12_token_alignment"](spark, SF))
    assert got == brute(docs) and sum(r[3] for r in got) > 1000


def test_awkward_rows(spark, awkward, nothing):
    assert rows(A.align(awkward, *PATHS)) == brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert A.align(nothing, *PATHS).collect() == []


def test_groups_come_back(spark, make):
    got = A.align(make(["unbelievable tokenisation, naïve café", "a▁b", None]), *PATHS, groups=True).orderBy("doc_id").collect()
    assert hashlib.sha256(got[0].groups.encode()).hexdigest() == got[0].groups_sha256
    assert [(r.groups, r.groups_sha256, r.n_a) for r in got[1:]] == [("", "", 0)] * 2


TEXTS = ["", " ", "  ", "a ", " a", "a▁ b", "▁", "<|endoftext|> x<|endoftext|>", "<s> a </s>", "<0x41> b", "tab\tand\r\nline", "\x1c x", "a\x00b", "東京 タワー", "é x", "ﬁ ²", "a b  c", "x" * 3000 + " y", "don't 5.5 -- 'tis"]


@pytest.mark.parametrize("chunk", [1, 9, 1 << 19])
def test_texts_in_parts(monkeypatch, chunk):
    monkeypatch.setattr(A, "CHUNK", chunk)
    aligner = A.Aligner(*PATHS)
    for t in TEXTS + [" ".join(random.Random(4).choices(TEXTS, k=200))]:
        a, b, groups = aligned(t)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert aligner.align(t, True)[:2] == (len(a), len(b)) and aligner.align(t, True)[4] == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "é", "日本", "🙂", ".", "'s", "12", "\t", " ", "Z", "<s>", "▁"]), max_size=14).map("".join))
def test_any_text(text):
    a, b, groups = aligned(text)
    got = A.Aligner.load(*PATHS).align(text, True)
    assert got[:2] == (len(a), len(b)) and got[4] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def test_ranks():
    rng = np.random.default_rng(9)
    for size in (1, 63, 64, 65, 1000):
        x, y = (np.flatnonzero(rng.random(size) < 0.4) for _ in range(2))
        both = A.BitSet(x, size) & A.BitSet(y, size)
        assert both.tolist() == sorted(set(x.tolist()) & set(y.tolist()))
        places = np.arange(size)
        assert A.BitSet(x, size).rank(places).tolist() == [(x <= p).sum() for p in places]


def test_pairs_that_can_be_linked_are_few():
    p = A.Pairs.load(*PATHS)
    assert len(p.keys) <= 2 * sum(map(len, p.bytes_a)) + sum(map(len, p.bytes_b))
    for k in random.Random(5).sample(p.keys.tolist(), 500):
        x, y = p.bytes_a[k >> 32], p.bytes_b[k & 0xFFFFFFFF]
        assert x.endswith(y) or y.endswith(x)

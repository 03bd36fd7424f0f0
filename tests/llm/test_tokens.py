"""Token counts and packing against the library on whole texts."""

import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kestrelq.llm import packing, token_counts
from kestrelq.llm.common import Segments

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


tokenizer = functools.cache(Tokenizer.from_file)


def ids(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


def test_counts(awkward, nothing):
    got = token_counts.count_tokens(awkward, BYTES).collect()
    assert len(got) == awkward.count()
    want = {r.doc_id: (len((r.text or "").encode()), len(ids(BYTES, r.text))) for r in awkward.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (*want[r.doc_id], want[r.doc_id][1] > 1024)
    assert token_counts.count_tokens(nothing, BYTES).count() == 0


PARTS = st.lists(st.sampled_from(["the", "The", "dog.", "dog,", "a..", ".", ",", " ", "  ", "\n", "\t", "\x1c", " ", " ", "é", "É.", "Σ", "ΑΣ", "İ", "é", "́", "H̱", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "n't", "5.", "½.", "_.", "a_", "🙂", "東京", "x" * 70, "x1"]), max_size=12)


@settings(max_examples=400, deadline=None)
@given(PARTS, st.sampled_from(["", " "]))
@pytest.mark.parametrize("path, blanks", [(BYTES, True), (WORDS, False)])
def test_segments_equal_the_library(path, blanks, parts, glue):
    text = glue.join(parts)
    want = ids(path, text)
    assert sum(map(len, Segments.load(path, True, blanks).of([text])[0])) == len(want)
    got = np.frombuffer(b"".join(Segments.load(path, False, blanks).of([text])[0]), "<u4").tolist()
    assert got == want


def check_pieces(df, texts):
    """Every id in one piece, sequences gapless, only the last one short."""
    by, seq, wholes = defaultdict(list), defaultdict(list), {}
    for r in df.collect():
        if r.doc_id not in wholes:
            wholes[r.doc_id] = [*ids(WORDS, texts[r.doc_id]), 1]
        whole = wholes[r.doc_id]
        piece = np.array(whole[r.start : r.start + r.length], "<u4").tobytes()
        assert r.doc_tokens == len(whole) and zlib.crc32(piece) == r.ids_crc32
        by[r.doc_id].append((r.start, r.length, len(whole)))
        seq[r.sequence_id].append((r.offset, r.length))
    for cuts in by.values():
        at = 0
        for start, length, n in sorted(cuts):
            assert start == at and length > 0
            at += length
        assert at == n
    sizes = {}
    for k, cuts in seq.items():
        at = 0
        for offset, length in sorted(cuts):
            assert offset == at
            at += length
        sizes[k] = at
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(sizes[k] == 2048 for k in range(len(sizes) - 1)) and all(n <= 2048 for n in sizes.values())
    return by


def test_packing(awkward, nothing):
    unique = awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in unique.collect()}
    assert set(check_pieces(packing.pack(unique, WORDS), texts)) == set(texts)
    assert packing.pack(nothing, WORDS).count() == 0
    total = packing.pack(awkward, WORDS).selectExpr("sum(length) n").first().n
    assert total == sum(len(ids(WORDS, r.text)) + 1 for r in awkward.collect())


def test_packing_returns_the_ids(make):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["alpha", "beta.", "Gamma,", "delta"], k=rng.randint(0, 3000))) for _ in range(12)]
    got = defaultdict(list)
    for r in packing.pack(make(texts), WORDS, ids=True).orderBy("doc_id", "start").collect():
        got[r.doc_id] += np.frombuffer(bytes(r.ids), "<u4").tolist()
    assert dict(got) == {i: [*ids(WORDS, t), 1] for i, t in enumerate(texts)}


def test_padded():
    assert [packing.padded(n) for n in (1, 3, 1024, 1025, 2048)] == [1, 2048, 1024, 2048, 2048]

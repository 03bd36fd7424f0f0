"""Decontamination, secrets and media against plain Python."""

import hashlib
import random
import re
import wave
import io
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from kestrelq.llm import decontaminate as D
from kestrelq.llm import media as M
from kestrelq.llm import secrets as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_hits(text, items, n=10):
    w = WORD.findall((text or "").translate(FOLD))
    hit, found = set(), set()
    for name, item in items:
        v = WORD.findall((item or "").translate(FOLD))
        size = min(n, len(v))
        for k in range(len(v) - size + 1 if size else 0):
            for i in range(len(w) - size + 1):
                if w[i : i + size] == v[k : k + size]:
                    hit.update(range(i, i + size))
                    found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = [(10, "The quick brown fox jumps over the lazy dog near the river bank"), (9, "one"), (2, None), (3, ""), (4, "a b a b a b a b a b a b"), (5, "été; 東京"), (9, "one"), (11, "quick brown fox jumps over the lazy dog near the river bank today")]
DOCS = ["x the quick BROWN fox-jumps over the lazy dog near the river bank y", "one", "a b a b a b a b a b", "b a b a b a b a b a b a", "no match here", "ein été 東京 mehr", "the quick brown fox jumps over"]


def test_find(spark, make, awkward, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for df in (make(DOCS), awkward):
        texts = {r.doc_id: r.text for r in df.collect()}
        got = D.find(df, items).collect()
        assert len(got) == df.count()
        for r in got:
            if r.doc_id is not None:
                assert tuple(r)[1:] == brute_hits(texts[r.doc_id], ITEMS)
    assert D.find(nothing, items).count() == 0
    assert {r.n_hit for r in D.find(make(DOCS), items.limit(0)).collect()} == {0}


def test_find_in_shards_equals_one(spark, make, awkward, nothing, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = make([*DOCS, ITEMS[0][1], "a b " * 500, None, ""])
    key = lambda r: tuple(map(str, r))
    want = [sorted(map(key, D.find(x, items).collect())) for x in (df, awkward)]
    kept = sorted(map(key, D.clean(df, items).collect()))
    monkeypatch.setattr(D, "SHARD_BYTES", 40)
    assert [sorted(map(key, D.find(x, items).collect())) for x in (df, awkward)] == want
    assert sorted(map(key, D.clean(df, items).collect())) == kept and D.clean(df, items).schema == df.schema
    assert D.find(nothing, items).count() == 0


def test_hits_come_from_the_states():
    """Every occurring window's items stand on the state in which the automaton is, and nothing else does."""
    m = D.Matcher([(str(k), (t or "").encode()) for k, t in ITEMS], 4)
    w = D.words(ITEMS[0][1].encode())
    state = matched = 0
    for i, c in enumerate(m.filter.ids(w).tolist()):
        state, matched = m.auto.step(state, matched, c)
        got = list(m.ending(state, matched))
        assert got == ([(4, {"10", "11"} if i > 3 else {"10"})] if i >= 3 else [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=8), max_size=4), st.lists(st.sampled_from("abcd"), max_size=20), st.integers(1, 4))
def test_matcher_on_random_words(items, doc, n):
    named = [(k, " ".join(x)) for k, x in enumerate(items)]
    m = D.Matcher([(str(k), t.encode()) for k, t in named], n)
    spans, found = m.match([w.encode() for w in doc])
    want = brute_hits(" ".join(doc), named, n)
    assert (D.covered(spans), len(found)) == want[1:3]


def test_clean(spark, make):
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    passage = ITEMS[0][1]
    df = make([f"Before it starts, {passage}! And after it: {'more words ' * 20}", passage, "untouched  text\n", None])
    out = {r.doc_id: r for r in D.clean(df, items).collect()}
    assert set(out) == {0, 2, 3} and D.clean(df, items).schema == df.schema
    assert "fox" not in out[0].text and out[0].text.startswith("Before it starts,") and out[0].n_chars == len(out[0].text)
    assert out[2].text == "untouched  text\n" and out[3].text is None


KEY = "q9Zx7LmP2vTtR4sWk8Yb3NcD"
SECRETS = [f"my password = '{'hunter22'}' and TOKEN:abc", f"AKIA{'Q7' * 9}", "deadbeef" * 4 + " text " + "0123456789abcdef" * 2, "api_key: Api-Key=x12345678", f"é key {KEY} end", "getUserNameFromRequestHandler the_quick_brown_fox_jumps", "secret=short", None]


def test_base_spans(make, awkward):
    a = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    for df in (make(SECRETS), awkward):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in S.find(df).collect():
            t = texts[r.doc_id] or "" if r.doc_id is not None else None
            if t is None:
                continue
            spans = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[2]) >= 6]
            spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
            spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
            spans.sort()
            text = ",".join(f"{('assign', 'access', 'hex')[k]}:{x}:{y}" for x, k, y in spans)
            assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
            assert ",".join(s for s in r.spans.split(",") if not s.startswith("markov")) == text


def test_models_tell_random_from_ordinary(spark):
    """Recall and precision on random tokens of no base kind and on ordinary ones, the models learnt from the corpus."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scan = S.Scanner(S.ordinary_samples(docs, "text"))
    rng = random.Random(99)
    letters = S.TOKEN_CHARS
    for chars in (letters[:62], letters[:62] + "+/", letters[26:62], letters[:62] + "-_"):
        for size in (20, 32, 44):
            tokens = ["".join(rng.choices(chars, k=size)).encode() for _ in range(300)]
            tokens = [t for t in tokens if not S.base_spans(t)]
            found = sum(bool(scan.stretches(t)) for t in tokens)
            assert found >= 0.9 * len(tokens), (chars, size, found)
            inside = sum(bool(scan.spans(b"some words before " + t + b" and after it")) for t in tokens)
            assert inside >= 0.9 * len(tokens)
    wrong = sum(bool(scan.stretches(x)) for x in S.identifier_samples(500, seed=77))
    assert wrong <= 5
    for plain in (b"https://example.com/articles/2023/the-quick-brown-fox", b"-" * 500, b"internationalization_configuration_manager", b"x" * 200_000):
        assert scan.stretches(plain) == [] or plain[:1] == b"x", plain


ORDINARY = ["https://example.org/blog/the-quick-brown-fox-jumps-over-2024-01-16", "/news/2024/how-to-grow-juicy-kiwi-figs", "/local/lib/python3", "getXMLHttpRequestObjectByJQuery", "ACGTACGGTCATTGCAACGT", "0" * 16, "550e8400-e29b-41d4-a716-446655440000", "+49-30-1234567-8901234", "20240116101530123456", "20240116T101530Z", "x86_64-linux-gnu-gcc-12", "utf8mb4_unicode_520_ci", "sha256sum/base64/md5/h264/mp3", "IMG_20240116_101530_HDR"]


def test_ordinary_slugs_paths_and_names(spark):
    """At most 1 % of slugs, paths and names made of corpus words that the models have not seen, and no listed one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scan = S.Scanner(S.ordinary_samples(docs.where("doc_id % 2 = 0"), "text"))
    seen = set(S.ordinary_samples(docs.where("doc_id % 2 = 0"), "text"))
    held = [w.decode() for w in S.ordinary_samples(docs.where("doc_id % 2 = 1"), "text") if w not in seen and w.isalpha()]
    assert len(held) > 2000
    rng, wrong = random.Random(6), []
    for i in range(1000):
        w = rng.choices(held, k=rng.randint(3, 6))
        year = rng.randint(1990, 2030)
        text = ("-".join(w), f"/{'/'.join(w)}/{year}/12", w[0].lower() + "".join(x.title() for x in w[1:]), f"https://example.org/blog/{'-'.join(w)}-{year}-01-16", "_".join(w) + str(i), f"/usr/lib/{w[0]}{i % 5}/{w[1]}-{i % 9}.{i % 30}/{''.join(x.title() for x in w[2:])}")[i % 6]
        wrong += [text] * any(k == 3 for *_, k in scan.spans(text.encode()))
    assert len(wrong) <= 10, wrong[:5]
    for text in ORDINARY:
        assert [x for x in scan.spans(f"see {text} here".encode()) if x[2] == 3] == [], text


def test_secret_beside_words_and_base_spans(spark):
    scan = S.Scanner([b"ordinary", b"words", b"prose", b"information", b"development", b"international", b"files", b"path"])
    found = [x for x in scan.spans(f"path/to/{KEY}/ordinary/files".encode()) if x[2] == 3]
    assert len(found) == 1 and found[0][0] <= 8 and found[0][1] >= 8 + len(KEY)
    both = scan.spans(f"AKIA{'Q7' * 9}/{KEY}x4{KEY}".encode())
    assert [k for *_, k in both] == [1, 3]


def test_samples_cover_every_word(make):
    """No word is shut out by its hash: with few words all are samples."""
    words = [f"word{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"]
    got = S.ordinary_samples(make([" ".join(words[k::8]) for k in range(8)]), "text")
    assert got == sorted(w.encode() for w in words)


def test_added_spans_and_masks(make, nothing):
    got = {r.doc_id: r.spans for r in S.find(make(SECRETS)).collect()}
    assert got[4] == f"markov:6:{6 + len(KEY)}" and got[5] == "" and got[7] == ""
    out = {r.doc_id: r for r in S.mask(make(SECRETS)).collect()}
    assert len(out) == len(SECRETS) and out[4].text == "é key [SECRET] end" and out[4].n_chars == len(out[4].text)
    assert "hunter22" not in out[0].text and "password = '" in out[0].text and out[7].text is None and out[5].text == SECRETS[5]
    assert S.mask(nothing).count() == 0 and S.find(nothing).count() == 0


def test_media_round_trip(awkward, nothing):
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    got = M.features(awkward, media=True, codes=True).collect()
    assert len(got) == awkward.count() and M.features(nothing).count() == 0
    by_text = {}
    for r in got:
        if r.doc_id is None:
            continue
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        with wave.open(io.BytesIO(r.media)) as w:
            assert (w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())) == (1, 1, payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert by_text.setdefault(texts[r.doc_id], r.feature) == r.feature
        assert sorted(r.fingerprint) == r.fingerprint
    assert by_text[""] != by_text[max(texts.values(), key=len)]


def plain_fingerprint(samples):
    """Peaks and pairs by the definition of the transform, one frame at a time."""
    import math

    n = max(1, -(-(len(samples) - M.FRAME) // M.HOP) + 1)
    x = [s - 128 for s in samples] + [0] * ((n - 1) * M.HOP + M.FRAME - len(samples))
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / (M.FRAME - 1)) for k in range(M.FRAME)]
    frames = []
    for f in range(n):
        part = x[f * M.HOP : f * M.HOP + M.FRAME]
        mean = sum(part) / M.FRAME
        part = [(v - mean) * w for v, w in zip(part, window)]
        power = [abs(sum(v * complex(math.cos(2 * math.pi * b * k / M.FRAME), -math.sin(2 * math.pi * b * k / M.FRAME)) for k, v in enumerate(part))) for b in range(M.FRAME // 2 + 1)]
        best = [max(range(lo, hi), key=lambda b: power[b]) for lo, hi in M.BANDS]
        top = sorted(best, key=lambda b: -power[b])[:2]
        frames.append((top, power[top[0]] > 1e-3))
    out = []
    for d in range(M.REACH + 1):
        for f in range(n - d):
            if frames[f][1] and frames[f + d][1]:
                out.append(f << 32 | frames[f][0][0] << 20 | (frames[f + d][0][0] if d else frames[f][0][1]) << 8 | d)
    return sorted(out)


def test_fingerprint_equals_the_plain_transform(make):
    rng = random.Random(21)
    texts = ["".join(rng.choices("abcdefgh ,.\nXYZ", k=n)) for n in (1, 200, 300, 700, 1500)] + ["ab" * 300, ""]
    got = {r.doc_id: r.fingerprint for r in M.features(make(texts), codes=True).collect()}
    for k, t in enumerate(texts):
        assert got[k] == plain_fingerprint(M.payload_of(t.encode())), k

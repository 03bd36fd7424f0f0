"""Every registered corpus query on the whole small table, against plain Python or DuckDB."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from kestrelq.llm import queries as Q
from tests.llm.test_models import tokens
from tests.llm.test_ngram_join import brute
from tests.llm.test_scans import FOLD, WORD
from tests.llm.test_tokens import BYTES, check_pieces, ids
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name, docs):
    got = Q.QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    return got


def test_operators_and_the_pipeline():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in Q.QUERIES if n != "pipeline")
    assert numbers == list(range(1, 14)) and "pipeline" in Q.QUERIES and set(Q.ORACLE) <= set(Q.QUERIES)


def test_op1(spark, docs):
    import math

    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    count = defaultdict(int)
    for d, t in docs.items():
        for w in tokens(t) if not held(d) else ():
            count[w] += 1
    n, v = sum(count.values()), len(count)
    total = [0.0, 0.0]
    for r in rows(spark, "op1_lm_scoring", docs):
        t = tokens(docs[r.doc_id])
        base = sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(t), sum(w in count for w in t), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        if r.held_out:
            total[0] += r.base_score
            total[1] += r.score
    assert total[1] > total[0]


def test_op2(spark, docs):
    assert set(check_pieces(Q.QUERIES["op2_packing"](spark, SF), docs)) == set(docs)


def test_op3(spark):
    assert difference(Q.QUERIES["op3_warc"](spark, SF), connect(SF), Q.ORACLE["op3_warc"]) == ""


def test_op4(spark, docs):
    got = rows(spark, "op4_ngram_jaccard_join", docs)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(sorted(docs.items()))


def test_op5(spark, docs):
    for r in rows(spark, "op5_token_counts", docs):
        n = len(ids(BYTES, docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)


def test_op7(spark, docs):
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORD.findall((r.text or "").translate(FOLD))
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[k : k + size])].add(str(r.item_id))
    sizes = {len(w) for w in windows}
    some = 0
    for r in rows(spark, "op7_decontamination", docs):
        w = WORD.findall(docs[r.doc_id].translate(FOLD))
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if names := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= names
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), sha, bool(hit))
        some += bool(hit)
    assert some


def test_op8(spark, docs):
    features = {}
    for r in rows(spark, "op8_media_columns", docs):
        raw = docs[r.doc_id].encode()
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert features.setdefault(raw, (r.feature, r.media_sha256)) == (r.feature, r.media_sha256)
    assert len({f for f, _ in features.values()}) > 0.95 * len(features)


def test_op9(spark, docs):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    for r in rows(spark, "op9_secret_scan", docs):
        t = docs[r.doc_id]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_op10(spark, docs):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = rows(spark, "op10_toxicity", docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.8 * len(held)

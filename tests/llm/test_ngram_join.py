import random
import re

import numpy as np
import pytest

from kestrelq.llm import ngram_join as N

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                n[i] += 1
                n[j] += 1
                a, b = root(i), root(j)
                parent[a] = b
    low = {}
    for k, (d, _) in enumerate(rows):
        low.setdefault(root(k), []).append(d)
    key = lambda d: (d is None, d)
    return sorted((d, min(low[root(k)], key=key), n[k]) for k, (d, _) in enumerate(rows) if d is not None)


def compare(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = N.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got if r.doc_id is not None) == brute(rows)


def edited(rng, words, k):
    w = list(words)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10**6)}"
    return " ".join(w)


def test_awkward(awkward, nothing):
    compare(awkward)
    assert N.near_duplicates(nothing).count() == 0 and N.deduplicated(nothing).columns == nothing.columns


def test_random_near_copies(make):
    rng = random.Random(5)
    texts = []
    for g in range(25):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([6, 40, 150, 400]))]
        texts += [edited(rng, base, rng.choice([0, 1, 2, 4, 8])) for _ in range(rng.randint(1, 6))]
    compare(make(texts).repartition(4))


def test_large_group_is_dealt_into_blocks(make, monkeypatch):
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 900)}" for _ in range(300)]
    monkeypatch.setattr(N, "BLOCK_MEMBERS", 16)
    monkeypatch.setattr(N, "SPREAD", 1)
    monkeypatch.setattr(N, "TILE", 7)
    compare(make([edited(rng, base, 3) for _ in range(120)] + [" ".join(base)] * 30).repartition(4))


def test_deduplicated_keeps_columns_and_first_ids(make):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(200)]
    df = make([edited(rng, base, 2), "something else entirely", edited(rng, base, 1), None, None, "", " ".join(base)])
    out = N.deduplicated(df)
    assert out.schema == df.schema
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 3, 4, 5]
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in df.collect()}


def test_components_of_a_path(spark):
    n = 70
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(200, 201)], "u long, v long")
    got = {r.node: r.label for r in N.components(edges).collect()}
    assert got == {k: 0 for k in range(1, n + 1)} | {201: 200}


@pytest.mark.parametrize("n", [20, 120])
def test_pruning_bound(n):
    """A pair at the threshold is dropped with a chance far below the odds of a wrong verification."""
    rng = np.random.default_rng(0)
    assert (rng.binomial(n, 0.8, 200_000) < N.least_matches(n)).mean() < 1e-4
    assert N.least_matches(n) > 0


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.8, 0.95])
def test_candidate_recall_at_the_threshold(threshold):
    rows = N.rows_for(threshold)
    assert (1 - threshold**rows) ** (N.HASHES // rows) < 1e-6


def test_threshold_too_low(make):
    with pytest.raises(ValueError):
        N.near_duplicates(make(["a"]), threshold=0.05)


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_other_thresholds(make, threshold):
    rng = random.Random(15)
    texts = []
    for g in range(12):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(120)]
        texts += [edited(rng, base, rng.choice([0, 1, 2, 5, 8])) for _ in range(6)]
    sets = [shingles(t) for t in texts]
    want = [sum(len(a & b) / len(a | b) >= threshold for b in sets) - 1 for a in sets]
    got = {r.doc_id: r.n_links for r in N.near_duplicates(make(texts), threshold=threshold).collect()}
    assert got == dict(enumerate(want)) and sum(want)


def test_tables_are_removed(spark, make):
    from kestrelq.llm import common

    before = len(common._held)
    out = common.settled_table(lambda: N.deduplicated(make(["a b c d e f", "a b c d e f", "x"])), "dedup")
    assert len(common._held) == before + 1 and out.count() == 2
    common.released(out)
    assert len(common._held) == before


def test_shared_folder_is_needed(spark, monkeypatch):
    """Neither setting: a local session gets a folder of its own, a cluster an error."""
    from kestrelq.llm import common

    class Context:
        master, folder = "spark://host:7077", None
        getCheckpointDir = lambda self: self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch(Session, "x")
    Session.sparkContext.folder = "hdfs://x/y"
    assert common.scratch(Session, "x").startswith("hdfs://x/y/x-")
    Session.sparkContext.folder, Context.master = None, "local[2]"
    assert common.scratch(Session, "x").startswith("file:")

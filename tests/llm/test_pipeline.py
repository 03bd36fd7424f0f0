"""The pipeline against plain Python, and every stage on awkward and empty tables."""

import random

import pytest

import corpus_pipeline as P
from kestrelq.llm import secrets as S
from kestrelq.llm import toxicity as T
from tests.llm.test_models import labelled
from tests.llm.test_ngram_join import brute, edited
from tests.llm.test_scans import FOLD, KEY, WORD
from tests.llm.test_tokens import check_pieces

BENCH = [(k, " ".join(f"bench{k}x{i}" for i in range(14))) for k in range(3)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean, toxic, copied, near-copied, leaking and secret-holding texts, dealt over several files."""
    rng = random.Random(12)
    texts, labels = labelled(9, 320)
    base = [f"word{rng.randint(0, 5000)}" for _ in range(120)]
    texts += [" ".join(base), " ".join(base), edited(rng, base, 1), edited(rng, base, 2)]
    texts += [f"Intro to this, {BENCH[0][1]}! Then {' '.join(rng.choices(base, k=60))}", BENCH[1][1], f"tail {BENCH[2][1].upper()}"]
    texts += [f"my password = hunter2222 and {KEY} then {' '.join(rng.choices(base, k=30))}", "", "short one"]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(len(texts), None, None, None, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def cut(text):
    """The text without benchmark windows, each gap one blank; None if most of its words go."""
    if text is None:
        return None, True
    found = list(WORD.finditer(text.translate(FOLD)))
    words = [m[0] for m in found]
    windows = {tuple(v[k : k + 10]) for _, t in BENCH for v in [t.split()] for k in range(len(v) - 9)}
    hit = {j for i in range(len(words) - 9) if tuple(words[i : i + 10]) in windows for j in range(i, i + 10)}
    if len(hit) > 0.5 * len(words):
        return None, False
    parts, last, j = [], 0, 0
    while j < len(words):
        if j in hit:
            end = j
            while end + 1 in hit:
                end += 1
            parts.append(text[last : found[j].start()].strip())
            last, j = found[end].end(), end
        j += 1
    return (" ".join([*parts, text[last:].strip()]).strip() if parts else text), True


def test_equals_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lab = spark.read.parquet(f"{folder}/labels.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.text is not None)
    rows += [(r.doc_id, None) for r in docs.where("text IS NULL").collect()]

    net = T.fit(*T.labelled_sample(docs, lab, "doc_id", "text", "toxic", 5, 0))
    score = lambda t: T.Scorer(net).scores([T.words_of((t or "").encode())])[0]
    rows = [(d, t) for d, t in rows if score(t) < 0.5]
    kept = {r.doc_id for r in P.drop_toxic(spark, docs, folder).collect()}
    assert kept == {d for d, _ in rows}
    truth = {r.doc_id: r.toxic for r in lab.collect()}
    assert sum(truth.get(d, 0) for d in kept) <= 3 and sum(1 for d, y in truth.items() if not y and d not in kept) <= 3

    first = {d for d, c, _ in brute(rows) if d == c}
    rows = [(d, t) for d, t in rows if d in first]
    assert not {321, 322, 323} & first and 320 in first

    rows = [(d, new) for d, t in rows for new, stays in [cut(t)] if stays]
    ids = {d for d, _ in rows}
    assert 324 in ids and 325 not in ids and 326 not in ids

    clean = P.cut_benchmark(spark, P.drop_near_duplicates(spark, P.drop_toxic(spark, docs, folder), folder), folder)
    assert sorted((r.doc_id, r.text or "") for r in clean.collect()) == sorted((d, t or "") for d, t in rows)
    scanner = S.Scanner(S.ordinary_samples(clean, "text"))

    def mask(t):
        raw = (t or "").encode()
        return S.masked(raw, scanner.spans(raw), b"[SECRET]").decode()

    rows = {d: mask(t) for d, t in rows}
    assert rows[327].count("[SECRET]") == 2 and "hunter2222" not in rows[327] and KEY not in rows[327]
    got = P.run(spark, folder)
    assert set(check_pieces(got, rows)) == set(rows)


def test_stages_keep_the_columns(spark, folder, awkward, nothing):
    """Nulls, repeated rows, clashing names, very long and empty texts; empty tables."""
    assert 4 <= len(P.STAGES) <= 5
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, awkward, folder)
        assert out.columns == awkward.columns and [f.dataType for f in out.schema] == [f.dataType for f in awkward.schema], name
        assert {tuple(r)[2:3] + tuple(r)[4:] for r in out.collect()} <= {tuple(r)[2:3] + tuple(r)[4:] for r in awkward.collect()}, name
        assert stage(spark, nothing, folder).count() == 0, name
    pack = P.STAGES[-1][1]
    assert pack(spark, awkward, folder).where("start = 0").count() == awkward.count() and pack(spark, nothing, folder).count() == 0


def test_run_on_empty_and_awkward_tables(spark, folder, awkward, nothing, tmp_path):
    for name, docs in (("nothing", nothing), ("awkward", awkward)):
        path = str(tmp_path / name)
        docs.write.parquet(f"{path}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
        out = P.run(spark, path)
        assert {"doc_id", "start", "length", "ids_crc32"} <= set(out.columns)
        assert (out.count() > 0) == (name == "awkward")

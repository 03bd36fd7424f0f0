"""WARC round trips and HTML extraction."""

import hashlib
import io
import random

import pytest

from kestrelq.llm import html_extract as H
from kestrelq.llm import queries as Q
from kestrelq.llm import warc as W

SCHEMA = "page_id long, url string, html string, text string, salt string"


def page_rows():
    big = "<p>" + "long text " * 200_000 + "</p>"
    magic = "\x1f\u008b\x08 WARC/1.1 \r\n\r\n " * 30
    return [(0, "http://a.example/é b", None, "x", "y"), (1, None, "", None, None), (2, "u", "same" * 30, None, None), (3, "u", "same" * 30, None, None), (4, "u", "tiny", None, None), (5, "u", "tiny", None, None), (6, "u", big, None, None), (7, "u", magic, None, None), (2, "u", "same" * 30, None, None), (None, "u", "same" * 30, None, None), (8, "line\r\nbreak", "東京 🙂" * 40, None, None), (9, "http://a/b%20c?x=%C3%A9&y=é %", "z" * 200, None, None), (10, None, "no address " * 20, None, None)]


@pytest.mark.parametrize("split", [257, 4 << 20])
def test_round_trip(spark, monkeypatch, split):
    rows = page_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    from kestrelq.llm.common import scratch

    manifest = W.write(df, scratch(spark, "warc-test"))
    if split == 257:
        manifest = manifest.where("size < 100000")
    got = W.read(manifest, split).collect()
    if split > 257:
        assert len(got) == len(rows)
    payloads = {i: (h or "").encode() for i, _, h, *_ in rows}
    urls = {i: u for i, u, *_ in rows}
    for r in got:
        want = payloads[r.page_id]
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(want), hashlib.sha256(want).hexdigest(), urls[r.page_id])
        assert (r.record_type, r.refers_to) == (("revisit", 2) if r.page_id == 3 else ("response", None))
        assert r.payload == (None if r.page_id == 3 else want)


def test_every_split_owns_each_record_once():
    rng = random.Random(2)
    records = [W.record("response", i, "u", "0" * 64, n, rng.randbytes(n)) for i, n in enumerate(rng.choices([0, 5, 300, 70_000], k=60))]
    data = b"".join(records)
    for split in (1000, 4096, 99_991, len(data)):
        ids = [W.parsed(*r)[0] for a in range(0, len(data), split) for r in W.read_range(io.BytesIO(data), len(data), a, min(len(data), a + split))]
        assert ids == list(range(60))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert W.round_trip(df).count() == 0 and H.extract(df).count() == 0


def main_texts(pages_blocks):
    """The main text of every page of a host that is one chunk, by the operator's own parts."""
    around = [H.outside(found) for found in pages_blocks]
    keys, pages, _ = H.substrings([t for t, _ in around], [j for _, j in around])
    keys = keys[pages >= H.PAGES]
    texts = [H.settled(found) for found in pages_blocks]
    return [H.judged_text(*H.candidates(found), keys) if t is None else t for t, found in zip(texts, pages_blocks)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- c --><div class="ad">Buy this now</div>
<article><h1>Head &amp; line</h1><p><b>First  para<br><p>Second &lt;b&gt; para.</p><aside>Side</aside><p>Third</p><div class="comments"><p>Nice!</p></div></article>
<footer>&copy; host</footer></body></html>"""


def test_blocks_by_structure():
    assert main_texts([H.blocks(PAGE)]) == ["Head & line\nFirst para\nSecond <b> para.\nThird"]


def test_repeated_blocks_of_pages_without_article():
    shell = "<body><div>Cookies are used on this site for all of you</div><div>{}</div><div>Follow us</div></body>"
    pages = [shell.format(f"Unique story number {k} about topic {k * 7} and some more words") for k in range(4)]
    assert main_texts([H.blocks(p) for p in pages]) == [f"Unique story number {k} about topic {k * 7} and some more words" for k in range(4)]


def test_marks_are_whole_attributes():
    for plain in (' style="overflow:hidden"', ' title="hidden gems"', ' data-id="share"', ' data-class=ad', " alt='a class=\"ad\" b'", ' href=/hidden', ' title="x > id=ad"'):
        assert not H.unwanted("div", plain), plain
        assert main_texts([H.blocks(f"<article><div{plain}>Text</div></article>")]) == ["Text"], plain
    for marked in (" hidden", ' HIDDEN=""', ' class="x ad-box"', " id=share", ' style="a:b" class = \'ad\'', ' aria-hidden="true"', ' role=banner', ' title="a"class="ad"'):
        assert H.unwanted("div", marked), marked


def test_text_beside_a_teaser_article_is_judged(spark):
    shell = "<body><div>Cookies are used on this site for all of you</div><article>Teaser {0}</article><div>Unique story number {0} about topic x{0} and some more words</div></body>"
    pages = [shell.format(k) for k in range(4)]
    want = [f"Teaser {k}\nUnique story number {k} about topic x{k} and some more words" for k in range(4)]
    rows = [(k, "http://host.example/x", p, None, None) for k, p in enumerate(pages)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()}
    assert got == dict(enumerate(want)) and main_texts([H.blocks(p) for p in pages]) == want


def test_repeats_equal_brute_force():
    """Keys, page counts and flags of a chunk's substrings against a plain count of its runs of LEAST tokens."""
    rng = random.Random(3)
    for _ in range(40):
        pages = [[" ".join(rng.choices("abc", k=rng.randint(1, 14))) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 5))]
        judged = [[rng.random() < 0.5 for _ in p] for p in pages]
        keys, n, asked = H.substrings(pages, judged)
        where, flags = {}, {}
        for k, (texts, marks) in enumerate(zip(pages, judged)):
            for text, mark in zip(texts, marks):
                t = text.split(" ") + [""] * max(0, H.LEAST - len(text.split(" ")))
                for i in range(len(t) - H.LEAST + 1):
                    where.setdefault(tuple(t[i : i + H.LEAST]), set()).add(k)
                    flags[tuple(t[i : i + H.LEAST])] = flags.get(tuple(t[i : i + H.LEAST]), False) or mark
        assert len(set(keys.tolist())) == len(keys) == len(where)
        assert sorted(n.tolist()) == sorted(map(len, where.values()))
        assert sorted(zip(n.tolist(), asked.tolist())) == sorted((len(v), flags[w]) for w, v in where.items())


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article>Text <x( class="ad">advert</x(> more</article>', "Text more"),
        ("<html><head><title>t</title><body><article>Body text</article>", "Body text"),
        ("<head><meta charset=x><p>Plain", "Plain"),
        ('<article><ul><li class="ad">Advert<li>One<li>Two</ul></article>', "One\nTwo"),
        ('<article><dl><dt>T<dd class="ad">Advert<dt>U<dd>V</dl></article>', "T\nU\nV"),
        ('<article><table><tr><td class="ad">Advert<td>One<tr><td>Two</table></article>', "One\nTwo"),
        ('<article><p class="ad">Advert<div>Story</div></article>', "Story"),
        ('<article>One</article><article>Two</article><nav>Menu</nav>', "One\nTwo"),
        ('<article><a title="x > y" href=\'q"\'>Link</a> and a < b, "quoted</article>', 'Link and a < b, "quoted'),
        ('<article>A <b title="unclosed>bold</b> text</article>', "A bold text"),
        ("<article>End <!-- unclosed > comment</article>", "End"),
        ("<article>1 <", "1 <"),
        ("<article><ul><li>a<ul><li>b</ul><li>c</ul></article>", "a\nb\nc"),
        ('<div class="no-sidebar"><article>Story</article></div>', "Story"),
        ('<div class="has-comments"><main>Story</main></div>', "Story"),
        ('<form id="aspnetForm"><nav>Menu</nav><article>Story</article><p>Submit</p></form>', "Story"),
        ('<article><h2 class="entry-header">Title</h2><header class="post-header"><h1>Head</h1></header><p>Story</article>', "Title\nHead\nStory"),
        ('<div class="site-header"><p>Logo</p></div><div class="modal page-wrapper"><p>Close</p><main><p>Story</main></div>', "Story"),
        ('<article>Story<div class="comments-list"><article>Nice!</article></div></article>', "Story"),
        ('<aside class="related-posts"><article>Teaser</article></aside><article>Story</article><nav><article>Menu</article></nav>', "Story"),
        ('<div class="ad-slot-1"><article>Buy</article></div><article>Story<form><p>Mail</p></form></article>', "Story"),
        ("<article>A<!-- x --!> B<!--> C<!---> D <!--!> e --> F</article>", "A B C D F"),
        ("<article>A<![CDATA[ x > y ]]>B<![CDATA[ open > C</article>", "AB C"),
        ("<article>" + "<div>" * 700 + "<ul><li>" + "<div>" * 700 + "<p>x<li>y</ul></article>", "x\ny"),
        ("<article>" + '<li class="ad">' + "<div>" * 700 + "Advert<li>Own</article>", "Own"),
    ],
)
def test_awkward_markup(page, want):
    assert main_texts([H.blocks(page)]) == [want]


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a '\"", '<b class="ad">', "<x( class=ad>", "<!--", "<li>", "<p>", "<", "</p>", '<a b="c" ', "<td>x", '"><a "', "<div>", "<div></p>", "<div><li>"])
def test_parsing_takes_linear_time(part):
    import time

    page = "<article>" + part * (500_000 // len(part))
    begin = time.process_time()
    H.blocks(page)
    assert time.process_time() - begin < 8


def test_many_names_take_linear_time():
    import time

    page = "<article>" + "".join(f"<span{k} class=ad>" for k in range(16_000))
    begin = time.process_time()
    H.blocks(page)
    assert time.process_time() - begin < 1.5


def test_extract(spark):
    rows = [(1, "http://Host.example/a", PAGE, None, None), (2, "http://host.example/b", PAGE, None, None), (3, None, None, None, None), (4, "bad url", "", None, None), (1, "http://Host.example/a", PAGE, None, None), (None, "http://x/", "<p>plain", None, None), (5, "http://y/", "a < b & c <unclosed", None, None)]
    got = H.extract(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert text[1] == text[2] == "Head & line\nFirst para\nSecond <b> para.\nThird" and text[3] == text[4] == "" and text[None] == "plain"


def test_articles_of_the_test_pages(spark):
    """The generator's article element, by a plain pattern, on all pages of the small table."""
    import html
    import re

    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in Q.QUERIES["op6_html_extraction"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == df.count()
    for r in df.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)
        blocks = re.split(r"</?p>|<br>|</?h1>", article[1] if article else "")
        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in blocks]
        assert got[r.page_id] == "\n".join(b for b in want if b)


@pytest.mark.parametrize("size", [1, 300, 6_000_000])
def test_chunks_and_partitions_decide_nothing(spark, monkeypatch, size):
    """Pages without an article, one hot host: repeats on distant pages are found whatever a chunk holds."""
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    notice, short, rows, want = words(30), words(2), [], {}
    for k in range(60):
        own = [words(rng.choice([1, 3, 8, 40])) for _ in range(3)]
        shared = notice if k in (0, 59) else words(12)
        texts = [shared, *own, short if k % 20 == 0 else words(3)]
        rows.append((k, "http://hot.example/x", "".join(f"<div>{t}</div>" for t in texts) + "<nav>menu of this host with many words in it</nav>", None, None))
        want[k] = "\n".join(t for t in texts if t not in (notice, short))
    rows.append((99, "http://other.example/", f"<div>{notice}</div>", None, None))
    want[99] = notice  # another host
    monkeypatch.setattr(H, "CHUNK_CHARS", size)
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == want


def plain_counts(rows):
    """(blocks, repeats, restored repeats) by page of distinct ids, by a plain count of the runs of LEAST tokens on each host's pages."""
    runs = lambda t: [tuple(t[i : i + H.LEAST]) for i in range(len(t) - H.LEAST + 1)]
    filled = lambda text: text.split(" ") + [""] * (H.LEAST - len(text.split(" ")))
    pages = {i: (host, H.blocks(page or "")) for i, host, page in rows}
    on, off = {}, {}
    for i, (host, found) in pages.items():
        for zone, text in found:
            for run in runs(filled(text)):
                on.setdefault((host, run), set()).add(i)
                if zone != H.ARTICLE:
                    off.setdefault((host, run), set()).add(i)

    def covered(host, text, seen):
        t, inside = filled(text), set()
        for k, run in enumerate(runs(t)):
            if len(seen.get((host, run), ())) >= H.PAGES:
                inside |= set(range(k, k + H.LEAST))
        return len(inside) / len(t) >= H.COVER

    out = {}
    for i, (host, found) in pages.items():
        repeats = [(zone, text) for zone, text in found if covered(host, text, on)]
        back = [z for z, t in repeats if z == H.ARTICLE or z == H.OUTSIDE and not covered(host, t, off)]
        out[i] = (len(found), len(repeats), len(back))
    return out


def test_every_block_of_the_test_pages_meets_the_arrays(spark):
    """Pages that markup settles too: what the host's repeats cover is counted and taken away, articles are restored."""
    from urllib.parse import urlsplit

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = plain_counts([(r.page_id, urlsplit(r.url).hostname, r.html) for r in df.collect()])
    got = {r.page_id: (r.n_blocks, r.n_repeated, r.n_restored) for r in Q.QUERIES["op6_html_extraction"](spark, "/root/testdata/sf0.01").collect()}
    assert got == want and sum(r for _, r, _ in want.values()) > sum(b for _, _, b in want.values()) > 0


@pytest.mark.parametrize("size", [1, 3000, 12_000_000])
def test_whole_pages_meet_whatever_a_chunk_holds(spark, monkeypatch, size):
    """Articles, adverts and open blocks that quote each other on the pages of three hosts, in one chunk or many."""
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(n))
    pool = [words(rng.choice([1, 3, 7, 20])) for _ in range(40)]
    frames = ["<div>{}</div>", "<article>{}</article>", "<nav>{}</nav>", "<p class=ad>{}</p>"]
    rows = []
    for k in range(240):
        texts = [rng.choice(pool) if rng.random() < 0.5 else words(rng.choice([1, 2, 5, 6, 9, 30])) for _ in range(rng.randint(0, 6))]
        page = "".join(rng.choice(frames).format(t + " " + rng.choice(pool) if rng.random() < 0.2 else t) for t in texts)
        rows.append((k, rng.choice(["a.x", "b.x", ""]), page or rng.choice(["", None])))
    monkeypatch.setattr(H, "CHUNK_CHARS", size)
    table = spark.createDataFrame([(k, f"http://{host.upper()}/p" if host else None, page, None, None) for k, host, page in rows], SCHEMA)
    got = {r.page_id: r for r in H.extract(table.repartition(3)).collect()}
    assert {k: (r.n_blocks, r.n_repeated, r.n_restored) for k, r in got.items()} == plain_counts(rows)
    for host in ("a.x", "b.x", ""):
        own = [(k, page) for k, h, page in rows if h == host]
        assert [got[k].text for k, _ in own] == main_texts([H.blocks(page or "") for _, page in own])


def test_a_passage_of_many_articles_is_a_repeat_that_is_restored(spark):
    license = "released under the terms of the license that all pages of this host name"
    pages = [f"<nav>{license}</nav><article><p>Story {k} is told once</p><p>{license}</p></article>" for k in range(3)]
    got = H.extract(spark.createDataFrame([(k, "http://h.x/", p, None, None) for k, p in enumerate(pages)], SCHEMA)).collect()
    assert {(r.page_id, r.text, r.n_blocks, r.n_repeated, r.n_restored) for r in got} == {(k, f"Story {k} is told once\n{license}", 3, 2, 1) for k in range(3)}


def test_bundles_and_keys_come_back():
    import numpy as np

    for pages in ([[]], [[], []], [[], [(2, "x")], [], []], [[(0, "a b"), (1, "0")], [(3, "é\0 c")]]):
        assert H.unbundled(H.bundle(pages)) == pages
    keys = np.array([0, 1, 255, 1 << 40, (1 << 64) - 1], np.uint64)
    assert (H.unpacked(H.packed(keys)) == keys).all() and len(H.unpacked(H.packed(keys[:0]))) == 0


def test_suffixes_sort_by_their_first_tokens():
    """Against a plain sort, on streams whose numbers fill their range and on such that pass their length."""
    import numpy as np

    rng = random.Random(7)
    for top in (1, 3, 11, 12, 13, 10**6):
        for n in (1, 2, 5, 12, 60):
            stream = [rng.randint(0, top) for _ in range(n - 1)] + [top]
            page = sorted(rng.randint(0, 3) for _ in range(n))
            suffixes, start, pages = H.suffix_groups(np.array(stream), np.array(page), H.LEAST)
            want = sorted(range(n), key=lambda i: (stream[i : i + H.LEAST], i))
            heads = [stream[i : i + H.LEAST] for i in want]
            assert suffixes.tolist() == want
            assert start.tolist() == [k for k in range(n) if k == 0 or heads[k] != heads[k - 1]]
            assert pages.tolist() == [len({page[i] for i, h in zip(want, heads) if h == heads[a]}) for a in start]

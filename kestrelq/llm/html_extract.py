"""HTML extraction: blocks by structure, boilerplate by suffix arrays over a host's whole pages.

Every block of every page, articles too, goes through the arrays: it is a repeat where substrings of at least LEAST
tokens that occur on several distinct pages of the host cover it. Markup is the check that follows: a repeat inside an
article or main element is restored (a passage that several articles share is still article text, and adverts quote
articles), and so is one that no markup settles and that repeats only what articles say; menus, notices and the like
go though they may occur once.

1. Pages are parsed where they lie. A host's pages meet in one group, or where it is larger than CHUNK_CHARS in several
   of about that size, over which its pages are dealt.
2. A chunk's token streams are concatenated and their suffixes sorted by their first LEAST tokens. That gives its
   distinct substrings of that length with the number of pages of each; a longer repeat is a union of these, on as
   many pages or more, so sorting further would cover no other token.
3. A host of one chunk is judged at once. The chunks of a larger one offer their substrings, dealt by key, and get back
   those that occur on several pages of the host, so what a chunk or a partition holds decides nothing.
"""

from __future__ import annotations

import bisect
import html as html_module
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelq.llm.common import pieces, quoted, written

#: Tokens of the shortest repeated substring that counts (a shorter whole block counts as it is), distinct
#: pages it has to occur on, share of a block's tokens that makes it covered.
LEAST, PAGES, COVER = 6, 2, 0.8
#: Characters of html in one chunk of a host, about; chunks whose worth of substrings meets in one group.
CHUNK_CHARS, MEETING = 12_000_000, 4

_PLACE = np.random.default_rng(20240918).integers(0, 1 << 63, LEAST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Fixed values of HTML: elements without text of the page, elements that are never article text, elements
#: that start a new block, elements without an end tag, attribute words that mark what is not article text.
SKIPPED = frozenset("script style noscript template head title textarea select option svg math iframe object canvas".split())
CHROME = frozenset("nav header footer aside form menu dialog button fieldset".split())
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS = frozenset("ad ads advert adverts advertisement banner sponsored promo nav navbar menu sidebar footer header masthead breadcrumb breadcrumbs cookie cookies consent notice notices popup modal newsletter subscribe share social related recommended comment comments reply replies disqus widget toolbar pagination login".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words that may stand beside a mark in a name, as in site-footer or ad-box; with any other word (no-sidebar,
#: has-comments, entry-header) the name does not say that the element itself is one.
NEUTRAL = frozenset("area bar block bottom box button buttons container form global icons inline inner item items left link links list main page panel posts right row section sections signup site slot sticky thread top unit wrap wrapper".split())
#: Marks and elements inside which no article counts: what they hold is quoted, advertised or said by readers. An
#: article or main element inside another marked one (a page's form, say) is the page's text.
QUOTING = frozenset("ad ads advert adverts advertisement sponsored promo related recommended comment comments reply replies disqus share social hidden nav footer aside".split())
RAW = frozenset("script style textarea title iframe noscript".split())
MAIN = frozenset("article main".split())

#: Elements that an opening one closes where their end tags were left out, up to one of the elements after the bar.
CLOSED = {k: (frozenset(v.split()), frozenset(w.split())) for k, v, w in (("li", "li", "ul ol menu"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td", "td th", "table tr"), ("th", "td th", "table tr"), ("tbody", "thead tbody tr td th", "table"), ("tfoot", "thead tbody tr td th", "table"), ("option", "option", "select"))}
#: What may stand in a head; anything else ends it.
HEAD = frozenset("base link meta noscript script style template title head".split())

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")  # in order, so that values are passed over
SPACE = re.compile(r"\s+")

COMMENT_END = re.compile(r"--!?>")
END_TAG = re.compile(r"</([a-zA-Z][^\s/>]*)")

#: Of a block: inside an article; outside; inside what quotes or is said by readers; inside another marked element,
#: whose own text is none of the page's but which may hold the article.
ARTICLE, OUTSIDE, NEVER, WRAPPER = 0, 1, 2, 3

#: Counts of a result's row: characters, blocks, blocks that are repeats, repeats that the check restores.
COUNTS = ["n_chars", "n_blocks", "n_repeated", "n_restored"]


def mark_of(token: str) -> str:
    """The mark in a class or id, if the whole of it is one, perhaps beside neutral words; else the empty string."""
    if token in MARKS:
        return token
    parts = [p for p in re.split(r"[-_]+", token) if p]
    marks = [p for p in parts if p in MARKS]
    return marks[0] if marks and all(p in MARKS or p in NEUTRAL or p.isdigit() for p in parts) else ""


def marks_of(attributes: str) -> set[str]:
    """The marks that an element's attributes give it."""
    out = set()
    for key, value in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            out.add("hidden")
        elif key == "role" and value in ROLES:
            out.add(value)
        elif key in ("class", "id"):
            out |= {m for t in value.split() if (m := mark_of(t))}
    return out


def unwanted(name: str, attributes: str) -> bool:
    """Whether an element's name or attributes say that it is no article text."""
    return name in CHROME or bool(attributes and marks_of(attributes))


def zone_inside(name: str, attributes: str, zone: int) -> int:
    """The zone of an element's content, given that around it. A main or article element is the page's text but where
    it is quoted or said by readers; a main element is it in a marked wrapper of any other kind. Headers inside an
    article are article text unless they are marked as something else."""
    marks = marks_of(attributes)
    if name in MAIN and not marks & QUOTING:
        return zone if zone == NEVER else ARTICLE
    if zone == NEVER or marks & QUOTING or name in QUOTING:
        return NEVER
    if marks or name in CHROME and not (name == "header" and zone == ARTICLE):
        return NEVER if zone == ARTICLE else WRAPPER
    return zone


class EndTags:
    """Where the end tags of each name stand in a page, found in one pass when the first is asked for."""

    def __init__(self, page: str):
        self.page, self.places = page, None

    def after(self, name: str, place: int) -> int | None:
        """Where the next end tag of ``name`` from ``place`` on ends; None without one."""
        if self.places is None:
            self.places = {}
            for m in END_TAG.finditer(self.page):
                self.places.setdefault(m[1].lower(), []).append(m.start())
        own = self.places.get(name, ())
        k = bisect.bisect_left(own, place)
        if k == len(own):
            return None
        end = self.page.find(">", own[k])
        return len(self.page) if end < 0 else end + 1


def tags(page: str):
    """(start, end, name, whether it is an end tag, attributes) of the page's tags in order, in linear time; the
    name is empty for comments and declarations. A consumer may send a place to go on from. Quotes that do not
    close, and a tag that would run to the page's end inside quotes, are taken as if there were no quotes."""
    size, at = len(page), 0
    final = {c: page.rfind(c) for c in (">", '"', "'", "]]>")}
    while 0 <= (start := page.find("<", at)) < final[">"]:
        at = start + 1
        if page.startswith("!--", at):
            m = COMMENT_END.search(page, at + 1)
            if m and m.start() == at + 1 and m[0] == "--!>":  # those are the opening dashes
                m = COMMENT_END.search(page, at + 3)
            name, closing, inner, at = "", False, "", m.end() if m else size
        elif page.startswith("![CDATA[", at) and at < final["]]>"]:
            name, closing, inner, at = "", False, "", page.find("]]>", at) + 3
        elif page[at] in "!?":
            name, closing, inner, at = "", False, "", page.find(">", at) + 1
        elif m := NAME.match(page, at):
            end = m.end()
            while (stop := STOP.search(page, end)) and stop[0] != ">":
                quote = stop.start()
                end = page.find(stop[0], quote + 1) + 1 if quote < final[stop[0]] else quote + 1
            end = stop.start() if stop else page.find(">", m.end())
            name, closing, inner, at = m[1].lower(), page[at] == "/", page[m.end() : end], end + 1
        else:
            continue
        to = yield start, at, name, closing, inner
        if to is not None:
            at = to
            yield None


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks in order; zone ARTICLE inside article or main, NEVER inside what
    is marked as something else, OUTSIDE elsewhere. Tags may be unclosed: an end tag closes what is open in it,
    the elements whose end tags may be left out end where the standard says, and an end tag without a start is
    ignored. Headers inside an article are article text."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # name, zone inside
    zone, skip, parts, at = OUTSIDE, 0, [], 0
    opened: dict[str, list[int]] = {}  # places on the stack of each name
    end_tags = EndTags(page)

    def end_block():
        if parts:
            text = SPACE.sub(" ", html_module.unescape("".join(parts))).strip()
            if text:
                out.append((NEVER if zone == WRAPPER else zone, text))
            parts.clear()

    def close(k: int):
        """Ends the open elements from the k-th on."""
        nonlocal skip, zone
        for x, _ in stack[k:]:
            opened[x].pop()
            skip -= x in SKIPPED
        del stack[k:]
        zone = stack[-1][1] if stack else OUTSIDE

    scanner = tags(page)
    for start, end, name, closing, attributes in scanner:
        if start > at and not skip:
            parts.append(page[at:start])
        at = end
        if not name:
            continue
        block = name in BLOCKS
        if closing:
            if block or name in SKIPPED:
                if block and not skip:
                    end_block()
                if opened.get(name):
                    close(opened[name][-1])
            continue
        if opened.get("head") and name not in HEAD:
            close(opened["head"][0])
        if block and not skip:
            end_block()
        if block and name != "br" and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if name in CLOSED:
            ends, stops = CLOSED[name]
            above = max((opened[x][-1] for x in stops if opened.get(x)), default=-1)
            lowest = len(stack)
            for x in ends:
                own = opened.get(x, ())
                k = bisect.bisect_right(own, above)
                lowest = min(lowest, own[k] if k < len(own) else lowest)
            close(lowest)
        if name in VOID or attributes.endswith("/") and not block:
            continue
        if name in RAW:  # its content is not markup
            at = end_tags.after(name, at) or len(page)
            scanner.send(at)
        elif block or name in SKIPPED:
            inside = zone if name in ("body", "html") else zone_inside(name, attributes, zone)
            opened.setdefault(name, []).append(len(stack))
            stack.append((name, inside))
            zone = inside
            skip += name in SKIPPED
        elif attributes and unwanted(name, attributes) and (to := end_tags.after(name, at)):  # a marked span or link
            at = to
            scanner.send(at)
    if at < len(page) and not skip:
        parts.append(page[at:])
    end_block()
    return out


def suffix_groups(stream: np.ndarray, page: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array sorted by the first ``least`` tokens, the places in it where another substring of that
    length begins, and each one's number of distinct pages. stream: token numbers, block ends as numbers of
    their own; page: each token's page, ascending.

    Prefix doubling stops at ``least``: suffixes of equal rank share a substring of that length, and longer
    repeats are unions of these.
    """
    n = len(stream)
    rank, width = stream.astype(np.int64), 1
    base = max(n, int(stream.max())) + 2
    while width < least:
        step = min(width, least - width)  # the overlap of two ranks is allowed: both start inside
        both = rank * base  # a pair of ranks as one number
        both[: n - step] += rank[step:] + 1
        order = np.argsort(both)
        both = both[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(both[1:] != both[:-1])))
        width += step
    suffixes = np.argsort(rank, kind="stable")
    r, p = rank[suffixes], page[suffixes]
    start = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    # stable: pages ascend inside a group, so distinct pages are the changes
    change = np.concatenate(([True], (p[1:] != p[:-1]) | (r[1:] != r[:-1])))
    return suffixes, start, np.add.reduceat(change.astype(np.int64), start)


def spread(at: np.ndarray, n: int, least: int) -> np.ndarray:
    """Marks of the ``n`` tokens inside substrings of ``least`` tokens that start at ``at``."""
    edge = np.zeros(n + least + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + least, -1)
    return np.cumsum(edge)[:n] > 0


def substring_keys(tokens: np.ndarray) -> np.ndarray:
    """64-bit keys of substrings, given the hashes of their LEAST tokens in rows."""
    x = (tokens * _PLACE).sum(axis=1, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


class Chunk:
    """The token stream of some pages' blocks, each followed by a number of its own. Shorter blocks than LEAST are
    filled up, so that they count as they are."""

    def __init__(self, pages: list[list[str]]):
        number: dict[str, int] = {}
        stream, sizes, owner = [], [], []
        for k, texts in enumerate(pages):
            for text in texts:
                tokens = [number.setdefault(t, len(number) + 1) for t in text.split(" ")]
                tokens += [0] * (LEAST - len(tokens))
                sizes.append(len(tokens))
                owner.append(k)
                stream += tokens
                stream.append(-len(sizes))  # a block's end: equal to nothing
        self.number, self.tokens = number, np.array(stream, np.int64)
        self.sizes, self.owner = np.array(sizes, np.int64), np.array(owner, np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes + 1)))[:-1]

    def of_tokens(self, of_blocks: np.ndarray) -> np.ndarray:
        return np.repeat(of_blocks, self.sizes + 1)

    def keys(self, at: np.ndarray) -> np.ndarray:
        """Keys of the substrings that start at ``at`` and end in their blocks."""
        import xxhash

        hashes = np.array([0, *(xxhash.xxh64_intdigest(t) for t in self.number)], np.uint64)
        out = np.empty(len(at), np.int64)
        for k in range(0, len(at), 1 << 18):  # rows of LEAST numbers are large
            out[k : k + (1 << 18)] = substring_keys(hashes[self.tokens[at[k : k + (1 << 18), None] + np.arange(LEAST)]])
        return out

    def inside(self, at: np.ndarray) -> np.ndarray:
        """Which of the substrings that start at ``at`` end in their blocks."""
        left = self.of_tokens(self.starts + self.sizes)[at] - at
        return left >= LEAST

    def counted(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes in order, where another substring of LEAST tokens begins there, and on how many distinct pages each
        occurs, at all and in flagged blocks."""
        page, flag = self.of_tokens(self.owner), self.of_tokens(flags)
        suffixes, start, pages = suffix_groups(self.tokens - self.tokens.min(), page, LEAST)
        group = np.repeat(np.arange(len(start)), np.diff(start, append=len(suffixes)))
        own = flag[suffixes]
        g, p = group[own], page[suffixes][own]
        change = np.ones(len(g), bool)
        change[1:] = (g[1:] != g[:-1]) | (p[1:] != p[:-1])
        return suffixes, start, pages, np.bincount(g[change], minlength=len(start))

    def covered(self, at: np.ndarray, cover: float = COVER) -> np.ndarray:
        """Which blocks lie in the substrings that start at ``at`` by ``cover`` or more."""
        if not len(self.sizes):
            return np.empty(0, bool)
        return np.add.reduceat(spread(at, len(self.tokens), LEAST).astype(np.int64), self.starts) / self.sizes >= cover


def substrings(pages: list[list[str]], judged: list[list[bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one chunk: keys of its distinct substrings of LEAST tokens, each one's number of distinct pages, and
    whether it stands in a judged block."""
    keys, n, m = offers(Chunk(pages), np.array([x for flags in judged for x in flags], bool))
    return keys, n, m > 0


def offers(chunk: Chunk, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a chunk's distinct substrings of LEAST tokens and each one's number of distinct pages, at all and in
    flagged blocks."""
    if not len(chunk.sizes):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    suffixes, start, n, m = chunk.counted(flags)
    own = chunk.inside(suffixes[start])
    return chunk.keys(suffixes[start][own]), n[own], m[own]


def among(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of ``keys`` in the ascending ``known``, and which of them are there."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    where = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return where, known[where] == keys


def packed(keys: np.ndarray) -> bytes:
    """Ascending unsigned keys as planes of the bytes of their differences."""
    return zlib.compress(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def uncovered(texts: list[str], found: np.ndarray, cover: float = COVER) -> list[str]:
    """The blocks of which less than ``cover`` lies in substrings of the keys ``found``."""
    import xxhash

    out = []
    for text in texts:
        hashes = np.array([xxhash.xxh64_intdigest(t) for t in text.split(" ")], np.uint64)
        hashes = np.concatenate((hashes, np.zeros(max(0, LEAST - len(hashes)), np.uint64)))
        keys = substring_keys(np.lib.stride_tricks.sliding_window_view(hashes, LEAST))
        if spread(np.flatnonzero(np.isin(keys, found)), len(hashes), LEAST).mean() < cover:
            out.append(text)
    return out


def settled(found: list[tuple[int, str]]) -> str | None:
    """The main text where markup settles it; None for a page with blocks to judge. This and the steps below decide
    page by page, given keys; ``checked`` decides on a chunk at once, and the tests hold one against the other."""
    if any(zone == OUTSIDE for zone, _ in found):
        return None
    return "\n".join(text for zone, text in found if zone == ARTICLE)


def outside(found: list[tuple[int, str]]) -> tuple[list[str], list[bool]]:
    """The blocks outside articles, and which of them are to be judged."""
    rest = [(text, zone == OUTSIDE) for zone, text in found if zone != ARTICLE]
    return [t for t, _ in rest], [j for _, j in rest]


def candidates(found: list[tuple[int, str]]) -> tuple[list[str], list[bool]]:
    """A page's blocks that may stay, in order, and which of them are article text."""
    own = [(text, zone == ARTICLE) for zone, text in found if zone != NEVER]
    return [t for t, _ in own], [a for _, a in own]


def judged_text(texts: list[str], article: list[bool], keys: np.ndarray) -> str:
    """The article's blocks and the uncovered ones, in order."""
    return "\n".join(t for t, own in zip(texts, article) if own or uncovered([t], keys))


def checked(pages: list[list[tuple[int, str]]], repeat: np.ndarray, chrome: np.ndarray) -> pa.Table:
    """text, n_chars, n_blocks, n_repeated, n_restored of pages, given which of their blocks are repeats and which are
    so outside articles alone. Repeats go; then the check by markup restores those inside articles and what only
    articles repeat, and takes away what is marked as no article text."""
    out, k = [], 0
    for found in pages:
        stay, repeated, restored = [], 0, 0
        for zone, text in found:
            keep = zone == ARTICLE or zone == OUTSIDE and not chrome[k]
            if keep:
                stay.append(text)
            if repeat[k]:
                repeated += 1
                restored += keep
            k += 1
        text = "\n".join(stay)
        out.append((text, len(text), len(found), repeated, restored))
    columns = list(zip(*out)) or [[]] * 5
    return pa.table([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["text", *COUNTS])


def bundle(pages: list[list[tuple[int, str]]]) -> bytes:
    """Pages' blocks, none of which is empty or holds a line feed, as one compressed text with its length before it."""
    text = "\n\n".join("\n".join(f"{zone}{text}" for zone, text in found) for found in pages).encode()
    return len(text).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(text, asbytes=True)


def unbundled(data: bytes) -> list[list[tuple[int, str]]]:
    text = pa.Codec("zstd").decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True).decode()
    return [[(int(x[0]), x[1:]) for x in page.split("\n")] if page else [] for page in text.split("\n\n")]


def flat(pages: list[list[tuple[int, str]]]) -> tuple[Chunk, np.ndarray]:
    """The pages' stream, and which blocks stand outside articles."""
    return Chunk([[text for _, text in found] for found in pages]), np.array([zone != ARTICLE for found in pages for zone, _ in found], bool)


def host_of(url: F.Column) -> F.Column:
    """The host in lower case; the empty string for a null or relative address."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars per row of ``pages``, its number of blocks, of those that are repeats on the host's pages,
    and of the repeats that the check by markup restores.

    A null or empty html gives an empty text, a null url the empty host. Very long pages are parsed whole, in linear
    time. Repeated rows give a row each; copies of a page in one host repeat its text on distinct rows, which removes
    nothing inside an article. An empty table has no row; other columns, whatever their names, are not read.
    Substrings are told apart by 64-bit keys inside a host of several chunks.
    """
    rows = pages.select(quoted(id_col).alias("id"), quoted(url_col).cast("string").alias("url"), quoted(html_col).alias("html"), host_of(quoted(url_col)).alias("host"))
    kind = rows.schema["id"].dataType.simpleString()
    # hosts larger than a chunk, so few that all tasks may know them
    large = rows.groupBy("host").agg(F.sum(F.length("html")).alias("n")).where(F.col("n") > CHUNK_CHARS).select("host", F.ceil(F.col("n") / CHUNK_CHARS).alias("parts"))
    dealt = rows.withColumn("rid", F.monotonically_increasing_id()).join(F.broadcast(large), "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.select("host", F.pmod(F.xxhash64("rid"), "parts").alias("part"), "parts", "id", "url", "html")

    def parse(batches):
        for b in batches:
            for part in pieces(b, "html", 8 << 20):
                found = [blocks(h or "") for h in part["html"].to_pylist()]
                places: dict[tuple, list[int]] = {}
                for k, place in enumerate(zip(*(part[c].to_pylist() for c in ("host", "part", "parts")))):
                    places.setdefault(place, []).append(k)
                ends = np.cumsum([0, *map(len, places.values())])
                order = pa.array([k for own in places.values() for k in own])
                ids, urls = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), part[c].take(order)) for c in ("id", "url"))
                bundles = pa.array([bundle([found[k] for k in own]) for own in places.values()], pa.binary())
                yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*places)), ids, urls, bundles], ["host", "part", "parts", "ids", "urls", "blocks"])

    place = "host string, part long"
    stored = written(dealt.mapInArrow(parse, f"{place}, parts long, ids array<{kind}>, urls array<string>, blocks binary"), "html-blocks")
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def offer(table: pa.Table) -> pa.Table:
        """A chunk's substrings, in buckets of keys."""
        keys, *counts = offers(*flat([x for b in table["blocks"].to_pylist() for x in unbundled(b)]))
        keys = keys.view(np.uint64)
        order = np.argsort(keys)
        keys, (at_all, outside_of) = keys[order], (np.minimum(c, PAGES)[order] for c in counts)
        both = (at_all + (PAGES + 1) * outside_of).astype(np.uint8)
        buckets = np.uint64(-(-table["parts"][0].as_py() // MEETING))
        own, at = np.unique((keys >> np.uint64(32)) * buckets >> np.uint64(32), return_index=True)
        cuts = list(zip(at, [*at[1:], len(keys)]))
        host, part = ([table[c][0].as_py()] * len(own) for c in ("host", "part"))
        columns = [pa.array(host, pa.string()), pa.array(part, pa.int64()), pa.array(own.astype(np.int64))]
        columns += [pa.array([packed(keys[a:b]) for a, b in cuts], pa.binary()), pa.array([zlib.compress(both[a:b].tobytes(), 1) for a, b in cuts], pa.binary())]
        return pa.table(columns, ["host", "part", "bucket", "keys", "counts"])

    def meet(table: pa.Table) -> pa.Table:
        """To each chunk, those of its keys in a bucket that occur on several pages of the host, and whether they do
        so outside articles."""
        keys = [unpacked(x) for x in table["keys"].to_pylist()]
        counts = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint8) for x in table["counts"].to_pylist()])
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        repeat = np.bincount(which, counts % (PAGES + 1))[which] >= PAGES
        chrome = np.bincount(which, counts // (PAGES + 1))[which] >= PAGES
        some, more, a = [], [], 0
        for x in keys:
            own = repeat[a : a + len(x)]
            some.append(packed(x[own]))
            more.append(zlib.compress(chrome[a : a + len(x)][own].tobytes(), 1))
            a += len(x)
        return pa.table([table["host"], table["part"], pa.array(some, pa.binary()), pa.array(more, pa.binary())], ["host", "part", "keys", "chrome"])

    offered = stored.where("parts > 1").select("host", "part", "parts", "blocks").repartition(n, "host", "part").groupBy("host", "part")
    offered = offered.applyInArrow(offer, f"{place}, bucket long, keys binary, counts binary")
    repeats = written(offered.groupBy("host", "bucket").applyInArrow(meet, f"{place}, keys binary, chrome binary"), "html-repeats")

    def judge(table: pa.Table, repeats: pa.Table) -> pa.Table:
        """The pages of a chunk, given its repeats in the host where that has others; both are bounded by the chunk."""
        found = [x for b in table["blocks"].to_pylist() for x in unbundled(b)]
        chunk, outer = flat(found)
        if not len(chunk.sizes):
            repeat = chrome = np.empty(0, bool)
        elif table["parts"][0].as_py() == 1:
            suffixes, start, *counts = chunk.counted(outer)
            size = np.diff(start, append=len(suffixes))
            repeat, chrome = (chunk.covered(suffixes[np.repeat(c >= PAGES, size)]) for c in counts)
        else:
            known = np.concatenate([np.empty(0, np.uint64), *map(unpacked, repeats["keys"].to_pylist())])
            outside_of = np.concatenate([np.empty(0, bool), *(np.frombuffer(zlib.decompress(x), bool) for x in repeats["chrome"].to_pylist())])
            order = np.argsort(known)
            at = np.arange(len(chunk.tokens))
            at = at[chunk.inside(at)]
            where, hit = among(chunk.keys(at).view(np.uint64), known[order])
            repeat, chrome = chunk.covered(at[hit]), chunk.covered(at[hit][outside_of[order][where[hit]]])
        text = checked(found, repeat, chrome)
        ids, urls = (pa.concat_arrays([x.flatten() for x in table[c].chunks]) for c in ("ids", "urls"))
        return pa.table([ids, urls, *text.columns], [id_col, "url", *text.column_names])

    result = f"`{id_col}` {kind}, url string, text string, " + ", ".join(f"{c} long" for c in COUNTS)
    chunks = stored.select("host", "part", "parts", "ids", "urls", "blocks").repartition(n, "host", "part")
    return chunks.groupBy("host", "part").cogroup(repeats.groupBy("host", "part")).applyInArrow(judge, result)

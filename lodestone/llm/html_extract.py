"""HTML extraction with a host suffix array.

Pages are parsed into blocks (runs of text between block-level tags; character references
decoded, white space to one space). Markup says of each block whether it is boilerplate for
sure (scripts, menus, forms, adverts, comments and so on, by element, role or class), whether it
belongs to an article element, or neither.

For each host, the token streams of all blocks are concatenated page by page and sorted into
suffix arrays (prefix doubling, up to MIN_TOKENS symbols deep: equality up to that depth is all that
counts), one of what lies outside article elements and one of what lies inside. Suffixes that agree so
far and stem from distinct pages are long repeated substrings; a block of which they cover more than a
half is repeated. What that means depends on the markup around it:

* On pages without an article element, a repeated block is boilerplate, and goes. A page all of whose
  blocks repeat elsewhere is a copy, not a template, and keeps them.
* Inside an article, repetition alone is not enough, as a passage that two articles share is part of
  both. A repeated block goes if its context (the path of block elements with their classes and ids) is
  mostly repeated on that host, over CONTEXT_PAGES pages or more: that is a template's element, whatever
  its class is called. It also goes if it lies on most pages of its host that have an article (FREQUENT_PAGES at
  least), unless more than half of the article would go that way: such pages are copies of each other.
  Pages whose article is mostly repeated don't count for contexts.

A page's text is that of its article elements; without one, of its main container or else of its body.

Hosts of any size: a host's pages are dealt by hash over shards of about SHARD_BYTES, thousands of pages each.
What counts is the whole host, outside articles and inside: shards of a
split host send the hashes of their prefixes, each once with its number of pages, to buckets, which
add them up and tell every shard the host's number of pages for each of its prefixes that several hold, and the number of
pages with an article. A page lies in one shard, so the sums are those of the host, and the size of a shard changes no result. Hashes have 40 bits, which
decide about a block only where several in a row collide. Contexts are summed over the shards, too. Streams travel compressed, article text
twice (once where no host is split); hashes travel as differences. The blocks to drop are joined to the pages by broadcast below a counted size, else by shuffle.

Nulls: a null html is an empty page with empty text, a null url belongs to the host "". Rows
that share page_id, url and html are one page for counting distinct pages, and all are returned; so are those
that share a page_id alone, each with its own text. Empty tables give empty results. Parsing takes
time in proportion to the page, however long, deep or malformed it is. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, saved, table

MIN_TOKENS, COVERED = 5, 0.5
#: Pages on which a block must lie to be on most of a host's, and pages that speak for a context.
FREQUENT_PAGES, CONTEXT_PAGES = 4, 3
#: Bytes of html a shard, and shards at most before they grow up to the second size.
SHARD_BYTES, LARGEST_SHARD_BYTES, MOST_SHARDS = 8 << 20, 64 << 20, 32_768
#: Shards whose prefixes fill about one bucket.
BUCKET_SHARDS = 8
BROADCAST_ROWS = 500_000

#: A tag with its attributes (no ">" where a quote is never closed), or the start of a comment or declaration. Possessive: nothing is tried twice.
_OPEN = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(>))?|!--|[!?/])""")
_NAME = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|!--|[!?/])")
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW = frozenset("script style textarea title noscript template iframe svg math object audio video canvas xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_DROP = frozenset("head nav footer aside form menu select button dialog datalist fieldset label".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id attributes that mark boilerplate.
_DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu footer sidebar aside banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "widget widgets related recommended recommendations trending share sharing social breadcrumb breadcrumbs pagination pager newsletter subscribe subscription signup login search comment comments disqus respond replies copyright disclaimer skip toolbar".split()
)
_MAIN_WORDS = frozenset("content article post entry story main articlebody".split())
BODY, MAIN, ARTICLE, DROP = 0, 1, 2, 3
#: An opening tag of these ends an open paragraph.
_ENDS_P = _BLOCK - {"body", "html", "head", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}


@dataclass(frozen=True)
class Block:
    text: str
    kind: int
    #: A hash of the block elements around it, with their classes and ids.
    context: int = 0


def _kind(tag: str, attributes: str, around: int) -> tuple[int, set[str]]:
    """What an element makes of its content, and the words of its class and id."""
    if around == DROP or tag in _DROP or (tag == "header" and around == BODY):
        return DROP, set()
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    words = set(re.split(r"[\s_\-:]+", f"{found.get('class', '')} {found.get('id', '')}")) - {""} if found else set()
    if tag not in ("body", "html", "article", "main") and (words & _DROP_WORDS or "header" in words and around == BODY) or tag == "article" and words & {"comment", "comments", "ad", "advert", "related"}:
        return DROP, words
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in _DROP_ROLES:
        return DROP, words
    if tag == "article" or found.get("itemprop") == "articlebody" or found.get("role") == "article":
        return ARTICLE, words
    if around == BODY and (tag == "main" or found.get("role") == "main" or tag in ("div", "section") and words & _MAIN_WORDS):
        return MAIN, words
    return around, words


class _Tags:
    """Tags and the places between them, front to back. Quotes hide a ">"; once one is never closed, they no longer do."""

    def __init__(self, html: str):
        self.html, self.quotes, self.last = html, True, html.rfind(">")

    def next(self, at: int):
        """(start, end, closing, name, attributes) of the next tag or comment (no name), or None."""
        html = self.html
        m = (_OPEN if self.quotes else _NAME).search(html, at)
        if not m:
            return None
        name, start, end = m[2], m.start(), m.end()
        if name and self.quotes:
            if m[4]:
                return start, end, m[1], name.lower(), m[3]
            self.quotes, end = False, m.end(2)
        if html.startswith("<!--", start):
            end = html.find("-->", end)
            return start, len(html) if end < 0 else end + 3, "", None, ""
        if start > self.last:
            return None
        begin, end = end, html.find(">", end) + 1
        return start, end, m[1] or "", name and name.lower(), html[begin : end - 1]

    def raw_end(self, tag: str, at: int) -> int:
        """Behind the closing tag of a raw element that is open at at."""
        m = _CLOSES[tag].search(self.html, at)
        return (self.html.find(">", m.end()) + 1 or len(self.html)) if m else len(self.html)


_CLOSES = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in _RAW}


def parse(html: str) -> list[Block]:
    """Blocks in page order, those without text left out."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []
    open_: dict[str, int] = {}
    held: list[str] = []
    kind, context, at, tags = BODY, 0, 0, _Tags(html)

    def end_block():
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append(Block(text, kind, context))
            held.clear()

    def leave(tag):
        """Closes the innermost open element of that name and all inside it."""
        while True:
            name = stack.pop()[0]
            open_[name] -= 1
            if name == tag:
                return stack[-1][1:] if stack else (BODY, 0)

    while found := tags.next(at):
        start, end, closing, tag, attributes = found
        if start > at:
            held.append(html[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if tag in _BLOCK:
                end_block()
            if open_.get(tag):
                # Text so far belongs to what was open; a change of kind ends its block.
                new = leave(tag)
                if new[0] != kind:
                    end_block()
                kind, context = new
            continue
        if tag in _RAW:
            if not attributes.endswith("/") or tag in ("script", "style"):
                at = tags.raw_end(tag, at)
            held.append(" ")
            continue
        if tag in _BLOCK:
            end_block()
        if tag == "br":
            held.append(" ")
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            continue
        if tag in _ENDS_P and open_.get("p"):
            kind, context = leave("p")
        new, words = _kind(tag, attributes, kind)
        if new != kind:
            end_block()
        kind = new
        if tag in _BLOCK:
            context = xxhash.xxh3_64_intdigest(f"{context} {tag} {' '.join(sorted(words))}".encode("utf-8", "surrogatepass")) >> 1
        stack.append((tag, kind, context))
        open_[tag] = open_.get(tag, 0) + 1
    held.append(html[at:])
    end_block()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", url or "", re.I)
    return m[1].lower() if m else ""


def best_kind(kinds) -> int | None:
    """Where the text of a page with blocks of these kinds is."""
    return next((k for k in (ARTICLE, MAIN, BODY) if k in kinds), None)


def n_tokens(text: str) -> int:
    return text.count(" ") + 1


def main_text(blocks: list[Block], repeated: frozenset[int] | set[int], frequent: frozenset[int] | set[int] = frozenset()) -> str:
    """repeated: numbers of blocks that the suffix array finds to be a template's; frequent: those on most pages of the host."""
    best = best_kind({b.kind for b in blocks})
    if best is None:
        return ""
    own = [(i, b.text) for i, b in enumerate(blocks) if b.kind == best]
    gone = sum(n_tokens(t) for i, t in own if i in repeated or i in frequent)
    if gone <= COVERED * sum(n_tokens(t) for _, t in own):
        repeated = repeated | frequent
    return "\n".join(t for _, t in [x for x in own if x[0] not in repeated] or own)


def prefix_ranks(ids: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of suffixes by their first depth symbols, by prefix doubling. ids: non-negative; suffixes that reach the end are padded with -1."""
    rank, span = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while span < depth:
        step = min(span, depth - span)
        after = np.full(len(rank), -1, dtype=np.int64)
        if step < len(rank):
            after[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        span += step
    return rank


HASH_BITS = 40


def _mixed(words: list[str], ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Hashes of the depth tokens from each place on. ids: numbers in words."""
    own = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=len(words))
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(depth if len(own) else 0):
        h = (h ^ own[ids[at + k]]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h >> np.uint64(64 - HASH_BITS)


def _numbered(streams: list[list[str]]) -> tuple[list[str], np.ndarray]:
    """The distinct tokens, and the number of each token of all streams in a row."""
    numbers: dict[str, int] = {}
    parts: list[int] = []
    for i, tokens in enumerate(streams):
        parts += [numbers.setdefault(t, len(numbers)) for t in tokens]
        parts.append(-1 - i)  # a separator of its own, so that no substring goes on into the next page
    return list(numbers), np.array(parts, dtype=np.int64)


def _whole(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places from which depth tokens lie in one stream."""
    if len(ids) < depth:
        return np.zeros(0, np.int64)
    run = np.cumsum(np.concatenate([[0], (ids >= 0).astype(np.int64)]))
    return np.flatnonzero(run[depth:] - run[:-depth] == depth)


def prefixes(streams: list[list[str]], depth: int = MIN_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, of what begins anywhere in the streams, and the number of streams that hold each: as an array's groups, without their order."""
    words, ids = _numbered(streams)
    at = _whole(ids, depth)
    owner = np.repeat(np.arange(len(streams), dtype=np.uint64), [len(s) + 1 for s in streams])
    both = np.unique(_mixed(words, ids, at, depth) << np.uint64(64 - HASH_BITS) | owner[at])
    h = both >> np.uint64(64 - HASH_BITS)
    heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
    return h[heads], np.diff(np.append(heads, len(h)))


class Array:
    """The suffix array of several streams: suffixes of depth tokens within their page, in the order of their ranks, and groups of those that agree."""

    def __init__(self, streams: list[list[str]], pages: list[int], depth: int = MIN_TOKENS):
        self.words, self.ids = _numbered(streams)
        self.depth, ids = depth, self.ids
        self.sizes = np.array([len(s) for s in streams], dtype=np.int64)
        owner = np.repeat(np.unique(np.array(pages), return_inverse=True)[1] if len(pages) else np.zeros(0, np.int64), self.sizes + 1)
        rank = prefix_ranks(ids - ids.min(initial=0), depth)
        real = _whole(ids, depth)
        self.suffixes = real[np.lexsort((owner[real], rank[real]))]
        r, page = rank[self.suffixes], owner[self.suffixes]
        begins = np.concatenate([[True], r[1:] != r[:-1]])[: len(r)]
        self.heads = np.flatnonzero(begins)
        self.members = np.diff(np.append(self.heads, len(r)))
        #: Distinct pages of each group.
        fresh = begins | np.concatenate([[True], page[1:] != page[:-1]])[: len(r)]
        self.pages = np.add.reduceat(fresh.astype(np.int64), self.heads) if len(r) else np.zeros(0, np.int64)

    def hashes(self) -> np.ndarray:
        """HASH_BITS bits for the prefix of each group."""
        return _mixed(self.words, self.ids, self.suffixes[self.heads], self.depth)

    def marks(self, group: np.ndarray) -> list[np.ndarray]:
        """For each stream, which tokens the suffixes of the chosen groups cover."""
        hit = self.suffixes[np.repeat(group, self.members)]
        mark = np.zeros(len(self.ids) + 1, dtype=np.int64)
        np.add.at(mark, hit, 1)
        np.add.at(mark, hit + self.depth, -1)
        out = np.cumsum(mark)[:-1] > 0
        ends = np.cumsum(self.sizes + 1).tolist()
        return [out[e - n - 1 : e - 1] for e, n in zip(ends, self.sizes.tolist(), strict=True)]


def covered(streams: list[list[str]], pages: list[int], more: np.ndarray | None = None, depth: int = MIN_TOKENS) -> tuple[list[np.ndarray], Array]:
    """For each stream (the tokens of one page's blocks in a row): which tokens a substring that several pages hold covers. more: pages of each group over all shards."""
    a = Array(streams, pages, depth)
    return a.marks((a.pages if more is None else more) > 1), a


_HOST = r"^(?i:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#]*@)?([^/?#:]*)"


def _pages(pages: DataFrame) -> DataFrame:
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.col("url").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"), F.xxhash64("page_id", url, html).alias("key"), host.alias("host"))


#: One page on its way to its host: texts of its blocks outside and inside articles (compressed, one a line), the kinds of all, the contexts of those inside.
STREAM = "host string, shard int, shards int, page_id long, key long, kinds binary, outside binary, inside binary, contexts array<long>"


def streams(pages: DataFrame) -> DataFrame:
    """The blocks of every page that has any. pages: as _pages() gives them, with shard and shards."""

    def packed(texts: list[str]) -> bytes | None:
        return zlib.compress("\n".join(texts).encode("utf-8", "surrogatepass"), 1) if texts else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for html in batch.column("html").to_pylist():
            blocks = parse(html)
            article = [b for b in blocks if b.kind == ARTICLE]
            rows.append((bytes(b.kind for b in blocks) or None, packed([b.text for b in blocks if b.kind != ARTICLE]), packed([b.text for b in article]), [b.context for b in article]))
        kinds = (pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        cols = [batch.column(n) for n in ("host", "shard", "shards", "page_id", "key")]
        return pa.RecordBatch.from_arrays([*cols, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], STREAM.replace(",", "").split()[::2])

    return map_slices(pages.select("host", "shard", "shards", "page_id", "key", "html"), "html", run, STREAM).where("kinds is not null")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[dict]]]:
    """Rows of each pair of the first two columns; they come sorted by it."""
    at, held = None, []
    for batch in batches:
        names = batch.schema.names
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != at:
                if held:
                    yield *at, held
                at, held = row[:2], []
            held.append(dict(zip(names[2:], row[2:], strict=True)))
    if held:
        yield *at, held


def _distinct(rows: list[dict]) -> list[dict]:
    """Rows of one page come one after the other."""
    return [r for k, r in enumerate(rows) if not k or (rows[k - 1]["page_id"], rows[k - 1]["key"]) != (r["page_id"], r["key"])]


def _texts(pages: list[dict], part: str) -> tuple[list[list[str]], list[list[str]]]:
    """The texts of the blocks of each page, outside or inside articles, and their tokens in a row."""
    blocks = [zlib.decompress(r[part]).decode("utf-8", "surrogatepass").split("\n") if r[part] else [] for r in pages]
    return blocks, [" ".join(b).split(" ") if b else [] for b in blocks]


def _pack(h: np.ndarray) -> bytes:
    """Ascending hashes: their number, the lower 16 bits of each, and the differences of the rest, byte by byte."""
    rest = np.diff(h >> np.uint64(16), prepend=np.uint64(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
    return len(h).to_bytes(4, "little") + (h & np.uint64(0xFFFF)).astype("<u2").tobytes() + zlib.compress(rest.T.tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    rest = np.ascontiguousarray(np.frombuffer(zlib.decompress(b[4 + 2 * n :]), np.uint8).reshape(4, n).T).view("<u4").reshape(-1)
    return np.cumsum(rest.astype(np.uint64), dtype=np.uint64) << np.uint64(16) | np.frombuffer(b, "<u2", n, 4)


def _pack_counts(n: np.ndarray) -> bytes:
    return zlib.compress(n.astype("<u4").tobytes(), 1)


def _unpack_counts(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), "<u4").astype(np.int64)


def _most(pages: int) -> int:
    """Pages that are most of so many."""
    return max(FREQUENT_PAGES, pages // 2 + 1)


#: Even buckets hold prefixes from outside articles, odd ones those from inside; bucket 1 adds up the pages with an article.
ASKED = "host string, bucket int, shard int, hashes binary, counts binary, articles long"
ANSWERED = "host string, shard int, bucket int, hashes binary, counts binary, articles long"
_ASKS = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
JUDGED = "host string, page_id long, key long, open boolean, blocks array<struct<i:int,context:long,frequent:boolean>>, contexts array<struct<context:long,n:long,covered:long,pages:long>>"


def _asks(rows: list[tuple], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ASKS, strict=True)], schema.replace(",", "").split()[::2])


def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a shard tells each bucket, which has a range of the hashes: hashes and their pages."""
    for host, shard, rows in _groups(batches):
        pages, buckets, out = _distinct(rows), -(-rows[0]["shards"] // BUCKET_SHARDS), []
        for side, part in enumerate(("outside", "inside")):
            h, n = prefixes(_texts(pages, part)[1])
            cuts = np.searchsorted(h, np.array([(b << HASH_BITS) // buckets for b in range(buckets + 1)], np.uint64)).tolist()
            for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                first = side and not b
                if x < y or first:
                    out.append((host, 2 * b + side, shard, _pack(h[x:y]), _pack_counts(n[x:y]), sum(r["inside"] is not None for r in pages) if first else None))
        yield _asks(out, ASKED)


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a bucket tells each shard: those of its hashes that several pages of the host hold, and how many do."""
    for host, bucket, rows in _groups(batches):
        hashes = [_unpack(r["hashes"]) for r in rows]
        distinct, number = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(number, weights=np.concatenate([_unpack_counts(r["counts"]) for r in rows]), minlength=len(distinct)).astype(np.int64)[number]
        articles = sum(r["articles"] for r in rows) if bucket == 1 else None
        ends, out = np.cumsum([len(x) for x in hashes]).tolist(), []
        for r, h, e in zip(rows, hashes, ends, strict=True):
            n = total[e - len(h) : e]
            if (n > 1).any() or bucket == 1:
                out.append((host, r["shard"], bucket, _pack(h[n > 1]), _pack_counts(n[n > 1]), articles))
        if out:
            yield _asks(out, ANSWERED)


def _host_pages(a: Array, told: list[dict]) -> np.ndarray:
    """Pages of the host, instead of the shard, for each group of a shard's array. told: the answers of all buckets."""
    out = np.ones(len(a.heads), dtype=np.int64)
    if told:
        told = sorted(told, key=lambda r: r["bucket"])
        h, n = np.concatenate([_unpack(r["hashes"]) for r in told]), np.concatenate([_unpack_counts(r["counts"]) for r in told])
        if len(h):
            own = a.hashes()
            at = np.minimum(np.searchsorted(h, own), len(h) - 1)
            out = np.where(h[at] == own, n[at], 1)
    return out


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated blocks of each page's main part, and what each context of the shard's articles holds."""
    for host, _, rows in _groups(batches):
        told = [r for r in rows if r["kinds"] is None]
        pages = _distinct([r for r in rows if r["kinds"] is not None])
        if not pages:
            continue
        (outside, x), (inside, y) = (_texts(pages, part) for part in ("outside", "inside"))
        a, c = (Array(t, list(range(len(pages)))) for t in (x, y))
        several, many, articles = a.pages, c.pages, sum(bool(x) for x in inside)
        if pages[0]["shards"] > 1:
            several, many = (_host_pages(arr, [r for r in told if r["bucket"] % 2 == side]) for side, arr in enumerate((a, c)))
            articles = next(r["articles"] for r in told if r["bucket"] == 1)
        out, about = [], {}
        for page, *found in zip(pages, outside, a.marks(several > 1), inside, c.marks(many > 1), c.marks(many >= _most(articles)), strict=True):
            kinds = np.frombuffer(page["kinds"], dtype=np.uint8)
            best = best_kind(set(kinds.tolist()))
            if best is None:
                continue
            texts, repeated, frequent = (found[2], found[3], found[4]) if best == ARTICLE else (found[0], found[1], None)
            # Numbers of the blocks of this part among all of the page.
            number = np.flatnonzero((kinds == ARTICLE) == (best == ARTICLE))
            n = np.array([n_tokens(t) for t in texts])
            begins = np.cumsum(n) - n
            some = np.add.reduceat(repeated.astype(np.int64), begins)
            much = some if frequent is None else np.add.reduceat(frequent.astype(np.int64), begins)
            context = page["contexts"] if best == ARTICLE else [0] * len(n)
            if best == ARTICLE and some.sum() <= COVERED * n.sum():
                seen = set()
                for k, at in enumerate(context):
                    x = about.setdefault(at, [0, 0, 0])
                    x[0] += int(n[k])
                    x[1] += int(some[k])
                    x[2] += at not in seen
                    seen.add(at)
            hit = [k for k in range(len(n)) if kinds[number[k]] == best and some[k] > COVERED * n[k]]
            if hit:
                out.append((host, page["page_id"], page["key"], best != ARTICLE, [{"i": int(number[k]), "context": context[k], "frequent": bool(much[k] > COVERED * n[k])} for k in hit], None))
        if about:
            out.append((host, None, None, None, None, [{"context": c, "n": x, "covered": y, "pages": z} for c, (x, y, z) in about.items()]))
        if out:
            block = pa.struct([("i", pa.int32()), ("context", pa.int64()), ("frequent", pa.bool_())])
            context = pa.struct([(c, pa.int64()) for c in ("context", "n", "covered", "pages")])
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(block), pa.list_(context))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["host", "page_id", "key", "open", "blocks", "contexts"])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def repeated_blocks(pages: DataFrame, shard_bytes: int | None = None) -> DataFrame:
    """page_id, key, i, sure: blocks that go (sure), or go unless their page is a copy. pages: as _pages() gives them."""
    spark = pages.sparkSession
    sizes = saved(pages.groupBy("host").agg(F.sum(F.octet_length("html").cast("long")).alias("bytes")), "html-hosts")
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    each = shard_bytes or min(LARGEST_SHARD_BYTES, max(SHARD_BYTES, total // MOST_SHARDS))
    large = sizes.where(F.col("bytes") > each).select("host", F.ceil(F.col("bytes") / each).cast("int").alias("shards"))
    n_large = large.count()
    dealt = pages.join(_small(large, n_large), "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1))).withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (2 * SHARD_BYTES))
    both = streams(dealt)
    if n_large:
        asked = streams(dealt.where("shards > 1")).repartition(n, "host", "shard").sortWithinPartitions("host", "shard", "page_id", "key").mapInArrow(ask, ASKED)
        # Written before the rest begins, so that the hashes are gone by then.
        answered = saved(asked.repartition(n, "host", "bucket").sortWithinPartitions("host", "bucket", "shard").mapInArrow(answer, ANSWERED), "html-answers")
        both = both.unionByName(answered, allowMissingColumns=True)
    judged = saved(both.repartition(n, "host", "shard").sortWithinPartitions("host", "shard", "page_id", "key").mapInArrow(judge, JUDGED), "html-repeated")
    contexts = judged.where("contexts is not null").select("host", F.explode("contexts").alias("c")).groupBy("host", "c.context").agg(F.sum("c.n").alias("n"), F.sum("c.covered").alias("covered"), F.sum("c.pages").alias("pages"))
    template = contexts.where((F.col("pages") >= CONTEXT_PAGES) & (F.col("covered") > COVERED * F.col("n"))).select("host", "context", F.lit(True).alias("template"))
    found = judged.where("blocks is not null").select("host", "page_id", "key", "open", F.explode("blocks").alias("b")).select("host", "page_id", "key", "open", "b.*").join(template, ["host", "context"], "left")
    sure = F.col("open") | F.coalesce("template", F.lit(False))
    return found.select("page_id", "key", "i", sure.alias("sure"), "frequent").where("sure or frequent").select("page_id", "key", "i", "sure")


def extract(documents: DataFrame, shard_bytes: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page. shard_bytes: html of one shard, for tests."""
    pages = _pages(documents)
    gone = saved(repeated_blocks(pages, shard_bytes), "html-gone")
    count = gone.count()
    needed = gone.groupBy(F.col("page_id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_list(F.when(F.col("sure"), F.col("i"))).alias("repeated"), F.collect_list(F.when(~F.col("sure"), F.col("i"))).alias("frequent"))
    joined = pages.join(_small(needed, count), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(parse(html), set(r or ()), set(f or ())) for html, r, f in zip(*(batch.column(c).to_pylist() for c in ("html", "repeated", "frequent")), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_slices(joined.select("page_id", "url", "html", "repeated", "frequent"), "html", run, "page_id long, url string, text string, n_chars long")


def op8_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

"""WARC and HTML extraction."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import html_extract, warc

PAGES = [
    (1, "http://a.org/x?y=1", "<p>" + "body " * 50 + "</p>"), (2, "http://b.org/é ü\r\nX: y", "<p>" + "body " * 50 + "</p>"), (3, None, None), (4, "http://c.org", ""), (5, "http://c.org", "short"), (6, "http://c.org", "short"), (7, "u", "nul \x00 🙂 " * 30),
    (7, "u", "nul \x00 🙂 " * 30), (None, "n", "<p>" + "body " * 50 + "</p>"), (9, "v", "nul \x00 🙂 " * 30), (-5, "w", "x" * 100), (10**12, "w", "x" * 100), (11, "w", "y" * 99), (12, "w", "y" * 99),
]


@pytest.fixture(scope="module")
def pages(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("shard", "kind", "digest", "key", "host", "n")}).repartition(4)


@pytest.mark.parametrize("roll", [1, 1 << 20])
def test_archive_round_trip(spark, pages, tmp_path, roll):
    out = f"file://{tmp_path}/a"
    manifest = warc.write_archive(pages, out, roll_bytes=roll, shard_bytes=300)
    assert manifest.count() == (len(PAGES) if roll == 1 else manifest.select("shard").distinct().count()) and manifest.select("shard").distinct().count() > 1
    got = warc.read_archive(spark, out).collect()
    first = {}
    for i, _, h in PAGES:
        b = (h or "").encode()
        if i is not None and len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    want = []
    for i, u, h in PAGES:
        b = (h or "").encode()
        to = first.get(b) if i is not None and b in first and i > first[b] else None
        want.append((i, u or "", len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to, b if to is None else None))
    key = repr
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    files = sorted(f for f in os.listdir(tmp_path / "a") if f.endswith(".gz"))
    for m in manifest.collect():
        data = (tmp_path / "a" / m.file).read_bytes()
        assert len(data) == m.bytes and hashlib.sha256(data).hexdigest() == m.sha256
    assert len(files) == manifest.count() and not [f for f in os.listdir(tmp_path / "a") if f.endswith(".tmp")]
    # The same pages in other partitions give the same bytes.
    again = f"file://{tmp_path}/b"
    warc.write_archive(pages.repartition(1), again, roll_bytes=roll, shard_bytes=300)
    assert all((tmp_path / "a" / f).read_bytes() == (tmp_path / "b" / f).read_bytes() for f in files)
    (tmp_path / "a" / "shard-000000-99999.warc.gz").write_bytes(b"left by a lost attempt")
    assert warc.read_archive(spark, out, payloads=False).count() == len(PAGES)


def test_files_roll_as_in_the_query(spark, tmp_path):
    """With the query's own sizes: shards of pages as compressible as prose are more than a file each."""
    rng = random.Random(6)
    vocabulary = words(rng, 3000).split()
    rows = [(i, f"http://a.org/{i}", "<p>" + " ".join(rng.choices(vocabulary, k=2500)) + "</p>") for i in range(600)]
    made = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/q").collect()
    assert len({m.shard for m in made}) > 1 and sum(m.records for m in made) == len(rows)
    several = [m for m in made if sum(x.shard == m.shard for x in made) > 1]
    assert several and max(m.bytes for m in made) < warc.ROLL_BYTES + (1 << 16)


def test_one_id_and_several_payloads(spark, tmp_path):
    """A revisit is decided by the payload of its row, not by its id alone; ids may lie anywhere in 64 bits."""
    a, b, c = ("<p>" + x * 60 + "</p>" for x in ("a ", "b ", "c "))
    far = (1 << 62) + 5
    rows = [(1, "u", a), (5, "u", a), (5, "u", b), (7, "u", b), (5, "u", c), (-far, "u", c), (far, "u", a), ((1 << 63) - 1, "u", "z" * 200), (-(1 << 63), "u", "z" * 200), (None, "u", b)]
    out = f"file://{tmp_path}/r"
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), out, shard_bytes=150)
    got = sorted(((r.page_id, r.payload_digest, r.refers_to, r.payload and bytes(r.payload)) for r in warc.read_archive(spark, out).collect()), key=repr)
    first = {a: 1, b: 5, c: -far, "z" * 200: -(1 << 63)}
    want = []
    for i, _, h in rows:
        to = first[h] if i is not None and i > first[h] else None
        want.append((i, hashlib.sha256(h.encode()).hexdigest(), to, h.encode() if to is None else None))
    assert got == sorted(want, key=repr)


def test_shards_hold_equal_bytes(spark, tmp_path):
    """Far-off ids, one id of many payloads and many null ids: none fills one shard."""
    rows = [(i, "u", f"{i:09d}" * 20) for i in range(400)] + [(1 << 60, "u", "far"), (-(1 << 61), "u", "far too")] + [(500, "u", f"{i:09d}" * 20) for i in range(200)] + [(None, "u", f"{i:09d}" * 21) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    made = warc.write_archive(pages, f"file://{tmp_path}/s", shard_bytes=3600, least_bytes=10**6).collect()
    records = {}
    for m in made:
        records[m.shard] = records.get(m.shard, 0) + m.records
    assert sum(records.values()) == len(rows) and len(records) > 20 and max(records.values()) <= 60
    order = sorted((r.shard, r.page_id) for r in spark.createDataFrame(rows, "page_id long, url string, html string").where("page_id is not null").withColumn("h", F.xxhash64("html")).withColumn("n", F.octet_length("html").cast("long")).transform(lambda d: d.withColumn("shard", warc._shards(d, 3600)[0])).collect())
    assert [i for _, i in order] == sorted(i for i, _, _ in rows if i is not None)


def test_damage_is_found():
    record = warc.encode_record(1, "u", b"payload")
    assert warc.decode_record(record)[2:5] == (7, hashlib.sha256(b"payload").hexdigest(), "response")
    with pytest.raises(ValueError, match="digest"):
        warc.decode_record(record.replace(b"\r\n\r\npayload", b"\r\n\r\npaYload"))


def test_empty_archive(spark, pages, tmp_path):
    out = f"file://{tmp_path}/e"
    assert warc.write_archive(pages.limit(0), out).count() == 0 and warc.read_archive(spark, out).count() == 0


def text(html, repeated=frozenset()):
    return html_extract.main_text(html_extract.parse(html), set(repeated))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("plain &amp; text&nbsp;here", "plain & text here"),
        ("<p>a<b>b</b>  c\n d<br>e<p>f&#233;&lt;", "ab c d e\nfé<"),
        ("<article><h1>T</h1><p>one</p><aside>no</aside><p>two</article><footer>f</footer>", "T\none\ntwo"),
        ('<body class="has-sidebar"><header>h</header><nav>n</nav><main><p>x</p><div class="cookie-notice">c</div></main>', "x"),
        ('<div class="post-content"><p>y</p></div><div id="comments"><p>nice</p></div>', "y"),
        ("<p>a<script>var x='</p><p>no';</script>b<style>p{}</style><!-- <p>no -->c", "a b c"),
        ("<p>a<textarea>no</textarea><select><option>no</select><button>no</button>", "a"),
        ('<article><p>a</p><section class="comments"><article><p>no</p></article></section></article>', "a"),
        ("<p title='a > b'>x</p><p data-x=\"<p>\">y</p>", "x\ny"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
        ("<script>never closed <p>no", ""),
        ("<p>cut <", "cut <"),
        ("<p hidden>no</p><p>yes</p>", "yes"),
        ("a < b and c > d", "a < b and c > d"),
    ],
)
def test_blocks(html, want):
    assert text(html) == want


def test_article_pages(spark, sf_dir):
    """The generator's pages: the text is that of the article element."""
    import html as entities
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(entities.unescape(re.sub(r"</?(b|br)>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        want = "\n".join(x for x in parts if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


@pytest.mark.parametrize("shard_bytes", [None, 400])
def test_templates_without_markup(spark, shard_bytes):
    """Boilerplate in plain divs goes where it repeats on a host, and stays where it doesn't; with one shard a host and with many."""
    rng = random.Random(3)
    menu, promo, foot = words(rng, 8), words(rng, 12), words(rng, 9)
    rows, want = [], {}
    for i in range(24):
        host = "one.org" if i < 20 else f"h{i}.org"
        own = [words(rng, 20), words(rng, 15)]
        # The promotion is on two pages only, which other shards than each other's may hold.
        parts = [menu, own[0], *([promo] if i in (2, 17) else []), own[1], foot]
        rows.append((i, f"http://{host}/{i}", "".join(f"<div>{p}</div>" for p in parts)))
        want[i] = "\n".join(own if i < 20 else parts)
    copy = words(rng, 40)
    rows += [(50, "http://one.org/50", f"<div>{copy}</div>"), (51, "http://one.org/51", f"<div>{copy}</div>")]
    want |= {50: copy, 51: copy}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.extract(pages, shard_bytes).collect()}
    assert got == want


def test_passage_on_several_pages_of_one_shard(spark):
    """A host of two shards: a passage on two pages of the one and on one page of the other goes from all three."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    promo = words(rng, 12)
    own = [words(rng, 20) for _ in range(40)]
    page = lambda i, *parts: (i, f"http://one.org/{i}", "".join(f"<div>{p}</div>" for p in parts))
    schema = "page_id long, url string, html string"
    pages = [page(i, own[i], promo) for i in range(40)]
    shard = {r.page_id: r.shard for r in html_extract._pages(spark.createDataFrame(pages, schema)).select("page_id", F.pmod(F.xxhash64("key"), F.lit(2)).alias("shard")).collect()}
    zero, one = ([i for i in shard if shard[i] == k] for k in (0, 1))
    rows = [pages[i] for i in (*zero[:2], one[0])]
    total = sum(len(r[2]) for r in rows)
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, schema), total - 1).collect()}
    assert got == {i: own[i] for i, _, _ in rows}


@pytest.mark.parametrize("shard_bytes", [None, 8000])
def test_templates_inside_articles(spark, shard_bytes):
    """A notice whose class says nothing goes from inside articles, as it repeats in a context that repeats; a
    passage that two articles share stays, and so do copies. Without the array the notices stay."""
    rng = random.Random(8)
    # Notices: one of two texts, so that no text is on most pages, but their element repeats.
    notices = [words(rng, 14) for _ in range(2)]
    license_ = words(rng, 11)
    shared, copy = words(rng, 25), [words(rng, 30) for _ in range(3)]
    rows, want, plain = [], {}, {}
    for i in range(20):
        own = [words(rng, 40), words(rng, 30), *([shared] if i in (3, 11) else [])]
        head = f'<article><div class="zq-box"><p>{notices[i % 2]}</p></div>'
        rows.append((i, "http://one.org/x", head + "".join(f"<p>{p}</p>" for p in own) + f"<p>{license_}</p></article>"))
        want[i], plain[i] = "\n".join(own), "\n".join([notices[i % 2], *own, license_])
    for i in (30, 31, 32):
        rows.append((i, "http://one.org/y", "<article>" + "".join(f"<p>{p}</p>" for p in copy) + "</article>"))
        want[i] = plain[i] = "\n".join(copy)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in html_extract.extract(pages, shard_bytes).collect()} == want
    assert {r.page_id: html_extract.main_text(html_extract.parse(r.html), set()) for r in pages.collect()} == plain


@pytest.mark.parametrize("shard_bytes", [100, 900, 2500])
def test_shards_change_nothing_inside_articles(spark, shard_bytes):
    """Notices on two pages each, a license on most pages, articles that share a passage: as if the host were not split."""
    rng = random.Random(12)
    notices, license_, shared = [words(rng, 14) for _ in range(12)], words(rng, 11), words(rng, 25)
    rows, want = [], {}
    for i in range(24):
        own = [words(rng, 40), *([shared] if i in (3, 11) else [])]
        last = [license_] if i % 8 else []
        rows.append((i, "http://one.org/x", f'<article><div class="zq-box"><p>{notices[i % 12]}</p></div>' + "".join(f"<p>{p}</p>" for p in [*own, *last]) + "</article>"))
        want[i] = "\n".join(own)
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string").repartition(3)
    whole = [(r.page_id, r.text) for r in html_extract.extract(pages).collect()]
    assert dict(whole) == want and len(whole) == 25
    assert sorted((r.page_id, r.text) for r in html_extract.extract(pages, shard_bytes).collect()) == sorted(whole)


def test_small_hosts_keep_what_articles_share(spark):
    """Five near copies of six pages are on most of a host's pages, and stay whole."""
    rng = random.Random(9)
    parts = [words(rng, 30) for _ in range(4)]
    rows, want = [], {}
    for i in range(6):
        own = [*parts, words(rng, 4)] if i else [words(rng, 50)]
        rows.append((i, "http://one.org/", "<article>" + "".join(f"<p>{p}</p>" for p in own) + "</article>"))
        want[i] = "\n".join(own)
    assert {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == want


@pytest.mark.parametrize(
    "make",
    [
        lambda n: "<div>" * n + "x" + "</p></span>" * n, lambda n: "<div>" * n + "</div>" * n + "x", lambda n: '<a "' * n + "x", lambda n: "<a '\">" * n + "x", lambda n: "<p>y<a b='" * n, lambda n: "<!-- " * n, lambda n: "</script" * n + "<script>" + "</script " * n,
        lambda n: "<p>" + "<b>" * n + "<p>x" * n, lambda n: "<" * n + "x", lambda n: "<div class='a b'>" * n + "x", lambda n: "&amp" * n + "&#" * n, lambda n: '<a ">" ' * n, lambda n: "<textarea></textarea " * n,
    ],
)
def test_malformed_pages_take_linear_time(make):
    import time

    n = 200_000  # about a megabyte; in quadratic time hours
    began = time.perf_counter()
    html_extract.parse(make(n))
    assert time.perf_counter() - began < 20


def brute_covered(streams, pages, depth):
    seen = {}
    for s, p in zip(streams, pages, strict=True):
        for i in range(len(s) - depth + 1):
            seen.setdefault(tuple(s[i : i + depth]), set()).add(p)
    out = []
    for s in streams:
        mark = [False] * len(s)
        for i in range(len(s) - depth + 1):
            if len(seen[tuple(s[i : i + depth])]) > 1:
                mark[i : i + depth] = [True] * depth
        out.append(mark)
    return out


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8])
def test_suffix_array_covers_what_repeats(depth):
    rng = random.Random(depth)
    streams = [[rng.choice("ab c".split()) for _ in range(rng.randint(0, 40))] for _ in range(12)]
    pages = [i // 2 for i in range(12)]
    got, _ = html_extract.covered(streams, pages, None, depth)
    assert [g.tolist() for g in got] == brute_covered(streams, pages, depth)


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_prefixes_are_the_groups_of_an_array(n):
    rng = random.Random(n)
    streams = [[rng.choice("abcdef") for _ in range(rng.randint(0, 2 * n // 30))] for _ in range(30)] if n else []
    h, pages = html_extract.prefixes(streams)
    a = html_extract.Array(streams, list(range(len(streams))))
    assert dict(zip(h.tolist(), pages.tolist(), strict=True)) == dict(zip(a.hashes().tolist(), a.pages.tolist(), strict=True))
    assert html_extract._unpack(html_extract._pack(h)).tolist() == h.tolist() == sorted(h.tolist())


def test_prefix_ranks_sort_suffixes():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 3, 200)
    rank = html_extract.prefix_ranks(ids, 6)
    cut = [tuple(ids[i : i + 6].tolist()) for i in range(200)]
    assert all((cut[i] < cut[j]) == (rank[i] < rank[j]) for i in range(0, 200, 3) for j in range(0, 200, 7))


def test_hosts():
    assert [html_extract.host_of(u) for u in ("http://A.org:80/x", "https://u@b.de?q", "//c.fr/x", "no url", "", None)] == ["a.org", "b.de", "c.fr", "", "", ""]


def test_awkward_pages(spark, pages):
    got = html_extract.extract(pages).collect()
    assert len(got) == len(PAGES) and {r.page_id: r.text for r in got}[3] == ""
    assert html_extract.extract(pages.limit(0)).count() == 0

"""SimHash, line hashing and the suffix array against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import simhash, spans, substring_dedup, suffix_dedup
from lodestone.llm.common import connected_components

from llm_cases import AWKWARD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """Index of the component of each fingerprint, by comparing all pairs."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark, sf_dir, small_batches):
    rows = documents(spark, sf_dir)
    rng = random.Random(5)
    base = rows[0][1].split()
    # Near copies, so that components hold different fingerprints.
    for k in range(30):
        w = list(base)
        w[rng.randrange(len(w))] = f"changed{k}"
        rows.append((10_000 + k, " ".join(w)))
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.components(frame(spark, rows)).collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    least = {}
    for (d, _), c in zip(rows, comp, strict=True):
        least[c] = min(d, least.get(c, d))
    assert got == {d: (f, least[c]) for (d, _), f, c in zip(rows, fps, comp, strict=True)}
    assert len(set(fps[-30:])) > 1 and len({x[1] for x in got.values()}) < len(rows)


@pytest.mark.parametrize("salt_rows", [4096, 8])
def test_no_link_is_lost(spark, monkeypatch, salt_rows):
    """Random chains of fingerprints up to 3 bits apart, with and without many salts."""
    monkeypatch.setattr(simhash, "SALT_ROWS", salt_rows)
    rng = np.random.default_rng(1)
    fps = set()
    for _ in range(40):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(2))
        for _ in range(8):
            fps.add(x)
            for b in rng.choice(64, size=int(rng.integers(1, 5)), replace=False).tolist():
                x ^= 1 << b
    # Degenerate ones too: few bits set, all set, code words.
    fps |= {0, 1, 3, 7, 15, (1 << 64) - 1, (1 << 64) - 8, 0b111, 1 << 62, 1 << 63, (1 << 62) | (1 << 63) | 1}
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    ids = spark.createDataFrame([(s,) for s in signed], "id long")
    edges = simhash.links(ids.select(F.col("id").alias("fp"), "id")).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    for e in edges.collect():
        assert 0 < ((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= 3
    got = {r.id: r.component for r in connected_components(ids, edges).collect()}
    groups = {}
    for s, c in zip(signed, brute_components(fps), strict=True):
        groups.setdefault(c, set()).add(s)
    theirs = {}
    for s, c in got.items():
        theirs.setdefault(c, set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))


def test_simhash_broadcasts_nothing(spark):
    """Sides grow with the input, and a dozen of 10 MB exceeded a driver's memory."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    base = [f"word{i}" for i in range(200)]
    simhash.components(spark.createDataFrame([(i, " ".join([*base[:-1], f"x{i}"])) for i in range(20)], "doc_id long, text string")).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList(int(before), 1000)
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    assert sum("SortMergeJoin" in p for p in plans) > 3 and not any("Broadcast" in p for p in plans)


def test_long_chain(spark):
    n = 200
    ids = spark.range(n).select("id")
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(ids, edges).collect()} == {0}


def test_simhash_awkward(spark, awkward, no_documents):
    got = simhash.components(awkward).collect()
    assert len(got) == len(AWKWARD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert {c for _, c in by[2]} == {1} and {c for _, c in by[3]} == {1} and {c for _, c in by[6]} == {5}
    assert simhash.components(no_documents).count() == 0
    kept = simhash.keep_first(awkward)
    assert kept.columns == awkward.columns and {1, 4, 5, 7, 8} >= {r.doc_id for r in kept.collect() if r.doc_id is not None} >= {1, 4, 5, 7}


def brute_lines(rows, sentences=True):
    seen, out = set(), []
    for _, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            for u in re.split(r"(?<=[.!?])[^\S\n]+", line) if sentences else [line]:
                key = " ".join(u.lower().split())
                if len(key.split()) >= 5:
                    if key in seen:
                        continue
                    seen.add(key)
                kept.append(u)
        out.append("".join("".join(kept).split()))
    return out


@pytest.mark.parametrize("sentences", [True, False])
def test_lines_equal_brute_force(spark, sf_dir, small_batches, sentences):
    rows = sorted(documents(spark, sf_dir))
    got = {r.doc_id: r for r in substring_dedup.removals(frame(spark, rows), sentences=sentences).collect()}
    for (d, t), kept in zip(rows, brute_lines(rows, sentences), strict=True):
        r = got[d]
        assert "".join(r.text.split()) == kept
        at, parts = 0, []
        for s in r.spans:
            parts.append(t[at : s.start])
            at = s.end
        assert "".join([*parts, t[at:]]) == r.text and r.n_removed == len(t) - len(r.text)


def test_paragraphs():
    text = "one two\nthree\n\n \nfour five. Six\n"
    of = lambda **k: [text[a:b] for a, b in substring_dedup.units(text, **k)]
    assert of(unit="paragraph", sentences=False) == ["one two\nthree", "four five. Six"]
    assert of() == ["one two", "three", "four five.", "Six"]


def test_lines_awkward(awkward, no_documents):
    got = substring_dedup.removals(awkward).collect()
    assert len(got) == len(AWKWARD) and substring_dedup.removals(no_documents).count() == 0
    fives = [r for r in got if r.doc_id == 5 and r.text.startswith("same")]
    assert len(fives) == 2 and fives[0] == fives[1]
    assert next(r for r in got if r.doc_id == 6).text == ""


def test_whole_lines_and_copies_go(spark, sf_dir):
    """As in the query: lines of any length and copies go whole, and short sentences inside a passage that repeats."""
    passage = "One two three four five six. Ha. Seven eight nine ten eleven."
    rows = [(1, f"Of.\n{passage}\nNo."), (2, f"Of.\n{passage}\nNo."), (3, "new words stay\nof."), (4, f"Words that are new here today. {passage} Others that are new as well.")]
    got = [r.text for r in sorted(substring_dedup.removals(frame(spark, rows), whole=True).collect(), key=lambda r: r.doc_id)]
    assert got == [rows[0][1], "", "new words stay\n", "Words that are new here today. Others that are new as well."]
    rows = documents(spark, sf_dir)
    rows += [(10_000, rows[0][1]), (10_001, f"Quite new words at the top.\n{rows[1][1]}")]
    got = {r.doc_id: r for r in substring_dedup.op2_substring_dedup(spark, sf_dir).union(substring_dedup.removals(frame(spark, rows), whole=True).where("doc_id >= 10000")).collect()}
    assert got[10_000].text.strip() == "" and got[10_001].text.strip() == "Quite new words at the top."
    seen = set()
    for d, t in sorted(rows):
        gone = {i for x in got[d].spans for i in range(x.start, x.end)}
        for m in re.finditer(r"[^\n]+", t or ""):
            key = " ".join(m[0].lower().split())
            if key in seen:
                assert all(i in gone or m.string[i].isspace() for i in range(*m.span()))
            elif key:
                seen.add(key)


def brute_windows(rows, window=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            if w in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(w)
        n = sum(1 for i, c in enumerate(gone) if c and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), n, hashlib.sha256(bytes(x for x, c in zip(b, gone, strict=True) if not c)).hexdigest())
    return out


def periodic(seed):
    r = random.Random(seed)
    rows = []
    for i in range(50):
        s = "".join(r.choice("ab") for _ in range(r.randint(0, 300)))
        s = "abc" * r.randint(30, 400) if i % 4 == 0 else "a" * r.randint(90, 1500) if i % 7 == 0 else s
        if i % 5 == 0 and rows:
            s = rows[-1][1][20:] + s + rows[i // 2][1][:150]
        rows.append((i, s))
    return rows


@pytest.mark.parametrize(("batch", "hot"), [(7, 2_000), (10_000, 2_000), (10_000, 2)])
def test_suffixes_equal_brute_force(spark, sf_dir, monkeypatch, batch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", hot)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for rows in (periodic(batch), documents(spark, sf_dir)):
            got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removals(frame(spark, rows)).collect()}
            assert got == brute_windows(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


@pytest.mark.parametrize("spill", [1 << 30, 0])
def test_construction_is_the_suffix_array(spill):
    r = random.Random(2)
    texts = [bytes(r.choice(b"ab\x00") for _ in range(r.randint(1, 40))) for _ in range(30)] + [b"a" * 30, b"a" * 30, b"ab" * 20]
    piece, start, common = suffix_dedup.construct(texts, 200, spill)
    rows = [(texts[p][s:], p) for p, s in zip(piece.tolist(), start.tolist(), strict=True)]
    assert rows == sorted(rows) and len(rows) == sum(len(t) + 1 for t in texts)
    for (a, _), (b, _), c in zip(rows, rows[1:], common[1:].tolist(), strict=False):
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert c == same


def test_long_document_is_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", 500)
    rows = [(d, t * 3 if d % 9 == 0 else t) for d, t in periodic(4)]
    texts = [t.encode() for _, t in rows]
    found = []
    for number, offset, parts in suffix_dedup._segments(texts, 100):
        blob = b"".join(parts)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        starts, counts, _, _ = suffix_dedup.pieces(np.frombuffer(blob, np.uint8), bounds)
        at = np.searchsorted(bounds, starts, side="right") - 1
        for a, c, k in zip(starts.tolist(), counts.tolist(), at.tolist(), strict=True):
            found += [(number[k], offset[k] + a - int(bounds[k]) + j) for j in range(c)]
    assert sorted(found) == [(i, s) for i, t in enumerate(texts) for s in range(max(0, len(t) - 99))]


def test_suffixes_awkward(awkward, no_documents):
    got = suffix_dedup.removals(awkward, texts=True).collect()
    assert len(got) == len(AWKWARD) and suffix_dedup.removals(no_documents).count() == 0
    fives = [r for r in got if r.doc_id == 5 and r.n_bytes == 600]
    assert len(fives) == 2 and fives[0] == fives[1] and 0 < fives[0].n_removed < 600
    six = next(r for r in got if r.doc_id == 6)
    assert six.n_removed == 600 and six.n_spans == 1 and bytes(six.kept) == b""


def test_ids_at_the_ends(spark):
    """The least and the greatest id are ids, and not the null that they might stand for."""
    low, high = -(1 << 63), (1 << 63) - 1
    line = "some words that make up a line of text which is long enough for a window of the suffix array, and then some more"
    rows = [(low, line), (None, line), (high, line + " end"), (None, "x y z"), (high, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.components(docs).collect()}
    assert {v for (i, _), v in got.items() if i == high} == {low, high} or {v for (i, _), v in got.items() if i == high} == {high}
    assert all(v is not None for v in got.values())
    for found in (suffix_dedup.removals(docs), substring_dedup.removals(docs)):
        ids = sorted(map(repr, (r.doc_id for r in found.collect())))
        assert ids == sorted(map(repr, (i for i, _ in rows)))
    gone = {r.doc_id: r.n_removed for r in substring_dedup.removals(docs.limit(2)).collect()}
    assert sorted(gone.values()) == [0, len(line)]


def test_not_first():
    k = np.array([1, 1, 1, 2, 2, 3])
    p = np.array([5, 4, 4, 7, 7, 1])
    assert spans.not_first((k,), (p,)).tolist() == [True, False, False, False, False, False]
    assert spans.merged([(5, 9), (0, 3), (3, 4), (8, 10)]) == [(0, 4), (5, 10)]

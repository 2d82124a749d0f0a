"""Suffix-array dedup by column-wise multi-document construction.

Every byte covered by a string of WINDOW bytes that also starts earlier (smaller doc_id, or same
document and earlier start) goes. Three phases, none of which holds a corpus in one place:

1. Dealing. Each window (string of WINDOW bytes) belongs to its minimizer, the least-hashed
   K-byte string in it; runs of windows with one minimizer form a piece, so that pieces hold
   every window once and equal windows always carry equal minimizers. Only hashes travel:
   (minimizer, hash of the piece in 128 bits, place). Of equal pieces all but the earliest go whole, as all
   their windows start earlier elsewhere. Minimizers with one piece content are done (unless
   the piece repeats its minimizer and so may repeat itself). Later copies within a slice are
   marked before the shuffle, so a group of copies costs its tasks one row a slice.
2. Construction. The contents that share a minimizer with different ones are cut from the
   texts, brought together by minimizer, and trimmed to the runs of windows whose hash occurs
   again in the batch. For each bounded batch of groups the
   Burrows-Wheeler transform of the collection is built column by column: every round inserts
   one symbol per piece, at the place that LF mapping gives, and updates the transform and the
   longest common prefixes in one sequential pass from old files to new (kept in memory below
   SPILL_BYTES). Rows joined by common prefixes of WINDOW or more hold equal windows; all but
   the earliest go.
   Minimizers with more than HOT_PIECES contents are not brought together: their windows are
   ranked one by one, by two hashes, after each slice has dealt with its own copies.
3. Cut. Spans are merged per document and removed.

Hashes decide who is compared, and, by 128 bits, which pieces are equal; in a collection that is built, bytes do.

Nulls are empty texts. A null doc_id ranks first. Rows that share doc_id and text are one
document and get the same result; other rows that share a doc_id rank by the hash of their text.
Texts shorter than WINDOW are left alone; longer ones of any length are taken whole, in segments. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, map_slices, partitions, saved, table
from .spans import keyed, merged, not_first, with_spans

WINDOW, K = 100, 16
#: Windows a piece at most: bounds the rounds of the construction to MOST_WINDOWS + WINDOW.
MOST_WINDOWS = 128
#: Bytes hashed at once; pieces built at once; pieces of one minimizer that may meet in a task (3 MB, built in about a second): groups beyond are compared window by window.
SEGMENT_BYTES, BATCH_PIECES, HOT_PIECES = 1 << 20, 2_000, 20_000
#: Text per slice where pieces and spans become objects.
SLICE_BYTES = 2 << 20
#: Columns of the construction beyond this size are kept in files.
SPILL_BYTES = 256 << 20

_B, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MIX = np.uint64(0xBF58476D1CE4E5B9)


_cached: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _cached or len(_cached[base][0]) < n:
        make = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, dtype=np.uint64)]), dtype=np.uint64)
        _cached[base] = make(base), make(pow(base, -1, 1 << 64))
    return tuple(x[:n] for x in _cached[base])


def kmer_hashes(data: np.ndarray, k: int = K, base: int = _B) -> np.ndarray:
    """A hash of each k bytes: differences of a prefix polynomial, brought to a common power, then mixed."""
    n = len(data)
    up, down = _powers(base, n + 1)
    s = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=s[1:])
    h = (s[k:] - s[: n + 1 - k]) * down[: n + 1 - k]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def pieces(data: np.ndarray, bounds: np.ndarray, window: int = WINDOW, k: int = K):
    """Pieces of concatenated segments. bounds: n + 1 offsets. Returns starts, window counts, minimizers, and whether the minimizer occurs twice in the piece."""
    w = window - k + 1
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none.astype(np.uint64), none.astype(bool)
    h = kmer_hashes(data, k)
    place = np.uint64((1 << 24) - 1)
    low = _sliding_min((h & ~place) | np.arange(len(h), dtype=np.uint64), w)
    at = (low & place).astype(np.int64)
    value = h[at]
    n = len(value)
    valid = np.zeros(n + 1, dtype=np.int8)  # windows that lie in one segment
    lengths = np.diff(bounds)
    ok = np.flatnonzero(lengths >= window)
    np.add.at(valid, bounds[:-1][ok], 1)
    np.add.at(valid, bounds[1:][ok] - window + 1, -1)
    valid = np.cumsum(valid[:n]) > 0
    new = np.ones(n, dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | ~valid[:-1]
    if (inside := bounds[:-1][bounds[:-1] < n]).size:
        new[inside] = True
    starts = np.flatnonzero(new & valid)
    ends = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]])) + 1
    counts = ends - starts
    if len(counts) and counts.max() > MOST_WINDOWS:
        parts = -(-counts // MOST_WINDOWS)
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends = np.repeat(starts, parts) + number * MOST_WINDOWS, np.repeat(ends, parts)
        counts = np.minimum(MOST_WINDOWS, ends - starts)
    mini = value[starts]
    twice = counts > w
    rows = np.flatnonzero(~twice)
    offsets = np.arange(1, w)
    for i in range(0, len(rows), 20_000):
        r = rows[i : i + 20_000]
        # The leftmost occurrence lies in the first window; a second one lies behind it, inside the piece.
        p = at[starts[r]]
        q = p[:, None] + offsets[None, :]
        last = starts[r] + counts[r] - 1 + w - 1
        twice[r] = ((h[np.minimum(q, len(h) - 1)] == mini[r][:, None]) & (q <= last[:, None])).any(axis=1)
    return starts, counts, mini, twice


def _segments(texts: list[bytes], window: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of (document number, offset, bytes) of about SEGMENT_BYTES; long documents are cut so that each window lies in one segment."""
    docs, offsets, parts, held = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - window + 1), SEGMENT_BYTES):
            part = t[a : a + SEGMENT_BYTES + window - 1]
            if len(part) < window:
                continue
            if held and held + len(part) > SEGMENT_BYTES:
                yield docs, offsets, parts
                docs, offsets, parts, held = [], [], [], 0
            docs.append(i)
            offsets.append(a)
            parts.append(part)
            held += len(part)
    if parts:
        yield docs, offsets, parts


#: A place packs where a piece starts, whether it is marked as later, whether its minimizer occurs twice, and its windows.
_START, _LATER, _TWICE, _COUNT = 12, 11, 10, (1 << 10) - 1


def _utf8(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def deal(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """mini, c1, c2 (a hash of the piece in 128 bits), doc, rid, place of all pieces."""
    names = ["mini", "c1", "c2", "doc", "rid", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, rid, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for i in range(0, batch.num_rows, 256):
                part = _utf8(texts.slice(i, 256))
                for number, offset, segments in _segments(part, window):
                    blob = b"".join(segments)
                    bounds = np.concatenate([[0], np.cumsum([len(s) for s in segments])]).astype(np.int64)
                    starts, counts, mini, twice = pieces(np.frombuffer(blob, dtype=np.uint8), bounds, window)
                    if not len(starts):
                        continue
                    digest, view = xxhash.xxh3_128_digest, memoryview(blob)
                    content = np.frombuffer(b"".join(digest(view[a:b]) for a, b in zip(starts.tolist(), (starts + counts + window - 1).tolist(), strict=True)), dtype="<i8").reshape(-1, 2)
                    c1, c2 = content[:, 0].copy(), content[:, 1].copy()
                    at = np.searchsorted(bounds, starts, side="right") - 1
                    row = np.array(number)[at] + i
                    start = starts - bounds[at] + np.array(offset)[at]
                    d, r = doc[row], rid[row]
                    later = not_first((mini, c1, c2), (d, r, start))
                    # Marked rows meet nobody: they take a key of their own.
                    key = np.where(later, (r.view(np.uint64) + start.astype(np.uint64)) * np.uint64(_B), mini)
                    place = (start << _START) | (later.astype(np.int64) << _LATER) | (twice.astype(np.int64) << _TWICE) | counts
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), c1, c2, d, r, place)], names)

    return docs.select("doc", "rid", "text").mapInArrow(run, "mini long, c1 long, c2 long, doc long, rid long, place long")


def judge(dealt: DataFrame) -> DataFrame:
    """mini, doc, rid, place, build: pieces that go whole (build false) and those whose windows must be compared (build true). Streams over sorted partitions and keeps one row."""
    n = partitions(dealt, 32 << 20)  # pieces take more than their texts do
    names = ["mini", "doc", "rid", "place", "build"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None  # the row before; the first content of its minimizer, until that is asked for
        for batch in batches:
            mini, c1, c2, doc, rid, place = (batch.column(i).to_numpy() for i in range(6))
            if not len(mini):
                continue
            later = (place >> _LATER) & 1 == 1
            twice = (place >> _TWICE) & 1 == 1
            start = place >> _START
            prev = lambda x, k: np.concatenate([[x[0] if last is None else last[k]], x[:-1]])
            same_mini = prev(mini, 0) == mini
            same_content = same_mini & (prev(c1, 1) == c1) & (prev(c2, 2) == c2)
            if last is None:
                same_mini[0] = same_content[0] = False
            same_place = same_content & (prev(doc, 3) == doc) & (prev(rid, 4) == rid) & (prev(start, 5) == start)
            same_mini, same_content = same_mini & ~later, same_content & ~later
            # first of its content: begins the content, or ties in place with such a row directly before it
            begins = ~same_content & ~later
            is_first = begins.copy()
            carried = last is not None and last[6]
            for i in np.flatnonzero(same_place & ~later).tolist():
                is_first[i] = is_first[i - 1] if i else carried
            out = [np.flatnonzero(~is_first)]
            build = np.flatnonzero(is_first & (same_mini | twice))
            # the first content of a minimizer is asked for as soon as a second one comes
            seconds = np.flatnonzero(begins & same_mini)
            wanted = []
            heads = np.flatnonzero(~same_mini & ~later)
            if len(seconds):
                at = np.searchsorted(heads, seconds, side="right") - 1
                if (at < 0).any() and first is not None:
                    wanted.append(first)
                    first = None
                wanted += [(mini[h], doc[h], rid[h], place[h]) for h in heads[np.unique(at[at >= 0])].tolist() if not twice[h]]
                asked = set(np.unique(at[at >= 0]).tolist())
            else:
                asked = set()
            if len(heads):
                h = int(heads[-1])
                first = None if len(heads) - 1 in asked or twice[h] else (mini[h], doc[h], rid[h], place[h])
            last = (mini[-1], c1[-1], c2[-1], doc[-1], rid[-1], start[-1], bool(is_first[-1]))
            rows = np.concatenate([out[0], build])
            cols = [x[rows] for x in (mini, doc, rid, place)]
            if wanted:
                cols = [np.concatenate([c, np.array(w, dtype=np.int64)]) for c, w in zip(cols, zip(*wanted, strict=True), strict=True)]
            flag = np.concatenate([np.zeros(len(out[0]), bool), np.ones(len(cols[0]) - len(out[0]), bool)])
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(flag)], names)

    return dealt.repartition(n, "mini").sortWithinPartitions("mini", "c1", "c2", "doc", "rid", "place").mapInArrow(run, "mini long, doc long, rid long, place long, build boolean")


class _Column:
    """An array that is replaced each round by one written front to back; beyond the limit it lives in a file."""

    def __init__(self, dtype, folder: str | None, name: str):
        self.dtype, self.folder, self.name, self.turn, self.data = np.dtype(dtype), folder, name, 0, np.zeros(0, dtype)

    def merge(self, at: np.ndarray, values: np.ndarray) -> None:
        """Inserts values so that they stand at the places at (ascending) of the new array."""
        n = len(self.data) + len(values)
        if self.folder is None:
            new = np.empty(n, self.dtype)
        else:
            self.turn ^= 1
            new = np.memmap(os.path.join(self.folder, f"{self.name}{self.turn}"), dtype=self.dtype, mode="w+", shape=(n,))
        keep = np.ones(n, dtype=bool)
        keep[at] = False
        new[keep] = self.data
        new[at] = values
        self.data = new


def construct(contents: list[bytes], window: int = WINDOW, spill_bytes: int = SPILL_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the collection's suffix array by column-wise insertion: piece, start in the piece, common prefix with the row before (up to window).

    Symbols are bytes plus one (UTF-8 has no byte 255); 0 stands for "no symbol before", at the
    front of a piece. Pieces end in markers that are less than all symbols and differ from each
    other. Which row belongs to which suffix follows from the finished transform, by walking LF
    mapping from the markers.
    """
    m = len(contents)
    size = np.array([len(c) for c in contents])
    flat, base = np.frombuffer(b"".join(contents), dtype=np.uint8) + np.uint8(1), np.cumsum(size) - size
    with tempfile.TemporaryDirectory() if (int(size.sum()) + m) * 2 > spill_bytes else _Nothing() as folder:
        bwt, lcp = _Column(np.uint8, folder, "bwt"), _Column(np.uint8, folder, "lcp")
        symbol = lambda piece, rest: np.where(rest < size[piece], flat[np.minimum(base[piece] + size[piece] - rest - 1, len(flat) - 1)], 0).astype(np.uint8)  # noqa: E731  before the suffix of length rest
        every = np.arange(m)
        first = symbol(every, np.zeros(m, np.int64))
        bwt.merge(every, first)
        lcp.merge(every, np.zeros(m, np.uint8))
        new, owner, last = every, every, first  # where the rows of the last round stand, of which pieces, and the symbols before them
        for rest in range(1, int(size.max(initial=0)) + 1):
            go = last > 0
            new, owner, last = new[go], owner[go], last[go]
            if not len(new):
                break
            b = bwt.data
            order = np.argsort(b, kind="stable")  # LF mapping of all rows: rows without a symbol, then the others by it
            rank = np.empty(len(b), dtype=np.int64)
            rank[order] = np.arange(len(b))
            rank = rank[new]
            # Rows of one round keep their order within a symbol, so sorting few numbers sorts them all.
            by_place = np.argsort(rank, kind="stable")
            new, owner, last, rank = new[by_place], owner[by_place], last[by_place], rank[by_place]
            total, ends = len(b), int(np.count_nonzero(b == 0))
            before, behind = order[np.maximum(rank - 1, 0)], order[np.minimum(rank + 1, total - 1)]
            before = np.where((rank > ends) & (b[before] == last), before, -1)
            behind = np.where((rank + 1 < total) & (b[behind] == last), behind, -1)
            with_before, with_behind = _common(lcp.data, before, new, window), _common(lcp.data, new, behind, window)
            k = rank - ends + m
            last = symbol(owner, np.full(len(owner), rest))
            bwt.merge(k, last)
            lcp.merge(k, with_before)
            after = k + 1
            fits = after < len(lcp.data)
            # A row directly behind that is new itself has the same value already.
            lcp.data[after[fits]] = with_behind[fits]
            new = k
        b, common = np.array(bwt.data), np.array(lcp.data)
    order = np.argsort(b, kind="stable")
    to = np.empty(len(b), dtype=np.int64)
    to[order] = np.arange(len(b)) - int(np.count_nonzero(b == 0)) + m
    piece, rest = np.empty(len(b), dtype=np.int32), np.empty(len(b), dtype=np.int32)
    at, own, n = every, every, 0
    while len(at):
        piece[at], rest[at] = own, n
        go = b[at] > 0
        at, own, n = to[at[go]], own[go], n + 1
    return piece, size[piece] - rest, common


class _Nothing:
    def __enter__(self):
        return None

    def __exit__(self, *a):
        return False


def _common(lcp: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """1 + least common prefix over rows a + 1 to b, up to window; 0 where there is no such row."""
    out = np.zeros(len(a), dtype=np.uint8)
    ok = np.flatnonzero((a >= 0) & (b >= 0))
    if len(ok):
        pairs = np.empty(2 * len(ok), dtype=np.int64)
        pairs[0::2], pairs[1::2] = a[ok] + 1, b[ok] + 1
        padded = np.append(lcp, np.uint8(0))
        out[ok] = np.minimum(np.minimum.reduceat(padded, pairs)[0::2].astype(np.int64) + 1, window)
    return out


def repeated_runs(contents: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the piece, start and end of the runs of windows whose hash occurs again: all that a repeated window can lie in."""
    flat = np.frombuffer(b"".join(contents), dtype=np.uint8)
    size = np.array([len(c) for c in contents])
    base = np.cumsum(size) - size
    if len(flat) < window:
        return (np.zeros(0, np.int64),) * 3
    h = kmer_hashes(flat, window)
    piece = np.repeat(np.arange(len(size)), size)[: len(h)]
    valid = np.flatnonzero(np.arange(len(h)) + window <= (base + size)[piece])
    order = valid[np.argsort(h[valid], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    again = order[np.append(same, False) | np.insert(same, 0, False)]
    hit = np.zeros(len(h) + 1, dtype=bool)
    hit[again] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8)))
    # A run may not go on from one piece into the next: windows of two pieces are never neighbours, as window - 1 starts lie between them.
    starts, ends = edge[0::2], edge[1::2]
    owner = piece[starts]
    return owner, starts - base[owner], ends - base[owner] + window - 1


def repeated_windows(contents: list[bytes], window: int = WINDOW):
    """Groups of equal windows: group number, piece, start."""
    piece, start, common = construct(contents, window)
    full = common >= window
    inside = full | np.append(full[1:], False)
    group = np.cumsum(~full)
    return group[inside], piece[inside], start[inside]


def compare(docs: DataFrame, cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, rid, start, end of repeated windows among pieces (mini, doc, rid, start, content) of docs that share a minimizer."""
    n = partitions(docs, 32 << 20)

    def solve(rows):
        if not rows:
            return None
        doc, rid, start = (np.array(x, dtype=np.int64) for x in list(zip(*rows, strict=True))[:3])
        owner, a, b = repeated_runs([r[3] for r in rows], window)
        if not len(owner):
            return None
        # Runs of equal content collapse: all but the earliest go whole, the earliest is built.
        d, r, s, size = doc[owner], rid[owner], start[owner] + a, b - a
        order, numbers, content = np.lexsort((s, r, d)), {}, []
        kept, whole = [], []
        for i in order.tolist():
            c = rows[owner[i]][3][a[i] : b[i]]
            seen = numbers.get(c)
            if seen is None:
                numbers[c] = i
                kept.append(i)
                content.append(c)
            elif (d[seen], r[seen], s[seen]) != (d[i], r[i], s[i]):
                whole.append(i)
        kept, whole = np.array(kept), np.array(whole, dtype=np.int64)
        group, piece, at = repeated_windows(content, window)
        piece = kept[piece]
        x, y, z = d[piece], r[piece], s[piece] + at
        gone = not_first((group,), (x, y, z))
        x, y, z = (np.concatenate([u[gone], v[whole]]) for u, v in ((x, d), (y, r), (z, s)))
        end = np.concatenate([np.full(int(gone.sum()), window), size[whole]]) + z
        if not len(x):
            return None
        order = np.lexsort((z, y, x))
        x, y, z, end = x[order], y[order], z[order], end[order]
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] > end[:-1])
        head = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (x[head], y[head], z[head], np.maximum.reduceat(end, head))], ["doc", "rid", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = [], None
        for batch in batches:
            for mini, doc, rid, start, content in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if mini != last and len(rows) >= BATCH_PIECES:
                    if out := solve(rows):
                        yield out
                    rows = []
                last = mini
                rows.append((doc, rid, start, content))
        if out := solve(rows):
            yield out

    return cut.repartition(n, "mini").sortWithinPartitions("mini").mapInArrow(run, "doc long, rid long, start long, end long")


def cut_pieces(docs: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """mini, doc, rid, start, content (bytes) of the wanted pieces."""
    lists = wanted.groupBy("doc", "rid").agg(F.collect_set(F.struct("mini", "place")).alias("want"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, rid, text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            for w in want:
                start = w["place"] >> _START
                out.append((w["mini"], doc, rid, start, text[start : start + (w["place"] & _COUNT) + window - 1]))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(),) * 4 + (pa.binary(),), strict=True)], ["mini", "doc", "rid", "start", "content"])

    return map_slices(docs.join(lists, ["doc", "rid"]).dropDuplicates(["doc", "rid"]).select("doc", "rid", "text", "want"), "text", run, "mini long, doc long, rid long, start long, content binary", SLICE_BYTES)


def hot_windows(docs: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, rid, start, end of repeated windows in pieces of crowded minimizers, without bringing a minimizer's pieces together.

    Windows are known by two 64-bit hashes. Those that their slice knows to be later than another go
    at once, as runs; of each distinct window one row a slice is left to be ranked.
    """
    lists = wanted.groupBy("doc", "rid").agg(F.collect_set("place").alias("want"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts, at = [], []
        for i, (text, want) in enumerate(zip(_utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
            for w in want:
                start = w >> _START
                parts.append(text[start : start + (w & _COUNT) + window - 1])
                at.append((i, start))
        blob = np.frombuffer(b"".join(parts), dtype=np.uint8)
        size = np.array([len(p) for p in parts], dtype=np.int64)
        base = np.cumsum(size) - size
        piece = np.repeat(np.arange(len(size)), size)[: max(0, len(blob) - window + 1)]
        ok = np.flatnonzero(np.arange(len(piece)) + window <= (base + size)[piece])
        i, start = (np.array(x, dtype=np.int64) for x in zip(*at, strict=True)) if at else (np.zeros(0, np.int64),) * 2
        h1, h2 = (kmer_hashes(blob, window, b)[ok] for b in (_B, _B2)) if len(ok) else (np.zeros(0, np.uint64),) * 2
        piece = piece[ok]
        d, r, s = batch.column(0).to_numpy()[i[piece]], batch.column(1).to_numpy()[i[piece]], start[piece] + ok - base[piece]
        later = not_first((h1, h2), (d, r, s))
        order = np.flatnonzero(later)
        order = order[np.lexsort((s[order], r[order], d[order]))]
        x, y, z = d[order], r[order], s[order]
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] > z[:-1] + window)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(x))[: len(head)] - 1
        own = y[head].view(np.uint64) ^ (z[head].astype(np.uint64) * np.uint64(_B))
        f = ~later
        cols = [np.concatenate(c) for c in ((own, h1[f]), (own, h2[f]), (x[head], d[f]), (y[head], r[f]), (z[head], s[f]), (z[tail] + window, s[f] + window), (np.ones(len(head), bool), np.zeros(int(f.sum()), bool)))]
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cols], ["h1", "h2", "doc", "rid", "start", "end", "later"])

    found = map_slices(docs.join(lists, ["doc", "rid"]).dropDuplicates(["doc", "rid"]).select("doc", "rid", "text", "want"), "text", run, "h1 long, h2 long, doc long, rid long, start long, end long, later boolean", SLICE_BYTES)
    order = F.rank().over(Window.partitionBy("h1", "h2", "later").orderBy("doc", "rid", "start"))
    return found.withColumn("r", order).where("later or r > 1").select("doc", "rid", "start", "end")


def removals(documents: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with texts, spans and kept (bytes)."""
    docs = keyed(documents)
    judged = saved(judge(deal(docs, window)), "suffix-judged")
    spans = judged.where("not build").select("doc", "rid", F.shiftright("place", _START).alias("start"), (F.shiftright("place", _START) + F.col("place").bitwiseAND(_COUNT) + (window - 1)).alias("end"))
    wanted = judged.where("build")
    crowded = checkpoint(wanted.groupBy("mini").agg(F.count("*").alias("n")).where(F.col("n") > HOT_PIECES).select("mini"))
    if not crowded.isEmpty():
        hot = saved(hot_windows(docs, wanted.join(crowded, "mini", "left_semi"), window), "suffix-hot")
        spans = spans.union(hot)
        wanted = wanted.join(crowded, "mini", "left_anti")
    built = saved(compare(docs, cut_pieces(docs, wanted, window), window), "suffix-built")
    more = ", spans array<struct<start:long,end:long>>, kept binary" if texts else ""

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = [], []
        for doc, text, none, cuts in zip(batch.column("doc").to_pylist(), _utf8(batch.column("text")), batch.column("none").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
            gone, kept, at = merged([(c["start"], c["end"]) for c in cuts or ()]), [], 0
            for a, b in gone:
                kept.append(text[at:a])
                at = b
            kept = b"".join([*kept, text[at:]])
            ids.append(None if none else doc)
            out.append((len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest(), *(([{"start": a, "end": b} for a, b in gone], kept) if texts else ())))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: 1 + len(cols)])

    return map_slices(with_spans(docs, spans.union(built)), "text", finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + more, SLICE_BYTES)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))

"""Substring dedup by line or paragraph hashing.

Texts are cut into units: lines, paragraphs (runs of lines between blank ones), or, with
sentences=True, the sentences of each, so that a passage inside a longer line is found too.
A unit is normalised (lower case, white space to one space) and hashed to 128 bits. Digests are
grouped over all documents; the occurrence with the smallest (doc_id, place) stays, all others
go. Units of fewer than min_words words always stay. With whole=True, as in the query, lines (or
paragraphs) count at any length and are hashed whole as well as by sentence, and sentences below
min_words words are hashed together with as many neighbours, after and before them, as reach it: a
repeated line goes whole, and so does a copy of a document. Removed spans keep their offsets into the
original text (code points, end exclusive), together with the white space that follows them.

Occurrences that a slice of a few megabytes already knows to be later than another are marked
there and do not meet at the digest's task, so a very common line costs one row a slice.

Nulls are empty texts without units. Texts and units of any length are taken whole. A null doc_id ranks before all others. Rows that share
doc_id and text are one document and get the same result; within one text later repeats go.
Extra columns are ignored by removals() and kept by nothing else; empty tables give empty results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_slices, saved, table
from .spans import keyed, merged, not_first, with_spans

MIN_WORDS = 5
_LINE = re.compile(r"[^\n]+")
_PARAGRAPH = re.compile(r"[^\n]+(?:\n(?![^\S\n]*\n)[^\n]*)*")
_SENTENCE_END = re.compile(r"(?<=[.!?])[^\S\n]+")


def units(text: str, unit: str = "line", sentences: bool = True) -> list[tuple[int, int]]:
    """Spans of the units of a text, without white space around them."""
    out = []
    for m in (_LINE if unit == "line" else _PARAGRAPH).finditer(text):
        part, base = m[0], m.start()
        cuts = [0]
        if sentences:
            for s in _SENTENCE_END.finditer(part):
                cuts.append(s.end())
        cuts.append(len(part))
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = part[a:b]
            left = len(piece) - len(piece.lstrip())
            if left < len(piece):
                out.append((base + a + left, base + a + len(piece.rstrip())))
    return out


def _joined(sizes: list[int], min_words: int) -> set[tuple[int, int]]:
    """(first, last) sentence of what counts of a line of sentences of these many words: a long sentence alone, a short one with neighbours after and before it."""
    out = set()
    for i in range(len(sizes)):
        for step in (1, -1):
            j, n = i, sizes[i]
            while n < min_words and 0 <= j + step < len(sizes):
                j += step
                n += sizes[j]
            if n >= min_words:
                out.add((min(i, j), max(i, j)))
    return out


def digests(text: str, unit: str, sentences: bool, min_words: int, whole: bool = False) -> list[tuple[int, int, int]]:
    """(128-bit digest, start, end) of the units that count."""
    digest = lambda w: xxhash.xxh3_128_intdigest(" ".join(w).encode("utf-8", "surrogatepass"))
    out = []
    if not whole:
        for a, b in units(text, unit, sentences):
            w = text[a:b].lower().split()
            if len(w) >= min_words:
                out.append((digest(w), a, b))
        return out
    inner, k = units(text, unit, True) if sentences else [], 0
    for a, b in units(text, unit, False):
        own = [text[a:b].lower().split()]
        out.append((digest(own[0]), a, b))
        first = k
        while k < len(inner) and inner[k][1] <= b:
            k += 1
        if k - first > 1:
            own = [text[x:y].lower().split() for x, y in inner[first:k]]
            for i, j in _joined([len(w) for w in own], min_words):
                if (i, j) != (0, len(own) - 1):
                    out.append((digest([t for w in own[i : j + 1] for t in w]), inner[first + i][0], inner[first + j][1]))
    return out


_MASK = (1 << 64) - 1


def occurrences(docs: DataFrame, unit: str, sentences: bool, min_words: int, whole: bool = False) -> DataFrame:
    """h1, h2, doc, rid, start, end, later: later rows are known to go and have a key of their own."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            rows += [(d >> 64, d & _MASK, doc, rid, a, b) for d, a, b in digests(text, unit, sentences, min_words, whole)]
        kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.int32)
        cols = [np.array(x, dtype=k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [np.zeros(0, k) for k in kinds]
        h1, h2, doc, rid, start, end = cols
        later = not_first((h1, h2), (doc, rid, start))
        h1 = np.where(later, rid.view(np.uint64) ^ (start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), h1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h1.view(np.int64), h2.view(np.int64), doc, rid, start, end, later)], ["h1", "h2", "doc", "rid", "start", "end", "later"])

    return map_slices(docs, "text", run, "h1 long, h2 long, doc long, rid long, start int, end int, later boolean")


def removed_spans(docs: DataFrame, unit: str = "line", sentences: bool = True, min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """doc, rid, start, end of the units that go. docs: as keyed() gives them."""
    occ = occurrences(docs, unit, sentences, min_words, whole)
    # rank, not row_number: rows of one document given twice tie and are treated alike.
    order = F.rank().over(Window.partitionBy("h1", "h2", "later").orderBy("doc", "rid", "start"))
    return occ.withColumn("r", order).where("later or r > 1").select("doc", "rid", "start", "end").distinct()


def removals(documents: DataFrame, unit: str = "line", sentences: bool = True, min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """Per document: doc_id, n_chars, n_removed (characters), n_spans, spans (start, end), text (what stays)."""
    docs = keyed(documents)
    gone = saved(removed_spans(docs, unit, sentences, min_words, whole), "substring")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = [], []
        for doc, text, none, cuts in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "none", "cuts")), strict=True):
            spans = []
            for c in cuts or ():
                b = c["end"]
                while b < len(text) and text[b].isspace():
                    b += 1
                spans.append((c["start"], b))
            spans, kept, at = merged(spans), [], 0
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            ids.append(None if none else doc)
            out.append((len(text), sum(b - a for a, b in spans), len(spans), [{"start": a, "end": b} for a, b in spans], "".join(kept)))
        cols = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_chars", "n_removed", "n_spans", "spans", "text"])

    return map_slices(with_spans(docs, gone), "text", cut, "doc_id long, n_chars long, n_removed long, n_spans long, spans array<struct<start:int,end:int>>, text string")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"), whole=True)

"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

The model file is parsed here (three message fields suffice) and shipped to the workers as
bytes: vocabularies are fixed and small. Text is escaped as the model asks (dummy prefix, space
to U+2581) and cut before every U+2581 that follows another character, which is exact as no piece
has one inside (checked at load). Each segment is solved by one pass of the automaton, which at
every position follows its output links through all pieces that end there:

* unigram models: Viterbi; each piece relaxes the best score of the position where it ends.
* BPE models: their scores are merge ranks, and the best-scoring path is not what merging gives.
  The same pass therefore keeps, for each position, the one last piece that the merge order allows:
  a piece may end a prefix if it merges with the last piece of the prefix before it to nothing
  else (pairwise compatibility decides the whole sequence). The result is that of merging.

Characters outside the vocabulary become byte pieces (or the unknown id without them). Solved
segments are cached per worker, in two generations of a fixed size.

Nulls and empty texts have no ids, and empty tables give empty results. Texts of any length are encoded whole. Decoding what was encoded gives the text again unless it holds
U+2581 itself, which the format cannot tell from a space (or, in models without byte pieces, a
character outside the vocabulary); round_trip says so per row. Repeated rows and null ids are
treated like any other row; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, table, text_or_empty

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE_ENTRIES, CACHE_CHARS, PAIR_ENTRIES = 70_000, 64, 150_000
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes):
    """(field number, value) of a protocol-buffer message: int for varints, bytes for the rest."""
    i = 0

    def varint():
        nonlocal i
        n = shift = 0
        while True:
            b = data[i]
            i += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[i : i + n]
            i += n


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    type: int = UNIGRAM
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True
    charsmap: bytes = b""
    unk_id: int = 0
    automaton: object = None
    byte_ids: list[int] = field(default_factory=list)
    cache: dict = field(default_factory=dict)
    older: dict = field(default_factory=dict)
    pairs: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls([], [], [])
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                m.pieces.append(f.get(1, b"").decode())
                m.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                m.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                m.type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                m.charsmap, m.dummy_prefix, m.trim, m.escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        return m.prepare()

    def prepare(self) -> Model:
        import ahocorasick

        if self.charsmap or not self.escape or self.type not in (UNIGRAM, BPE) or USER in self.kinds:
            raise ValueError("only unigram and BPE models with identity normalisation and without user-defined pieces are supported")
        self.automaton, self.by_piece = ahocorasick.Automaton(), {}
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == NORMAL and p:
                self.automaton.add_word(p, (i, len(p)))
                self.by_piece[p] = i
        self.automaton.make_automaton()
        by_name = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_ids = [by_name[f"<0x{b:02X}>"] for b in range(256)] if by_name else []
        self.unk_id = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.least = min((s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL), default=0.0) - UNKNOWN_PENALTY
        inside = any(SPACE in p.lstrip(SPACE) for p in self.by_piece)
        self.segments = re.compile(r".+" if inside else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S)
        self.out = [bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        return self

    def escaped(self, text: str) -> str:
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return ((" " if self.dummy_prefix else "") + text).replace(" ", SPACE)

    def unknown(self, ch: str) -> list[int]:
        return [self.byte_ids[b] for b in ch.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unk_id]

    def viterbi(self, s: str) -> list[int]:
        """Best total score; of equal ones the path whose last piece is found first, that is, the longest."""
        best, back = [0.0] + [None] * len(s), [None] * (len(s) + 1)
        ends = self._ends(s)
        for e in range(1, len(s) + 1):
            single = False
            for i, n in ends.get(e, ()):
                single |= n == 1
                score = best[e - n] + self.scores[i]
                if best[e] is None or score > best[e]:
                    best[e], back[e] = score, (i, n)
            if not single:
                score = best[e - 1] + self.least
                if best[e] is None or score > best[e]:
                    best[e], back[e] = score, (None, 1)
        return self._path(s, back)

    def _ends(self, s: str) -> dict:
        ends: dict = {}
        for last, piece in self.automaton.iter(s):
            ends.setdefault(last + 1, []).append(piece)
        return ends

    def _path(self, s, back) -> list[int]:
        out, e = [], len(s)
        while e:
            i, n = back[e]
            out.append(self.unknown(s[e - 1]) if i is None else [i])
            e -= n
        return [i for x in reversed(out) for i in x]

    def last_pieces(self, s: str) -> list[int]:
        """The automaton reports matches by end, the longest first: at each end the first that the order of merges allows is the last piece of the prefix."""
        last, pairs, at = [-2] * (len(s) + 1), self.pairs, 1
        sizes = [0] * (len(s) + 1)
        for end, (i, n) in self.automaton.iter(s):
            end += 1
            while at < end:
                if last[at] == -2:
                    last[at], sizes[at] = -1, 1
                at += 1
            if last[end] != -2:
                continue
            # -1, a character outside the vocabulary, merges with nothing, as the start does.
            key = ((last[end - n] if end > n else -1) + 1) << 20 | i
            fits = pairs.get(key)
            if fits is None:
                fits = self._merged_to(key)
            if fits:
                last[end], sizes[end] = i, n
        for e in range(at, len(s) + 1):
            if last[e] == -2:
                last[e], sizes[e] = -1, 1
        out, e = [], len(s)
        while e:
            i = last[e]
            if i >= 0:
                out.append(i)
            else:
                out.extend(reversed(self.unknown(s[e - 1])))
            e -= sizes[e]
        out.reverse()
        return out

    def _merged_to(self, key: int) -> bool:
        """Whether merging the two pieces of a key (the first may be missing) ends in just them."""
        if len(self.pairs) > PAIR_ENTRIES:
            self.pairs.clear()
        before, i = (key >> 20) - 1, key & 0xFFFFF
        want = [self.pieces[i]] if before < 0 else [self.pieces[before], self.pieces[i]]
        got = self.pairs[key] = merge("".join(want), self.by_piece, self.scores) == want
        return got

    def solve(self, s: str) -> bytes:
        return np.array(self.last_pieces(s) if self.type == BPE else self.viterbi(s), dtype="<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        cache, out = self.cache, []
        for s in self.segments.findall(self.escaped(text)):
            ids = cache.get(s)
            if ids is None:
                ids = self.older.get(s)
                if ids is None:
                    ids = self.solve(s)
                if len(s) <= CACHE_CHARS:
                    if len(cache) >= CACHE_ENTRIES:
                        self.older, self.cache = cache, (cache := {})
                    cache[s] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), dtype="<i4")

    def decode(self, ids) -> str:
        text = b"".join(map(self.out.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def merge(s: str, by_piece: dict, scores: list[float]) -> list[str]:
    """Plain BPE merging of a short string: the best-scored adjacent pair first, the leftmost of equal ones."""
    parts = list(s)
    while True:
        best, at = None, -1
        for k in range(len(parts) - 1):
            i = by_piece.get(parts[k] + parts[k + 1])
            if i is not None and (best is None or scores[i] > best):
                best, at = scores[i], k
        if at < 0:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


_models: dict[int, Model] = {}


def loaded(data: bytes) -> Model:
    """One model per worker."""
    key = hash(data)
    if key not in _models:
        _models.clear()
        _models[key] = Model.parse(data)
    return _models[key]


def encode(docs: DataFrame, model: str = MODEL, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, round_trip."""
    with open(model, "rb") as f:
        data = f.read()  # a fixed vocabulary, well below a megabyte
    shipped = docs.sparkSession.sparkContext.broadcast(data)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = loaded(shipped.value)
        texts = batch.column(1).to_pylist()
        ids = [m.encode(t) for t in texts]
        same = [m.decode(x) == t for x, t in zip(ids, texts, strict=True)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(ids) if ids else np.array([], np.int32)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), lists, pa.array(same)], ["doc_id", "n_tokens", "ids", "round_trip"])

    return map_slices(docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text).alias("text")), "text", run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of rows with doc_id, ids."""
    with open(model, "rb") as f:
        data = f.read()
    shipped = encoded.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        m = loaded(shipped.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))

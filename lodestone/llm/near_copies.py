"""Near copies by wide SimHash fingerprints: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The fingerprints of simhash.py tell texts apart by 3 of 64 bits. At a similarity of 0.8 about 15 % of the
bits differ, give or take, so here they have 256 bits, over the distinct shingles of a text, and
links are found by anchors as well: each of a number of tables samples some of the bits, every
word of these bits is an anchor (the code whose covering radius is 0), and a fingerprint goes to the one
anchor a table that lies within that radius. Two fingerprints at the similarity of 0.8 meet at
some anchor with probability RECALL, more similar ones all the more surely; codes with a
larger radius (Hamming, Golay) need several times the replicas for that, as replicas a table grow faster than hits.
The bits a table samples follow the logarithm of the number of fingerprints, so that an anchor holds a few dozen
whatever the size of the table, and the number of tables follows from the bits and RECALL.

Per anchor all fingerprints are compared. Those that differ in SURE bits or fewer are linked (0.87 or more by
estimate). Those that differ in MOST or fewer may be similar enough; of these links a spanning forest of the
nearest leaves the task, and each is verified by the exact similarity of the texts: first the nearest of
every text, then what is left between components. Anchors that a sample of one class in SAMPLE shows to be crowded are dealt
over salts, each of which compares its own members with all; the sample bears on the dealing alone.

The anchors link most, but not all: pairs that meet at none, whose fingerprints differ by more, or that a forest's
link stood for which then failed. So an exact way for the rest follows (missing()). Two sets of that similarity share one of their first shingles,
in whatever order, if a fifth of each is taken and one more; pairs of different components that share one, of sizes and places that allow the
similarity, are verified too. No pair of similar texts is left out. The order puts shingles last that are frequent in a sample, which bears on the
work alone. A shingle's texts of one component are not compared with each other. Hardly any of these pairs are similar, so sets of shingles
meet only after parities have (possible()): a bit for each residue of the hashes, odd counts set, so that no more bits differ than shingles do.

Equal sets of shingles are one class from the start, so copies are never paired. Nulls and texts without words are one
class. Texts of fewer words than a shingle have one shingle. Words are runs of characters outside ASCII white space,
A-Z lower-cased. Repeated rows and rows that share an id are judged by their texts. Texts of any length are hashed whole. Null
ids take part, come last, and a component of null ids alone has a null component_id. Empty tables give empty
results. Extra columns are ignored by components() and kept by keep_first().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint, connected_components, discard, partitions, saved, text_or_empty, unsent, words
from .lm_scoring import mix

SHINGLE, BITS = 5, 256
#: Similarity as a fraction, so that the comparison is exact.
NUMERATOR, DENOMINATOR = 4, 5
#: Of two texts of equal size at the least similarity, the share of bits that differ.
FLIP = math.acos(2 * NUMERATOR / (DENOMINATOR + NUMERATOR)) / math.pi
RECALL = 0.95
#: Bits a table at most: beyond, tables would cost more than the comparisons they save.
MOST_BITS = 22
#: Expected differing bits at similarity 0.8 are 39, the standard deviation is 6.
SURE, MOST = 28, 54
SAMPLE, SALT_ROWS = 16, 4096
BROADCAST_ROWS = 500_000
MOST_PAIRS = 1 << 17
#: Shingles that come last: in so many texts of the sample, and at most so many of them. Groups up to SMALL are compared side by side.
FREQUENT, MOST_FREQUENT, SMALL = 4, 200_000, 64
_G = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > 60_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, cache: dict) -> np.ndarray:
    """Hashes of the distinct shingles of a text, ascending."""
    w = text.translate(_LOWER).split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(cache.__getitem__, w), dtype=np.uint64, count=len(w))
    n = max(1, len(h) - SHINGLE + 1)
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(h))):
        grams = mix(grams * _G + h[k : k + n] + np.uint64(1))
    return np.unique(grams)


def wide(grams: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """The fingerprint of a set of shingles, BITS / 64 numbers."""
    out = np.zeros(BITS // 64, dtype=np.uint64)
    for j in range(BITS // 64 if len(grams) else 0):
        counts = np.zeros(64, dtype=np.int64)
        for a in range(0, len(grams), block):
            g = mix(grams[a : a + block] + np.uint64((j + 1) * int(_G) & (1 << 64) - 1))
            counts += np.add.reduce(np.unpackbits(g.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
        out[j] = np.packbits(2 * counts > len(grams), bitorder="little").view("<u8")[0]
    return out


def first(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which two similar sets share one: what is not frequent comes first, then by hash. frequent: ascending."""
    n = len(grams)
    late = frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams if len(frequent) else np.zeros(n, bool)
    return np.concatenate([grams[~late], grams[late]])[: n - -(-NUMERATOR * n // DENOMINATOR) + 1 if n else 0]


def parity(grams: np.ndarray) -> np.ndarray:
    """Bits, as bytes: one for each residue of the hashes modulo a power of two, at least the size of the set; it is 1 if an odd number of hashes has it."""
    bits = 1 << max(6, (len(grams) - 1).bit_length())
    return np.packbits(np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little")


def differing(a: bytes, b: bytes) -> int:
    """Elements in which two sets of these parities differ, at least. The longer parity is folded to the length of the other."""
    if len(a) < len(b):
        a, b = b, a
    x, n = int.from_bytes(a, "little"), 8 * len(a)
    while n > 8 * len(b):
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _texts(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    t = text_or_empty(text)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(t).alias("rid"), t.alias("text"))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    cache = _Hashes()
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            column = part.column(2)
            yield part, [shingles(t, cache) for t in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """Shingles that many texts of a sample have, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _each(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["s"])

    few = texts.where(F.pmod("rid", F.lit(SAMPLE)) == 0).mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    return np.sort(few.orderBy(F.desc("n")).limit(MOST_FREQUENT).select("s").toArrow().column(0).to_numpy().view(np.uint64))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, rid (hash of the text), fp (BITS / 8 bytes), key (hash of the set of shingles), n (its size), first (its first shingles, 8 bytes each), parity."""
    texts = _texts(docs, id_column, text)
    frequent = frequent_shingles(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _each(batches):
            more = [[f(g) for g in sets] for f in (lambda g: wide(g).tobytes(), lambda g: xxhash.xxh3_128_digest(g.tobytes()), lambda g: first(g, frequent).tobytes(), lambda g: parity(g).tobytes())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, pa.binary()) for x in more), pa.array([len(g) for g in sets], pa.int32())], ["doc_id", "rid", "fp", "key", "first", "parity", "n"])

    return texts.mapInArrow(run, "doc_id long, rid long, fp binary, key binary, first binary, parity binary, n int")


def meeting(bits: int, tables: int) -> float:
    """Probability that two texts at the least similarity meet at an anchor of some table, over all numbers of bits in which they may differ."""
    total, every = 0.0, math.comb(BITS, bits)
    for d in range(BITS + 1):
        likely = math.comb(BITS, d) * FLIP**d * (1 - FLIP) ** (BITS - d)
        total += likely * (1 - (1 - math.comb(BITS - d, bits) / every) ** tables)
    return total


def plan(classes: int, recall: float = RECALL) -> tuple[int, int]:
    """Bits a table and tables for so many classes: about 2^5 classes an anchor, up to MOST_BITS bits."""
    bits = min(MOST_BITS, max(8, int(math.log2(max(2, classes))) - 4))
    low, high = 0, 1
    while meeting(bits, high) < recall:
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if meeting(bits, middle) >= recall else (middle, high)
    return bits, high


def sampled_bits(bits: int, tables: int) -> np.ndarray:
    """The bits of each table: slices of permutations, so that tables overlap as little as can be."""
    rng, each = np.random.default_rng(20), BITS // bits
    order = [rng.permutation(BITS)[: each * bits].reshape(each, bits) for _ in range(-(-tables // each))]
    return np.concatenate(order)[:tables]


def anchors(fps: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Anchor of each fingerprint (rows) in each table (columns). fps: rows of bytes."""
    on = np.unpackbits(fps, axis=1, bitorder="little")
    powers = np.int64(1) << np.arange(tables.shape[1], dtype=np.int64)
    return np.stack([on[:, t].astype(np.int64) @ powers | k << 32 for k, t in enumerate(tables)], axis=1)


def _labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest row each row is linked to, by any number of links."""
    label = np.arange(n) if label is None else label
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _best(label: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the pairs between different labels, the nearest of each two labels."""
    x, y = label[a], label[b]
    go = x != y
    a, b, d, low, high = a[go], b[go], d[go], np.minimum(x, y)[go], np.maximum(x, y)[go]
    order = np.lexsort((b, a, d, high, low))
    low, high = low[order], high[order]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])[: len(order)]
    keep = order[new]
    return a[keep], b[keep], d[keep]


def near_pairs(group: np.ndarray, fps: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows come sorted by group, own ones first; own rows are compared with all later ones of their group.

    Returns the label of each row under sure links, and a spanning forest (a, b, distance) of the nearest other links between labels.
    """
    n, label = len(group), np.arange(len(group))
    alive, step, held, sure, size = np.flatnonzero(own), 0, [], [], 0

    def settle():
        nonlocal label, held, sure, size
        if sure:
            label = _labels(n, np.concatenate([s[0] for s in sure]), np.concatenate([s[1] for s in sure]), label)
        held = [_best(label, *(np.concatenate(x) for x in zip(*held, strict=True)))] if held else []
        sure, size = [], len(held[0][0]) if held else 0

    while True:
        step += 1
        alive = alive[alive + step < n]
        alive = alive[group[alive] == group[alive + step]]
        if not len(alive):
            break
        d = np.bitwise_count(fps[alive] ^ fps[alive + step]).sum(axis=1, dtype=np.int32)
        near = np.flatnonzero(d <= MOST)
        if len(near):
            a, d = alive[near], d[near]
            s = d <= SURE
            sure.append((a[s], a[s] + step))
            held.append((a[~s], a[~s] + step, d[~s]))
            size += len(a)
            if size > MOST_PAIRS:
                settle()
    settle()
    if not held:
        return label, *(np.zeros(0, np.int64),) * 3
    a, b, d = held[0]
    root = {}

    def find(x):
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    keep = []
    for k in np.lexsort((b, a, d)).tolist():
        x, y = find(int(label[a[k]])), find(int(label[b[k]]))
        if x != y:
            root[x] = y
            keep.append(k)
    return label, a[keep], b[keep], d[keep]


EDGE = "ia long, ra long, ib long, rb long, d int"


def links(classes: DataFrame, recall: float = RECALL) -> DataFrame:
    """ia, ra, ib, rb, d of pairs of classes (id, rid, fp): d is at most SURE for links that hold, more for those to be verified."""
    spark = classes.sparkSession
    count = classes.count()
    bits, n_tables = plan(count, recall)
    tables = sampled_bits(bits, n_tables)

    def replicate(keys_only: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 1024):
                    part = batch.slice(k, 1024)
                    raw = np.frombuffer(b"".join(part.column("fp").to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)
                    at = anchors(raw, tables)
                    if keys_only:
                        yield pa.RecordBatch.from_arrays([pa.array(at.reshape(-1))], ["anchor"])
                        continue
                    row = np.repeat(np.arange(len(raw)), n_tables)
                    f = raw.view("<i8")[row]
                    yield pa.RecordBatch.from_arrays([pa.array(at.reshape(-1)), *(pa.array(f[:, j]) for j in range(BITS // 64)), *(pa.array(part.column(c).to_numpy()[row]) for c in ("id", "rid"))], ["anchor", "f0", "f1", "f2", "f3", "id", "rid"])

        return run

    few = classes.select("id", "rid", "fp").where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0)
    crowded = few.mapInArrow(replicate(True), "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLE > SALT_ROWS)
    crowded = checkpoint(crowded.select("anchor", F.ceil(F.col("n") * SAMPLE / SALT_ROWS).cast("int").alias("salts")))
    rows = classes.select("id", "rid", "fp").mapInArrow(replicate(False), "anchor long, f0 long, f1 long, f2 long, f3 long, id long, rid long")
    n_crowded = crowded.count()
    if n_crowded:
        rows = rows.join(F.broadcast(crowded) if n_crowded <= BROADCAST_ROWS else crowded, "anchor", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        rows = rows.withColumn("home", F.pmod(F.xxhash64("f0", "f1"), F.col("salts")).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("own", F.col("salt") == F.col("home")).drop("salts", "home")
    else:
        rows = rows.withColumn("salt", F.lit(0)).withColumn("own", F.lit(True))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of an anchor and a salt are held whole: the salt bounds its own rows, and the others are 48 bytes each."""
        names = ("anchor", "salt", "own", "f0", "f1", "f2", "f3", "id", "rid")

        def solve(cols):
            group = np.cumsum(np.concatenate([[0], (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)]))
            label, a, b, d = near_pairs(group, np.stack(cols[3:7], axis=1).view(np.uint64), cols[2])
            moved = np.flatnonzero(label != np.arange(len(label)))
            x, y = np.concatenate([moved, a]), np.concatenate([label[moved], b])
            d = np.concatenate([np.zeros(len(moved), np.int32), d.astype(np.int32)])
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (cols[7][x], cols[8][x], cols[7][y], cols[8][y], d)], ["ia", "ra", "ib", "rb", "d"])

        held, size, enough = [], 0, 50_000
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            size += batch.num_rows
            if size < enough:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[-1]) + 1 if cols[0][0] != cols[0][-1] or cols[1][0] != cols[1][-1] else 0
            if last:
                yield solve([c[:last] for c in cols])
            held, size = [[c[last:] for c in cols]], len(cols[0]) - last
            enough = max(50_000, 2 * size)  # a large group is looked through a few times only
        if held:
            yield solve([np.concatenate(x) for x in zip(*held, strict=True)])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count * n_tables // 1_500_000)
    found = rows.select("anchor", "salt", "own", "f0", "f1", "f2", "f3", "id", "rid").repartition(n, "anchor", "salt").sortWithinPartitions("anchor", "salt", F.desc("own")).mapInArrow(compare, EDGE)
    swap = (F.col("ia") > F.col("ib")) | ((F.col("ia") == F.col("ib")) & (F.col("ra") > F.col("rb")))
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return found.select(pick("ia", "ib").alias("ia"), pick("ra", "rb").alias("ra"), pick("ib", "ia").alias("ib"), pick("rb", "ra").alias("rb"), "d").groupBy("ia", "ra", "ib", "rb").agg(F.min("d").alias("d"))


def similar_sizes(token: np.ndarray, n: np.ndarray, place: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one token and different components whose sizes and places of the token allow the similarity. Rows come sorted by token and n."""
    out_a, out_b = [], []

    def keep(a, b):
        both = 1 + np.minimum(n[a] - 1 - place[a], n[b] - 1 - place[b])
        good = (component[a] != component[b]) & ((NUMERATOR + DENOMINATOR) * both >= NUMERATOR * (n[a] + n[b])) & (DENOMINATOR * np.minimum(n[a], n[b]) >= NUMERATOR * np.maximum(n[a], n[b]))
        out_a.append(a[good])
        out_b.append(b[good])

    begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    sizes = np.diff(np.append(begins, len(token)))
    mixed = np.minimum.reduceat(component, begins) != np.maximum.reduceat(component, begins)
    alive, step = np.flatnonzero(np.repeat(mixed & (sizes <= SMALL), sizes)), 0
    while len(alive):
        step += 1
        alive = alive[alive + step < len(token)]
        alive = alive[(token[alive] == token[alive + step]) & (DENOMINATOR * n[alive] >= NUMERATOR * n[np.minimum(alive + step, len(n) - 1)])]
        keep(alive, alive + step)
    for k in np.flatnonzero(mixed & (sizes > SMALL)).tolist():
        rows = np.arange(begins[k], begins[k] + sizes[k])
        found, count = np.unique(component[rows], return_counts=True)
        rest = component[rows] != found[count.argmax()]  # of the largest component no two rows are compared
        for r in rows[rest].tolist():
            low, high = begins[k] + np.searchsorted(n[rows], [-(-NUMERATOR * int(n[r]) // DENOMINATOR), DENOMINATOR * int(n[r]) // NUMERATOR + 1])
            b = np.arange(low, high)
            b = b[(b > r) | ~rest[b - begins[k]]]
            keep(np.full(len(b), r), b)
    return np.concatenate([*out_a, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*out_b, np.zeros(0, np.int64)]).astype(np.int64)


def missing(classes: DataFrame, one: DataFrame) -> DataFrame:
    """ia, ra, ib, rb of all pairs of classes in different components that may be similar. one: id, component of linked classes."""
    spark = classes.sparkSession
    own = F.struct("id", "rid")
    named = one.select(F.col("id").alias("_node"), "component")
    rows = classes.where("n > 0").join(unsent(named), own == F.col("_node"), "left").select("id", "rid", F.xxhash64(F.coalesce("component", own)).alias("component"), "n", "first")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                each = [np.frombuffer(x, np.int64) for x in part.column("first").to_pylist()]
                row = np.repeat(np.arange(len(each)), [len(x) for x in each])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each)), pa.array(np.concatenate([np.arange(len(x), dtype=np.int32) for x in each])), *(pa.array(part.column(c).to_numpy()[row]) for c in ("n", "component", "id", "rid"))], ["token", "place", "n", "component", "id", "rid"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(cols):
            token, place, n, component, ids, rids = cols
            a, b = similar_sizes(token, n.astype(np.int64), place.astype(np.int64), component)
            swap = (ids[a] > ids[b]) | (ids[a] == ids[b]) & (rids[a] > rids[b])
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[a], rids[a], ids[b], rids[b])], ["ia", "ra", "ib", "rb"])

        held, size, enough = [], 0, 50_000
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size < enough:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                yield solve([c[:last] for c in cols])
            held, size = [[c[last:] for c in cols]], len(cols[0]) - last
            enough = max(50_000, 2 * size)
        if held:
            yield solve([np.concatenate(x) for x in zip(*held, strict=True)])

    parts = partitions(classes, 4 << 20)
    dealt = rows.mapInArrow(spread, "token long, place int, n int, component long, id long, rid long").repartition(parts, "token").sortWithinPartitions("token", "n")
    return dealt.mapInArrow(pair, "ia long, ra long, ib long, rb long").distinct()


def possible(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges whose parities and sizes allow the similarity: none goes whose sets have it, and few stay whose sets are far from it."""
    of = lambda x: unsent(classes.select(F.col("id").alias(f"i{x}"), F.col("rid").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}")))
    names = ["ia", "ra", "ib", "rb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(c).to_pylist() for c in ("pa", "pb", "na", "nb"))
            keep = [(DENOMINATOR + NUMERATOR) * max(differing(*x), abs(x_n - x_m)) <= (DENOMINATOR - NUMERATOR) * (x_n + x_m) for *x, x_n, x_m in zip(a, b, n, m, strict=True)]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return edges.select(names).join(of("a"), ["ia", "ra"]).join(of("b"), ["ib", "rb"]).mapInArrow(run, "ia long, ra long, ib long, rb long")


def verified(docs: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges whose texts have the similarity. docs: doc_id, rid, text. Sets travel with the edges that parities allow, and are removed at the end."""
    edges = saved(possible(classes, edges), "near-possible")
    ends = checkpoint(edges.select(F.col("ia").alias("id"), F.col("ra").alias("rid")).union(edges.select("ib", "rb")).distinct())
    small = F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends
    h = F.transform(words(ascii_lower(F.col("text"))), lambda w: F.xxhash64(w))
    run = lambda x, i: F.xxhash64(x, *(F.get("h", i + k) for k in range(1, SHINGLE)))
    grams = F.when(F.size("h") >= SHINGLE, F.transform(F.slice("h", F.lit(1), F.greatest(F.size("h") - (SHINGLE - 1), F.lit(0))), run)).otherwise(F.array(F.xxhash64("h")))
    sets = docs.join(small, (docs["doc_id"] == ends["id"]) & (docs["rid"] == ends["rid"]), "left_semi").dropDuplicates(["doc_id", "rid"]).select("doc_id", "rid", h.alias("h")).select(F.col("doc_id").alias("id"), "rid", F.array_distinct(grams).alias("s"))
    sets = saved(sets, "near-sets")
    a, b = (sets.select(F.col("id").alias(f"i{x}"), F.col("rid").alias(f"r{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    found = saved(edges.join(a, ["ia", "ra"]).join(b, ["ib", "rb"]).where(DENOMINATOR * both >= NUMERATOR * (F.size("sa") + F.size("sb") - both)).select("ia", "ra", "ib", "rb"), "near-verified")
    discard(sets)
    return found


def _nodes(edges: DataFrame) -> DataFrame:
    end = lambda x: F.struct(F.col(f"i{x}").alias("id"), F.col(f"r{x}").alias("rid"))
    return edges.select(end("a").alias("a"), end("b").alias("b"))


def _joined(edges: DataFrame) -> DataFrame:
    """id, component of all ends of edges."""
    edges = checkpoint(edges)
    return connected_components(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), edges)


def components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """doc_id, rid, component_id of every row."""
    last = F.lit((1 << 63) - 1)  # null ids come last; a real id of that value meets none of them here, as ids are compared with their texts
    full = saved(fingerprints(docs, id_column, text), "near-fingerprints")
    classes = saved(full.groupBy("key").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("id"), "rid", "fp", "n", "first", "parity")).alias("c")).select("c.*", "key"), "near-classes")
    fps = saved(full.select("doc_id", "rid", "key"), "near-keys")
    discard(full)  # its first shingles, a third of the input, are those of the classes
    found = saved(links(classes, recall), "near-links")
    texts = docs.select(F.coalesce(F.col(id_column).cast("long"), last).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("rid"), text_or_empty(text).alias("text"))
    sure, unsure = found.where(F.col("d") <= SURE), found.where(F.col("d") > SURE)
    # First the nearest link of each end.
    ranked = unsure.select(F.struct("d", "ia", "ra", "ib", "rb").alias("e"), F.explode(F.array(F.struct(F.col("ia").alias("i"), F.col("ra").alias("r")), F.struct(F.col("ib").alias("i"), F.col("rb").alias("r")))).alias("end"))
    nearest = checkpoint(ranked.groupBy("end").agg(F.min("e").alias("e")).select("e.ia", "e.ra", "e.ib", "e.rb").distinct())
    one = checkpoint(_joined(_nodes(sure.select("ia", "ra", "ib", "rb").union(verified(texts, classes, nearest)))))
    # Then what is left between components.
    part = lambda x: one.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    rest = _nodes(unsure.join(nearest, ["ia", "ra", "ib", "rb"], "left_anti")).join(part("a"), "a", "left").join(part("b"), "b", "left").where(~F.coalesce("ca", "a").eqNullSafe(F.coalesce("cb", "b")))
    rest = checkpoint(rest.select(F.col("a.id").alias("ia"), F.col("a.rid").alias("ra"), F.col("b.id").alias("ib"), F.col("b.rid").alias("rb")))
    if not rest.isEmpty():
        more = checkpoint(_nodes(verified(texts, classes, rest)))
        if not more.isEmpty():
            one = _joined(one.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    # At last, exactly, pairs that the fingerprints left out.
    left = saved(missing(classes, one), "near-left")
    if not left.isEmpty():
        more = checkpoint(_nodes(verified(texts, classes, left)))
        if not more.isEmpty():
            one = _joined(one.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    named = one.select(F.col("id.id").alias("i"), F.col("id.rid").alias("r"), F.col("component.id").alias("component_id"))
    by_fp = classes.join(named, (classes["id"] == named["i"]) & (classes["rid"] == named["r"]), "left").select("key", F.nullif(F.coalesce("component_id", "id"), last).alias("component_id"))
    return fps.join(by_fp, "key").select("doc_id", "rid", "component_id")


def keep_first(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The documents whose id is the smallest of their component; of repeated rows with that id, all stay."""
    kept = components(docs, recall=recall).where("doc_id <=> component_id").select(F.col("doc_id").alias("_kept"), F.col("rid").alias("_rid")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == kept["_rid"]), "left_semi")

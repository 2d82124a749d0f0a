"""SimHash near-dedup by anchor-point covering.

Fingerprints of 64 bits; two link if 3 bits or fewer differ. Bits 0-30 and 31-61 are two
halves of 31 bits (bits 62 and 63 are compared, not used for search). Of at most 3 differing
bits, at most one lies in some half. Anchors of a half are the words of the perfect Hamming
code (31, 26): its covering radius is 1, so each value has exactly one home anchor within 1, and
two values at distance 1 or less share an anchor within 1 + 1 = 2 of both. Each distinct
fingerprint is stored at its home and replicated to every anchor within radius 2 (16 a half, 32
in all, whatever the data); homes are compared with replicas per anchor. No link is lost.

Equal fingerprints are one class before the search, so copies are never paired. Per anchor only
a spanning forest of the links leaves the task; anchors with many members are dealt over salts
(homes go to every salt, replicas to one). Joins are by shuffle alone, so the driver's memory doesn't grow with the input. Components come from an iterative star algorithm on
checkpointed edges.

Nulls and empty texts have fingerprint zero and link like any other. Texts of any length are hashed whole. Empty tables give empty results. Repeated rows and ties get
the same component. Null ids take part as copies and are returned with their component; a
component of null ids alone has a null component_id. Extra columns are ignored by components() and kept by keep_first().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, map_slices, partitions, saved, table, text_or_empty, unsent

THRESHOLD, SHINGLE, SEED = 3, 3, 42
#: Replicas at one salt of an anchor, in the mean.
SALT_ROWS = 4096
_HALF = np.uint64((1 << 31) - 1)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingle hashes of a text."""
    w = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) < shingle:
        return h(b" ".join(w), SEED)
    hashes = np.array([h(b" ".join(x), SEED) for x in zip(*(w[i:] for i in range(shingle)), strict=False)], dtype=np.uint64)
    return majority(hashes)


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def majority(hashes: np.ndarray, block: int = 1 << 15) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), block):
        bits = np.unpackbits(hashes[i : i + block].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (signed 64 bits)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), dtype=np.uint64, count=batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_slices(docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text).alias("text")), "text", run, "doc_id long, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x), dtype=np.int64)
    for j in range(31):
        s ^= np.where((x >> np.uint64(j)) & np.uint64(1), j + 1, 0)
    return s


#: For each syndrome s, the masks that lead from a value to the anchors within 2 of it: the single bit s, then the 15 pairs of bits whose numbers give s.
def _masks() -> np.ndarray:
    out = np.zeros((32, 16), dtype=np.uint64)
    for s in range(1, 32):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s]
        out[s] = [1 << (s - 1), *pairs]
    return out


_ANCHOR_MASKS = _masks()


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number in fps, anchor key) of all replicas; the home of a half comes first. Keys hold the half in bit 31."""
    rows, keys = [], []
    for half in (0, 1):
        part = (fps >> np.uint64(31 * half)) & _HALF
        s = _syndrome(part)
        at = part[:, None] ^ _ANCHOR_MASKS[s]
        use = np.ones(at.shape, dtype=bool)
        use[s == 0, 1:] = False  # a code word has no other anchor within 2
        i, j = np.nonzero(use)
        rows.append(i * 2 + (j == 0))
        keys.append(at[i, j] | np.uint64(half << 31))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def _forest(homes: np.ndarray, all_fps: np.ndarray) -> list[tuple[int, int]]:
    """Links between homes and members, without those that earlier ones of this call imply."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(0, len(homes), 256):
        block = homes[i : i + 256]
        near = np.bitwise_count(block[:, None] ^ all_fps[None, :]) <= THRESHOLD
        for a, b in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            x, y = int(block[a]), int(all_fps[b])
            if x != y and (p := find(x)) != (q := find(y)):
                parent[max(p, q)] = min(p, q)
                out.append((x, y))
    return out


def links(classes: DataFrame) -> DataFrame:
    """classes: fp (distinct), id. Returns a, b: a spanning forest of each anchor's links, each end as a struct of id and fp."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                part = batch.slice(k, 20_000)
                fps, ids = part.column("fp").to_numpy().view(np.uint64), part.column("id").to_numpy()
                rows, keys = anchors_of(fps)
                i = rows >> 1
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array((rows & 1).astype(bool)), pa.array(fps[i].view(np.int64)), pa.array(ids[i])], ["anchor", "home", "fp", "id"])

    replicas = classes.mapInArrow(replicate, "anchor long, home boolean, fp long, id long")
    # Anchors with a single member can link nothing, and a count of members tells how many salts an anchor needs.
    sizes = replicas.groupBy("anchor").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 and any_home").withColumn("salts", F.ceil(F.col("n") / SALT_ROWS).cast("int")).select("anchor", "salts")
    members = replicas.join(unsent(sizes), "anchor")
    dealt = members.select("anchor", "home", "fp", "id", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")))).alias("salt"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor and salt; a group is held whole: its replicas are bounded by the salts, its homes by the 32 values of one anchor times what differs outside its half."""

        def edges(rows):
            ida, fpa, idb, fpb = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ida, pa.int64()), pa.array(np.array(fpa, np.uint64).view(np.int64)), pa.array(idb, pa.int64()), pa.array(np.array(fpb, np.uint64).view(np.int64))], ["ia", "fa", "ib", "fb"])

        def flush(fps, home, ids):
            if len(fps) < 2 or not home.any():
                return []
            u = fps.view(np.uint64)
            return [(by_fp[x], x, by_fp[y], y) for x, y in _forest(u[home], u)] if (by_fp := dict(zip(u.tolist(), ids.tolist(), strict=True))) else []

        rest, out = None, []
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            cols = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
            key = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[4]) != 0)) + 1
            bounds = [0, *key.tolist()]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a > 1:
                    out += flush(cols[2][a:b], cols[1][a:b], cols[3][a:b])
            rest = [c[bounds[-1] :] for c in cols]
            if out:
                yield edges(out)
                out = []
        if rest is not None and (out := flush(rest[2], rest[1], rest[3])):
            yield edges(out)

    n = partitions(classes, 8 << 20)  # each class has 32 replicas
    return dealt.repartition(n, "anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(compare, "ia long, fa long, ib long, fb long").select(F.struct(F.col("ia").alias("id"), F.col("fa").alias("fp")).alias("a"), F.struct(F.col("ib").alias("id"), F.col("fb").alias("fp")).alias("b"))


def components(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row."""
    fps = saved(fingerprints(docs, id_column, text), "simhash")
    # A class is known by its smallest id and its fingerprint: the order of nodes is that of ids, so the smallest
    # node of a component names it, and nothing has to be gathered by component. Null ids come last.
    last = F.lit((1 << 63) - 1)
    classes = saved(fps.groupBy("fp").agg(F.coalesce(F.min("doc_id"), last).alias("id")), "simhash-classes")
    found = connected_components(classes.select(F.struct("id", "fp").alias("id")), links(classes))
    by_fp = found.select("id.fp", F.col("component.id").alias("component_id"), "component")
    unnamed = F.col("component_id") == last
    real = fps.where(F.col("doc_id") == last)
    if not real.isEmpty():  # an id of the value that stands for null: its component has a name
        named = by_fp.join(unsent(real.select("fp").distinct()), "fp").select("component", F.lit(True).alias("named")).distinct()
        by_fp = by_fp.join(unsent(named), "component", "left")
        unnamed = unnamed & F.col("named").isNull()
    by_fp = by_fp.select("fp", F.when(~unnamed, F.col("component_id")).alias("component_id"))
    return fps.join(unsent(by_fp), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents whose id is the smallest of their component; of repeated rows with that id, all stay."""
    kept = components(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(unsent(kept), docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    c = components(table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""LM scoring with a log-frequency Bloom filter.

Training documents are counted once: unigrams and bigrams, as 64-bit hashes summed per slice
before the shuffle. The model is a Bloom filter: an n-gram of count c is entered at levels 1 to
1 + floor(log2 c), and a count is read back by probing level after level until one is missing.
The filter is built in blocks by the executors, and its size follows the number of entries. Up to
MAX_FILTER_BYTES it is gathered and broadcast. A larger one stays dealt over parts of PART_BLOCKS
blocks: each slice of texts sends its distinct n-grams to the parts that hold them and gets their
levels back, by two shuffles. Blocks and bits are the same, and so is every score. Every n-gram that
occurs is in the model, once or often.

Score: log10 of the product over tokens w after u (the end token before the first one) of
L(u) * low(u w) / high(u) + (1 - L(u)) * (mid(w) + 1) / (M + V + 1). low and high are the ends and
mid the middle of the count range that the filter reads, M is the sum of mid over all unigrams, and
L(u) = LAMBDA * (1 - 1 / (low(u) + 1)): contexts are trusted by their count. Rounding bigrams down and
their contexts up keeps the sum over w within 1, false positives aside.

The base score needs exact counts. Tokens of at least the count that leaves HEAD_TOKENS of
them are broadcast; all rarer tokens meet their counts by a shuffle join on the hash. Which way a
token goes changes no number.

Nulls are empty texts, which have the end token alone. Texts of any length are scored whole. A null doc_id counts as the empty string
(remainder 0: it trains). Repeated rows count and are scored as often as they occur. Without
any training document N and V are 0. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, partitions, saved, slices, table, text_or_empty

FOLDS, HELD = 7, 2
LAMBDA = 0.3
MAX_FILTER_BYTES = 128 << 20
BITS_PER_ENTRY, PROBES, BLOCK_BYTES = 10, 5, 1 << 16
PART_BLOCKS = 256
HEAD_TOKENS = 1 << 20
SLICE_BYTES = 4 << 20
#: Bytes of stored input a shuffle partition.
TASK_BYTES = 64 << 20
#: An n-gram of this count in a slice is common; so many are held by a task.
COMMON, HELD_ENTRIES = 8, 1 << 20
END = b""
#: Middle of a count range over its lower end.
MID = 4 / 3
_G1, _G2, _G3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Numbers(dict):
    def __missing__(self, token):
        self[token] = n = len(self)
        return n


def tokenise(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers of all texts in a row, where each text begins (and the end), and the hash of each numbered token. The low bit of a unigram hash is 0."""
    numbers, parts, sizes = _Numbers(), [], []
    for t in texts:
        w = t.lower().split()
        w.append(END)
        parts.append(np.fromiter(map(numbers.__getitem__, w), dtype=np.int64, count=len(w)))
        sizes.append(len(w))
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for w in numbers), dtype=np.uint64, count=len(numbers)) & ~np.uint64(1)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), hashes


def contexts(ids: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
    """The token before each token; the end token before the first of a text."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[bounds[:-1]] = end
    return out


def pair_hashes(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hashes of bigrams; the low bit is 1."""
    return mix(before * _G2 + after) | np.uint64(1)


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def count_ngrams(docs: DataFrame) -> DataFrame:
    """h, c of all unigrams and bigrams of docs (text)."""

    def as_batch(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    def counted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids, bounds, hashes = tokenise(_bytes(batch.column(0)))
        end = int(ids[bounds[1] - 1])
        before = contexts(ids, bounds, end)
        # One number a pair sorts faster than two columns do.
        pairs, n2 = np.unique(before * len(hashes) + ids, return_counts=True)
        h2 = pair_hashes(hashes[pairs // len(hashes)], hashes[pairs % len(hashes)])
        n1 = np.bincount(ids, minlength=len(hashes))
        return np.concatenate([hashes, h2]), np.concatenate([n1, n2])

    def run(batches):
        """N-grams that are common in a slice are summed over the slices of the task, so that each costs a row a task; the others wouldn't meet."""
        held, size = [], 0

        def summed():
            h, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return h, np.bincount(at, weights=np.concatenate([x[1] for x in held]), minlength=len(h)).astype(np.int64)

        for part in slices(batches, "text", SLICE_BYTES):
            if not part.num_rows:
                continue
            h, c = counted(part)
            common = c >= COMMON
            yield as_batch(h[~common], c[~common])
            held.append((h[common], c[common]))
            size += len(held[-1][0])
            if size > HELD_ENTRIES:
                held = [summed()]
                size = len(held[0][0])
                if size > HELD_ENTRIES // 2:
                    yield as_batch(*held[0])
                    held, size = [], 0
        if held:
            yield as_batch(*summed())

    n = partitions(docs, TASK_BYTES // 4)
    # Slices are counted already: another partial aggregation would hash mostly distinct pairs for nothing.
    return docs.select("text").mapInArrow(run, "h long, c long").repartition(n, "h").groupBy("h").agg(F.sum("c").alias("c"))


class Filter:
    """Log-frequency Bloom filter in blocks; all probes of an n-gram fall into one block."""

    def __init__(self, data: np.ndarray, first: int = 0, blocks: int | None = None):
        """data: blocks from number first on, of so many in all."""
        self.data, self.first, self.blocks = data, first, blocks or max(1, len(data) // BLOCK_BYTES)

    @staticmethod
    def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
        return ((mix(h ^ _G3) >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)

    @staticmethod
    def places(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        a = mix(h + np.uint64(level * int(_G1) & (1 << 64) - 1))
        return a, (a >> np.uint64(32)) | np.uint64(1)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The highest level up to which all are present, 0 where there is none."""
        out, alive, level = np.zeros(len(h), dtype=np.int8), np.arange(len(h)), 0
        base = (self.block_of(h, self.blocks) - self.first) * BLOCK_BYTES
        mask = np.uint64(8 * BLOCK_BYTES - 1)
        while len(alive) and level < 63:
            level += 1
            a, step = self.places(h[alive], level)
            for i in range(PROBES):
                bit = ((a + np.uint64(i) * step) & mask).astype(np.int64)
                hit = (self.data[base[alive] + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 == 1
                alive, a, step = alive[hit], a[hit], step[hit]
            out[alive] = level
        return out


class Levels:
    """Levels that the parts of a filter have sent back, in place of the filter."""

    def __init__(self, h: np.ndarray, level: np.ndarray):
        order = np.argsort(h)
        self.h, self.level = h[order], level[order]

    def levels(self, h: np.ndarray) -> np.ndarray:
        return self.level[np.searchsorted(self.h, h)]


def n_blocks(n_entries: int) -> int:
    return math.ceil(n_entries * BITS_PER_ENTRY / 8) // BLOCK_BYTES + 1


def filter_blocks(entries: DataFrame, blocks: int) -> DataFrame:
    """block, bits of the blocks that have entries. entries: h, c."""

    def place(batches):
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(Filter.block_of(h, blocks)), b.column(0), b.column(1)], ["block", "h", "c"])

    def make(batches):
        held, last = [], None

        def flush():
            h, c = (np.concatenate(x) for x in zip(*held, strict=True))
            bits, levels = np.zeros(8 * BLOCK_BYTES, dtype=bool), np.floor(np.log2(c)).astype(np.int64) + 1
            for level in range(1, int(levels.max()) + 1):
                a, step = Filter.places(h[levels >= level], level)
                for i in range(PROBES):
                    bits[((a + np.uint64(i) * step) & np.uint64(8 * BLOCK_BYTES - 1)).astype(np.int64)] = True
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

        for b in batches:
            block, h, c = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if last is not None and block[x] != last:
                    yield flush()
                    held = []
                last = int(block[x])
                held.append((h[x:y], c[x:y]))
        if held:
            yield flush()

    n = partitions(entries, TASK_BYTES)
    return entries.select("h", "c").mapInArrow(place, "block long, h long, c long").repartition(n, "block").sortWithinPartitions("block").mapInArrow(make, "block long, bits binary")


def build_filter(entries: DataFrame, n_entries: int) -> np.ndarray:
    """entries: h, c. Blocks are made by the executors; the driver joins them."""
    blocks = n_blocks(n_entries)
    data = np.zeros(blocks * BLOCK_BYTES, dtype=np.uint8)
    for row in filter_blocks(entries, blocks).toLocalIterator():
        data[row.block * BLOCK_BYTES : (row.block + 1) * BLOCK_BYTES] = np.frombuffer(row.bits, dtype=np.uint8)
    return data


def _asked(ids: np.ndarray, bounds: np.ndarray, hashes: np.ndarray, blocks: int, per_part: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a slice and the parts that hold them, in the order of parts and hashes."""
    before = contexts(ids, bounds, int(ids[bounds[1] - 1]))
    pairs = np.unique(before * len(hashes) + ids)
    h = np.unique(np.concatenate([hashes, pair_hashes(hashes[pairs // len(hashes)], hashes[pairs % len(hashes)])]))
    part = Filter.block_of(h, blocks) // per_part
    order = np.argsort(part, kind="stable")
    return h[order], part[order]


def levels_by_shuffle(cut: DataFrame, made: DataFrame, blocks: int) -> DataFrame:
    """slice, part, level (a byte for each n-gram that _asked() gives for the part). cut: as score() writes slices; made: as filter_blocks() gives it."""
    per_part = PART_BLOCKS

    def ask(batches):
        for b in batches:
            for key, *held in zip(*(b.column(c).to_pylist() for c in ("slice", "ids", "bounds", "hashes")), strict=True):
                h, part = _asked(*_numbers(*held), blocks, per_part)
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                n = len(cuts) - 1
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.nulls(n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array([h[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["part", "block", "slice", "data"])

    def answer(batches):
        at, data = None, None
        for b in batches:
            out = []
            for part, block, key, held in zip(*(b.column(c).to_pylist() for c in ("part", "block", "slice", "data")), strict=True):
                if part != at:
                    at, data = part, np.zeros(per_part * BLOCK_BYTES, dtype=np.uint8)
                if block is not None:
                    data[(block - part * per_part) * BLOCK_BYTES :][:BLOCK_BYTES] = np.frombuffer(held, dtype=np.uint8)
                else:
                    out.append((key, part, Filter(data, part * per_part, blocks).levels(np.frombuffer(held, dtype=np.uint64)).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["slice", "part", "level"])

    n = partitions(cut, TASK_BYTES)
    held = made.select(F.floor(F.col("block") / per_part).cast("long").alias("part"), "block", F.lit(None).cast("long").alias("slice"), F.col("bits").alias("data"))
    asked = cut.select("slice", "ids", "bounds", "hashes").mapInArrow(ask, "part long, block long, slice long, data binary")
    return held.union(asked).repartition(n, "part").sortWithinPartitions("part", F.col("block").isNull()).mapInArrow(answer, "slice long, part long, level binary")


def _numbers(ids: bytes, bounds: bytes, hashes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int32).astype(np.int64), np.frombuffer(bounds, np.int64), np.frombuffer(hashes, np.uint64)


def _thresholds(counts: DataFrame) -> tuple[int, int, int, int, float]:
    """N, V, least unigram count of the head, number of entries of the model, and M. One row per order and capped count comes to the driver."""
    order = F.col("h").bitwiseAND(1)
    level = F.floor(F.log2("c")).cast("int") + 1
    rows = counts.groupBy(order.alias("two"), F.least("c", F.lit(4096)).alias("c")).agg(F.count("*").alias("n"), F.sum("c").alias("total"), F.sum(level).alias("levels"), F.sum(F.pow(F.lit(2.0), level - 1)).alias("lows")).collect()
    uni = sorted((r.c, r.n, r.total) for r in rows if not r.two)
    tokens, types = sum(x[2] for x in uni), sum(x[1] for x in uni)
    head, held = 1 << 62, 0
    for c, n, _ in reversed(uni):
        if held + n > HEAD_TOKENS:
            break
        head, held = c, held + n
    n_entries = sum(r.levels for r in rows)
    mids = sum(MID * r.lows for r in rows if not r.two)
    return tokens, types, head, n_entries, mids


def probabilities(f: Filter, hashes: np.ndarray, ids: np.ndarray, before: np.ndarray, middle: float, weight: float = LAMBDA) -> np.ndarray:
    """P(token | token before) for each place, from membership probes alone. middle: M + V + 1."""
    level = f.levels(hashes).astype(np.int64)
    mid = np.where(level > 0, MID * 2.0 ** (level - 1), 0.0)
    high = np.maximum(1.0, 2.0**level)
    level2 = f.levels(pair_hashes(hashes[before], hashes[ids])).astype(np.int64)
    low2 = np.where((level2 > 0) & (level[before] > 0), 2.0 ** (level2 - 1), 0.0)
    # Contexts are trusted by their count; after one that was never seen all weight goes to the unigram.
    trust = np.where(level > 0, weight * (1 - 1 / (2.0 ** (level - 1) + 1)), 0.0)[before]
    return trust * np.minimum(1.0, low2 / high[before]) + (1 - trust) * (mid[ids] + 1) / middle


def score(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = documents.sparkSession
    key = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), (F.crc32(key.cast("binary")) % FOLDS == HELD).alias("held_out"), text_or_empty(text).alias("text"))
    counts = saved(count_ngrams(docs.where("not held_out")), "ngrams")
    total, types, head_from, n_entries, mids = _thresholds(counts)
    two = F.col("h").bitwiseAND(1) == 1
    blocks = n_blocks(n_entries)
    per_part = PART_BLOCKS
    dealt = blocks * BLOCK_BYTES > MAX_FILTER_BYTES
    data = None if dealt else build_filter(counts, n_entries)
    head = counts.where(~two & (F.col("c") >= head_from)).orderBy("h").toArrow()  # HEAD_TOKENS rows at most
    shipped = spark.sparkContext.broadcast((data, head.column("h").to_numpy(), head.column("c").to_numpy()))
    spread, middle = float(total + types + 1), mids + types + 1

    names = ["doc_id", "held_out", "n_tokens", "n_head", "head_log", "score", "tail"]
    schema = "doc_id long, held_out boolean, n_tokens long, n_head long, head_log double, score double, tail array<long>"

    def measured(f: Filter | Levels, doc_id: pa.Array, held: pa.Array, ids: np.ndarray, bounds: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        _, head_h, head_c = shipped.value
        signed = hashes.view(np.int64)
        at = np.minimum(np.searchsorted(head_h, signed), max(0, len(head_h) - 1))
        in_head = head_h[at] == signed if len(head_h) else np.zeros(len(signed), bool)
        c = np.where(in_head, head_c[at], 0) if len(head_h) else np.zeros(len(signed), np.int64)
        sums = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every text has a token at least
        end = int(ids[bounds[1] - 1])
        p = probabilities(f, hashes, ids, contexts(ids, bounds, end), middle)
        tail = ~in_head[ids]
        n_tail = sums(tail.astype(np.int64))
        arrays = [doc_id, held, pa.array(np.diff(bounds)), pa.array(sums(in_head[ids].astype(np.int64))), pa.array(sums(np.log10(c + 1.0)[ids])), pa.array(sums(np.log10(p)))]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_tail)]).astype(np.int32)), pa.array(signed[ids[tail]]))
        return pa.RecordBatch.from_arrays([*arrays, lists], names)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return measured(Filter(shipped.value[0]), batch.column(0), batch.column(1), *tokenise(_bytes(batch.column(2))))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        """One row a slice, known by its first row."""
        ids, bounds, hashes = tokenise(_bytes(batch.column(2)))
        cols = [pa.array([batch.column(3)[0].as_py()], pa.int64()), *(pa.array([batch.column(k).to_pylist()], pa.list_(t)) for k, t in ((0, pa.int64()), (1, pa.bool_()))), *(pa.array([x.tobytes()], pa.binary()) for x in (ids.astype(np.int32), bounds, hashes))]
        return pa.RecordBatch.from_arrays(cols, ["slice", "docs", "held", "ids", "bounds", "hashes"])

    def gather(batches):
        """Levels of a slice come in the order of their parts, the slice after them."""
        got = []
        for b in batches:
            for part, level, docs_, held, *numbers in zip(*(b.column(c).to_pylist() for c in ("part", "level", "docs", "held", "ids", "bounds", "hashes")), strict=True):
                if part is not None:
                    got.append(level)
                    continue
                ids, bounds, hashes = _numbers(*numbers)
                f = Levels(_asked(ids, bounds, hashes, blocks, per_part)[0], np.frombuffer(b"".join(got), dtype=np.int8))
                got = []
                yield measured(f, pa.array(docs_, pa.int64()), pa.array(held, pa.bool_()), ids, bounds, hashes)

    if dealt:
        pieces = "slice long, docs array<long>, held array<boolean>, ids binary, bounds binary, hashes binary"
        written = saved(map_slices(docs.withColumn("row", F.monotonically_increasing_id()), "text", cut, pieces, SLICE_BYTES), "lm-slices")
        levels = saved(levels_by_shuffle(written, filter_blocks(counts, blocks), blocks), "lm-levels")
        n = partitions(written, TASK_BYTES)
        both = levels.unionByName(written, allowMissingColumns=True)
        rows = both.repartition(n, "slice").sortWithinPartitions("slice", F.col("part").isNull(), "part").mapInArrow(gather, schema)
    else:
        rows = map_slices(docs, "text", run, schema, SLICE_BYTES)
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = counts.where(~two & (F.col("c") < head_from))
    tails = rows.select("row", F.explode("tail").alias("h")).join(rare, "h").groupBy("row").agg(F.count("*").alias("n_tail"), F.sum(F.log10(F.col("c") + 1)).alias("tail_log"))
    zero = F.lit(0)
    out = rows.join(tails, "row", "left")
    base = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) - F.col("n_tokens") * math.log10(spread)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", zero)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))

"""WARC: a deterministic sharded writer and a reader.

Records are range-sorted by page_id. Shards are contiguous ranges of ids of about equal bytes, cut by a
histogram: at most BINS bins of ids reach the driver, and bins that hold more than a shard are split
again between their smallest and largest id, until they fit or hold one id. So a few far-off ids don't
spoil the cut, and boundaries depend on the data alone, not on a sample, on partitions or on the
cluster. A single id (or the null id) of more bytes than a shard is dealt over several by the hash of its
payload. Within a shard the writer streams sorted records, compresses each
to a gzip member, and rolls to a new file once roll_bytes of compressed data are reached.
Headers, record ids (UUIDs of name) and digests are generated anew. A file is written under a
temporary name of its attempt and renamed; the manifest, a Parquet table written through
Spark's committer, lists what belongs to the archive, so files of lost attempts are never read.

Of records with equal payloads of at least least_bytes, that with the smallest page_id is the
response and the others are revisits of it. Which row refers to what travels as small rows
(page_id, digest, target) through the same shuffle as the pages: page bodies are shuffled once.

Nulls: a null html is an empty payload, a null url an empty URI; a null page_id sorts first,
is always a response and is never referred to. Repeated rows with a response's id are
responses; rows that share an id but not the payload are judged by their payloads. A payload of any
length is one record, held whole by its task. Any 64-bit id is valid. Empty tables give an archive of no
files. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, shared_dir, table

LEAST_REVISIT_BYTES = 100
#: Files roll at an eighth of a shard's payload, below its compressed size, so that they do roll by it; at least at this size.
ROLL_BYTES = 512 << 10
#: A shard holds so many payload bytes at least, and there are so many shards at most.
SHARD_BYTES, MOST_SHARDS = 4 << 20, 16_384
BINS = 65_536
#: Pages carry no crawl time; archives of the same pages are equal byte by byte.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard long, file string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def encode_record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}"]
    lines += [f"WARC-Target-URI: {quote(url or '', safe='!#$%&()*+,/:;=?@[]~' + chr(39))}", f"WARC-Date: {DATE}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"X-Page-Id: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(record: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


class _Roller:
    """Files of one shard."""

    def __init__(self, out: str, shard: int, roll_bytes: int):
        self.out, self.shard, self.roll_bytes, self.number, self.stream = out, shard, roll_bytes, 0, None
        self.fs, self.root = _fs(out)

    def write(self, record: bytes):
        """Returns a manifest row when a file was closed."""
        if self.stream is None:
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temp = f"{self.root}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.stream, self.records, self.size, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        data = _gzip(record)
        self.stream.write(data)
        self.sha.update(data)
        self.records, self.size = self.records + 1, self.size + len(data)
        return self.close() if self.size >= self.roll_bytes else None

    def close(self):
        if self.stream is None:
            return None
        self.stream.close()
        self.stream = None
        self.fs.move(self.temp, f"{self.root}/{self.name}")
        self.number += 1
        return self.shard, self.name, self.records, self.size, self.sha.hexdigest()


def _last_at_most(values: list[int], x):
    """The number of the last of the ascending values that is at most x, -1 where none is: two short scans instead of one long one."""
    step = max(1, math.isqrt(len(values)))
    literal = lambda v, kind: F.from_json(F.lit(json.dumps(v)), kind)  # noqa: E731  folded once
    outer = F.size(F.filter(literal(values[::step], "array<bigint>"), lambda v: v <= x)) - 1
    inner = F.get(literal([values[i : i + step] for i in range(0, len(values), step)], "array<array<bigint>>"), outer)
    return F.when(outer < 0, F.lit(-1)).otherwise(outer * step + F.size(F.filter(inner, lambda v: v <= x)) - 1)


def _ranges(sized: DataFrame, each: int, bins: int = BINS) -> list[tuple[int, int, int]]:
    """(smallest id, largest id, bytes) of ascending ranges that hold at most `each` bytes or one id. sized: page_id (not null), n."""
    low, high, total = sized.agg(F.min("page_id"), F.max("page_id"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if low is None:
        return []
    done, open_ = [], [(low, high, total)]
    while open_:
        per = max(2, bins // len(open_))
        widths = [(b - a) // per + 1 for a, b, _ in open_]
        wide = F.col("page_id").cast("decimal(20,0)")
        at = _last_at_most([a for a, _, _ in open_], F.col("page_id"))
        pick = lambda v: F.get(F.from_json(F.lit(json.dumps(v)), "array<decimal(20,0)>"), F.col("k"))
        found = sized.withColumn("k", at).where("k >= 0").where(wide <= pick([b for _, b, _ in open_])).withColumn("low", pick([a for a, _, _ in open_])).withColumn("width", pick(widths))
        rows = found.groupBy("k", F.expr("(cast(page_id as decimal(20,0)) - low) div width").alias("b")).agg(F.min("page_id").alias("a"), F.max("page_id").alias("z"), F.sum("n").alias("n")).collect()  # bins rows at most
        parts = [(r.a, r.z, r.n) for r in rows]
        open_ = sorted(p for p in parts if p[2] > each and p[0] < p[1])
        done += [p for p in parts if p[2] <= each or p[0] == p[1]]
    return sorted(done)


def _shards(sized: DataFrame, shard_bytes: int):
    """A function from the columns page_id and h to the shard, the number of shards, and the bytes of one."""
    total, nulls = sized.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("page_id").isNull(), F.col("n"))), F.lit(0))).first()
    each = max(shard_bytes, total // MOST_SHARDS)
    starts, bases, spreads, held = [], [], [], 0
    count = null_shards = max(1, nulls // each) if nulls else 0
    for a, b, n in _ranges(sized.where("page_id is not null"), each):
        many = n // each if a == b and n > each else 1
        if not starts or held >= each or held + n > 2 * each or many > 1:
            starts.append(a)
            bases.append(count)
            spreads.append(many)
            count, held = count + many, 0
        held += n if many == 1 else 2 * each
    if count <= 1:
        return F.lit(0), 1, each
    at = _last_at_most(starts, F.col("page_id"))
    pick = lambda v: F.get(F.from_json(F.lit(json.dumps(v)), "array<int>"), at)
    by_id = pick(bases) + (F.pmod(F.col("h"), pick(spreads)).cast("int") if max(spreads) > 1 else F.lit(0)) if starts else F.lit(0)
    none = F.pmod(F.col("h"), F.lit(max(1, null_shards))).cast("int")
    return F.when(F.col("page_id").isNull(), none).otherwise(by_id), count, each


def write_archive(pages: DataFrame, out: str, roll_bytes: int | None = None, shard_bytes: int = SHARD_BYTES, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) below out and returns the committed manifest. Files roll at roll_bytes of compressed data."""
    spark = pages.sparkSession
    fs, root = _fs(out)
    fs.create_dir(root, recursive=True)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("h", F.xxhash64("html"))
    sized = saved(p.select("page_id", F.octet_length("html").cast("long").alias("n")), "warc-sizes")
    shard, count, each = _shards(sized, shard_bytes)
    roll_bytes = roll_bytes or max(ROLL_BYTES, each // 8)
    digests = p.where(F.octet_length("html") >= least_bytes).select("page_id", "h", F.unhex(F.sha2(F.col("html").cast("binary"), 256)).alias("digest"))
    # Only digests that occur again come back to be joined: for most data a small share.
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    refs = digests.join(firsts, "digest").where("page_id > first").select("page_id", "h", "digest", F.col("first").alias("refers_to")).distinct()
    none = F.lit(None)
    rows = p.select("page_id", F.lit(1).alias("kind"), "url", "html", none.cast("binary").alias("digest"), none.cast("long").alias("refers_to"), "h")
    rows = rows.unionByName(refs.select("page_id", F.lit(0).alias("kind"), none.cast("string").alias("url"), none.cast("string").alias("html"), "digest", "refers_to", "h"))
    rows = rows.withColumn("shard", shard.cast("long"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, owner, refers, done = None, None, {}, []
        for batch in batches:
            cols = [batch.column(n) for n in ("page_id", "kind", "url", "html", "digest", "refers_to", "shard")]
            html = cols[3].cast(pa.binary() if pa.types.is_string(cols[3].type) else pa.large_binary())
            for i, (page_id, kind, url, digest, to, at) in enumerate(zip(*(c.to_pylist() for c in (cols[0], cols[1], cols[2], cols[4], cols[5], cols[6])), strict=True)):
                if owner != page_id:
                    owner, refers = page_id, {}  # a page's references come before its records
                if kind == 0:
                    refers[digest] = to
                    continue
                if roller is None or roller.shard != at:
                    if roller and (row := roller.close()):
                        done.append(row)
                    roller = _Roller(out, at, roll_bytes)
                payload = html[i].as_py()
                row = roller.write(encode_record(page_id, url, payload, refers.get(hashlib.sha256(payload).digest()) if refers else None))
                if row:
                    done.append(row)
        if roller and (row := roller.close()):
            done.append(row)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["shard", "file", "records", "bytes", "sha256"])

    sorted_rows = rows.repartition(count, "shard").sortWithinPartitions("shard", "page_id", "kind", "url", "h")
    sorted_rows.mapInArrow(write, MANIFEST).write.parquet(f"{out}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if not rest and not (rest := stream.read(chunk)):
                raise ValueError("the archive ends inside a record")
            parts.append(d.decompress(rest))
            rest = d.unused_data
        yield b"".join(parts)


def decode_record(data: bytes) -> tuple:
    head, _, block = data.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = block[: int(h["Content-Length"])]
    if h["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError(f"block digest of {h['WARC-Record-ID']} differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload digest of {h['WARC-Record-ID']} differs")
    from urllib.parse import unquote

    to, page = h.get("X-Refers-To-Page"), h.get("X-Page-Id", "")
    return int(page) if page else None, unquote(h.get("WARC-Target-URI", "")), size, digest, h["WARC-Type"], int(to) if to else None, payload if h["WARC-Type"] == "response" else None


def read_archive(spark: SparkSession, out: str, payloads: bool = True) -> DataFrame:
    """One row per record of the committed files, digests checked. A revisit has no payload of its own."""
    files = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(out)
        names = RECORDS.replace(",", "").split()[::2]

        def batch_of(rows):
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in _members(stream):
                        row = decode_record(data)
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(data) * payloads + 200
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return files.repartition(max(1, files.count()) if files.count() < 4096 else 4096, "file").mapInArrow(read, RECORDS)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), out)
    return read_archive(spark, out, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside this class (ASCII space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one is set only where that is unset (tests, local mode)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared checkpoint folder, so that a lost executor costs a read and not a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Paths that saved() wrote within each open scratch().
_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes at its end what saved() wrote inside. What shall stay is taken out of the list that it gives; the last entry is what was written last."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Spark's own setting by which a finished statement drops its shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it back: as checkpoint(), but columnar and compressed. What the statement shuffled is dropped with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table that saved() gave back, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def partitions(df: DataFrame, bytes_each: int) -> int:
    """Shuffle partitions for work on df: those of the session, or more where its files are known to be large. A count that is given can't be changed at run time."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, size // bytes_each) if size < 1 << 52 else least  # a size beyond is Spark's "unknown"


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column):
    """Lower-cases A-Z alone, whatever the locale."""
    return F.translate(column, UPPER, LOWER)


def words(column):
    return F.regexp_extract_all(column, F.lit(WORD), F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that one slice has about most_bytes of the string column at most, or a single row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        first, total = 0, 0
        for i, n in enumerate(sizes):
            if i > first and total + n > most_bytes:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n
        if first < batch.num_rows:
            yield batch.slice(first)


def map_slices(df: DataFrame, column: str, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, most_bytes: int = 8 << 20) -> DataFrame:
    """mapInArrow over slices of bounded size; f gets and returns one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, most_bytes):
            yield f(part)

    return df.mapInArrow(run, schema)


def unsent(df: DataFrame) -> DataFrame:
    """A side of a join that Spark must not broadcast, however small it seems: at 10 MB, its default bound, a dozen of them exceed a driver's memory."""
    return df.hint("merge")


def connected_components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node, by alternating large-star and small-star steps.

    nodes: column id. edges: columns a, b with a != b, in one direction or both.
    Each round is two aggregations on (node, smallest neighbour) pairs, so a hub is summed
    before it is shuffled; the number of rounds grows with the logarithm of the longest path.
    The edge set is checkpointed each round. No side is broadcast, as all grow with the input.
    Returns id, component; nodes without an edge are their own component.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links = checkpoint(links)
    before = None
    for _ in range(most_rounds):
        both = links.select("u", "v").union(links.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(unsent(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(unsent(least), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        links = checkpoint(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(unsent(links.select(F.col("u").alias("id"), F.col("v").alias("component"))), "id", "left").select("id", F.coalesce("component", "id").alias("component"))

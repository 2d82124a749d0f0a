"""An index in versioned snapshots: upserts and deletes as anti-join and union.

Rows lie in buckets by the hash of their path (vectors by that of their symbol's path). A snapshot is a
list of folders, one a table and bucket, so a change of few files writes the buckets of these files anew and
names the others as they are. Data is written under a name of its own; the mark CURRENT-<n> then names what counts.
A mark is made only if there is none of that number and counts once its list is complete, so readers of the old snapshot are
never disturbed and a writer that dies at any point leaves nothing that is seen. One writer at a time is meant; one that
finds that another has followed the snapshot it started from fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EMBEDDINGS, FILES, SYMBOLS

#: Buckets of a new store; one with an index keeps its own.
BUCKETS = 64
TABLES = {"files": FILES, "symbols": SYMBOLS + ", symbol_id bigint", "embeddings": EMBEDDINGS}


def upsert(base: DataFrame, delta: DataFrame, *keys: str) -> DataFrame:
    """base with rows of equal keys replaced by those of delta."""
    return base.join(delta.select(*keys).distinct(), list(keys), "left_anti").unionByName(delta)


def remove(base: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def replace_files(tables: dict[str, DataFrame], files: DataFrame, symbols: DataFrame, embeddings: DataFrame | None = None) -> dict[str, DataFrame]:
    """Files and all that hangs on them replaced: old symbols of their paths go, and with those their vectors."""
    paths = files.select("path")
    stale = tables["symbols"].join(paths.distinct(), "path", "left_semi").select("symbol_id")
    kept = remove(tables["embeddings"], stale, "symbol_id")
    return {"files": upsert(tables["files"], files, "path"), "symbols": remove(tables["symbols"], paths, "path").unionByName(symbols), "embeddings": kept if embeddings is None else upsert(kept, embeddings, "symbol_id")}


def remove_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Rows of the paths gone from all three tables."""
    stale = tables["symbols"].join(paths.select("path").distinct(), "path", "left_semi").select("symbol_id")
    return {"files": remove(tables["files"], paths, "path"), "symbols": remove(tables["symbols"], paths, "path"), "embeddings": remove(tables["embeddings"], stale, "symbol_id")}


class SnapshotStore:
    """Snapshots below a folder that driver and executors share. Reads and writes go through Hadoop's file system, so any store that Spark knows will do."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """Numbers of all marks, complete or not, the newest first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))] if self._fs.exists(self._path(self.root)) else []
        return sorted((int(n.split("-")[1]) for n in names if n.startswith("CURRENT-")), reverse=True)

    def _snapshot(self, number: int) -> dict | None:
        """What a mark says: folder, buckets, and the folders of each table by bucket; None for a mark whose writer died."""
        stream = self._fs.open(self._path(f"{self.root}/CURRENT-{number}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return found if found.get("complete") else None

    def _newest(self) -> tuple[int, dict | None]:
        """Number and content of the snapshot that counts; -1 where there is none."""
        return next(((n, s) for n in self._numbers() if (s := self._snapshot(n))), (-1, None))

    def current(self) -> str | None:
        """The folder of the newest snapshot: a name that changes with each."""
        snapshot = self._newest()[1]
        return f"{self.root}/{snapshot['folder']}" if snapshot else None

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def read(self) -> dict[str, DataFrame]:
        return self._read(self._newest()[1])

    def _read(self, snapshot: dict | None, only: list[int] | None = None) -> dict[str, DataFrame]:
        out = {}
        for k, schema in TABLES.items():
            held = snapshot["tables"][k] if snapshot else {}
            folders = [f"{self.root}/{f}" for b, f in sorted(held.items()) if only is None or int(b) in only]
            out[k] = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return out

    @staticmethod
    def _bucket(buckets: int):
        return F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")

    def write(self, tables: dict[str, DataFrame]) -> str:
        """Writes all buckets of the next snapshot and returns its folder."""
        number, _ = self._newest()
        return self._commit(number, self._written(tables, self.buckets), self.buckets)

    def update(self, paths: DataFrame, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> str | None:
        """Writes the next snapshot by changing the buckets of the paths alone. change: the tables of these buckets to their new rows, all of them of those paths or kept."""
        number, snapshot = self._newest()
        if snapshot is None:
            return self.write(change(self.read()))
        buckets = snapshot["buckets"]
        touched = sorted(r[0] for r in paths.select(self._bucket(buckets)).distinct().collect())  # as many as there are buckets at most
        if not touched:
            return None
        folder, tables = self._written(change(self._read(snapshot, touched)), buckets)
        for k, held in snapshot["tables"].items():
            tables[k] |= {b: f for b, f in held.items() if int(b) not in touched}
        return self._commit(number, (folder, tables), buckets)

    def _written(self, tables: dict[str, DataFrame], buckets: int) -> tuple[str, dict[str, dict[str, str]]]:
        folder = f"v-{uuid.uuid4().hex}"
        listed = {}
        for k, schema in TABLES.items():
            columns = [c.split()[0] for c in schema.split(", ")]
            df = tables[k]
            if "path" in columns:
                df = df.select(*columns, self._bucket(buckets).alias("bucket"))
            else:
                # Vectors follow their symbols; one without a symbol is of no use.
                owners = self.spark.read.schema(f"{TABLES['symbols']}, bucket int").parquet(f"{self.root}/{folder}/symbols").select("symbol_id", "bucket")
                df = df.select(*columns).join(owners, "symbol_id").select(*columns, "bucket")
            order = ["bucket", "path"] if "path" in columns else ["bucket"]
            # Few files a bucket, and none too large: small ones meet in a task, large ones are split.
            df.hint("rebalance", F.col("bucket")).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{self.root}/{folder}/{k}")
            found = self._fs.listStatus(self._path(f"{self.root}/{folder}/{k}"))
            names = [s.getPath().getName() for s in found if s.getPath().getName().startswith("bucket=")]
            listed[k] = {n.split("=")[1]: f"{folder}/{k}/{n}" for n in names}
        return folder, listed

    def _commit(self, base: int, written: tuple[str, dict[str, dict[str, str]]], buckets: int) -> str:
        """Names a snapshot that was made from number base. Fails if another writer has made one from it."""
        folder, tables = written
        number = max(self._numbers(), default=-1) + 1
        mark = self._path(f"{self.root}/CURRENT-{number}")
        stream = self._fs.create(mark, False)  # fails if it exists
        try:
            if self._newest()[0] != base:
                raise RuntimeError(f"another writer has followed snapshot {base}")
            stream.write(bytearray(json.dumps({"folder": folder, "buckets": buckets, "base": base, "tables": tables, "complete": True}).encode()))
        finally:
            stream.close()
        return f"{self.root}/{folder}"

    def vacuum(self, keep: int = 2) -> None:
        """Drops all but the newest snapshots, and data that none of those kept names: also that of writers that died, so none may be at work."""
        complete = [(n, s) for n in self._numbers() if (s := self._snapshot(n))][: max(1, keep)]
        numbers = {n for n, _ in complete}
        folders = {s["folder"] for _, s in complete} | {f.split("/")[0] for _, s in complete for held in s["tables"].values() for f in held.values()}
        for s in self._fs.listStatus(self._path(self.root)):
            name = s.getPath().getName()
            if name.startswith("CURRENT-") and int(name.split("-")[1]) not in numbers or name.startswith("v-") and name not in folders:
                self._fs.delete(s.getPath(), True)

    def drop(self) -> None:
        self._fs.delete(self._path(self.root), True)


def index_status(rows: DataFrame) -> DataFrame:
    """indexed, failed of rows with a status: unreadable files count as indexed, as they end without an error."""
    return rows.agg(F.count_if(F.col("status").isin("ok", "unreadable")).alias("indexed"), F.count_if(F.col("status") == "failed").alias("failed"))

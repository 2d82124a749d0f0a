"""File trees. Spark's own file sources leave out names that begin with a dot or an underscore, so listing is done here."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import INDEX_DIR, SKIP_DIRS, skipped, watch_ignored
from ..functions.text import decoded


#: Folders that the driver hands to executors to list.
LIST_FOLDERS = 64


def _walk(root: str, prune: tuple[str, ...]) -> Iterator[str]:
    for folder, folders, names in os.walk(root):
        # What the predicates would reject anyway isn't entered.
        folders[:] = sorted(d for d in folders if d not in prune and not d.endswith(".egg-info"))
        for n in sorted(names):
            yield os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/")


def _entered(name: str, prune: tuple[str, ...]) -> bool:
    return name not in prune and not name.endswith(".egg-info")


def _store(root: str):
    """File system and base path of a URI, as workers see it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root.rstrip("/"))


def _list_store(spark: SparkSession, root: str, prune: tuple[str, ...]) -> DataFrame:
    """path of all files below a URI. The driver goes down until there are folders enough; executors list what is below them."""
    from pyarrow import fs as pafs

    fs, base = _store(root)
    files, folders = [], [""]
    while folders and len(folders) < LIST_FOLDERS:
        below = []
        for folder in folders:
            for x in fs.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/"))):
                rel = x.path[len(base) :].lstrip("/")
                if x.type == pafs.FileType.Directory:
                    below += [rel] * _entered(x.base_name, prune)
                else:
                    files.append((rel,))
        folders = below

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(root)
        for batch in batches:
            todo, found = batch.column(0).to_pylist(), []
            while todo:
                for x in store.get_file_info(pafs.FileSelector(f"{top}/{todo.pop()}")):
                    rel = x.path[len(top) :].lstrip("/")
                    if x.type == pafs.FileType.Directory:
                        todo += [rel] * _entered(x.base_name, prune)
                    else:
                        found.append(rel)
                if len(found) > 10_000 or not todo:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["path"])
                    found = []

    df = spark.createDataFrame(files, "path string")
    if folders:
        df = df.union(spark.createDataFrame([(f,) for f in sorted(folders)], "path string").repartition(len(folders)).mapInArrow(walk, "path string"))
    return df


def list_files(spark: SparkSession, root: str, watch: bool = False, partitions: int | None = None) -> DataFrame:
    """path (relative to root) of the files to index, or of those to watch. root: a folder that all nodes mount, or the URI of a store."""
    prune = (*SKIP_DIRS, INDEX_DIR) if not watch else (INDEX_DIR,)
    df = _list_store(spark, root, prune) if "://" in root else spark.createDataFrame([(p,) for p in _walk(root, prune)], "path string")
    df = df.where(~(watch_ignored(F.col("path")) if watch else skipped(F.col("path"))))
    return df.repartition(partitions) if partitions else df


def read_files(paths: DataFrame, root: str) -> DataFrame:
    """path, content, last_modified, size, status. Executors read; a file that can't be read is a row with status "unreadable"."""

    def content(path: str) -> tuple[bytes, float, int]:
        full = os.path.join(root, path)
        stat = os.stat(full)
        with open(full, "rb") as f:
            return f.read(), stat.st_mtime, stat.st_size

    def stored(path: str, store) -> tuple[bytes, float, int]:
        fs, base = store
        info = fs.get_file_info(f"{base}/{path}")
        with fs.open_input_file(f"{base}/{path}") as f:
            return f.readall(), info.mtime_ns / 1e9, info.size

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(root) if "://" in root else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    row = (path, *(stored(path, store) if store else content(path)), "ok")
                except OSError:
                    row = (path, None, None, None, "unreadable")
                kinds = (pa.string(), pa.binary(), pa.float64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["path", "raw", "last_modified", "size", "status"])

    raw = paths.select("path").mapInArrow(read, "path string, raw binary, last_modified double, size long, status string")
    return raw.select("path", decoded(F.col("raw")).alias("content"), "last_modified", "size", "status")

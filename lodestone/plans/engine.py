"""The engine: an index in a folder, and the questions it answers. All methods give DataFrames; nothing but query texts, query vectors and file names passes through the driver."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHUNK_LINES, SEARCH_CAP, Flags
from ..functions.paths import language
from ..operators import classify as classification
from ..operators import graph, render, retrieve
from ..operators.chunking import chunk_files
from ..operators.fts import FtsIndex, build_index, load_index, parse_query, sanitised, save_index, search, symbol_id
from ..operators.parsing import extract_symbols
from ..operators.store import SnapshotStore, index_status, remove_files, replace_files
from ..operators.vector_search import Embedder, embed_symbols, top_k
from ..sources import logs
from ..sources.files import list_files, read_files
from ..streaming import cdc


class Engine:
    """chunker: "lines" (fixed blocks) or "symbols" (sections and syntax). embedder: a factory, see vector_search; without one only the lexical side answers."""

    def __init__(self, spark: SparkSession, index_dir: str, embedder: Callable[[], Embedder] | None = None, chunker: str = "lines", stemmed: bool = True, flags: Flags = Flags()):
        self.spark, self.store, self.embedder, self.chunker, self.stemmed, self.flags = spark, SnapshotStore(spark, index_dir), embedder, chunker, stemmed, flags
        self.watcher = None
        self._parts: dict[str, Any] = {}

    # Building

    def _index(self, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """files (path, content, last_modified, size) as rows of the three tables."""
        f = files.withColumn("language", F.coalesce("language", language(F.col("path"))) if "language" in files.columns else language(F.col("path")))
        symbols = (chunk_files(f, CHUNK_LINES) if self.chunker == "lines" else extract_symbols(f)).withColumn("symbol_id", symbol_id())
        vectors = embed_symbols(symbols, self.embedder) if self.embedder else None
        return f.select("path", "language", "last_modified", "size"), symbols, vectors

    def index_files(self, files: DataFrame, paths: DataFrame | None = None) -> None:
        """Indexes files given as a table (path, content, last_modified, size[, language]); those of the same paths are replaced. paths: theirs, where they are cheaper to get than files."""
        self.store.update((files if paths is None else paths).select("path"), lambda tables: replace_files(tables, *self._index(files)))
        self._forget()

    def build_index(self, root: str) -> DataFrame:
        """Indexes a folder anew and returns the counts."""
        read = read_files(list_files(self.spark, root), root)
        empty = {k: df.limit(0) for k, df in self.store.read().items()}
        self.store.write(replace_files(empty, *self._index(read.where("status = 'ok'"))))
        self._forget()
        return index_status(read)

    def ensure_index(self, root: str) -> None:
        """Builds the index if there is none."""
        if self.store.current() is None:
            self.build_index(root)

    def index_paths(self, root: str, paths: list[str]) -> None:
        listed = self.spark.createDataFrame([(p,) for p in paths], "path string")
        self.index_files(read_files(listed, root).where("status = 'ok'"), listed)

    def remove_files(self, paths: list[str]) -> None:
        gone = self.spark.createDataFrame([(p,) for p in paths], "path string")
        self.store.update(gone, lambda tables: remove_files(tables, gone))
        self._forget()

    def drop_index(self) -> None:
        self.store.drop()
        self._forget()

    def _forget(self) -> None:
        if "graphs" in self._parts:
            self._parts["graphs"].release()
        self._parts = {}

    # Parts

    def _part(self, name: str, make: Callable[[], Any]) -> Any:
        """A part of the current snapshot: made anew once a stream or another writer has made another."""
        at = self.store.current()
        if self._parts.get("at") != at:
            self._forget()
            self._parts["at"] = at
        if name not in self._parts:
            self._parts[name] = make()
        return self._parts[name]

    @property
    def tables(self) -> dict[str, DataFrame]:
        return self._part("tables", self.store.read)

    @property
    def fts(self) -> FtsIndex:
        """The inverted index of the current snapshot, stored beside it on first use."""
        return self._part("fts", self._fts)

    def _fts(self) -> FtsIndex:
        at = self.store.current()
        if at is None:
            return build_index(self.tables["symbols"], self.stemmed)
        folder = f"{at}/fts-{'stemmed' if self.stemmed else 'plain'}"
        if not self.store.exists(f"{folder}/statistics/_SUCCESS"):
            save_index(build_index(self.tables["symbols"], self.stemmed), folder)
        return load_index(self.spark, folder)

    @property
    def graphs(self) -> retrieve.Graphs:
        return self._part("graphs", self._graphs)

    def _graphs(self) -> retrieve.Graphs:
        s = self.tables["symbols"]
        return retrieve.Graphs(graph.call_nodes(s), graph.call_edges(s), graph.import_edges(s, self.tables["files"])).kept()

    def _lexical(self, queries: dict[int, str]) -> DataFrame:
        texts = {k: sanitised(q) if self.flags.sanitize_query else q for k, q in queries.items()}
        return search(self.fts, texts, self.spark)

    def _vectors(self, queries: dict[int, str]) -> DataFrame | None:
        if self.embedder is None:
            return None
        try:
            vectors = self.embedder()(list(queries.values()))
        except Exception as error:  # noqa: BLE001  whatever a model fails with: the lexical side answers alone
            warnings.warn(f"queries are not embedded: {error}", stacklevel=2)
            return None
        return self.spark.createDataFrame([(k, [float(x) for x in v]) for k, v in zip(queries, vectors, strict=True)], "query_id long, embedding array<double>")

    # Questions

    def get_context(self, tasks: DataFrame, scope: str | None = None) -> DataFrame:
        """tasks: query_id, task. One nested row a task. scope overrides the scope that the rules find."""
        texts = {r.query_id: r.task for r in tasks.select("query_id", "task").collect()}  # queries are typed by someone: few and short
        return retrieve.get_context(tasks, self._vectors(texts), self._lexical(texts), self.tables["symbols"], self.tables["files"], self.tables["embeddings"], self.graphs, self.flags, scope=scope)

    def context_markdown(self, tasks: DataFrame) -> DataFrame:
        return render.context_markdown(self.get_context(tasks))

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """Result rows of one query, at most SEARCH_CAP."""
        limit = min(limit, SEARCH_CAP)
        vectors, lexical = self._vectors({0: query}), self._lexical({0: query})
        semantic = None if vectors is None else top_k(vectors, self.tables["embeddings"], 2 * limit)
        limits = self.spark.createDataFrame([(0, limit)], "query_id long, fetch int")
        hits = retrieve.hybrid(semantic, lexical, limits, self.flags)
        return retrieve.hits_with_symbols(hits, self.tables["symbols"], self.tables["files"], self.flags)

    def query_error(self, query: str) -> str | None:
        return parse_query(query, self.stemmed).error

    def search_markdown(self, query: str, limit: int = 10) -> DataFrame:
        return render.search_markdown(self.spark.createDataFrame([(0, query)], "query_id long, query string"), self.search(query, limit))

    def expand_context(self, path: str) -> DataFrame:
        return retrieve.expand_context(self.tables["symbols"], self.tables["files"], self.spark.createDataFrame([(path,)], "path string"), self.flags)

    def callers(self, name: str) -> DataFrame:
        return graph.callers(self.graphs.call_nodes, self.graphs.call_edges, self.spark.createDataFrame([(name,)], "name string"))

    def callees(self, name: str) -> DataFrame:
        return graph.callees(self.graphs.call_nodes, self.graphs.call_edges, self.spark.createDataFrame([(name,)], "name string"))

    def deps(self, path: str) -> DataFrame:
        return graph.deps(self.graphs.import_edges, path)

    def dependents(self, path: str) -> DataFrame:
        return graph.dependents(self.graphs.import_edges, path)

    def deps_markdown(self, path: str) -> DataFrame:
        return render.deps_markdown(self.spark.createDataFrame([(path,)], "path string"), self.graphs.import_edges)

    def structure(self) -> DataFrame:
        return retrieve.structure(self.tables["files"], self.tables["symbols"], self.graphs.import_edges)

    def stats(self) -> DataFrame:
        return retrieve.stats(self.tables["files"], self.tables["symbols"])

    def savings_report(self) -> DataFrame:
        return retrieve.savings(self.tables["files"])

    def classify(self, tasks: DataFrame) -> DataFrame:
        return classification.with_config(classification.explain(tasks))

    def tail_logs(self, path: str, n: int = 50) -> DataFrame:
        return logs.tail(logs.read_log(self.spark, path), n)

    # Following changes

    def watch(self, events: DataFrame, root: str, checkpoint: str, trigger: dict | None = None):
        """Indexes the folder if there is no index, then applies the stream of events."""
        self.ensure_index(root)
        self.watcher = cdc.watch(events, self.store, lambda paths: self._index(read_files(paths, root).where("status = 'ok'")), checkpoint, trigger)
        return self.watcher

    def unwatch(self) -> None:
        if self.watcher is not None:
            self.watcher.stop()
            self.watcher = None
        self._forget()

"""The query catalogue: one query an operator, on the test tables or on literal inputs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SEARCH_CAP, scope_config
from ..functions import paths as P
from ..functions.porter import stem_column
from ..functions.text import estimated_tokens, lines
from ..functions.vectors import l2_normalise, mean_pool
from ..operators import chunking, classify, fts, fusion, graph, parsing, render, retrieve, store, vector_search
from ..schemas import SYMBOL_COLUMNS, SYMBOLS
from ..sources import logs
from ..sources.files import list_files, read_files
from ..sources.tables import documents_as_files, is_indexed, table
from ..streaming import cdc
from . import fixtures as X

#: Lexical queries over documents; each kind is a catalogue entry of its own.
FTS_QUERIES = {
    "fts_single_term": "that", "fts_or": "that OR que OR nichtsdergleichen", "fts_and": "the that", "fts_not": "that NOT with", "fts_phrase": '"of the"', "fts_prefix": "tha*", "fts_column": "path: 7 OR content: über", "fts_precedence": "que NOT de OR that with", "fts_first": "^the", "fts_near": "NEAR(that with, 3)",
}
TASK_TEXTS = {1: "that with", 2: "de que les", 3: "fix the words that are here", 4: "und nicht OR que"}
#: Stored vectors that stand for the embedded tasks.
TASK_VECTORS = {1: 3, 2: 14, 3: 159, 4: 265}
SEARCH_LIMIT, DIGITS = 20, 6


def _folder(spark, what: str) -> str:
    """A new folder that all nodes share: below spark.checkpoint.dir, or a local one where that is unset, in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        root = f"file://{made}"
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _files(spark, d) -> DataFrame:
    return documents_as_files(table(spark, d, "documents"))


def _symbols(spark, d) -> DataFrame:
    """Live symbols of documents. The id is that of the document where a text is one chunk, which ties it to the vector of the same number; further chunks have ids of their own beyond."""
    s = chunking.chunk_files(_files(spark, d))
    return s.withColumn("symbol_id", F.col("path").cast("long") + (F.col("line_start") - 1).cast("long") * 1_000_000_000)


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("symbol_id"), "embedding")


def _code(spark) -> DataFrame:
    return spark.createDataFrame(X.CODE, SYMBOLS)


def _imports(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(X.IMPORTS, SYMBOLS), spark.createDataFrame(X.IMPORT_FILES, "path string")


def _import_edges(spark) -> DataFrame:
    return graph.import_edges(*_imports(spark))


def _sections(spark, *languages: str) -> DataFrame:
    f = spark.createDataFrame([r for r in X.SECTION_FILES if r[1] in languages], "path string, language string, content string")
    return chunking.section_symbols(f)


def _events(spark) -> DataFrame:
    return spark.createDataFrame(X.FILE_EVENTS, "event_id long, op string, path string, dest_path string, is_directory boolean").withColumn("ts", F.timestamp_seconds(F.col("event_id")))


def chunk_lines_50(spark, d):
    return chunking.chunk_files(_files(spark, d))


def chunk_lines_30(spark, d):
    return chunking.fallback_chunks(_files(spark, d), 30)


def chunk_lines_20(spark, d):
    return chunking.fallback_chunks(_files(spark, d), 20)


def file_line_stats(spark, d):
    return _files(spark, d).select("path", "language", "size", F.size(lines(F.col("content"))).cast("long").alias("n_lines"))


def file_scan(spark, d):
    """Documents written as files, some under names that are skipped, then listed and read like a project."""
    root = _folder(spark, "files")
    i = F.col("doc_id")
    name = F.concat(F.when(i % 7 == 0, "build/").otherwise(F.concat(F.lit("src/.part"), (i % 20).cast("string"), F.lit("/"))), i.cast("string"), F.when(i % 11 == 0, ".png").otherwise(".py"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                store.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}") as f:
                    f.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    table(spark, d, "documents").select(name.alias("path"), "text").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    read = read_files(list_files(spark, root), root)
    return read.select("path", P.language(F.col("path")).alias("language"), "size", F.length("content").cast("long").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("digest"), "status")


def language_breakdown(spark, d):
    return retrieve.language_breakdown(_files(spark, d))


def index_stats(spark, d):
    return retrieve.stats(_files(spark, d), _symbols(spark, d))


def structure_totals(spark, d):
    return retrieve.stats(_files(spark, d), _symbols(spark, d)).join(retrieve.token_total(_symbols(spark, d)).withColumn("one", F.lit(1)), F.lit(1) == F.col("one")).drop("one")


def token_estimate(spark, d):
    return _symbols(spark, d).select("path", "line_start", estimated_tokens(F.col("content")).cast("long").alias("tokens"))


def savings_report(spark, d):
    return retrieve.savings(_files(spark, d))


def path_language(spark, d):
    given = spark.createDataFrame(X.PATHS, "path string").union(table(spark, d, "pages").select("url"))
    return given.select("path", P.language(F.col("path")).alias("language"), P.suffix(F.col("path")).alias("suffix"))


def skip_predicate(spark, d):
    c = F.col("path")
    return spark.createDataFrame(X.PATHS, "path string").select("path", P.skipped(c).alias("skipped"), P.watch_ignored(c).alias("ignored"))


def indexed_lookup(spark, d):
    asked = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path")).distinct()
    return is_indexed(_files(spark, d), asked)


def _lexical(spark, d, queries, stemmed=False) -> DataFrame:
    return fts.search(fts.build_index(_symbols(spark, d), stemmed), queries, spark)


def _fts(name):
    def run(spark, d):
        s = _symbols(spark, d).select("symbol_id", "path", "line_start")
        return _lexical(spark, d, {0: FTS_QUERIES[name]}).join(s, "symbol_id").select("path", "line_start", F.round("rank", DIGITS).alias("rank"))

    return run


def fts_porter(spark, d):
    s = _symbols(spark, d).select("symbol_id", "path", "line_start")
    return _lexical(spark, d, {0: "anding OR handed"}, stemmed=True).join(s, "symbol_id").select("path", "line_start", F.round("rank", DIGITS).alias("rank"))


def porter_stems(spark, d):
    return spark.createDataFrame(list(X.STEMS), "word string, expected string").select("word", stem_column(F.col("word")).alias("stem"))


def fts_top(spark, d):
    return _fts("fts_or")(spark, d).orderBy("rank", "path", "line_start").limit(SEARCH_LIMIT)


def fts_syntax(spark, d):
    """Which query texts are errors."""
    return spark.createDataFrame([(q, fts.parse_query(q).error is not None) for q, _ in X.QUERY_TEXTS], "query string, error boolean")


def lexical_fallback(spark, d):
    """Without vectors: the lexical side alone, at a fixed score."""
    limits = spark.createDataFrame([(1, 15), (2, 25)], "query_id long, fetch int")
    lexical = _lexical(spark, d, {1: "that", 2: "que OR les"}).withColumn("rank", F.round("rank", DIGITS))
    hits = retrieve.hits_with_symbols(retrieve.hybrid(None, lexical, limits), _symbols(spark, d), _files(spark, d))
    return hits.select("query_id", "path", "line_start", "language", "score", "combined_score")


def fts_normalised(spark, d):
    hits = _lexical(spark, d, {1: "that", 2: "que OR les"})
    return hits.select("query_id", "symbol_id", F.round(fusion.normalised_rank(F.col("rank")), DIGITS).alias("fts_score"))


def vec_l2_normalise(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", l2_normalise(F.transform("embedding", lambda x: x * 4)).alias("e"))
    return v.select("vec_id", F.posexplode("e").alias("dim", "x")).select("vec_id", "dim", F.round("x", DIGITS).alias("value"))


def vec_cosine_pairs(spark, d):
    v = table(spark, d, "embeddings")
    pairs = v.select("vec_id", F.col("embedding").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return vector_search.similarity(pairs).select("vec_id", F.round("score", DIGITS).alias("score"))


def vec_mean_pool(spark, d):
    """Vectors of three neighbours as the tokens of one text, of which the mask leaves some out."""
    v = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("text"), F.struct("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.when(F.col("vec_id") % 4 == 1, 0.0).otherwise(1.0).alias("m")).alias("t"))
    tokens = v.groupBy("text").agg(F.array_sort(F.collect_list("t")).alias("t"))
    size = len(table(spark, d, "embeddings").select("embedding").first()[0])
    pooled = tokens.select("text", mean_pool(F.transform("t", lambda x: x.e), F.transform("t", lambda x: x.m), size).alias("e"))
    return pooled.select("text", F.posexplode("e").alias("dim", "x")).select("text", "dim", F.round("x", DIGITS).alias("value"))


def _vector_queries(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def vec_topk(spark, d):
    return vector_search.top_k(_vector_queries(spark, d), _vectors(spark, d), 10, DIGITS)


def vec_topk_labels(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("symbol_id"), "label")
    return vec_topk(spark, d).join(labels, "symbol_id").groupBy("query_id", "label").agg(F.count("*").alias("n"), F.round(F.max("score"), DIGITS).alias("best"))


def _task_vectors(spark, d) -> DataFrame:
    asked = spark.createDataFrame(list(TASK_VECTORS.items()), "query_id long, vec_id long")
    return table(spark, d, "embeddings").join(F.broadcast(asked), "vec_id").select("query_id", "embedding")


def _hybrid(spark, d, limit: int = SEARCH_LIMIT) -> DataFrame:
    limits = spark.createDataFrame([(k, limit) for k in TASK_TEXTS], "query_id long, fetch int")
    semantic = vector_search.top_k(_task_vectors(spark, d), _vectors(spark, d), 2 * limit, DIGITS)
    lexical = _lexical(spark, d, TASK_TEXTS).withColumn("rank", F.round("rank", DIGITS))
    return retrieve.hybrid(semantic, lexical, limits, digits=DIGITS)


def hybrid_search(spark, d):
    hits = retrieve.hits_with_symbols(_hybrid(spark, d), _symbols(spark, d), _files(spark, d))
    return hits.select("query_id", "path", "line_start", "language", F.round("score", DIGITS).alias("score"), "combined_score")


def _tasks(spark, d) -> DataFrame:
    said = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("task"))
    return said.union(spark.createDataFrame([(-k, t) for k, t in X.TASKS], "query_id long, task string"))


def classify_tasks(spark, d):
    return classify.with_config(classify.classify(_tasks(spark, d))).drop("task")


def explain_tasks(spark, d):
    return classify.explain(_tasks(spark, d)).select("query_id", "scope_name", F.array_join("matched_signals", "|").alias("signals"), "reasoning")


def scope_limits(spark, d):
    return scope_config(spark)


def _scored(spark, d) -> DataFrame:
    """Chunks scored by length, one query a language."""
    s = _symbols(spark, d).join(_files(spark, d).select("path", "language"), "path")
    number = F.element_at(F.create_map(*(F.lit(x) for kv in {"de": 1, "en": 2, "es": 3, "fr": 4}.items() for x in kv)), F.col("language")).cast("long")
    score = F.length("content") / 100000.0
    return s.select(number.alias("query_id"), "symbol_id", "path", "language", *SYMBOL_COLUMNS[1:], score.alias("score"), score.alias("combined_score"))


def _caps(spark) -> DataFrame:
    c = scope_config(spark)
    return c.select(F.col("scope").cast("long").alias("query_id"), "max_files", "max_symbols", "max_tokens")


def budget_cap(spark, d):
    return retrieve.cap(_scored(spark, d), _caps(spark)).select("query_id", "path", "line_start", F.col("tokens").cast("long").alias("tokens"), F.round("combined_score", DIGITS).alias("combined_score"))


def top_files_symbols(spark, d):
    g = retrieve.group_by_file(retrieve.cap(_scored(spark, d), _caps(spark)))
    return g.select("query_id", "path", F.size("symbols").cast("long").alias("n_symbols"), F.round("relevance_score", DIGITS).alias("relevance_score"), F.col("tokens").cast("long").alias("tokens"))


def _contexts(spark, d) -> DataFrame:
    return contexts(spark, d, _lexical(spark, d, TASK_TEXTS).withColumn("rank", F.round("rank", DIGITS)))


def contexts(spark, d, lexical: DataFrame) -> DataFrame:
    """Contexts of the tasks, whatever index their lexical hits come from."""
    tasks = spark.createDataFrame(list(TASK_TEXTS.items()), "query_id long, task string")
    return retrieve.get_context(tasks, _task_vectors(spark, d), lexical, _symbols(spark, d), _files(spark, d), _vectors(spark, d), None, digits=DIGITS)


def context_result(spark, d):
    f = _contexts(spark, d).select("query_id", "scope", "total_tokens", "explanation", F.explode("files").alias("f"))
    return f.select("query_id", "scope", "total_tokens", "explanation", "f.path", "f.language", F.size("f.symbols").cast("long").alias("n_symbols"), F.round("f.relevance_score", DIGITS).alias("relevance_score"))


def context_markdown(spark, d):
    return render.context_markdown(_contexts(spark, d))


def search_markdown(spark, d):
    """As Engine.search_markdown with a limit beyond the cap, for a batch of queries."""
    asked = spark.createDataFrame(list(TASK_TEXTS.items()), "query_id long, query string")
    hits = retrieve.hits_with_symbols(_hybrid(spark, d, min(10 * SEARCH_CAP, SEARCH_CAP)), _symbols(spark, d), _files(spark, d))
    return render.search_markdown(asked, hits)


def expanded_markdown(spark, d):
    asked = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"))
    return render.expanded_markdown(retrieve.expand_context(_symbols(spark, d), _files(spark, d), asked))


def expand_context(spark, d):
    asked = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"))
    e = retrieve.expand_context(_symbols(spark, d), _files(spark, d), asked)
    return e.select("path", "language", F.size("symbols").cast("long").alias("n_symbols"), F.aggregate("symbols", F.lit(0).cast("long"), lambda s, x: s + F.length(x.content)).alias("n_chars"), "relevance_score")


def context_with_graph(spark, d):
    """Expansion on code: a lexical hit, its callers, and the files that its file is linked to."""
    code = _code(spark).unionByName(_imports(spark)[0]).withColumn("symbol_id", fts.symbol_id())
    files = code.select("path").union(_imports(spark)[1]).distinct().withColumn("language", P.language(F.col("path")))
    graphs = retrieve.Graphs(graph.call_nodes(code), graph.call_edges(code), graph.import_edges(code, files)).kept()
    tasks = spark.createDataFrame([(1, "open_socket"), (2, "refactor OR across OR load_config OR anything")], "query_id long, task string")
    lexical = fts.search(fts.build_index(code), {1: "open_socket", 2: "load_config"}, spark)
    out = retrieve.get_context(tasks, None, lexical, code, files, None, graphs)
    return out.select("query_id", "scope", F.posexplode("files").alias("place", "f")).select("query_id", "scope", "place", "f.path", F.size("f.symbols").alias("n_symbols"), F.round("f.relevance_score", DIGITS).alias("relevance_score"))


def call_sites(spark, d):
    return graph.call_sites(_symbols(spark, d)).select("path", "line_start", "callee")


def call_nodes(spark, d):
    return graph.call_nodes(_code(spark))


def call_edges(spark, d):
    return graph.call_edges(_code(spark))


def _names(spark) -> DataFrame:
    return spark.createDataFrame([("log_line",), ("load_config",), ("open_socket",), ("emit",), ("none",)], "name string")


def callers(spark, d):
    return graph.callers(graph.call_nodes(_code(spark)), graph.call_edges(_code(spark)), _names(spark))


def callees(spark, d):
    return graph.callees(graph.call_nodes(_code(spark)), graph.call_edges(_code(spark)), _names(spark))


def callers_markdown(spark, d):
    return render.callers_markdown(_names(spark), callers(spark, d))


def graph_loaded(spark, d):
    """Edges that went through a stored graph."""
    folder = _folder(spark, "graph")
    graph.save_graph(graph.call_nodes(_code(spark)), graph.call_edges(_code(spark)), folder)
    return graph.load_graph(spark, folder)[1]


def import_refs(spark, d):
    return graph.import_refs(_imports(spark)[0])


def import_edges(spark, d):
    return _import_edges(spark)


def deps(spark, d):
    return graph.deps(_import_edges(spark), "app/main.py")


def dependents(spark, d):
    return graph.dependents(_import_edges(spark), "lib/util.py")


def deps_markdown(spark, d):
    return render.deps_markdown(_imports(spark)[1], _import_edges(spark))


def _related(depth):
    def run(spark, d):
        return graph.related_files(_import_edges(spark), _imports(spark)[1].select(F.col("path").alias("start")), depth).withColumn("hops", F.col("hops").cast("long"))

    return run


def entry_points(spark, d):
    return graph.entry_points(_imports(spark)[1], _import_edges(spark))


def hotspots(spark, d):
    return graph.hotspots(_imports(spark)[1], _import_edges(spark), 5)


def graph_json(spark, d):
    return graph.as_json(graph.call_nodes(_code(spark)), graph.call_edges(_code(spark)))


def structure_report(spark, d):
    s, f = _imports(spark)
    files = f.withColumn("language", P.language(F.col("path")))
    return render.structure_markdown(retrieve.structure(files, s, _import_edges(spark)))


def stats_report(spark, d):
    return render.stats_markdown(index_stats(spark, d))


def md_sections(spark, d):
    return _sections(spark, "markdown")


def yaml_chunks(spark, d):
    return _sections(spark, "yaml")


def toml_symbols(spark, d):
    return _sections(spark, "toml")


def docker_blocks(spark, d):
    return _sections(spark, "dockerfile")


def sized_chunks(spark, d):
    return _sections(spark, "json", "xml", "text", "unknown").drop("content")


def html_document(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("language"), F.col("html").alias("content"))
    return chunking.section_symbols(pages).select("path", "symbol_name", "symbol_type", "line_start", "line_end", F.length("content").cast("long").alias("n_chars"))


def sql_symbols(spark, d):
    return _parsed(spark, "sql")


def py_symbols(spark, d):
    return _parsed(spark, "python")


def _parsed(spark, language: str) -> DataFrame:
    return parsing.parsed_symbols(spark.createDataFrame([r for r in X.SOURCE_FILES if r[1] == language], "path string, language string, content string"))


def parsed_symbols(spark, d):
    return parsing.extract_symbols(spark.createDataFrame(X.SOURCE_FILES, "path string, language string, content string"))


#: Event types as file operations, so that the change operators have data.
EVENT_OPS = {"view": "modified", "click": "modified", "purchase": "modified", "signup": "created", "error": "deleted"}


def _event_changes(spark, d) -> DataFrame:
    op = F.element_at(F.create_map(*(F.lit(x) for kv in EVENT_OPS.items() for x in kv)), F.col("event_type"))
    e = table(spark, d, "events").select("event_id", "ts", op.alias("op"), F.col("user_id").cast("string").alias("path"), F.lit(None).cast("string").alias("dest_path"), F.lit(False).alias("is_directory"))
    return cdc.last_changes(cdc.file_changes(e))


def cdc_latest_op(spark, d):
    return _event_changes(spark, d)


def cdc_apply(spark, d):
    """Documents after the changes: deleted ones gone, changed ones re-indexed as empty."""
    f = _files(spark, d).select("path", "language", "last_modified", "size")
    s = _symbols(spark, d)
    tables = {"files": f, "symbols": s.select(*SYMBOL_COLUMNS, "symbol_id"), "embeddings": _vectors(spark, d)}

    def index(paths):
        files = paths.select("path", F.lit("text").alias("language"), F.lit(1.0).alias("last_modified"), F.lit(0).cast("long").alias("size"))
        return files, tables["symbols"].limit(0), None

    after = cdc.apply_changes(tables, _event_changes(spark, d), index)
    counted = after["files"].select("path", "language", "size")
    n = after["symbols"].groupBy("path").agg(F.count("*").alias("n_symbols"))
    return counted.join(n, "path", "left").select("path", "language", "size", F.coalesce("n_symbols", F.lit(0)).cast("long").alias("n_symbols"))


def _reindexed(spark, d):
    """The tables of documents, and what indexes changed ones anew with a line in front."""
    f = _files(spark, d).drop("content")
    tables = {"files": f, "symbols": _symbols(spark, d).select(*SYMBOL_COLUMNS, "symbol_id"), "embeddings": _vectors(spark, d)}

    def index(paths):
        files = _files(spark, d).join(paths, "path", "left_semi").withColumn("content", F.concat(F.lit("changed\n"), "content"))
        symbols = chunking.chunk_files(files).withColumn("symbol_id", fts.symbol_id())
        return files.drop("content"), symbols.select(*SYMBOL_COLUMNS, "symbol_id"), symbols.select("symbol_id", F.array(F.length("content").cast("float")).alias("embedding"))

    return tables, index


def _reindex_counts(after: dict[str, DataFrame]) -> DataFrame:
    new = after["symbols"].join(after["embeddings"].where("size(embedding) = 1"), "symbol_id", "left")
    n = new.groupBy("path").agg(F.count("*").alias("n_symbols"), F.sum(F.length("content").cast("long")).alias("n_chars"), F.coalesce(F.sum(F.get("embedding", F.lit(0)).cast("long")), F.lit(0)).cast("long").alias("embedded_chars"))
    return after["files"].select("path", "language").join(n, "path")


def cdc_reindex(spark, d):
    """Documents after the changes: deleted ones gone, changed ones indexed anew, symbols and vectors with them."""
    last = _event_changes(spark, d)
    tables, index = _reindexed(spark, d)
    return _reindex_counts(cdc.apply_changes(tables, last, index))


def store_reindex(spark, d):
    """The same through a stored index, which writes the buckets of the changed paths alone."""
    last = _event_changes(spark, d)
    tables, index = _reindexed(spark, d)
    s = store.SnapshotStore(spark, _folder(spark, "index"), 16)
    s.write(tables)
    s.update(last, lambda held: cdc.apply_changes(held, last, index))
    return _reindex_counts(s.read())


def embedded_symbols(spark, d):
    """With a stand-in for a model: shares of three letters and all others, to unit length."""

    def factory():
        import numpy as np

        def embed(texts):
            out = np.array([[t.count("e"), t.count("n"), t.count("a"), len(t) - t.count("e") - t.count("n") - t.count("a")] for t in texts], dtype=np.float64)
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return embed

    e = vector_search.embed_symbols(_symbols(spark, d), factory)
    return e.select("symbol_id", F.posexplode("embedding").alias("dim", "x")).select("symbol_id", "dim", F.round(F.col("x").cast("double"), 4).alias("value"))


def cdc_moves(spark, d):
    return cdc.last_changes(cdc.file_changes(_events(spark)))


def listing_diff(spark, d):
    now = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(0.0).alias("last_modified"), F.col("n_chars").alias("size"))
    before = now.where("cast(path as int) % 7 <> 0").withColumn("size", F.when(F.col("path").cast("int") % 5 == 0, F.col("size") + 1).otherwise(F.col("size"))).union(spark.createDataFrame([("gone", 0.0, 1)], "path string, last_modified double, size long"))
    return cdc.diff_listing(before, now)


def upsert_replace(spark, d):
    base = _files(spark, d).select("path", "language", "size")
    delta = base.where("cast(path as int) % 10 = 3").withColumn("language", F.lit("new")).union(spark.createDataFrame([("new.py", "python", 7)], "path string, language string, size long"))
    return store.upsert(base, delta, "path")


def remove_cascade(spark, d):
    """Rows left in each table after files go."""
    s = _symbols(spark, d)
    tables = {"files": _files(spark, d), "symbols": s, "embeddings": _vectors(spark, d)}
    gone = tables["files"].where("cast(path as int) % 3 = 0").select("path")
    left = store.remove_files(tables, gone)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in left.items()]
    return parts[0].union(parts[1]).union(parts[2])


def index_counts(spark, d):
    rows = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 9 == 0, "failed").when(F.col("o_orderkey") % 7 == 0, "unreadable").when(F.col("o_orderkey") % 5 == 0, "skipped").otherwise("ok").alias("status"))
    return store.index_status(rows)


def log_tail(spark, d):
    return logs.tail(spark.createDataFrame(X.LOG, "line_no long, value string"), 6)


def log_tail_by_source(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("line_no"), F.concat(F.upper("event_type"), F.lit(" "), F.col("props")).alias("value"))
    return logs.tail_by_source(e, 5)


def file_symbols(spark, d):
    w = Window.partitionBy("path").orderBy("line_start")
    return _symbols(spark, d).withColumn("place", F.row_number().over(w)).select("path", "place", "line_start", "line_end")


QUERIES = {
    f.__name__: f
    for f in (
        chunk_lines_50, chunk_lines_30, chunk_lines_20, file_line_stats, file_scan, language_breakdown, index_stats, structure_totals, token_estimate, savings_report, path_language, skip_predicate, indexed_lookup, file_symbols,
        fts_porter, porter_stems, fts_top, fts_normalised, fts_syntax, lexical_fallback, vec_l2_normalise, vec_mean_pool, vec_cosine_pairs, vec_topk, vec_topk_labels, embedded_symbols, hybrid_search, classify_tasks, explain_tasks, scope_limits, budget_cap, top_files_symbols, context_result, context_markdown, search_markdown, expanded_markdown, expand_context, context_with_graph,
        call_sites, call_nodes, call_edges, callers, callees, callers_markdown, import_refs, import_edges, deps, dependents, deps_markdown, entry_points, hotspots, graph_json, graph_loaded, structure_report, stats_report,
        md_sections, yaml_chunks, toml_symbols, docker_blocks, sized_chunks, html_document, sql_symbols, py_symbols, parsed_symbols, cdc_latest_op, cdc_apply, cdc_reindex, store_reindex, cdc_moves, listing_diff, upsert_replace, remove_cascade, index_counts, log_tail, log_tail_by_source,
    )
}
QUERIES |= {name: _fts(name) for name in FTS_QUERIES}
QUERIES |= {f"related_files_k{k}": _related(k) for k in (1, 2, 3)}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked context of a batch of tasks."""
    return hybrid_search(spark, sf_dir)

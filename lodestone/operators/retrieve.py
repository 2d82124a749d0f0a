"""Context for tasks: classify, search, expand along the graphs, limit, group. Every step is keyed by query_id, so a batch of tasks is one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EXPANDED_SCORE, LEXICAL_ONLY_SCORE, REQUESTED_SCORE, SCOPES, WELL_COVERED_HITS, Flags
from ..functions.text import bare_name, estimated_tokens
from .classify import explain, with_config
from .fusion import fuse, top_per_query
from .graph import callers, hotspots, related_files
from .vector_search import top_k

DEEPEST = 3
COLUMNS = ("query_id", "symbol_id", "path", "language", "symbol_name", "symbol_type", "line_start", "line_end", "content", "score", "combined_score")


@dataclass
class Graphs:
    """Edge and node tables; None where there is no graph."""

    call_nodes: DataFrame
    call_edges: DataFrame
    import_edges: DataFrame

    def kept(self) -> Graphs:
        """Persisted: a question uses each table several times. Blocks that don't fit or get lost are computed again."""
        return Graphs(self.call_nodes.persist(), self.call_edges.persist(), self.import_edges.persist())

    def release(self) -> None:
        for df in (self.call_nodes, self.call_edges, self.import_edges):
            df.unpersist()


def hits_with_symbols(hits: DataFrame, symbols: DataFrame, files: DataFrame, flags: Flags = Flags()) -> DataFrame:
    """Fused hits as result rows. A hit that the vector side found knows its language, one of the lexical side alone does not."""
    joined = hits.join(symbols, "symbol_id").join(files.select("path", F.col("language").alias("_language")), "path", "left")
    known = F.coalesce("_language", F.lit("unknown"))
    return joined.withColumn("language", known if flags.fix_language else F.when(F.col("semantic"), known).otherwise("unknown")).select(*COLUMNS)


def hybrid(semantic: DataFrame | None, lexical: DataFrame | None, limits: DataFrame, flags: Flags = Flags(), digits: int | None = None) -> DataFrame | None:
    """The fallback chain: both sides fused; without vectors the lexical side alone at a fixed score; without either nothing.

    limits: query_id, fetch (rows in the end; each side may bring twice as many).
    """
    lim = F.broadcast(limits.select("query_id", "fetch"))
    if semantic is not None and lexical is not None:
        lex = top_per_query(lexical.join(lim, "query_id"), [F.col("rank"), F.col("symbol_id")], 2 * F.col("fetch")).drop("fetch")
        fused = fuse(semantic, lex, 1 << 30, flags.fix_fts_norm, digits)
        return top_per_query(fused.join(lim, "query_id"), [F.desc("combined_score"), F.col("symbol_id")], F.col("fetch")).drop("fetch")
    if lexical is not None:
        lex = top_per_query(lexical.join(lim, "query_id"), [F.col("rank"), F.col("symbol_id")], F.col("fetch"))
        return lex.select("query_id", "symbol_id", F.lit(LEXICAL_ONLY_SCORE).alias("score"), F.lit(LEXICAL_ONLY_SCORE).alias("combined_score"), F.lit(False).alias("semantic"))
    return None


def expansion_files(results: DataFrame, limits: DataFrame, graphs: Graphs) -> DataFrame:
    """query_id, path of files that call what was found or are near its files in the import graph."""
    lim = F.broadcast(limits.select("query_id", "use_callers", "use_deps", "search_depth"))
    r = results.join(lim, "query_id")
    names = r.where("use_callers").select("query_id", bare_name(F.col("symbol_name")).alias("name")).distinct()
    calling = callers(graphs.call_nodes, graphs.call_edges, names.select("name")).select("name", "file_path").distinct()
    by_calls = names.join(calling, "name").select("query_id", F.col("file_path").alias("path"))
    seen = r.where("use_deps").select("query_id", "path", "search_depth").distinct()
    starts = seen.groupBy(F.col("path").alias("start")).agg(F.max("search_depth").alias("depth"))
    near = related_files(graphs.import_edges, starts, DEEPEST)
    by_imports = seen.join(near.select("start", F.col("path").alias("related"), "hops"), F.col("path") == F.col("start")).where("hops <= search_depth").select("query_id", F.col("related").alias("path"))
    extra = by_calls.union(by_imports).distinct()
    covered = results.groupBy("query_id", "path").agg(F.count("*").alias("n")).where(F.col("n") >= WELL_COVERED_HITS)
    return extra.join(covered.select("query_id", "path"), ["query_id", "path"], "left_anti")


def expand(results: DataFrame, limits: DataFrame, graphs: Graphs, symbols: DataFrame, files: DataFrame, flags: Flags = Flags()) -> DataFrame:
    """results and all symbols of the expansion files at score 0."""
    extra = expansion_files(results, limits, graphs).join(symbols, "path")
    if flags.dedup_expanded:
        extra = extra.join(results.select("query_id", "symbol_id"), ["query_id", "symbol_id"], "left_anti")
    language = F.lit("unknown")
    if flags.fix_language:
        extra, language = extra.join(files.select("path", F.col("language").alias("_language")), "path", "left"), F.coalesce("_language", F.lit("unknown"))
    zero = F.lit(EXPANDED_SCORE)
    return results.unionByName(extra.withColumn("language", language).withColumn("score", zero).withColumn("combined_score", zero).select(*COLUMNS))


def cap(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows of the best files, the best symbols of those, and of these the longest run from the top that fits the token budget.

    Adds tokens and file_rank. Ties: files by path, symbols by path and line.
    """
    lim = F.broadcast(limits.select("query_id", "max_files", "max_symbols", "max_tokens"))
    best = rows.groupBy("query_id", "path").agg(F.max("combined_score").alias("best")).where("best > -1")
    w = Window.partitionBy("query_id").orderBy(F.desc("best"), "path")
    top = best.join(lim.select("query_id", "max_files"), "query_id").withColumn("file_rank", F.row_number().over(w)).where("file_rank <= max_files").select("query_id", "path", "file_rank")
    order = [F.desc("combined_score"), F.col("path"), F.col("line_start"), F.col("symbol_name"), F.desc("score")]
    kept = rows.join(top, ["query_id", "path"]).join(lim.select("query_id", "max_symbols", "max_tokens"), "query_id")
    kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where("_r <= max_symbols").withColumn("tokens", estimated_tokens(F.col("content")))
    running = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("_sum", running).where("_sum <= max_tokens").drop("_sum", "max_symbols", "max_tokens")


def group_by_file(capped: DataFrame) -> DataFrame:
    """query_id, path, language, symbols (by line), relevance_score (their mean), tokens, first (rank of the file's best symbol)."""
    entry = F.struct("line_start", "_r", "language", F.struct(F.col("symbol_name").alias("name"), "symbol_type", "line_start", "line_end", "content", F.col("combined_score").alias("score")).alias("symbol"))
    g = capped.groupBy("query_id", "path").agg(F.sort_array(F.collect_list(entry)).alias("e"), F.avg("combined_score").alias("relevance_score"), F.sum("tokens").alias("tokens"), F.min("_r").alias("first"))
    return g.select("query_id", "path", F.get("e", F.lit(0)).language.alias("language"), F.transform("e", lambda x: x.symbol).alias("symbols"), "relevance_score", "tokens", "first")


def context_results(classified: DataFrame, files_found: DataFrame) -> DataFrame:
    """One nested row per task, also for those without a result."""
    entry = F.struct((-F.col("relevance_score")).alias("a"), F.col("first").alias("b"), F.struct("path", "language", "symbols", "relevance_score").alias("f"))
    nested = files_found.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("e"), F.sum("tokens").alias("total_tokens"))
    joined = classified.join(nested, "query_id", "left")
    return joined.select("query_id", "task", F.lower("scope_name").alias("scope"), F.coalesce(F.transform("e", lambda x: x.f), F.array().cast("array<struct<path:string,language:string,symbols:array<struct<name:string,symbol_type:string,line_start:int,line_end:int,content:string,score:double>>,relevance_score:double>>")).alias("files"), F.coalesce("total_tokens", F.lit(0)).cast("long").alias("total_tokens"), "any_hit", "reasoning")


def get_context(tasks: DataFrame, query_vectors: DataFrame | None, lexical: DataFrame | None, symbols: DataFrame, files: DataFrame, embeddings: DataFrame | None, graphs: Graphs | None, flags: Flags = Flags(), digits: int | None = None, scope: str | None = None) -> DataFrame:
    """query_id, task, scope, files, total_tokens, explanation of every task. scope: the name of a scope for all tasks, else each gets its own.

    tasks: query_id, task. query_vectors: query_id, embedding. lexical: query_id, symbol_id, rank.
    """
    explained = explain(tasks)
    if scope is not None:
        number = {name.lower(): n for n, name, *_ in SCOPES}[scope.lower()]
        explained = explained.withColumns({"scope": F.lit(number), "scope_name": F.lit(scope.upper())})
    classified = with_config(explained)
    limits = classified.withColumn("fetch", 2 * F.col("max_symbols"))
    semantic = None
    if query_vectors is not None and embeddings is not None:
        wanted = query_vectors.join(limits.select("query_id", (2 * F.col("fetch")).alias("k")), "query_id")
        semantic = top_k(wanted, embeddings, "k", digits)
    hits = hybrid(semantic, lexical, limits, flags, digits)
    if hits is None:
        empty = F.array().cast("array<struct<path:string,language:string,symbols:array<struct<name:string,symbol_type:string,line_start:int,line_end:int,content:string,score:double>>,relevance_score:double>>")
        return classified.select("query_id", "task", F.lower("scope_name").alias("scope"), empty.alias("files"), F.lit(0).cast("long").alias("total_tokens"), F.concat(F.lit("No results found. "), F.col("reasoning")).alias("explanation"))
    results = hits_with_symbols(hits, symbols, files, flags)
    every = expand(results, limits, graphs, symbols, files, flags) if graphs is not None else results
    found = results.select("query_id", F.lit(True).alias("any_hit")).distinct()
    out = context_results(classified.join(found, "query_id", "left"), group_by_file(cap(every, limits)))
    explanation = F.when(F.coalesce("any_hit", F.lit(False)), F.col("reasoning")).otherwise(F.concat(F.lit("No results found. "), F.col("reasoning")))
    return out.select("query_id", "task", "scope", "files", "total_tokens", explanation.alias("explanation"))


def expand_context(symbols: DataFrame, files: DataFrame, paths: DataFrame, flags: Flags = Flags()) -> DataFrame:
    """path, language, symbols, relevance_score: all symbols of the files asked for."""
    entry = F.struct("line_start", F.struct(F.col("symbol_name").alias("name"), "symbol_type", "line_start", "line_end", "content", F.lit(REQUESTED_SCORE).alias("score")).alias("symbol"))
    g = symbols.join(paths.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    d = paths.select("path").distinct().join(g, "path", "left")
    language = F.lit("unknown")
    if flags.fix_language:
        d, language = d.join(files.select("path", F.col("language").alias("_l")), "path", "left"), F.coalesce("_l", F.lit("unknown"))
    empty = F.array().cast("array<struct<name:string,symbol_type:string,line_start:int,line_end:int,content:string,score:double>>")
    return d.select("path", language.alias("language"), F.coalesce(F.transform("e", lambda x: x.symbol), empty).alias("symbols"), F.lit(REQUESTED_SCORE).alias("relevance_score"))


def stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: file_count, symbol_count."""
    counted = files.select(F.lit(1).alias("f"), F.lit(0).alias("s")).unionAll(symbols.select(F.lit(0), F.lit(1)))
    return counted.agg(F.coalesce(F.sum("f"), F.lit(0)).cast("long").alias("file_count"), F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("symbol_count"))


def token_total(symbols: DataFrame) -> DataFrame:
    return symbols.agg(F.floor(F.coalesce(F.sum(F.length("content").cast("long")), F.lit(0)) / 4).cast("long").alias("total_tokens_estimate"))


def language_breakdown(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("n_files"))


def structure(files: DataFrame, symbols: DataFrame, import_edges: DataFrame, n: int = 10) -> DataFrame:
    """One row: totals, language_breakdown (map), the first entry_points and hotspot_files. Lists are cut to n before they are gathered."""
    from .graph import entry_points

    one = F.lit(1).alias("one")
    totals = stats(files, symbols).select(one, F.col("file_count").alias("total_files"), F.col("symbol_count").alias("total_symbols"))
    tokens = token_total(symbols).select(one, "total_tokens_estimate")
    languages = language_breakdown(files).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n_files")))).alias("language_breakdown")).select(one, "language_breakdown")
    entries = entry_points(files, import_edges).orderBy("path").limit(n).agg(F.array_sort(F.collect_list("path")).alias("entry_points")).select(one, "entry_points")
    hot = hotspots(files, import_edges, n).agg(F.sort_array(F.collect_list(F.struct((-F.col("dependent_count")).alias("a"), "file_path", "dependent_count"))).alias("h"))
    hot = hot.select(one, F.transform("h", lambda x: F.struct(x.file_path.alias("file_path"), x.dependent_count.alias("dependent_count"))).alias("hotspot_files"))
    return totals.join(tokens, "one").join(languages, "one").join(entries, "one").join(hot, "one").drop("one")


def savings(files: DataFrame) -> DataFrame:
    """One row: file_count, raw_tokens, saved_tokens, reduction (percent, one decimal)."""
    from ..config import CONTEXT_TOKENS, RAW_TOKENS_PER_FILE

    c = files.agg(F.count("*").alias("file_count")).withColumn("raw_tokens", F.col("file_count") * RAW_TOKENS_PER_FILE)
    c = c.withColumn("saved_tokens", F.greatest(F.lit(0).cast("long"), F.col("raw_tokens") - CONTEXT_TOKENS))
    return c.withColumn("reduction", F.when(F.col("raw_tokens") > 0, F.round(100 * F.col("saved_tokens") / F.col("raw_tokens"), 1)).otherwise(F.lit(0.0)))

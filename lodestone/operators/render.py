"""Results as Markdown, one text a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lines(*parts) -> Column:
    return F.array_join(F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts)), "\n")


def _counted(n: Column) -> Column:
    return F.format_number(n, 0)


def context_markdown(results: DataFrame, title: str = "lodestone context") -> DataFrame:
    """query_id, markdown of context results."""

    def symbol(s):
        return _lines(F.format_string("### %s: `%s` (lines %d–%d)", s.symbol_type, s["name"], s.line_start, s.line_end), "", "```", F.regexp_replace(s.content, r"\s+$", ""), "```", "")

    def file(f):
        head = _lines(F.format_string("## File: `%s` (relevance: %.2f)", f.path, f.relevance_score), F.concat(F.lit("**Language:** "), f.language), "")
        return F.array_join(F.concat(F.array(head), F.transform(f.symbols, symbol)), "\n")

    head = _lines(F.format_string(f"# {title} — %s scope", F.col("scope")), "", F.concat(F.lit("**Task:** "), "task"), F.concat(F.lit("**Reasoning:** "), "explanation"), F.concat(F.lit("**Estimated tokens:** "), _counted(F.col("total_tokens"))), "")
    body = F.when(F.size("files") == 0, F.lit("_No relevant context found._")).otherwise(F.array_join(F.transform("files", file), "\n"))
    return results.select("query_id", F.concat(head, F.lit("\n"), body).alias("markdown"))


def expanded_markdown(contexts: DataFrame) -> DataFrame:
    def symbol(language):
        return lambda s: _lines(F.format_string("### %s: %s (lines %d-%d)", s.symbol_type, s["name"], s.line_start, s.line_end), F.concat(F.lit("```"), language), s.content, "```\n")

    parts = F.concat(F.array(F.concat(F.lit("## Expanded: "), "path", F.lit("\n"))), F.transform("symbols", symbol(F.col("language"))))
    return contexts.select("path", F.array_join(parts, "\n").alias("markdown"))


def _listing(rows: DataFrame, key: str, order: list[str], line: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x.line).alias("items"))


def callers_markdown(names: DataFrame, found: DataFrame) -> DataFrame:
    """name, markdown for each name asked for."""
    line = F.format_string("- `%s` in `%s` line %d", F.col("function_name"), F.col("file_path"), F.col("line_start"))
    d = names.select("name").distinct().join(_listing(found, "name", ["file_path", "line_start", "function_name"], line), "name", "left")
    none = F.format_string("No callers found for `%s`.", F.col("name"))
    some = F.concat(F.format_string("## Callers of `%s`\n\n", F.col("name")), F.array_join("items", "\n"))
    return d.select("name", F.when(F.col("items").isNull(), none).otherwise(some).alias("markdown"))


def deps_markdown(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """path, markdown for each path asked for."""
    p = paths.select("path").distinct()
    line = lambda c: F.format_string("  - `%s`", F.col(c))
    out = _listing(edges.select(F.col("src").alias("path"), "dst"), "path", ["dst"], line("dst")).withColumnRenamed("items", "out")
    into = _listing(edges.select(F.col("dst").alias("path"), "src"), "path", ["src"], line("src")).withColumnRenamed("items", "into")
    d = p.join(out, "path", "left").join(into, "path", "left")
    listed = lambda c: F.coalesce(F.array_join(c, "\n"), F.lit("  - none found"))
    return d.select("path", _lines(F.format_string("## Dependencies for `%s`\n", F.col("path")), "### This file imports:", listed("out"), "\n### Files that import this file:", listed("into")).alias("markdown"))


def search_markdown(queries: DataFrame, results: DataFrame) -> DataFrame:
    """query_id, markdown. queries: query_id, query. results: as result rows, best first by combined_score."""
    line = _lines(
        F.format_string("### `%s` — %s: `%s` (lines %d-%d) score: %s", F.col("path"), F.col("symbol_type"), F.col("symbol_name"), F.col("line_start"), F.col("line_end"), F.round("score", 3).cast("string")),
        F.concat(F.lit("```"), "language"), F.col("content"), "```\n",
    )
    rows = results.withColumn("_o", -F.col("combined_score"))
    d = queries.join(_listing(rows, "query_id", ["_o", "path", "line_start"], line), "query_id", "left")
    some = F.concat(F.format_string("## Search results for `%s`\n\n", F.col("query")), F.array_join("items", "\n"))
    return d.select("query_id", F.when(F.col("items").isNull(), F.format_string("No results found for `%s`.", F.col("query"))).otherwise(some).alias("markdown"))


def structure_markdown(structure: DataFrame) -> DataFrame:
    languages = F.transform(F.map_entries("language_breakdown"), lambda e: F.format_string("  - %s: %d files", e.key, e.value))
    entries = F.transform(F.slice("entry_points", 1, 10), lambda p: F.format_string("  - `%s`", p))
    hot = F.transform(F.slice("hotspot_files", 1, 10), lambda h: F.format_string("  - `%s` (%d dependents)", h.file_path, h.dependent_count))
    head = F.array(F.lit("## Project Structure\n"), F.format_string("**Files:** %d  ", F.col("total_files")), F.format_string("**Symbols:** %d  ", F.col("total_symbols")), F.format_string("**Est. tokens:** %d\n", F.col("total_tokens_estimate")), F.lit("### Language Breakdown"))
    parts = F.concat(head, languages, F.array(F.lit("\n### Entry Points")), entries, F.array(F.lit("\n### Most Depended-On Files")), hot)
    return structure.select(F.array_join(parts, "\n").alias("markdown"))


def stats_markdown(stats: DataFrame, size_kb: int = 0, watching: bool = False) -> DataFrame:
    return stats.select(_lines("## lodestone stats\n", F.format_string("**Indexed files:** %d", F.col("file_count")), F.format_string("**Total symbols:** %d", F.col("symbol_count")), f"**DB size:** {size_kb} KB", f"**Watcher:** {'running' if watching else 'stopped'}").alias("markdown"))

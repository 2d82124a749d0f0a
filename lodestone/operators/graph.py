"""Call and import graphs as edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import parent
from ..functions.text import bare_name

# Suffixes that an import may resolve to, in order; the import pattern.
IMPORT_SUFFIXES = (".py", "/__init__.py", ".ts", ".js", ".tsx", ".jsx")
IMPORT = r"(?U)(?:from\s+(\.{0,3}[\w.]*)\s+import\s+[\w,\s*]+)|(?:import\s+([\w.]+))"
CALLING_TYPES = ("function", "method", "chunk")
LEAST_NAME = 3


def node_id(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit("::"), name)


def call_nodes(symbols: DataFrame) -> DataFrame:
    """One node per path and name; of several the last by line gives the attributes."""
    s = symbols.where(F.col("symbol_type").isin(*CALLING_TYPES))
    last = F.max(F.struct("line_start", "line_end", "content"))
    return s.groupBy("path", "symbol_name").agg(last.alias("m")).select(node_id(F.col("path"), F.col("symbol_name")).alias("id"), "symbol_name", F.col("path").alias("file_path"), F.col("m.line_start").alias("line_start"))


def call_sites(symbols: DataFrame) -> DataFrame:
    """path, symbol_name, line_start, callee: names followed by an opening bracket, once a symbol."""
    s = symbols.where(F.col("symbol_type").isin(*CALLING_TYPES))
    found = F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"(?U)\b(\w+)\s*\("), F.lit(1)))
    return s.select("path", "symbol_name", "line_start", F.explode(found).alias("callee"))


def call_edges(symbols: DataFrame) -> DataFrame:
    """src, dst, caller_file, callee_file, line. Extraction and an equi-join stand for a pattern of all names."""
    s = symbols.where(F.col("symbol_type").isin(*CALLING_TYPES)).withColumn("bare", bare_name(F.col("symbol_name")))
    targets = s.where(F.length("bare") >= LEAST_NAME).select(F.col("bare").alias("callee"), node_id(F.col("path"), F.col("symbol_name")).alias("dst"), F.col("path").alias("callee_file")).distinct()
    plain = call_sites(symbols)
    odd = targets.where(~F.col("callee").rlike(r"(?U)^\w+$")).select("callee").distinct()
    found = plain.unionByName(_odd_sites(s, odd))
    joined = found.join(targets, "callee").where(bare_name(F.col("symbol_name")) != F.col("callee"))
    edges = joined.select(node_id(F.col("path"), F.col("symbol_name")).alias("src"), "dst", F.col("path").alias("caller_file"), "callee_file", F.col("line_start").alias("line")).where("src <> dst")
    # One edge a pair; of several callers of one id the last by line gives the line.
    return edges.groupBy("src", "dst", "caller_file", "callee_file").agg(F.max("line").alias("line"))


def _is_word(c: Column) -> Column:
    return c.rlike(r"(?U)^\w$")


def _odd_sites(s: DataFrame, odd: DataFrame) -> DataFrame:
    """Call sites of names with other characters, such as headings or line ranges.

    What stands before an opening bracket is cut to each length that a name has and joined by equality, so that
    the number of names doesn't matter. For names that hold a bracket themselves, what stands before it goes back to the
    beginning of the text, else to the bracket before.
    """
    keys = ("path", "symbol_name", "line_start")
    content = F.coalesce("content", F.lit(""))
    held = odd.select("callee", F.length("callee").alias("n"), F.contains("callee", F.lit("(")).alias("bracket")).distinct()
    lengths = held.select("n", "bracket").distinct().collect()  # as many as names have lengths
    parts = F.split(content, r"\(", -1)
    inner = F.slice(parts, F.lit(1), F.size(parts) - 1)
    whole = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "("))
    found = []
    for bracket in (False, True):
        sizes = sorted(r.n for r in lengths if r.bracket == bracket)
        if not sizes:
            continue
        before = F.when(F.size(parts) > 1, whole if bracket else inner).otherwise(F.array().cast("array<string>"))
        tails = s.select(*keys, F.explode(before).alias("part")).select(*keys, F.regexp_replace("part", r"(?U)\s+$", "").alias("tail"))
        cuts = tails.select(*keys, "tail", F.explode(F.array(*(F.lit(n) for n in sizes)).cast("array<int>")).alias("n")).where(F.length("tail") >= F.col("n"))
        callee = F.substring(F.col("tail"), F.length("tail") - F.col("n") + 1, F.col("n"))
        left = F.when(F.length("tail") > F.col("n"), F.substring(F.col("tail"), F.length("tail") - F.col("n"), F.lit(1))).otherwise("")
        named = cuts.select(*keys, callee.alias("callee"), left.alias("before")).where(_is_word(F.substring("callee", 1, 1)) != _is_word(F.col("before")))
        found.append(named.join(held.where(F.col("bracket") == bracket).select("callee"), "callee", "left_semi").select(*keys, "callee").distinct())
    return reduce(DataFrame.unionByName, found) if found else s.select(*keys, F.lit(None).cast("string").alias("callee")).limit(0)


def import_refs(symbols: DataFrame) -> DataFrame:
    """path, raw_import of all import symbols."""
    content = F.coalesce("content", F.lit(""))
    relative, absolute = (F.regexp_extract_all(content, F.lit(IMPORT), F.lit(g)) for g in (1, 2))
    raw = F.explode(F.zip_with(relative, absolute, lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b)))
    return symbols.where("symbol_type = 'import'").select("path", raw.alias("raw_import")).where("raw_import <> ''")


def import_candidates(path: Column, raw: Column) -> Column:
    """Paths that an import may mean, first choice first: by suffix, each with ever shorter tails."""
    dots = F.length(raw) - F.length(F.regexp_replace(raw, r"^\.+", ""))
    module = F.translate(F.regexp_replace(raw, r"^\.+", ""), ".", "/")
    folder = F.split(F.when(parent(path) == ".", F.lit("")).otherwise(parent(path)), "/")
    folder = F.filter(folder, lambda x: x != "")
    up = F.slice(folder, F.lit(1), F.greatest(F.size(folder) - (dots - 1), F.lit(0)))
    base = F.array_join(F.concat(up, F.filter(F.array(module), lambda x: x != "")), "/")
    stem = F.when(dots > 0, F.when(base == "", F.lit(".")).otherwise(base)).otherwise(module)
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, F.size(F.split(c, "/"))), "/"))
    return F.flatten(F.array(*(tails(F.concat(stem, F.lit(s))) for s in IMPORT_SUFFIXES)))


def import_edges(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst, raw_import: imports that resolve to a known file other than their own; one edge a pair, the greatest text of several."""
    refs = import_refs(symbols).distinct()
    options = refs.select("path", "raw_import", F.posexplode(import_candidates(F.col("path"), F.col("raw_import"))).alias("choice", "dst"))
    hit = options.join(files.select(F.col("path").alias("dst")).distinct(), "dst")
    chosen = hit.groupBy("path", "raw_import").agg(F.min_by("dst", "choice").alias("dst"))
    return chosen.where("path <> dst").groupBy(F.col("path").alias("src"), "dst").agg(F.max("raw_import").alias("raw_import"))


def callers(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """name, function_name, file_path, line_start of what calls each name. names: name."""
    called = nodes.select("id", bare_name(F.col("symbol_name")).alias("name")).join(names.distinct(), "name")
    by = edges.join(called, edges["dst"] == called["id"]).select("name", "src")
    return by.join(nodes, by["src"] == nodes["id"]).select("name", F.col("symbol_name").alias("function_name"), "file_path", "line_start")


def callees(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """name, function_name, file_path, line_start of what each name calls."""
    calling = nodes.select("id", bare_name(F.col("symbol_name")).alias("name")).join(names.distinct(), "name")
    to = edges.join(calling, edges["src"] == calling["id"]).select("name", "dst")
    return to.join(nodes, to["dst"] == nodes["id"]).select("name", F.col("symbol_name").alias("function_name"), "file_path", "line_start")


def deps(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("src") == path).select(F.col("dst").alias("path"))


def dependents(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("dst") == path).select(F.col("src").alias("path"))


def related_files(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, path, hops of the files within depth undirected steps. starts: start[, depth], where a start's own depth may be less.

    A step joins the frontier, deduplicated, to the edges; depth is small and fixed, so the steps are unrolled.
    """
    links = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct()
    own = F.col("depth") if "depth" in starts.columns else F.lit(depth)
    frontier = starts.select("start", own.alias("depth")).distinct().select("start", "depth", F.col("start").alias("path"), F.lit(0).alias("hops"))
    reached = [frontier]
    for hop in range(1, depth + 1):
        step = frontier.where(F.col("depth") >= hop).join(links, frontier["path"] == links["a"]).select("start", "depth", F.col("b").alias("path")).distinct()
        frontier = step.withColumn("hops", F.lit(hop))
        reached.append(frontier)
    both = reduce(DataFrame.unionByName, reached)
    return both.groupBy("start", "path").agg(F.min("hops").alias("hops")).where("path <> start")


def in_degrees(files: DataFrame, edges: DataFrame) -> DataFrame:
    """file_path, dependent_count of every file."""
    counts = edges.groupBy("dst").agg(F.count_distinct("src").alias("n"))
    return files.select("path").distinct().join(counts, F.col("path") == F.col("dst"), "left").select(F.col("path").alias("file_path"), F.coalesce("n", F.lit(0)).cast("long").alias("dependent_count"))


def entry_points(files: DataFrame, edges: DataFrame) -> DataFrame:
    """path of the files that nothing imports."""
    return files.select("path").distinct().join(edges.select(F.col("dst").alias("path")).distinct(), "path", "left_anti")


def hotspots(files: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    return in_degrees(files, edges).orderBy(F.desc("dependent_count"), "file_path").limit(n)


def as_json(nodes: DataFrame, edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """A node-link document per row of nodes and edges: one JSON line each, so that a graph of any size is written without gathering it."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("value"))
    e = edges.withColumnRenamed(source, "source").withColumnRenamed(target, "target")
    return n.unionByName(e.select(F.lit("link").alias("kind"), F.to_json(F.struct(*e.columns)).alias("value")))


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def load_graph(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def load_node_link(spark, file: str, graph: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one graph of a node-link JSON document ({graph: {nodes, links}})."""
    doc = spark.read.option("multiLine", True).json(file).select(f"{graph}.*")
    links = "links" if "links" in doc.columns else "edges"
    return doc.select(F.explode("nodes").alias("n")).select("n.*"), doc.select(F.explode(links).alias("e")).select("e.*")

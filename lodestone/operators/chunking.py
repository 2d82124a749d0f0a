"""Texts to symbols. All but the SQL and syntax parsers are row-local expressions: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK_LINES
from ..functions.text import lines

# Lines per chunk by language; other languages without a parser take 50.
CHUNK_SIZES = {"json": 30, "xml": 40, "text": 20, "config": 20, "regex": 50, "unknown": 50}
YAML_LINES, HTML_WHOLE_LINES = 30, 100
# Patterns of section starts.
HEADING = r"^(#{1,6})\s+(.*)"
YAML_KEY = r"^([A-Za-z_][A-Za-z0-9_\-]*):"
TOML_TABLE, TOML_KEY = r"^\[([^\]]+)\]", r"^([A-Za-z_][A-Za-z0-9_\-]*)\s*="
INSTRUCTION = r"(?i)^(FROM|RUN|COPY|ADD|ENV|EXPOSE|WORKDIR|CMD|ENTRYPOINT|LABEL|ARG|VOLUME|USER|ONBUILD|HEALTHCHECK|SHELL)\b"


def _symbol(name: Column, kind: Column | str, start: Column, end: Column, content: Column) -> Column:
    return F.struct(name.alias("symbol_name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("symbol_type"), start.cast("int").alias("line_start"), end.cast("int").alias("line_end"), content.alias("content"))


def _joined(part: Column) -> Column:
    return F.array_join(part, "")


def _chunks(ls: str, size: Column, name, at_least_one: bool) -> Column:
    """Blocks of size lines; name(start, end, block) names them."""
    n = F.size(ls)
    count = F.ceil(n / size).cast("int")
    count = F.greatest(count, F.lit(1)) if at_least_one else count

    def block(k):
        start, end = k * size + 1, F.least((k + 1) * size, n)
        part = F.slice(F.col(ls), start.cast("int"), size.cast("int"))
        return _symbol(name(start, end, part), "chunk", start, end, _joined(part))

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), block)).otherwise(F.array().cast(_EMPTY))


_EMPTY = "array<struct<symbol_name:string,symbol_type:string,line_start:int,line_end:int,content:string>>"


def _fallback(size: Column) -> Column:
    return _chunks("_lines", size, lambda start, end, part: F.concat(F.lit("chunk_"), start.cast("string")), True)


def _or_fallback(found: Column, size: int = CHUNK_LINES) -> Column:
    return F.when(F.size(found) > 0, found).otherwise(_fallback(F.lit(size)))


def line_chunks(path: Column, size: int = CHUNK_LINES) -> Column:
    """The live chunker: named path:start-end; an empty text has no chunk."""
    return _chunks("_lines", F.lit(size), lambda start, end, part: F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")), False)


def markdown_sections() -> Column:
    """From each heading to the next; what comes before the first is left out."""
    marked = F.transform("_lines", lambda x, i: F.struct(i.alias("i"), F.trim(F.regexp_replace(F.regexp_extract(x, HEADING, 2), r"^\s+|\s+$", "")).alias("name"), x.rlike(HEADING).alias("hit")))
    return F.filter(marked, lambda s: s.hit)


def _sections(heads: str) -> Column:
    n = F.size("_lines")

    def section(h, k):
        end = F.coalesce(F.get(F.col(heads), k + 1).i, n)
        return _symbol(h["name"], "function", h.i + 1, end, _joined(F.slice(F.col("_lines"), h.i + 1, F.greatest(end - h.i, F.lit(0)))))

    return F.transform(heads, section)


def yaml_chunks() -> Column:
    def name(start, end, part):
        keys = F.filter(F.transform(part, lambda x: F.regexp_extract(x, YAML_KEY, 1)), lambda k: k != "")
        return F.coalesce(F.get(keys, F.lit(0)), F.concat(F.lit("chunk_"), start.cast("string")))

    return _chunks("_lines", F.lit(YAML_LINES), name, True)


def toml_symbols() -> Column:
    def one(x, i):
        s = F.regexp_replace(x, r"^\s+|\s+$", "")
        header, key = F.regexp_extract(s, TOML_TABLE, 1), F.regexp_extract(s, TOML_KEY, 1)
        return _symbol(F.when(header != "", header).otherwise(key), F.when(header != "", "function").otherwise("variable"), i + 1, i + 1, x)

    return F.filter(F.transform("_lines", one), lambda s: s.symbol_name != "")


def docker_heads() -> Column:
    """Where blocks begin: at each instruction, and at the first line before one."""
    marked = F.transform("_lines", lambda x, i: F.struct(i.alias("i"), F.upper(F.regexp_extract(F.regexp_replace(x, r"^\s+", ""), INSTRUCTION, 1)).alias("name")))
    return F.filter(marked, lambda s: (s["name"] != "") | (s.i == 0))


def _blocks(heads: str) -> Column:
    n = F.size("_lines")

    def block(h, k):
        end = F.coalesce(F.get(F.col(heads), k + 1).i, n)
        return _symbol(F.when(h["name"] != "", h["name"]).otherwise("chunk_1"), "chunk", h.i + 1, end, _joined(F.slice(F.col("_lines"), h.i + 1, F.greatest(end - h.i, F.lit(0)))))

    return F.transform(heads, block)


def html_document() -> Column:
    n = F.size("_lines")
    whole = F.array(_symbol(F.lit("document"), "chunk", F.lit(1), n, _joined(F.col("_lines"))))
    return F.when(n <= HTML_WHOLE_LINES, whole).otherwise(_fallback(F.lit(CHUNK_LINES)))


def _exploded(d: DataFrame, symbols: Column) -> DataFrame:
    return d.select("path", F.explode(symbols).alias("s")).select("path", "s.*")


def chunk_files(files: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    """Symbols of files (path, content) as fixed blocks of lines."""
    d = files.select("path", lines(F.coalesce("content", F.lit(""))).alias("_lines"))
    return _exploded(d, line_chunks(F.col("path"), size))


def fallback_chunks(files: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    d = files.select("path", lines(F.coalesce("content", F.lit(""))).alias("_lines"))
    return _exploded(d, _fallback(F.lit(size)))


def section_symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (path, language, content) whose language has a text-based extractor: all but SQL and syntax-tree languages."""
    d = files.select("path", "language", lines(F.coalesce("content", F.lit(""))).alias("_lines"))
    lang = F.col("language")
    d = d.withColumn("_md", F.when(lang == "markdown", markdown_sections())).withColumn("_docker", F.when(lang == "dockerfile", docker_heads())).withColumn("_toml", F.when(lang == "toml", toml_symbols()))
    size = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in CHUNK_SIZES.items() for x in kv)), lang), F.lit(CHUNK_LINES))
    found = (
        F.when(lang == "markdown", _or_fallback(_sections("_md")))
        .when(lang == "yaml", yaml_chunks())
        .when(lang == "toml", _or_fallback(F.col("_toml")))
        .when(lang == "dockerfile", _or_fallback(_blocks("_docker")))
        .when(lang == "html", html_document())
        .otherwise(_fallback(size))
    )
    return _exploded(d, found)

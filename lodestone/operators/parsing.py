"""Symbols that need a parser: SQL statements and syntax trees.

Python sources are parsed with the standard library. Other languages use a tree-sitter grammar
where one is installed with the executors, and line chunks where none is.
"""

from __future__ import annotations

import ast
import importlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK_LINES
from ..schemas import SYMBOLS
from .chunking import CHUNK_SIZES, section_symbols

Row = tuple[str, str, int, int, str]
#: Languages that section_symbols() handles.
TEXT_LANGUAGES = ("markdown", "yaml", "toml", "dockerfile", "html", *CHUNK_SIZES)

_LINE_END = re.compile("(?<=[\n\x0b\f\x1c-\x1e\x85\u2028\u2029])")
# Statements that begin a SQL symbol.
_CREATE = re.compile(r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW|FUNCTION|PROCEDURE|INDEX)\s+(\S+)", re.I)
_STATEMENT = re.compile(r"^(SELECT|INSERT|UPDATE|DELETE|WITH)\b", re.I)
_SQL_KINDS = (({"TABLE", "VIEW"}, "class"), ({"FUNCTION", "PROCEDURE"}, "function"))


def split_lines(text: str) -> list[str]:
    return [x for x in _LINE_END.split(text.replace("\r\n", "\n").replace("\r", "\n")) if x]


def plain_chunks(ls: list[str], size: int = CHUNK_LINES) -> list[Row]:
    starts = range(0, len(ls), size) if ls else (0,)
    return [(f"chunk_{a + 1}", "chunk", a + 1, min(a + size, len(ls)), "".join(ls[a : a + size])) for a in starts]


def sql_symbols(ls: list[str]) -> list[Row]:
    """Statements up to the line with a semicolon. One that never ends reports a last line one past the file, and nothing follows it."""
    out, at = [], 0
    ends = [i for i, x in enumerate(ls) if ";" in x]
    while at < len(ls):
        created = _CREATE.search(ls[at])
        if not created and not _STATEMENT.match(ls[at].strip()):
            at += 1
            continue
        stop = next((e for e in ends if e >= at), None)
        last = len(ls) if stop is None else stop
        body = "".join(ls[at : last + 1])
        if created:
            said = set(ls[at].upper().split())
            kind = next((k for names, k in _SQL_KINDS if names & said), "variable")
            out.append((created[1].rstrip("(").strip(), kind, at + 1, last + 1, body))
        else:
            out.append((f"chunk_{at + 1}", "chunk", at + 1, last + 1, body))
        at = last + 1
    return out or plain_chunks(ls)


def python_symbols(text: str) -> list[Row]:
    """Functions, classes, imports and assignments in source order, nested ones too; nothing where the source doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class", ast.Import: "import", ast.ImportFrom: "import", ast.Assign: "variable", ast.AnnAssign: "variable", ast.AugAssign: "variable"}
    raw = text.split("\n")
    out = []

    def name_of(node) -> str:
        if hasattr(node, "name"):
            return node.name
        if isinstance(node, ast.ImportFrom):
            return "." * node.level + (node.module or "")
        if isinstance(node, ast.Import):
            return node.names[0].name
        target = node.targets[0] if isinstance(node, ast.Assign) else node.target
        while isinstance(target, (ast.Attribute, ast.Subscript, ast.Starred)):
            target = target.value
        return target.id if isinstance(target, ast.Name) else ast.unparse(target)

    def visit(node) -> None:
        kind = kinds.get(type(node))
        if kind:
            first = node.lineno
            part = raw[first - 1 : node.end_lineno]
            out.append((name_of(node), kind, first, node.end_lineno, "\n".join(part).lstrip() if len(part) == 1 else "\n".join([part[0][node.col_offset :], *part[1:]])))
        for child in ast.iter_child_nodes(node):
            visit(child)

    visit(tree)
    return out


# Languages whose grammar module has another name than their own, and the node types of each language that are symbols.
GRAMMAR_MODULES = {"jsx": "tree_sitter_javascript", "tsx": "tree_sitter_typescript", "csharp": "tree_sitter_c_sharp"}
_JAVASCRIPT = {
    "function_declaration": "function", "function_expression": "function", "arrow_function": "function", "method_definition": "function",
    "class_declaration": "class", "import_statement": "import", "variable_declaration": "variable", "lexical_declaration": "variable",
}
_TYPESCRIPT = {**_JAVASCRIPT, "interface_declaration": "class", "type_alias_declaration": "class", "enum_declaration": "class", "abstract_class_declaration": "class"}
_C = {"function_definition": "function", "struct_specifier": "class", "enum_specifier": "class", "typedef_declaration": "class", "preproc_include": "import", "preproc_define": "variable"}
NODE_TYPES: dict[str, dict[str, str]] = {
    "python": {"function_definition": "function", "async_function_definition": "function", "class_definition": "class", "import_statement": "import", "import_from_statement": "import", "assignment": "variable"},
    "javascript": _JAVASCRIPT,
    "jsx": _JAVASCRIPT,
    "typescript": _TYPESCRIPT,
    "tsx": _TYPESCRIPT,
    "java": {"method_declaration": "function", "constructor_declaration": "function", "class_declaration": "class", "interface_declaration": "class", "enum_declaration": "class", "import_declaration": "import", "field_declaration": "variable"},
    "c": _C,
    "cpp": {**_C, "class_specifier": "class", "function_declarator": "function", "namespace_definition": "class", "template_declaration": "function"},
    "csharp": {"method_declaration": "function", "constructor_declaration": "function", "class_declaration": "class", "interface_declaration": "class", "struct_declaration": "class", "enum_declaration": "class", "using_directive": "import", "field_declaration": "variable", "property_declaration": "variable"},
    "go": {"function_declaration": "function", "method_declaration": "function", "type_declaration": "class", "import_declaration": "import", "var_declaration": "variable", "const_declaration": "variable", "short_var_declaration": "variable"},
    "rust": {"function_item": "function", "impl_item": "class", "struct_item": "class", "enum_item": "class", "trait_item": "class", "use_declaration": "import", "const_item": "variable", "static_item": "variable", "let_declaration": "variable", "mod_item": "class"},
    "ruby": {"method": "function", "singleton_method": "function", "class": "class", "module": "class", "call": "import", "assignment": "variable"},
    "php": {"function_definition": "function", "method_declaration": "function", "class_declaration": "class", "interface_declaration": "class", "trait_declaration": "class", "namespace_use_declaration": "import"},
    "swift": {"function_declaration": "function", "class_declaration": "class", "struct_declaration": "class", "protocol_declaration": "class", "enum_declaration": "class", "import_declaration": "import", "variable_declaration": "variable"},
    "kotlin": {"function_declaration": "function", "class_declaration": "class", "object_declaration": "class", "interface_declaration": "class", "import_header": "import", "property_declaration": "variable"},
    "scala": {"function_definition": "function", "class_definition": "class", "object_definition": "class", "trait_definition": "class", "import_declaration": "import", "val_definition": "variable"},
    "haskell": {"function": "function", "type_class": "class", "data_declaration": "class", "import": "import"},
    "lua": {"function_declaration": "function", "local_function": "function", "assignment_statement": "variable"},
    "r": {"function_definition": "function", "left_assignment": "variable", "library_call": "import"},
    "bash": {"function_definition": "function", "variable_assignment": "variable", "command": "import"},
    "css": {"rule_set": "function", "at_rule": "import"},
}
#: Fields of a node that may hold its name, in the order in which they are asked for.
NAME_FIELDS = ("name", "identifier", "declarator")


def syntax_tree(text: str, language: str):
    """The root of the tree of a grammar; None where the language or its module is unknown or parsing fails."""
    try:
        ts = importlib.import_module("tree_sitter")
        grammar = importlib.import_module(GRAMMAR_MODULES.get(language, f"tree_sitter_{language}"))
        return ts.Parser(ts.Language(grammar.language())).parse(text.encode()).root_node
    except Exception:  # noqa: BLE001  any failure of an optional grammar means: no grammar
        return None


def node_name(node) -> str:
    named = (child for field in NAME_FIELDS if (child := node.child_by_field_name(field)) is not None)
    child = next(named, None) or next((c for c in node.children if c.type == "identifier"), None)
    return node.type if child is None else child.text.decode(errors="replace")


def grammar_symbols(text: str, language: str, tree: Callable[[str, str], Any] = syntax_tree) -> list[Row] | None:
    """Symbols of a syntax tree in source order, nested ones too; None where there is no tree."""
    types = NODE_TYPES.get(language)
    root = tree(text, language) if types else None
    if root is None:
        return None
    out: list[Row] = []
    todo = [root]  # a stack of our own: trees may be deep
    while todo:
        node = todo.pop()
        if kind := types.get(node.type):
            out.append((node_name(node), kind, node.start_point[0] + 1, node.end_point[0] + 1, node.text.decode(errors="replace")))
        todo += reversed(node.children)
    return out


def parse_text(text: str, language: str) -> list[Row]:
    """Symbols of a SQL, Python or grammar language; line chunks where there are none."""
    ls = split_lines(text)
    if language == "sql":
        return sql_symbols(ls)
    found = python_symbols(text) if language == "python" else grammar_symbols(text, language)
    return found or plain_chunks(ls)


#: Text whose symbols make one batch of parsed_symbols().
BATCH_CHARS = 4 << 20


def parsed_symbols(files: DataFrame, parser: Callable[[str, str], list[Row]] = parse_text) -> DataFrame:
    """Symbols of files (path, language, content) by parser. A file that a parser fails on gets line chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "symbol_name", "symbol_type", "line_start", "line_end", "content"]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            rows, held = [], 0
            for path, language, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    found = parser(text, language)
                except Exception:  # noqa: BLE001  one bad file must not end the job
                    found = plain_chunks(split_lines(text))
                rows += [(path, *r) for r in found]
                held += len(text)
                if held >= BATCH_CHARS:
                    yield as_batch(rows)
                    rows, held = [], 0
            if rows:
                yield as_batch(rows)

    return files.select("path", "language", F.coalesce("content", F.lit("")).alias("content")).mapInArrow(run, SYMBOLS)


def extract_symbols(files: DataFrame) -> DataFrame:
    """All symbols of files (path, language, content), each language by its own extractor. A null language is an unknown one."""
    known = files.withColumn("language", F.coalesce("language", F.lit("unknown")))
    by_text = F.col("language").isin(*TEXT_LANGUAGES)
    return section_symbols(known.where(by_text)).unionByName(parsed_symbols(known.where(~by_text)))

"""Literal inputs for operators whose data the test tables don't hold: code, paths, logs, tasks."""

from __future__ import annotations

PATHS = [("Dockerfile",), ("src/Makefile",), ("dockerfile",), (".env",), ("conf/x.env",), ("a/A.PY",), ("s.R",), ("img/i.svg",), ("LICENSE",), ("a/build/x.py",), ("x.egg-info/y",), ("env",), ("pkg/env/z.py",), ("lib/mod.tsx",), ("q.SQL",), ("m.cc",), ("t.tar.gz",), ("w.pyc",), ("W.PYC",), ("a.",), ("node_modules/p/i.js",)]

TASKS = [
    (1, "fix the crash when the parser meets an empty file"), (2, "please rename the helper and clean up its callers"), (3, "add support for a new api that has rate limit"), (4, "migrate the entire codebase to the new architecture today"),
    (5, "tweak the prefix handling logic today"), (6, "why does foo() differ from bar() in release builds"), (7, "one two three four"), (8, "one two three four five"), (9, "Fix this module, add support everywhere and call run()"), (10, ""), (11, "  FIX   it  "), (12, "we should look at the naïve café words here"),
]

# path, symbol_name, symbol_type, line_start, line_end, content
CODE = [
    ("app/main.py", "main", "function", 1, 9, "def main():\n    load_config()\n    run_server( 1)\n    main()\n"),
    ("app/main.py", "run_server", "function", 11, 20, "def run_server(n):\n    open_socket(n)\n    ab()\n"),
    ("app/conf.py", "load_config", "function", 1, 5, "def load_config():\n    return parse_text(read())\n"),
    ("lib/net.py", "open_socket", "function", 3, 9, "def open_socket(n):\n    log_line('x')\n"),
    ("lib/net.py", "log_line", "function", 12, 15, "def log_line(s):\n    pass\n"),
    ("lib/util.py", "log_line", "function", 1, 4, "def log_line(s):\n    log_line(s)\n    emit(s)\n"),
    ("lib/util.py", "ab", "function", 6, 8, "def ab():\n    log_line('ab')\n"),
    ("lib/util.py", "pkg:emit", "method", 10, 12, "emit(self)\n    load_config ()\n"),
    ("lib/util.py", "CONST", "variable", 14, 14, "CONST = load_config()\n"),
    ("doc/x.md", "1-50", "chunk", 1, 50, "call 1-50(x) or open_socket (y)\n"),
    ("doc/y.md", "Set up", "chunk", 1, 9, "then Set up(now) and 1-50 (z)\n"),
]

IMPORT_FILES = [(p,) for p in ("app/__init__.py", "app/main.py", "app/conf.py", "app/sub/deep.py", "lib/net.py", "lib/util.py", "lib/__init__.py", "web/view.ts", "web/form.jsx", "core/a/b/tool.py", "alone.py")]
IMPORTS = [
    ("app/main.py", "i1", "import", 1, 1, "from app.conf import load_config"),
    ("app/main.py", "i2", "import", 2, 2, "import lib.net, lib.util"),
    ("app/main.py", "i3", "import", 3, 3, "from . import conf"),
    ("app/main.py", "i4", "import", 4, 4, "from .sub.deep import x"),
    ("app/sub/deep.py", "i5", "import", 1, 1, "from ..conf import y"),
    ("app/sub/deep.py", "i6", "import", 2, 2, "from ...lib.util import z"),
    ("app/conf.py", "i7", "import", 1, 1, "from lib.util import (a,"),
    ("lib/net.py", "i8", "import", 1, 1, "import lib.util"),
    ("lib/util.py", "i9", "import", 1, 1, "import lib.net"),
    ("lib/util.py", "i10", "import", 2, 2, "import os"),
    ("lib/util.py", "i11", "import", 3, 3, "from lib.util import me"),
    ("web/view.ts", "i12", "import", 1, 1, "import web.form"),
    ("web/form.jsx", "i13", "import", 1, 1, "import React from react"),
    ("web/form.jsx", "i14", "import", 2, 2, "import proj.core.a.b.tool"),
    ("core/a/b/tool.py", "i15", "import", 1, 1, "from app.main import main"),
]

SECTION_FILES = [
    ("a.md", "markdown", "intro\n# One\ntext\n## Two  \nmore\n####### no\n#x\n# Three\n"), ("b.md", "markdown", "no heading\nhere\n"), ("c.md", "markdown", ""),
    ("a.yaml", "yaml", "# c\n  in: 1\nname: x\nother: y\n" + "- item\n" * 30 + "tail-key: 1\n"), ("b.yml", "yaml", "- a\n- b\n"),
    ("a.toml", "toml", "x = 1\n[tool.a]\n  key-b = 2\n[[arr]]\n# c\n"), ("b.toml", "toml", "# nothing\n"),
    ("Dockerfile", "dockerfile", "# syntax\nFROM a\nRUN b \\\n  c\ncopy d e\n"), ("d2/Dockerfile", "dockerfile", "FROM z\n"),
    ("p.json", "json", "{\n" + "1,\n" * 40 + "}\n"), ("q.xml", "xml", "<a/>\n" * 41), ("t.txt", "text", "line\n" * 21), ("u", "unknown", "x"),
]

SOURCE_FILES = [
    ("q.sql", "sql", "-- c\nCREATE TABLE users (\n id int\n);\nselect 1;\nCREATE OR REPLACE FUNCTION f() AS x;\ncreate index ix on t(a);\nCREATE UNIQUE INDEX nope ON t(a);\nWITH a AS (SELECT 1)\nSELECT * FROM a\n"),
    ("e.sql", "sql", "-- nothing\n"),
    ("m.py", "python", "import os\nfrom a.b import c\nX = 1\n\nclass K(Base):\n    y: int = 2\n    async def go(self):\n        def inner(): pass\n        return 1\n"),
    ("bad.py", "python", "def (:\n"),
    ("s.go", "go", "package main\nfunc main() {}\n"),
]

# Examples of the published description of the Porter algorithm, with the stems that its five steps give.
STEMS = tuple(
    x.split("/")
    for x in (
        "caresses/caress ponies/poni ties/ti caress/caress cats/cat feed/feed agreed/agre plastered/plaster bled/bled motoring/motor sing/sing conflated/conflat troubled/troubl sized/size hopping/hop tanned/tan falling/fall hissing/hiss fizzed/fizz "
        "failing/fail filing/file happy/happi sky/sky relational/relat conditional/condit rational/ration valenci/valenc hesitanci/hesit digitizer/digit conformabli/conform radicalli/radic differentli/differ vileli/vile analogousli/analog "
        "vietnamization/vietnam predication/predic operator/oper feudalism/feudal decisiveness/decis hopefulness/hope callousness/callous formaliti/formal sensitiviti/sensit sensibiliti/sensibl triplicate/triplic formative/form formalize/formal "
        "electriciti/electr electrical/electr hopeful/hope goodness/good revival/reviv allowance/allow inference/infer airliner/airlin gyroscopic/gyroscop adjustable/adjust defensible/defens irritant/irrit replacement/replac adjustment/adjust "
        "dependent/depend adoption/adopt homologou/homolog communism/commun activate/activ angulariti/angular homologous/homolog effective/effect bowdlerize/bowdler probate/probat rate/rate cease/ceas controll/control roll/roll"
    ).split()
)

#: Query texts, and whether they are errors.
QUERY_TEXTS = [
    ("run", False), ("run OR parse", False), ("run AND", True), ("OR run", True), ('"the of"', False), ('"open', True), ("don't", True), ("user.login", True), ("rate-limiting", True), ("foo: bar", True), ("content: run", False), ("{path symbol_name}: run", False),
    ("NEAR(run parse, 5)", False), ("what is this?", True), ("fix the crash in parse_tokens()", True), ("nat*", False), ("^run", False), ("(run OR parse) AND token", False), ("run AND NOT parse", True), ("run NOT parse", False), ("the + of", False),
]

#: What parsing SOURCE_FILES gives, written down by hand.
_METHOD = "async def go(self):\n        def inner(): pass\n        return 1"
SOURCE_SYMBOLS = [
    ("q.sql", "users", "class", 2, 4, "CREATE TABLE users (\n id int\n);\n"), ("q.sql", "chunk_5", "chunk", 5, 5, "select 1;\n"), ("q.sql", "f()", "function", 6, 6, "CREATE OR REPLACE FUNCTION f() AS x;\n"),
    ("q.sql", "ix", "variable", 7, 7, "create index ix on t(a);\n"), ("q.sql", "chunk_9", "chunk", 9, 11, "WITH a AS (SELECT 1)\nSELECT * FROM a\n"),
    ("e.sql", "chunk_1", "chunk", 1, 1, "-- nothing\n"),
    ("m.py", "os", "import", 1, 1, "import os"), ("m.py", "a.b", "import", 2, 2, "from a.b import c"), ("m.py", "X", "variable", 3, 3, "X = 1"), ("m.py", "K", "class", 5, 9, f"class K(Base):\n    y: int = 2\n    {_METHOD}"),
    ("m.py", "y", "variable", 6, 6, "y: int = 2"), ("m.py", "go", "function", 7, 9, _METHOD), ("m.py", "inner", "function", 8, 8, "def inner(): pass"),
    ("bad.py", "chunk_1", "chunk", 1, 1, "def (:\n"), ("s.go", "chunk_1", "chunk", 1, 2, "package main\nfunc main() {}\n"),
]

LOG = [
    (0, "2024 | INFO | start"), (1, "2024 | ERROR | WARNING both"), (2, "2024 | WARNING | low"), (3, "2024 | SUCCESS | ok"), (4, "✓ done"), (5, "plain"), (6, "2024 | INFO | SUCCESS and ERROR"), (7, "end"),
]

# event_id, op, path, dest_path, is_directory
FILE_EVENTS = [
    (1, "created", "a.py", None, False), (2, "modified", "a.py", None, False), (3, "deleted", "a.py", None, False), (4, "created", "b.py", None, False), (5, "moved", "b.py", "c.py", False), (6, "moved", "build/t.py", "d.py", False),
    (7, "moved", "e.py", ".git/e.py", False), (8, "created", "dir", None, True), (9, "modified", "w.pyc", None, False), (10, "created", "f.py", None, False), (11, "deleted", "f.py", None, False), (12, "created", "f.py", None, False), (13, "opened", "g.py", None, False),
]


def quoted(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    """A SQL table of the rows."""
    return f"(VALUES {', '.join('(' + ', '.join(quoted(v) for v in r) + ')' for r in rows)}) AS v({columns})"

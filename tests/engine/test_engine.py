"""The facade end to end, and the stream that keeps its index current."""

import json

import pytest

from lodestone.operators import graph
from lodestone.plans.engine import Engine
from lodestone.schemas import FILE_EVENTS


def toy_factory():
    """Made inside a function, so that workers get it by value."""

    def factory():
        import numpy as np

        def embed(texts):
            out = np.zeros((len(texts), 8))
            for i, t in enumerate(texts):
                for ch in t.lower():
                    out[i, ord(ch) % 8] += 1
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return embed

    return factory


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "project"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg" / "__init__.py").write_text("")
    (root / "pkg" / "net.py").write_text("from pkg.util import emit\n\ndef open_socket(n):\n    emit(n)\n")
    (root / "pkg" / "util.py").write_text("def emit(x):\n    return x\n")
    (root / "main.py").write_text("import pkg.net\n\ndef main():\n    open_socket(3)\n")
    (root / "README.md").write_text("# Title\nwords about sockets\n")
    return root


def test_symbols_engine(spark, project, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/index", embedder=toy_factory(), chunker="symbols")
    counts = e.build_index(str(project)).first()
    assert (counts.indexed, counts.failed) == (5, 0)
    assert {r.function_name for r in e.callers("emit").collect()} == {"open_socket"}
    assert {r.function_name for r in e.callees("main").collect()} == {"open_socket"}
    assert {r.path for r in e.deps("main.py").collect()} == {"pkg/net.py"}
    assert {r.path for r in e.dependents("pkg/util.py").collect()} == {"pkg/net.py"}
    s = e.structure().first()
    assert s.total_files == 5 and s.language_breakdown == {"markdown": 1, "python": 4} and "main.py" in s.entry_points
    assert e.search("open_socket", 50).count() > 0
    assert e.query_error("don't") and e.query_error("socket") is None
    tasks = spark.createDataFrame([(1, "open_socket"), (2, "please rename the open_socket helper")], "query_id long, task string")
    got = {r.query_id: r for r in e.get_context(tasks).collect()}
    assert got[1].scope == "surgical" and got[2].scope == "local"
    assert {f.path for f in got[1].files} >= {"pkg/net.py"} and got[1].total_tokens > 0
    text = e.context_markdown(tasks).where("query_id = 1").first().markdown
    assert text.startswith("# lodestone context — surgical scope\n\n**Task:** open_socket\n") and "```" in text
    assert "## Search results for `open_socket`" in e.search_markdown("open_socket").first().markdown
    assert e.expand_context("pkg/util.py").first().symbols[0].name == "emit"
    assert e.savings_report().first().reduction == 60.0


def test_lines_engine_without_vectors(spark, project, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/index")
    e.ensure_index(str(project))
    assert e.stats().first().asDict() == {"file_count": 5, "symbol_count": 4}
    tasks = spark.createDataFrame([(1, "sockets"), (2, "what is (this)?")], "query_id long, task string")
    got = {r.query_id: r for r in e.get_context(tasks).collect()}
    assert [f.path for f in got[1].files][0] == "README.md" and got[1].files[0].relevance_score == 0.5
    assert got[2].files == [] and got[2].explanation.startswith("No results found. ")
    assert {r.scope for r in e.get_context(tasks, scope="architectural").collect()} == {"architectural"}
    e.remove_files(["README.md"])
    assert e.stats().first().file_count == 4
    (project / "main.py").write_text("x\n" * 120)
    e.index_paths(str(project), ["main.py"])
    e.index_paths(str(project), ["main.py"])
    assert e.stats().first().asDict() == {"file_count": 4, "symbol_count": 5}
    e.store.vacuum(keep=1)
    assert e.stats().first().file_count == 4
    e.drop_index()
    assert e.store.current() is None


def test_watch(spark, project, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/index", embedder=toy_factory())
    e.ensure_index(str(project))
    events = tmp_path / "events"
    events.mkdir()
    (project / "new.py").write_text("y = 1\n")
    (project / "README.md").unlink()
    rows = [(1, "2024-01-01 00:00:01", "created", "new.py", None, False), (2, "2024-01-01 00:00:02", "deleted", "README.md", None, False), (3, "2024-01-01 00:00:03", "moved", "main.py", ".git/main.py", False), (4, "2024-01-01 00:00:04", "modified", "pkg", None, True)]
    names = ["event_id", "ts", "op", "path", "dest_path", "is_directory"]
    (events / "1.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
    stream = spark.readStream.schema(FILE_EVENTS).json(str(events))
    q = e.watch(stream, str(project), f"{tmp_path}/checkpoint", {"availableNow": True})
    q.awaitTermination(120)
    e.unwatch()
    assert {r.path for r in e.tables["files"].collect()} == {"pkg/__init__.py", "pkg/net.py", "pkg/util.py", "new.py"}
    # Vectors follow their symbols.
    assert e.tables["embeddings"].count() == e.tables["symbols"].count() == 3


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a::f", "f", "a", 1)], "id string, symbol_name string, file_path string, line_start int")
    edges = spark.createDataFrame([("a::f", "b::g", "a", "b", 1)], "src string, dst string, caller_file string, callee_file string, line int")
    graph.save_graph(nodes, edges, f"{tmp_path}/g")
    n, e = graph.load_graph(spark, f"{tmp_path}/g")
    assert n.collect() == nodes.collect() and e.collect() == edges.collect()
    (tmp_path / "g.json").write_text(json.dumps({"call_graph": {"nodes": [{"id": "x"}], "links": [{"source": "x", "target": "y"}]}}))
    n, e = graph.load_node_link(spark, f"{tmp_path}/g.json", "call_graph")
    assert n.first().id == "x" and (e.first().source, e.first().target) == ("x", "y")


def test_log_tail(spark, tmp_path):
    from lodestone.sources import logs

    lines = [f"line {i} " + ("ERROR" if i % 3 == 0 else "WARNING" if i % 3 == 1 else "✓") for i in range(5000)]
    (tmp_path / "x.log").write_text("\n".join(lines) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        got = logs.tail(logs.read_log(spark, f"{tmp_path}/x.log"), 1200).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in got] == lines[-1200:]
    assert [r.severity for r in got[-3:]] == [{0: "error", 1: "warning", 2: "success"}[i % 3] for i in range(4997, 5000)]


def test_answers_are_those_of_the_newest_snapshot(spark, project, tmp_path):
    """Another engine, as a stream would, changes the index: nothing is served from before."""
    e, other = (Engine(spark, f"file://{tmp_path}/index") for _ in range(2))
    e.ensure_index(str(project))
    assert e.stats().first().file_count == 5 and "README.md" in {r.path for r in e.search("sockets").collect()}
    other.remove_files(["README.md"])
    assert e.stats().first().file_count == 4
    assert "README.md" not in {r.path for r in e.search("sockets").collect()}


def test_a_failing_embedder_leaves_the_lexical_side(spark, project, tmp_path):
    def broken():
        raise RuntimeError("no model")

    e = Engine(spark, f"file://{tmp_path}/index")
    e.ensure_index(str(project))
    e.embedder = broken
    with pytest.warns(UserWarning, match="no model"):
        found = e.search("sockets").collect()
    assert "README.md" in {r.path for r in found} and {r.combined_score for r in found} == {0.5}


class Node:
    """A syntax node as grammars give it, made by hand."""

    def __init__(self, kind, text, line, children=(), **fields):
        self.type, self.text, self.children, self.fields = kind, text.encode(), list(children), fields
        self.start_point, self.end_point = (line, 0), (line + text.count("\n"), 0)

    def child_by_field_name(self, name):
        return self.fields.get(name)


def test_syntax_trees_of_other_languages():
    from lodestone.operators import parsing

    name = lambda t: Node("identifier", t, 0)
    inner = Node("method_declaration", "void go() {}", 2, name=name("go"))
    root = Node("compilation_unit", "", 0, [
        Node("using_directive", "using System;", 0, [Node("using", "using", 0), name("System")]),
        Node("class_declaration", "class K {\n void go() {}\n}", 1, [inner], identifier=name("K")),
        Node("comment", "// no", 5), Node("field_declaration", "int x;", 6),
    ])
    got = parsing.grammar_symbols("", "csharp", lambda text, language: root)
    assert got == [("System", "import", 1, 1, "using System;"), ("K", "class", 2, 4, "class K {\n void go() {}\n}"), ("go", "function", 3, 3, "void go() {}"), ("field_declaration", "variable", 7, 7, "int x;")]
    assert parsing.grammar_symbols("", "brainfuck", lambda text, language: root) is None
    assert len(parsing.NODE_TYPES) == 21 and parsing.GRAMMAR_MODULES["csharp"] == "tree_sitter_c_sharp"
    deep = Node("module", "", 0)
    for _ in range(5000):
        deep = Node("block", "", 0, [deep])
    assert parsing.grammar_symbols("", "python", lambda text, language: deep) == []


def test_files_of_no_language(spark):
    from lodestone.operators.parsing import extract_symbols

    files = spark.createDataFrame([("a", None, "one\ntwo\n"), ("b", "unknown", "one\ntwo\n"), ("c", None, None)], "path string, language string, content string")
    got = {r.path: (r.symbol_type, r.line_start, r.line_end, r.content) for r in extract_symbols(files).collect()}
    assert got["a"] == got["b"] and set(got) == {"a", "b", "c"}


def test_calls_of_names_with_brackets(spark):
    """However many such names there are."""
    rows = [("a.md", "f(x) y", "chunk", 1, 2, "nothing"), ("b.md", "g", "chunk", 1, 2, "then f(x) y (1) and zz(f)(2)"), ("c.md", "(f)", "function", 1, 1, "-")]
    rows += [("d.md", f"n{i}(", "chunk", i, i, "") for i in range(10_100)]
    rows += [("e.md", "h", "function", 1, 1, "n7((3) n10099( (")]
    symbols = spark.createDataFrame(rows, "path string, symbol_name string, symbol_type string, line_start int, line_end int, content string")
    got = {(r.src, r.dst) for r in graph.call_edges(symbols).collect()}
    assert got == {("b.md::g", "a.md::f(x) y"), ("b.md::g", "c.md::(f)"), ("e.md::h", "d.md::n7("), ("e.md::h", "d.md::n10099(")}


def test_files_of_a_store(spark, project, tmp_path, monkeypatch):
    """A URI gives what the folder gives, whether the driver lists all or executors list most."""
    from lodestone.sources import files

    for name in (".git/x", "build/y.py", "pkg/deep/er/.hidden.py", "a.egg-info/z", "pkg/deep/w.py", "b.png"):
        (project / name).parent.mkdir(parents=True, exist_ok=True)
        (project / name).write_text(name)
    key = lambda r: (r.path, r.content, r.size, round(r.last_modified, 3), r.status)
    for folders in (1, 2, 64):
        monkeypatch.setattr(files, "LIST_FOLDERS", folders)
        for watch in (False, True):
            want, got = (sorted(map(key, files.read_files(files.list_files(spark, root, watch), root).collect())) for root in (str(project), f"file://{project}"))
            assert want == got and len(want) > 5
    gone = files.read_files(spark.createDataFrame([("none.py",)], "path string"), f"file://{project}").first()
    assert (gone.status, gone.content) == ("unreadable", None)

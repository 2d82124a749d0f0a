"""Rules on literals: lines, chunks, paths, decoding, estimates."""

import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions.text import estimated_tokens
from lodestone.operators.chunking import chunk_files, fallback_chunks
from lodestone.operators.parsing import extract_symbols, plain_chunks, split_lines, sql_symbols
from lodestone.sources.files import list_files, read_files


def as_files(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab \n\x0b\x0c\x1c\x85\u2028", max_size=400), min_size=1, max_size=5))
def test_chunks_rebuild_the_text(spark, texts):
    rows = chunk_files(as_files(spark, texts), 3).orderBy("path", "line_start").collect()
    for i, t in enumerate(texts):
        own = [r for r in rows if r.path == str(i)]
        assert "".join(r.content for r in own) == t
        n = len(t.splitlines(keepends=True))
        assert [r.line_start for r in own] == list(range(1, n + 1, 3)) and (not own or own[-1].line_end == n)


def test_sizes(spark):
    texts = ["", "x", "l\n" * 50, "l\n" * 51, "l\n" * 49 + "l"]
    live = chunk_files(as_files(spark, texts)).groupBy("path").count().collect()
    assert {r.path: r["count"] for r in live} == {"1": 1, "2": 1, "3": 2, "4": 1}
    empty = fallback_chunks(as_files(spark, [""])).first()
    assert (empty.symbol_name, empty.line_start, empty.line_end, empty.content) == ("chunk_1", 1, 0, "")


def test_token_estimate(spark):
    texts = ["", " a  b\tc\n", "a b c", "x\x1cy\u3000z", "w " * 10]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(estimated_tokens(F.col("t"))).collect()]
    assert got == [int(len(t.split()) * 1.3) for t in texts]


def test_sql_statement_that_never_ends():
    assert [r[:4] for r in sql_symbols(["SELECT 1\n", "FROM t\n"])] == [("chunk_1", "chunk", 1, 3)]
    assert sql_symbols([]) == plain_chunks([])


def test_reads_hidden_and_broken_files(spark, tmp_path):
    (tmp_path / "_a.py").write_bytes(b"x\r\ny\rz\xff\n")
    (tmp_path / ".github").mkdir()
    (tmp_path / ".github" / "w.yml").write_text("k: v\n")
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "no.py").write_text("")
    (tmp_path / "p.png").write_bytes(b"\x89")
    (tmp_path / "gone.txt").write_text("")
    listed = list_files(spark, str(tmp_path)).persist()
    assert {r.path for r in listed.collect()} == {"_a.py", ".github/w.yml", "gone.txt"}
    os.remove(tmp_path / "gone.txt")
    got = {r.path: r for r in read_files(listed, str(tmp_path)).collect()}
    assert got["_a.py"].content == (tmp_path / "_a.py").read_text(encoding="utf-8", errors="replace")
    assert got["gone.txt"].status == "unreadable" and got["_a.py"].size == 8


def test_python_symbols(spark):
    source = "import os, sys\nfrom . import q\n\n@deco\ndef f(x):\n    def g(): pass\n    return g\n\nclass A:\n    n = 1\n"
    f = spark.createDataFrame([("m.py", "python", source), ("e.py", "python", ""), ("x.foo", "foo", "a\nb")], "path string, language string, content string")
    got = [(r.path, r.symbol_name, r.symbol_type, r.line_start, r.line_end) for r in extract_symbols(f).orderBy("path", "line_start").collect()]
    assert [g for g in got if g[0] == "m.py"] == [("m.py", "os", "import", 1, 1), ("m.py", ".", "import", 2, 2), ("m.py", "f", "function", 5, 7), ("m.py", "g", "function", 6, 6), ("m.py", "A", "class", 9, 10), ("m.py", "n", "variable", 10, 10)]
    assert ("e.py", "chunk_1", "chunk", 1, 0) in got and ("x.foo", "chunk_1", "chunk", 1, 2) in got


def test_split_lines_like_python():
    text = "a\nb\x0bc\x0cd\x1ce\x1df\x1eg\x85h\u2028i\u2029j\n\n"
    assert split_lines(text) == text.splitlines(keepends=True)

"""Fusion, limits and vectors on literals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import Flags
from lodestone.functions.vectors import l2_normalise, mean_pool
from lodestone.operators import fusion, retrieve, vector_search


def test_fusion(spark):
    sem = spark.createDataFrame([(1, 10, 0.9), (1, 11, -0.2)], "query_id long, symbol_id long, score double")
    lex = spark.createDataFrame([(1, 10, -4.0), (1, 12, -1.0), (2, 13, -3.0)], "query_id long, symbol_id long, rank double")
    got = {(r.query_id, r.symbol_id): (r.score, r.combined_score) for r in fusion.fuse(sem, lex, 10).collect()}
    # The strongest lexical hit counts nothing; a sole hit neither.
    assert got[1, 10] == pytest.approx((0.9, 0.63)) and got[1, 11] == pytest.approx((-0.2, -0.14))
    assert got[1, 12] == pytest.approx((0.225, 0.225)) and got[2, 13] == (0.0, 0.0)
    fixed = {(r.query_id, r.symbol_id): r.combined_score for r in fusion.fuse(sem, lex, 10, fix_fts_norm=True).collect()}
    assert fixed[1, 10] == pytest.approx(0.93) and fixed[2, 13] == pytest.approx(0.3)


def rows(spark, items):
    full = [(1, i, p, "l", f"n{i}", "chunk", ln, ln, "w " * words, s, s) for i, (p, ln, words, s) in enumerate(items)]
    return spark.createDataFrame(full, "query_id long, symbol_id long, path string, language string, symbol_name string, symbol_type string, line_start int, line_end int, content string, score double, combined_score double")


def limits(spark, files, symbols, tokens):
    return spark.createDataFrame([(1, files, symbols, tokens)], "query_id long, max_files int, max_symbols int, max_tokens int")


@pytest.mark.parametrize(("tokens", "kept"), [(0, []), (10, []), (11, [0]), (24, [0]), (25, [0, 1]), (37, [0, 1]), (38, [0, 1, 2])])
def test_budget_keeps_a_prefix(spark, tokens, kept):
    # 9, 11 and 10 words are 11, 14 and 13 tokens; a first row over the budget leaves nothing.
    r = rows(spark, [("a", 1, 9, 0.9), ("a", 2, 11, 0.8), ("b", 1, 10, 0.7)])
    assert sorted(x.symbol_id for x in retrieve.cap(r, limits(spark, 5, 5, tokens)).collect()) == kept


def test_file_and_symbol_caps(spark):
    r = rows(spark, [("a", 1, 1, 0.5), ("b", 1, 1, 0.9), ("c", 1, 1, 0.5), ("b", 2, 1, 0.1), ("a", 2, 1, 0.5)])
    got = [(x.path, x.line_start) for x in retrieve.cap(r, limits(spark, 2, 3, 1000)).orderBy("_r").collect()]
    assert got == [("b", 1), ("a", 1), ("a", 2)]
    g = {x.path: x for x in retrieve.group_by_file(retrieve.cap(r, limits(spark, 2, 9, 1000))).collect()}
    assert g["b"].relevance_score == pytest.approx(0.5) and [s.line_start for s in g["b"].symbols] == [1, 2]


def test_top_k_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "symbol_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(i, x[i].tolist(), 3 + i) for i in range(7)], "query_id long, embedding array<float>, k int")
    got = {}
    for r in vector_search.top_k(q, corpus, "k").collect():
        got.setdefault(r.query_id, set()).add(r.symbol_id)
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(7):
        assert got[i] == set(np.argsort(-(n @ n[i]))[: 3 + i].tolist())


def test_pooling(spark):
    d = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1.0, 1.0, 0.0]), ([[1.0, 2.0]], [0.0])], "t array<array<double>>, m array<double>")
    got = [r[0] for r in d.select(mean_pool(F.col("t"), F.col("m"), 2)).collect()]
    assert got[0] == [2.0, 3.0] and got[1] == [0.0, 0.0]
    assert spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(l2_normalise(F.col("v")).alias("v")).collect()[0].v == [0.6, 0.8]


def test_language_flag(spark):
    hits = spark.createDataFrame([(1, 1, 0.5, 0.5, True), (1, 2, 0.5, 0.5, False)], "query_id long, symbol_id long, score double, combined_score double, semantic boolean")
    symbols = spark.createDataFrame([(1, "a.py", "n", "chunk", 1, 1, "c"), (2, "a.py", "m", "chunk", 2, 2, "c")], "symbol_id long, path string, symbol_name string, symbol_type string, line_start int, line_end int, content string")
    files = spark.createDataFrame([("a.py", "python")], "path string, language string")
    of = lambda f: {r.symbol_id: r.language for r in retrieve.hits_with_symbols(hits, symbols, files, f).collect()}
    assert of(Flags()) == {1: "python", 2: "unknown"} and of(Flags(fix_language=True)) == {1: "python", 2: "python"}

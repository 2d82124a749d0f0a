"""BM25, the query language and stemming against SQLite's FTS5, an independent implementation."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.functions.porter import stem
from lodestone.operators import fts

WORDS = "run runs running runner nation national nationality café naïve parse parser parsing token tokens the of and relate relational conditional hopping hope hoping flies agreed plastered happy sky generalization oscillators electricity revival adjustment effective probate controlling".split()


def corpus(n=60, seed=3):
    r = random.Random(seed)
    return [(i, f"dir/f{i % 7}.py", f"name_{r.choice(WORDS)}", "chunk", " ".join(r.choice(WORDS) for _ in range(r.randint(0, 30)))) for i in range(n)]


@pytest.fixture(scope="module")
def both(spark):
    rows = corpus()
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table s using fts5(path, symbol_name, symbol_type, line_start unindexed, line_end unindexed, content, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("insert into s(rowid, path, symbol_name, symbol_type, content) values (?,?,?,?,?)", [(a + 1, b, c, d, e) for a, b, c, d, e in rows])
    df = spark.createDataFrame(rows, "symbol_id long, path string, symbol_name string, symbol_type string, content string")
    index = fts.build_index(df)
    index.postings.persist()
    index.lengths.persist()
    return con, index


QUERIES = [
    "run", "running token", "run OR parse", "run AND NOT parse", "run NOT parse OR token", "token OR run parse", '"the of"', "the + of", "nat*", "content: run", "path: f3", "{path symbol_name}: run", "- content: run", "^run", "content: ^run", "NEAR(run parse, 5)", "NEAR(run parse token, 8)",
    "NEAR(run)", "cafe", "naive", "(run OR parse) AND token", "name_running", '"it"', "run OR \"\"", "don't", "user.login", "rate-limiting", "foo: bar", "run AND", "", "what is this?", "fix the crash in parse_tokens()", "chunk", "chunk AND run", "relational conditional",
]


def test_like_sqlite(spark, both):
    con, index = both
    expected, errors = {}, set()
    for k, q in enumerate(QUERIES):
        try:
            expected |= {(k, r[0] - 1): r[1] for r in con.execute("select rowid, rank from s where s match ?", (q,))}
        except sqlite3.OperationalError:
            errors.add(k)
    assert errors == {k for k, q in enumerate(QUERIES) if fts.parse_query(q).error}, [(QUERIES[k], fts.parse_query(QUERIES[k]).error) for k in range(len(QUERIES))]
    got = {(r.query_id, r.symbol_id): r.rank for r in fts.search(index, dict(enumerate(QUERIES)), spark).collect()}
    assert set(got) == set(expected), {QUERIES[k] for k, _ in set(got) ^ set(expected)}
    for key, rank in expected.items():
        assert got[key] == pytest.approx(rank, rel=1e-5, abs=1e-9), (QUERIES[key[0]], key)


def test_stems_like_sqlite():
    con = sqlite3.connect(":memory:")
    r = random.Random(1)
    ends = "s es ed ing ly ational tional enci anci izer bli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti icate ative alize iciti ical ful ness al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize y e ll eed ies sses logi".split()
    words = sorted({r.choice(["hop", "relat", "condit", "valen", "digit", "conform", "radic", "different", "vil", "analog", "vietnam", "predic", "oper", "feud", "decis", "hope", "callous", "formal", "sensit", "sens", "triplic", "form", "electr", "good", "reviv", "allow", "infer", "airlin", "gyroscop", "adjust", "defens", "irrit", "replac", "depend", "adopt", "homolog", "commun", "activ", "angular", "effect", "bowdler", "prob", "ceas", "controll", "roll", "sky", "cry", "by", "tr", "fizz", "fall", "hiss", "tann", "fil", "siz", "troubl", "conflat"]) + r.choice(ends) for _ in range(1500)} | set(WORDS))
    words = [w for w in words if w.isascii()]
    con.execute("create virtual table t using fts5(w, tokenize='porter unicode61')")
    con.execute("create virtual table v using fts5vocab(t, row)")
    wrong = []
    for w in words:
        con.execute("delete from t")
        con.execute("insert into t values (?)", (w,))
        theirs = con.execute("select term from v").fetchone()[0]
        if theirs != stem(w):
            wrong.append((w, stem(w), theirs))
    assert not wrong, wrong[:20]


def test_tokens(spark):
    rows = [("Foo_bar, Ünïcode x1y2 — ÉCOLE",), ("",), (None,)]
    from lodestone.functions.text import fts_tokens

    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(fts_tokens(F.col("t"))).collect()]
    assert got == [["foo", "bar", "unicode", "x1y2", "ecole"], [], None]


def test_stored_index(spark, both, tmp_path):
    _, index = both
    fts.save_index(index, f"{tmp_path}/i", 16)
    stored = fts.load_index(spark, f"{tmp_path}/i")
    asked = {1: "run OR token", 2: "nat*", 3: '"the of"', 4: "content: run"}
    rows = lambda i: sorted((r.query_id, r.symbol_id, round(r.rank, 9)) for r in fts.search(i, asked, spark).collect())
    assert rows(stored) == rows(index)
    plan = fts.search(stored, {1: "token"}, spark)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]
    assert "PushedFilters: [In(term" in plan or "EqualTo(term" in plan

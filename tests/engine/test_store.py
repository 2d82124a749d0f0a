"""The snapshot store: what a change rewrites, and what writers that die leave."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators.store import TABLES, SnapshotStore, remove_files, replace_files


def tables(spark, rows, note):
    """One file, two symbols and their vectors a row."""
    files = spark.createDataFrame([(p, note, 0.0, 1) for p in rows], TABLES["files"])
    symbols = spark.createDataFrame([(p, f"s{k}", "chunk", k, k, note, hash((p, k)) % 10**12) for p in rows for k in (1, 2)], TABLES["symbols"])
    return files, symbols, symbols.select("symbol_id", F.array(F.lit(1.0).cast("float")).alias("embedding"))


def counts(store):
    t = store.read()
    return t["files"].count(), t["symbols"].count(), t["embeddings"].count()


@pytest.fixture
def store(spark, tmp_path):
    s = SnapshotStore(spark, f"file://{tmp_path}/index", buckets=8)
    s.write(dict(zip(TABLES, tables(spark, [f"f{i}" for i in range(40)], "old"), strict=True)))
    return s


def test_a_change_writes_its_buckets_alone(spark, store, tmp_path):
    assert counts(store) == (40, 80, 80)
    before = store.current()
    new = tables(spark, ["f3", "new"], "changed")
    at = store.update(new[0].select("path"), lambda t: replace_files(t, *new))
    assert at != before and store.current() == at
    assert counts(store) == (41, 82, 82)
    assert {r.path for r in store.read()["files"].where("language = 'changed'").collect()} == {"f3", "new"}
    written = os.listdir(f"{at.removeprefix('file:')}/files")
    assert 1 <= sum(n.startswith("bucket=") for n in written) <= 2
    gone = spark.createDataFrame([("f5",), ("absent",)], "path string")
    store.update(gone, lambda t: remove_files(t, gone))
    assert counts(store) == (40, 80, 80)
    store.vacuum(keep=1)
    assert counts(store) == (40, 80, 80) and len([n for n in os.listdir(tmp_path / "index") if n.startswith("CURRENT")]) == 1


def test_a_dead_writer_is_not_seen(spark, store, tmp_path):
    """One that died before its mark, and one that died while it made it."""
    now = store.current()
    store._written(dict(zip(TABLES, tables(spark, ["dead"], "dead"), strict=True)), 8)
    assert store.current() == now and counts(store)[0] == 40
    (tmp_path / "index" / "CURRENT-1").write_text("")
    (tmp_path / "index" / "CURRENT-2").write_text('{"folder": "v-x", "tab')
    assert store.current() == now
    new = tables(spark, ["next"], "new")
    store.update(new[0].select("path"), lambda t: replace_files(t, *new))
    assert counts(store) == (41, 82, 82) and not store.read()["files"].where("language = 'dead'").count()


def test_a_second_writer_fails(spark, store):
    new = tables(spark, ["a"], "new")

    def slow(t):
        other = SnapshotStore(spark, store.root)
        other.update(new[0].select("path"), lambda u: replace_files(u, *new))
        return t

    with pytest.raises(RuntimeError, match="another writer"):
        store.update(spark.createDataFrame([("f1",)], "path string"), slow)
    assert counts(store) == (41, 82, 82)


def test_nothing_left(spark, store):
    every = spark.createDataFrame([(f"f{i}",) for i in range(40)], "path string")
    store.update(every, lambda t: remove_files(t, every))
    assert counts(store) == (0, 0, 0)
    assert store.update(every.limit(0), lambda t: t) is None

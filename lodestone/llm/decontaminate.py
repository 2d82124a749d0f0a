"""Benchmark decontamination by size-partitioned MinHash containment search [native].

A benchmark item of n distinct shingles (five words, lower case; the whole text where it has
fewer words) is contained in a document if at least 80 % of them occur in it. Items are
partitioned by size into classes [2^j, 2^(j+1)). An item of a class whose sizes go up to u is
sketched by its floor(0.2 u) + 1 smallest values of a MinHash permutation. A document that
contains the item lacks at most 0.2 u of its shingles and so has at least one of the sketch:
probing documents' shingles against the sketches misses nothing, however long the document is,
where comparing signatures of whole documents would. Candidates are then verified by exact
containment.

The sketches and the candidate pairs are broadcast only below a counted size, and joined by
shuffle beyond it. Everything runs in DataFrame functions.

Nulls and empty texts contain nothing; items without a word match nothing; empty tables give empty results. Documents of any length are
probed whole. Null ids match as
any other id. Rows that share a doc_id are judged one by one and the largest containment is
reported; repeated items likewise. Extra columns are ignored by contained_items() and kept by
drop_contaminated().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, table, words

SHINGLE = 5
#: Containment as a fraction, so that the comparison is exact.
NUMERATOR, DENOMINATOR = 4, 5
#: Rows of (shingle, item) or (doc, item) that may be broadcast, about 32 bytes each.
BROADCAST_ROWS = 500_000


def _hashes(text: Column) -> Column:
    return F.transform(words(F.lower(F.coalesce(text.cast("string"), F.lit("")))), lambda w: F.xxhash64(w))


def _grams(h: str, n: int) -> Column:
    """Hashes of all runs of n words; h: a column of word hashes."""
    run = lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, n)))
    return F.when(F.size(h) >= n, F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(0))), run)).otherwise(F.array().cast("array<bigint>"))


def _items(bench: DataFrame) -> DataFrame:
    """item_id, set (distinct shingle hashes), n, length (words a shingle)."""
    b = bench.select(F.col("item_id"), _hashes(F.col("text")).alias("h")).where(F.size("h") > 0)
    b = b.withColumn("length", F.least(F.size("h"), F.lit(SHINGLE)))
    s = F.coalesce(*(F.when(F.col("length") == n, _grams("h", n)) for n in range(1, SHINGLE + 1)))
    return b.withColumn("set", F.array_distinct(s)).withColumn("n", F.size("set")).select("item_id", "set", "n", "length")


def sketches(items: DataFrame) -> DataFrame:
    """shingle, item_id, size_class: the MinHash sketch of each item."""
    i = items.withColumn("size_class", F.floor(F.log2(F.col("n"))).cast("int")).withColumn("upper", F.pow(F.lit(2), F.col("size_class") + 1).cast("int") - 1)
    least = F.slice(F.sort_array(F.transform("set", lambda x: F.struct(F.xxhash64(x, F.lit("minhash")).alias("m"), x.alias("x")))), F.lit(1), (F.floor(F.col("upper") * (DENOMINATOR - NUMERATOR) / DENOMINATOR) + 1).cast("int"))
    return i.select("item_id", "size_class", F.explode(least).alias("s")).select(F.col("s.x").alias("shingle"), "item_id", "size_class")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contained_items(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of all pairs at or above the threshold."""
    items = checkpoint(_items(bench))
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # five values at most
    probe = checkpoint(sketches(items))
    # Which shingle lengths are asked for is known from the items, so that documents are hashed for no others.
    d = docs.select("doc_id", _hashes(F.col("text")).alias("h"))
    grams = F.concat(*(_grams("h", n) for n in lengths)) if lengths else F.array().cast("array<bigint>")
    hits = d.select("doc_id", F.explode(grams).alias("shingle")).join(_small(probe, probe.count()), "shingle").select("doc_id", "item_id").distinct()
    candidates = checkpoint(hits)
    pairs = candidates.withColumnRenamed("doc_id", "c_doc")
    n = candidates.count()
    found = docs.select("doc_id", "text").join(_small(pairs, n), F.col("doc_id").eqNullSafe(F.col("c_doc"))).select("doc_id", "item_id", _hashes(F.col("text")).alias("h"))
    found = found.select("doc_id", F.col("item_id").alias("c_item"), F.array_distinct(grams).alias("grams"))
    small_items = _small(items, items.select(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    exact = found.join(small_items, F.col("c_item").eqNullSafe(F.col("item_id"))).select("doc_id", "item_id", F.size(F.array_intersect("grams", "set")).cast("long").alias("n_shared"), F.col("n").cast("long").alias("n_item"))
    exact = exact.where(DENOMINATOR * F.col("n_shared") >= NUMERATOR * F.col("n_item"))
    best = exact.withColumn("containment", F.col("n_shared") / F.col("n_item")).groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shared", "b.n_item", "b.containment")


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents that contain no item."""
    ids = checkpoint(contained_items(docs, bench).select(F.col("doc_id").alias("_leak")).distinct())
    return docs.join(_small(ids, ids.count()), docs["doc_id"].eqNullSafe(ids["_leak"]), "left_anti")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), i AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s,
    least(len(w), 5) AS n FROM b
), z AS (
  SELECT item_id, count(*)::BIGINT AS n_item FROM i GROUP BY item_id
), l AS (
  SELECT DISTINCT n FROM i
), g AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - l.n + 2), lambda k: array_to_string(w[k:k + l.n - 1], ' '))) AS s FROM w, l WHERE len(w) >= l.n
)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n_item) AS n_item, count(*)::DOUBLE / any_value(n_item) AS containment
FROM g JOIN i USING (s) JOIN z USING (item_id) GROUP BY doc_id, item_id HAVING 5 * count(*) >= 4 * any_value(n_item)
"""

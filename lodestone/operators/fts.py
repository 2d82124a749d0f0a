"""Full-text search: an inverted index, a query language and BM25, for many queries in one job.

Queries are parsed on the driver into phrases and a boolean tree. Phrase terms meet the postings
in one equi-join; an instance of a phrase is a group of postings of equal shifted position, so a
phrase of any length costs one aggregation and no self-join. The tree becomes one expression
over the set of matched phrases.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.porter import stem, stem_lists
from ..functions.text import _ACCENTED, _PLAIN, fts_tokens

COLUMNS = ("path", "symbol_name", "symbol_type", "content")
# BM25.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
NEAR_DISTANCE = 10


def symbol_id(*columns: str) -> Column:
    return F.xxhash64(*(columns or ("path", "line_start", "symbol_name")))


@dataclass
class FtsIndex:
    """postings: symbol_id, col, pos, term. lengths: symbol_id, n (tokens of all columns)."""

    postings: DataFrame
    lengths: DataFrame
    stemmed: bool
    counted: tuple[float, float] | None = None
    #: Number of term buckets by which stored postings are partitioned.
    buckets: int | None = None

    def statistics(self) -> tuple[float, float]:
        """Rows and mean length, counted once an index. Lengths of an index that isn't stored are kept: a number a symbol, for which all texts are read."""
        if self.counted is None:
            self.lengths = self.lengths.persist()
            self.counted = tuple(self.lengths.agg(F.count("*").cast("double"), F.coalesce(F.avg("n"), F.lit(1.0))).first())
        return self.counted


def build_index(symbols: DataFrame, stemmed: bool = True) -> FtsIndex:
    """symbols: symbol_id and the four searched columns."""
    tokens = symbols.select("symbol_id", *(fts_tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in COLUMNS))
    lengths = tokens.select("symbol_id", sum(F.size(c) for c in COLUMNS).alias("n"))
    if stemmed:  # before terms are rows: a join with stems would bring all postings of a frequent term together
        tokens = tokens.select("symbol_id", *(stem_lists(c).alias(c) for c in COLUMNS))
    entries = tokens.select("symbol_id", F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("terms")) for c in COLUMNS))).alias("e"))
    postings = entries.select("symbol_id", "e.col", F.posexplode("e.terms").alias("pos", "term"))
    return FtsIndex(postings, lengths, stemmed)


BUCKETS, SPREAD = 64, 8


def save_index(index: FtsIndex, folder: str, buckets: int = BUCKETS) -> None:
    """Postings partitioned by a hash of the term and sorted by term within files, so that a search reads the buckets of its terms alone.

    The rows of a bucket are spread over a few files, as a frequent term may hold much of the table.
    """
    bucket = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).cast("int")
    p = index.postings.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("symbol_id"), F.lit(SPREAD)))
    p.sortWithinPartitions("bucket", "term", "symbol_id", "col", "pos").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{folder}/lengths")
    spark = index.postings.sparkSession
    rows, mean = load_lengths(spark, folder).agg(F.count("*").cast("double"), F.coalesce(F.avg("n"), F.lit(1.0))).first()
    # Written last: an index without it is not complete.
    spark.createDataFrame([(index.stemmed, buckets, rows, mean)], "stemmed boolean, buckets int, rows double, mean double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/statistics")


def load_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("symbol_id long, n int").parquet(f"{folder}/lengths")


def load_index(spark: SparkSession, folder: str) -> FtsIndex:
    m = spark.read.parquet(f"{folder}/statistics").first()
    postings = spark.read.schema("symbol_id long, col string, pos int, term string, bucket int").parquet(f"{folder}/postings")
    return FtsIndex(postings, load_lengths(spark, folder), m.stemmed, (m.rows, m.mean), m.buckets)


def _read(index: FtsIndex, terms: list[str], prefixes: list[str]) -> DataFrame:
    """Postings that the terms may be among: by bucket where no prefix is asked for, and by value in any case."""
    wanted = F.col("term").isin(sorted(set(terms))) | _any(F.startswith(F.col("term"), F.lit(p)) for p in sorted(set(prefixes)))
    postings = index.postings.where(wanted)
    if index.buckets is None:
        return postings
    if not prefixes:
        postings = postings.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % index.buckets for t in terms})))
    return postings.drop("bucket")


@dataclass
class Phrase:
    terms: list[str]
    prefix: bool = False
    first: bool = False
    columns: tuple[str, ...] | None = None
    near: int | None = None  # number of its NEAR group
    distance: int = NEAR_DISTANCE


@dataclass
class Query:
    """tree: ("phrase", number) | ("and" | "or" | "not", left, right)."""

    phrases: list[Phrase] = field(default_factory=list)
    tree: tuple | None = None
    error: str | None = None


class QueryError(ValueError):
    pass


_LEX = re.compile(r'\s+|"((?:[^"]|"")*)"|([A-Za-z0-9_\x1a\x80-\U0010ffff]+)|([(){}:+*^,\-])')


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise QueryError(f"syntax error near {text[at]!r}")
        at = m.end()
        if m[1] is not None:
            out.append(("string", m[1].replace('""', '"')))
        elif m[2] is not None:
            out.append((m[2] if m[2] in ("AND", "OR", "NOT") else "word", m[2]))
        elif m[3] is not None:
            out.append((m[3], m[3]))
    return [*out, ("end", "")]


_TERM = re.compile(r"[^\W_]+")
_FOLD = str.maketrans(_ACCENTED, _PLAIN)


def query_terms(text: str, stemmed: bool) -> list[str]:
    found = _TERM.findall(text.lower().translate(_FOLD))
    return [stem(t) for t in found] if stemmed else found


class _Parser:
    """Precedence from tightest: implicit AND, NOT, AND, OR."""

    def __init__(self, text: str, stemmed: bool):
        self.tokens, self.at, self.query, self.stemmed, self.groups = _lex(text), 0, Query(), stemmed, 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)][0]

    def take(self, kind: str) -> str:
        got, value = self.tokens[self.at]
        if got != kind:
            raise QueryError(f"syntax error near {value!r}")
        self.at += 1
        return value

    def binary(self, word: str, kind: str, below) -> tuple:
        left = below()
        while self.peek() == word:
            self.at += 1
            left = (kind, left, below())
        return left

    def any_of(self):
        return self.binary("OR", "or", self.all_of)

    def all_of(self):
        return self.binary("AND", "and", self.without)

    def without(self):
        return self.binary("NOT", "not", self.implicit)

    def implicit(self):
        if self.peek() == "(":
            self.at += 1
            inner = self.any_of()
            self.take(")")
            return inner
        tree = self.member(None)
        while self.peek() in ("word", "string", "^", "{", "-"):
            tree = ("and", tree, self.member(None))
        return tree

    def column_set(self) -> tuple[str, ...] | None:
        negated = self.peek() == "-"
        start = self.at
        self.at += negated
        if self.peek() == "{":
            self.at += 1
            names = []
            while self.peek() in ("word", "string"):
                names.append(self.tokens[self.at][1])
                self.at += 1
            self.take("}")
        elif self.peek() in ("word", "string") and self.peek(1) == ":":
            names = [self.tokens[self.at][1]]
            self.at += 1
        elif negated:
            # A bare minus is read as a column filter whose column does not exist.
            raise QueryError(f"no such column: {self.tokens[self.at][1]}")
        else:
            self.at = start
            return None
        self.take(":")
        if unknown := [x for x in names if x.lower() not in (*COLUMNS, "line_start", "line_end")]:
            raise QueryError(f"no such column: {unknown[0]}")
        wanted = tuple(x.lower() for x in names)
        return tuple(c for c in COLUMNS if c not in wanted) if negated else tuple(c for c in COLUMNS if c in wanted)

    def member(self, columns):
        own = self.column_set()
        if own is not None:
            columns = own if columns is None else tuple(c for c in own if c in columns)
            if self.peek() == "(":
                self.at += 1
                before = len(self.query.phrases)
                inner = self.any_of()
                self.take(")")
                for p in self.query.phrases[before:]:
                    p.columns = columns if p.columns is None else tuple(c for c in p.columns if c in columns)
                return inner
        if self.peek() == "word" and self.tokens[self.at][1] == "NEAR" and self.peek(1) == "(":
            return self.near(columns)
        return self.phrase(columns)

    def near(self, columns):
        self.at += 2
        group, members = self.groups, []
        self.groups += 1
        while self.peek() in ("word", "string", "^"):
            members.append(self.phrase(columns))
        distance = NEAR_DISTANCE
        if self.peek() == ",":
            self.at += 1
            said = self.take("word")
            if not said.isdigit():
                raise QueryError(f"expected integer, got {said!r}")
            distance = int(said)
        self.take(")")
        if not members:
            raise QueryError("syntax error near ')'")
        tree = members[0]
        for m in members[1:]:
            tree = ("and", tree, m)
        for _, k in members:
            self.query.phrases[k].near, self.query.phrases[k].distance = group, distance
        return tree

    def phrase(self, columns):
        first = self.peek() == "^"
        self.at += first
        terms, prefix = [], False
        while True:
            if self.peek() not in ("word", "string"):
                raise QueryError(f"syntax error near {self.tokens[self.at][1]!r}")
            terms += query_terms(self.tokens[self.at][1], self.stemmed)
            self.at += 1
            if prefix := self.peek() == "*":
                self.at += 1
            if self.peek() != "+":
                break
            self.at += 1
        self.query.phrases.append(Phrase(terms, prefix, first, columns))
        return ("phrase", len(self.query.phrases) - 1)


def parse_query(text: str, stemmed: bool = True) -> Query:
    """A query whose error is set matches nothing."""
    try:
        p = _Parser(text, stemmed)
        tree = p.any_of()
        p.take("end")
    except QueryError as e:
        return Query(error=str(e))
    p.query.tree = tree
    return p.query


def sanitised(text: str) -> str:
    """Prose as an OR of its words."""
    return " OR ".join(f'"{t}"' for t in dict.fromkeys(_TERM.findall(text.lower())))


def _holds(tree: tuple, matched: Column) -> Column:
    kind = tree[0]
    if kind == "phrase":
        return F.array_contains(matched, tree[1])
    left, right = _holds(tree[1], matched), _holds(tree[2], matched)
    return left & right if kind == "and" else left | right if kind == "or" else left & ~right


def _counting(tree: tuple, matched: Column, above: Column | None = None) -> list[Column]:
    """For each phrase its number where it adds to the score: where every part of the query around it holds."""
    kind = tree[0]
    if kind == "phrase":
        return [F.when(F.lit(True) if above is None else above, F.lit(tree[1]))]
    if kind != "or":
        own = _holds(tree, matched)
        above = own if above is None else above & own
    return _counting(tree[1], matched, above) + ([] if kind == "not" else _counting(tree[2], matched, above))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("phrase", T.IntegerType()), T.StructField("p", T.IntegerType())])))
def _near_clumps(instances: pd.Series, sizes: pd.Series, distance: pd.Series) -> pd.Series:
    """Instances of the clumps that one sweep over all lists finds. In a clump no phrase ends more than the distance before the last one begins."""

    def keep(items, lengths, most):
        sizes = {int(x["phrase"]): int(x["n"]) for x in lengths}
        lists = {k: sorted({int(i["p"]) for i in items if int(i["phrase"]) == k}) for k in sizes}
        out: set[tuple[int, int]] = set()
        at = dict.fromkeys(lists, 0)
        if not all(lists.values()):
            return []
        while True:
            last = max(lists[k][at[k]] for k in lists)
            late = [k for k in lists if lists[k][at[k]] < last - sizes[k] - most]
            if not late:
                out |= {(k, lists[k][at[k]]) for k in lists}
                # Whichever phrase comes next moves on.
                ahead = {k: lists[k][at[k] + 1] for k in lists if at[k] + 1 < len(lists[k])}
                if not ahead:
                    break
                late = [min(ahead, key=ahead.get)]
            for k in late:
                at[k] += 1
            if any(at[k] >= len(lists[k]) for k in late):
                break
        return [{"phrase": a, "p": b} for a, b in sorted(out)]

    return pd.Series([keep(a, b, c) for a, b, c in zip(instances, sizes, distance, strict=True)])


def search(index: FtsIndex, queries: dict[int, str], spark: SparkSession) -> DataFrame:
    """query_id, symbol_id, rank (negative, lower is better) of every row that a query matches."""
    parsed = {k: q for k, q in ((k, parse_query(t, index.stemmed)) for k, t in queries.items()) if q.tree and not q.error}
    rows = [(k, n, i, t, bool(p.prefix and i == len(p.terms) - 1), p.first, len(p.terms), list(COLUMNS if p.columns is None else p.columns), -1 if p.near is None else p.near, p.distance) for k, q in parsed.items() for n, p in enumerate(q.phrases) for i, t in enumerate(p.terms)]
    terms = spark.createDataFrame(rows, "query_id long, phrase int, i int, wanted string, prefix boolean, first boolean, n_terms int, cols array<string>, near int, distance int")
    # Terms of the queries of one call: bounded by the text of the queries, which came through the driver.
    terms = F.broadcast(terms)
    starts = [r[3] for r in rows if r[4]]
    postings = _read(index, [r[3] for r in rows if not r[4]], starts)
    hits = postings.join(terms.where("not prefix"), F.col("term") == F.col("wanted"))
    if starts:
        hits = hits.unionByName(postings.join(terms.where("prefix"), F.startswith(F.col("term"), F.col("wanted"))))
    hits = hits.where(F.array_contains("cols", F.col("col")))
    keys = ("query_id", "phrase", "symbol_id")
    placed = hits.groupBy(*keys, "col", (F.col("pos") - F.col("i")).alias("p")).agg(F.count_distinct("i").alias("got"), F.first("n_terms").alias("n_terms"), F.first("first").alias("first"), F.first("near").alias("near"), F.first("distance").alias("distance"))
    placed = placed.where((F.col("got") == F.col("n_terms")) & (~F.col("first") | (F.col("p") == 0)))
    # How rare a phrase is doesn't depend on what is near it.
    seen = placed.groupBy("query_id", "phrase").agg(F.count_distinct("symbol_id").cast("double").alias("hits"))
    if any(p.near is not None for q in parsed.values() for p in q.phrases):
        sizes = spark.createDataFrame([(k, p.near, [{"phrase": n, "n": len(x.terms)} for n, x in enumerate(q.phrases) if x.near == p.near]) for k, q in parsed.items() for p in q.phrases if p.near is not None], "query_id long, near int, sizes array<struct<phrase:int,n:int>>").distinct()
        groups = placed.where("near >= 0").groupBy("query_id", "near", "symbol_id", "col").agg(F.collect_list(F.struct("phrase", F.col("p").cast("int").alias("p"))).alias("all"), F.first("distance").alias("distance")).join(F.broadcast(sizes), ["query_id", "near"])
        kept = groups.select("query_id", "symbol_id", "col", F.explode(_near_clumps("all", "sizes", "distance")).alias("e")).select("query_id", "e.phrase", "symbol_id", "col", F.col("e.p").alias("p"))
        placed = placed.where("near < 0").select(*keys, "col", "p").unionByName(kept)
    tf = placed.groupBy(*keys).agg(F.count("*").cast("double").alias("f"))
    rows_, mean = index.statistics()  # keeps the lengths, if they aren't stored
    scored = tf.join(F.broadcast(seen), ["query_id", "phrase"]).join(index.lengths, "symbol_id")
    idf = F.log((F.lit(rows_) - F.col("hits") + 0.5) / (F.col("hits") + 0.5))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    gain = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n") / F.lit(mean)))
    out = scored.withColumn("gain", gain).groupBy("query_id", "symbol_id").agg(F.array_sort(F.collect_list(F.struct("phrase", "gain"))).alias("gains"))
    out = out.withColumn("matched", F.transform("gains", lambda g: g.phrase))
    holds = counting = None
    for k, q in parsed.items():
        cond, adds = _holds(q.tree, F.col("matched")), F.array_compact(F.array(*_counting(q.tree, F.col("matched"))))
        this = F.col("query_id") == k
        holds = F.when(this, cond) if holds is None else holds.when(this, cond)
        counting = F.when(this, adds) if counting is None else counting.when(this, adds)
    if holds is None:
        return out.where("false").select("query_id", "symbol_id", F.lit(0.0).alias("rank"))
    total = F.aggregate(F.filter("gains", lambda g: F.array_contains("counting", g.phrase)), F.lit(0.0), lambda s, g: s + g.gain)
    return out.where(holds).withColumn("counting", counting).select("query_id", "symbol_id", (-total).alias("rank"))


def _any(conditions):
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out

"""Quality rules as a short-circuit cascade [native].

Each rule is a Column that is true where a document must go. The cost and the selectivity of
every rule are estimated on a bounded sample of rows: of several runs over the sample, many times repeated, the
quickest counts, less that of a rule that does nothing. The cascade then asks the rules in the
order of rejection per cost, inside one CASE expression, so that a document pays for a rule,
and for the measures that it alone needs, only if all earlier ones let it pass; the rules on few and on repeated words
are part of it. The verdict is an AND over all rules: the order, and so
the sample, changes the time taken and never the result. quality_measures() returns the base counts of every row
and so has to take them of every row.

Nulls: a null text is an empty text (no words), which the word-count rule rejects. Texts of any length are judged whole.
Empty tables give empty results. Rows are judged one by one, so ties and repeated rows need no
rule. Columns of the input whose names clash with those added are kept by quality_filter and
left out by quality_measures.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty, words

MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Rows on which costs and selectivities are estimated, their characters, how many rows there are to one that the hash of its text chooses,
#: how often they are repeated, and runs over them. They bear on the order of the rules alone.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_STEP, SAMPLE_REPEATS, SAMPLE_RUNS = 500, 2000, 4, 32, 3
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """reject gets the names of prepared columns (text and words, see prepare) and returns a boolean Column."""

    name: str
    reject: Callable[[], Column]


def _share(pattern: str) -> Column:
    """Characters of the pattern by characters outside white space."""
    rest = F.length(F.regexp_replace("_text", pattern, ""))
    return (F.length("_text") - rest) / F.greatest(F.col("_chars"), F.lit(1))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _written(lines: Column) -> Column:
    """The lines with a word."""
    return F.filter(lines, lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)


def _many_duplicates() -> Column:
    return _let(_written(F.split("_text", "\n")), lambda x: F.size(x) - F.size(F.array_distinct(x)) > 0.4 * F.size(x))


def repeat_words(words_: Column) -> Column:
    """Words in 3-word windows found twice or more, inside one expression: as prepare() does it in steps."""
    windows = lambda h: F.when(F.size(h) >= 3, F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    twice = lambda s: F.transform(F.filter(s, lambda e, j: F.coalesce(e.x == F.get(s, j - 1).x, F.lit(False)) | F.coalesce(e.x == F.get(s, j + 1).x, F.lit(False))), lambda e: e.i)
    covered = lambda p: F.size(F.array_union(F.array_union(p, F.transform(p, lambda i: i + 1)), F.transform(p, lambda i: i + 2)))
    placed = lambda t: F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    count = lambda t: F.when(F.size(t) > F.size(F.array_distinct(t)), _let(placed(t), lambda s: _let(twice(s), covered))).otherwise(0)
    return _let(F.transform(words_, lambda w: F.xxhash64(w)), lambda h: _let(windows(h), count))


#: The base rule, as rules of the cascade.
BASE_RULES = (
    Rule("few_words", lambda: F.size("_words") < MIN_WORDS),
    Rule("repeated_words", lambda: 100 * repeat_words(F.col("_words")) > MOST_REPEATED_PERCENT * F.size("_words")),
)

#: Beyond the base rule. Thresholds are those of published heuristics for web text, widened where clean documents need it.
DEFAULT_RULES = (
    Rule("symbols_per_word", lambda: F.col("_symbols") > 0.1 * F.size("_words")),
    Rule("mean_word_length", lambda: ~(F.col("_chars") / F.greatest(F.size("_words"), F.lit(1))).between(2.5, 12)),
    Rule("duplicate_lines", _many_duplicates),
    Rule("few_letters", lambda: _share(r"\p{L}+") < 0.6),
    Rule("mostly_capitals", lambda: _share(r"\p{Lu}+") > 0.5),
    Rule("punctuation_marks", lambda: _share("[!?]+") > 0.1),
)


def barrier() -> Column:
    """True, but not deterministic. A filter on plain expressions would be pushed below the projections and copy
    the measures into itself, once for each place that uses them; above such a column it stays."""
    return F.monotonically_increasing_id() >= 0


def light(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the working columns that rules read; the names begin with an underscore."""
    d = df.withColumn("_text", text_or_empty(text)).withColumn("_words", words(F.col("_text")))
    return d.withColumn("_chars", F.length(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", ""))).withColumn("_symbols", F.length("_text") - F.length(F.translate("_text", SYMBOLS, "")))


def prepare(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns of light() and the base counts of lines and repeated words.

    Repeated 3-word windows are found inside the row: window hashes, and only where they aren't
    all distinct a sort of (hash, place) and a comparison of neighbours, in n log n.
    """
    d = light(df, text)
    d = d.withColumn("_worded", _written(F.split("_text", "\n")))
    d = d.withColumn("_lines", F.size("_worded")).withColumn("_dup_lines", F.size("_worded") - F.size(F.array_distinct("_worded")))
    d = d.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    d = d.withColumn("_n", F.size("_h"))
    d = d.withColumn("_t", F.when(F.col("_n") >= 3, F.transform(F.slice("_h", F.lit(1), F.greatest(F.col("_n") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("_s", F.when(F.size("_t") > F.size(F.array_distinct("_t")), F.sort_array(F.transform("_t", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")))
    near = lambda s, j: F.coalesce(s.x == F.get("_s", j - 1).x, F.lit(False)) | F.coalesce(s.x == F.get("_s", j + 1).x, F.lit(False))
    d = d.withColumn("_p", F.transform(F.filter("_s", near), lambda s: s.i))
    covered = F.array_union(F.array_union("_p", F.transform("_p", lambda i: i + 1)), F.transform("_p", lambda i: i + 2))
    return d.withColumn("_repeat", F.when(F.size("_p") > 0, F.size(covered)).otherwise(0)).drop("_worded", "_h", "_n", "_t", "_s", "_p")


def base_failed() -> Column:
    n = F.size("_words")
    return (n < MIN_WORDS) | (100 * F.col("_repeat") > MOST_REPEATED_PERCENT * n)


def estimate(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(name, seconds a row, share rejected) of each rule over a bounded sample."""
    t = text_or_empty(text)
    # Read partition by partition until there are enough; the rest of the table isn't touched.
    texts = [r[0] for r in docs.where(F.pmod(F.xxhash64(t), F.lit(SAMPLE_STEP)) == 0).select(F.substring(t, 1, SAMPLE_CHARS)).limit(sample_rows).collect()]
    sample = light(docs.sparkSession.createDataFrame([(x,) for x in texts], "text string")).select("_text", "_words", "_chars", "_symbols").persist()
    try:
        n = max(1, sample.count() * SAMPLE_REPEATS)
        repeated = sample.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_REPEATS))))

        def seconds(c: Column) -> tuple[float, int]:
            asked, times = repeated.agg(F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("bigint")), F.lit(0))), []
            for _ in range(SAMPLE_RUNS):
                began = time.perf_counter()
                hits = asked.first()[0]
                times.append(time.perf_counter() - began)
            return min(times), hits

        nothing = seconds(F.length("_text") < 0)[0]
        measured = [(rule.name, *seconds(rule.reject())) for rule in rules]
        return [(name, max(took - nothing, 1e-4) / n, hits / n) for name, took, hits in measured]
    finally:
        sample.unpersist()


def order_rules(estimates: list[tuple[str, float, float]]) -> list[str]:
    """Highest rejection per cost first; ties keep the given order."""
    return [name for name, cost, share in sorted(estimates, key=lambda e: -e[2] / max(e[1], 1e-9))]


def cascade(rules: list[Rule]) -> Column:
    """True where no rule rejects. CASE branches are asked in order, and none after the first that holds."""
    out = None
    for rule in rules:
        hit = F.coalesce(rule.reject(), F.lit(False))
        out = F.when(hit, False) if out is None else out.when(hit, False)
    return F.lit(True) if out is None else out.otherwise(True)


def ordered(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> list[Rule]:
    by_name = {r.name: r for r in rules}
    return [by_name[x] for x in order_rules(estimate(docs, rules, text))]


def quality_measures(docs: DataFrame, id_column: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """One row per document: the base counts, base_failed and kept."""
    d = prepare(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")))
    steps = ordered(docs, rules, text)
    failed = base_failed()
    return d.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"), F.col("_chars").cast("long").alias("word_chars"), F.col("_symbols").cast("long").alias("n_symbols"),
        F.col("_dup_lines").cast("long").alias("n_dup_lines"), F.col("_repeat").cast("long").alias("n_repeat_words"), failed.alias("base_failed"), F.when(failed, False).otherwise(cascade(steps) & barrier()).alias("kept"),
    )


def quality_filter(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """The documents that pass, with their own columns."""
    d = light(docs.select(F.struct("*").alias("_row"), F.col(text).alias("text")))
    verdict = cascade(ordered(docs, (*BASE_RULES, *rules), text)) & barrier()
    return d.withColumn("_keep", verdict).where("_keep").select("_row.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_measures(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, t, w, len(w)::BIGINT AS n, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS sym,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END AS g
  FROM w
), e AS (
  SELECT doc_id, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM g
), r AS (
  SELECT doc_id, i FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id
), m AS (
  SELECT g.doc_id, t, n AS n_words, chars AS word_chars, sym AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
    n < 50 OR 100 * coalesce(n_repeat, 0) > 50 * n AS base_failed,
    (length(t) - length(regexp_replace(t, '\p{L}+', '', 'g')))::DOUBLE / greatest(chars, 1) AS letters,
    (length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')))::DOUBLE / greatest(chars, 1) AS capitals,
    (length(t) - length(regexp_replace(t, '[!?]+', '', 'g')))::DOUBLE / greatest(chars, 1) AS marks
  FROM g LEFT JOIN c USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_symbols > 0.1::DOUBLE * n_words) AND word_chars::DOUBLE / greatest(n_words, 1) BETWEEN 2.5::DOUBLE AND 12::DOUBLE AND NOT (n_dup_lines > 0.4::DOUBLE * n_lines)
    AND NOT letters < 0.6::DOUBLE AND NOT capitals > 0.5::DOUBLE AND NOT marks > 0.1::DOUBLE AS kept
FROM m
"""

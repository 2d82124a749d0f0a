"""Scope of a task by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SCOPES, SHORT_TASK_WORDS, SIGNALS, scope_config
from ..functions.text import word_count

FUNCTION_CALL = r"(?U)\b\w+\(\)"
SHORT = "<short task>"


def _first_signal(task: Column, signals: tuple[str, ...]) -> Column:
    """The first phrase of a level that occurs anywhere in the task, also inside a word."""
    return F.coalesce(*(F.when(task.contains(s), F.lit(s)) for s in signals))


def explain(tasks: DataFrame) -> DataFrame:
    """query_id, task, scope (1 to 4), scope_name, matched_signals, reasoning."""
    t = tasks.withColumn("_t", F.lower(F.regexp_replace("task", r"^\s+|\s+$", "")))
    t = t.withColumn("_n", word_count(F.col("_t"))).withColumn("_levels", F.array(*(_first_signal(F.col("_t"), s) for s in SIGNALS)))
    t = t.withColumn("_calls", F.regexp_extract_all("_t", F.lit(FUNCTION_CALL), F.lit(0))).withColumn("_signals", F.concat(F.array_compact("_levels"), "_calls"))
    levels = F.array_compact(F.concat(F.transform("_levels", lambda s, i: F.when(s.isNotNull(), i + 1)), F.array(F.when(F.size("_calls") > 0, F.lit(1)))))
    short = F.col("_n") < SHORT_TASK_WORDS
    scope = F.when(short, 1).otherwise(F.coalesce(F.array_max(levels), F.lit(2))).cast("int")
    named = t.withColumn("scope", scope).withColumn("scope_name", F.element_at(F.array(*(F.lit(s[1]) for s in SCOPES)), F.col("scope")))
    quoted = F.array_join(F.transform(F.slice("_signals", 1, 3), lambda s: F.concat(F.lit("'"), s, F.lit("'"))), " and ")
    more = F.when(F.size("_signals") > 3, F.format_string(" (+%d more)", F.size("_signals") - 3)).otherwise("")
    reasoning = (
        F.when(short, F.format_string("Task is only %d word(s) → surgical scope", F.col("_n")))
        .when(F.size("_signals") == 0, "No keyword signals detected → defaulting to local scope")
        .otherwise(F.concat(F.lit("Detected "), quoted, more, F.lit(" → "), F.lower("scope_name"), F.lit(" scope")))
    )
    return named.select("query_id", "task", "scope", "scope_name", F.when(short, F.array(F.lit(SHORT))).otherwise(F.col("_signals")).alias("matched_signals"), reasoning.alias("reasoning"))


def classify(tasks: DataFrame) -> DataFrame:
    return explain(tasks).select("query_id", "task", "scope", "scope_name")


def with_config(classified: DataFrame) -> DataFrame:
    """classified with the retrieval limits of its scope: a join with four rows."""
    return classified.join(F.broadcast(scope_config(classified.sparkSession).drop("scope_name")), "scope")

"""Retrieval limits by scope, weights and behaviour flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Limits by scope.
SCOPE_COLUMNS = "scope int, scope_name string, max_files int, max_symbols int, max_tokens int, use_callers boolean, use_deps boolean, search_depth int"
SCOPES = (
    (1, "SURGICAL", 3, 10, 2000, True, False, 1),
    (2, "LOCAL", 8, 30, 6000, True, True, 1),
    (3, "CONNECTED", 20, 80, 15000, True, True, 2),
    (4, "ARCHITECTURAL", 50, 200, 40000, True, True, 3),
)

# Signal phrases by scope; of each scope the first that occurs is reported.
SURGICAL_SIGNALS = ("fix", "bug", "error", "crash", "exception", "null", "undefined", "typo", "wrong value", "off by one", "return value", "this line", "this function", "this method")
LOCAL_SIGNALS = ("this file", "this module", "this class", "refactor", "rename", "move", "clean up", "rewrite", "simplify", "this component", "add method", "add function", "add field")
CONNECTED_SIGNALS = ("feature", "add support", "integrate", "connect", "wire up", "add endpoint", "new route", "new api", "rate limit", "middleware", "plugin", "extension", "across", "multiple files")
ARCHITECTURAL_SIGNALS = ("migrate", "refactor entire", "redesign", "replace", "switch from", "move from", "all files", "entire codebase", "everywhere", "architecture", "restructure", "overhaul", "convert", "upgrade entire", "global")
SIGNALS = (SURGICAL_SIGNALS, LOCAL_SIGNALS, CONNECTED_SIGNALS, ARCHITECTURAL_SIGNALS)
SHORT_TASK_WORDS = 5

# Score fusion, expansion, estimates.
SEMANTIC_WEIGHT, LEXICAL_WEIGHT = 0.7, 0.3
LEXICAL_ONLY_SCORE, EXPANDED_SCORE, REQUESTED_SCORE = 0.5, 0.0, 1.0
WELL_COVERED_HITS = 3
TOKENS_PER_WORD = 1.3
SEARCH_CAP = 20
RAW_TOKENS_PER_FILE, CONTEXT_TOKENS = 2000, 4000
CHUNK_LINES = 50


@dataclass(frozen=True)
class Flags:
    """Departures from the default behaviour, all off unless asked for."""

    #: Best lexical hit gets 1.0 instead of 0.0.
    fix_fts_norm: bool = False
    #: Symbols that the search found already are not added again by expansion.
    dedup_expanded: bool = False
    #: Lexical and expanded rows get the language of their file instead of "unknown".
    fix_language: bool = False
    #: Prose is searched as an OR of its words instead of being parsed as a query.
    sanitize_query: bool = False


def scope_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCOPES, SCOPE_COLUMNS)

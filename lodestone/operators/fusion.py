"""Fusion of semantic and lexical hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LEXICAL_WEIGHT, SEMANTIC_WEIGHT


def top_per_query(hits: DataFrame, order: list[Column], k: Column | int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def normalised_rank(rank: Column, fixed: bool = False) -> Column:
    """The strongest hit of a query gets 0 and weaker ones more; fixed turns that round."""
    most = F.max(F.abs(rank)).over(Window.partitionBy("query_id"))
    share = F.abs(rank) / F.when(most == 0, F.lit(1.0)).otherwise(most)
    return share if fixed else 1 - share


def fuse(semantic: DataFrame, lexical: DataFrame, k: Column | int, fix_fts_norm: bool = False, digits: int | None = None) -> DataFrame:
    """query_id, symbol_id, score, combined_score, semantic (whether the vector side found it), best k a query.

    semantic: query_id, symbol_id, score. lexical: query_id, symbol_id, rank. Both as the sides
    fetched them; a side that lacks a symbol contributes nothing.
    """
    rounded = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    lex = lexical.withColumn("lex", normalised_rank(F.col("rank"), fix_fts_norm)).select("query_id", "symbol_id", "lex")
    both = semantic.withColumnRenamed("score", "sem").join(lex, ["query_id", "symbol_id"], "full_outer")
    part = F.coalesce(F.col("lex") * LEXICAL_WEIGHT, F.lit(0.0))
    scored = both.select("query_id", "symbol_id", F.coalesce("sem", part).alias("score"), rounded(F.coalesce(F.col("sem") * SEMANTIC_WEIGHT, F.lit(0.0)) + part).alias("combined_score"), F.col("sem").isNotNull().alias("semantic"))
    return top_per_query(scored, [F.desc("combined_score"), F.col("symbol_id")], k)

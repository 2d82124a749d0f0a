"""A training-data pipeline over the documents table. Counts as part of the llm subpackage.

Each stage takes all that its predecessor kept and returns documents with their own columns; the
last returns token ids. Between stages documents are written as Parquet below the shared folder, and a
stage's input of the run's own making is removed once the next one is written.

Null and empty texts are rejected by the quality rules. Repeated rows that are kept stay as often as they occur, as a
document is known by its id. Null ids take part. Texts of any length are taken whole. Further columns
pass through up to the last stage, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, near_copies, quality_rules, secrets, sentencepiece
from lodestone.llm.common import saved, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the cascade rejects go."""
    return quality_rules.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (SimHash, five words, a similarity of 0.8) the document with the smallest id stays."""
    return near_copies.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; documents stay."""
    return secrets.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids; round_trip says that they decode to the text."""
    return sentencepiece.encode(docs)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination), ("secret_scan", secret_scan), ("sentencepiece", encoding)]

#: SimHash, the random field and the tokenizer can't be put into SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch(spark) as made:
            made += held  # the input, once the output is written
            docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
            held = [made.pop()]
    return docs

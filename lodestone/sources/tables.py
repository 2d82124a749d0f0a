"""Tables of texts as files, and vectors keyed like symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents_as_files(documents: DataFrame) -> DataFrame:
    """path, language, last_modified, size, content of a documents table."""
    return documents.select(F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("language"), F.lit(0.0).alias("last_modified"), F.col("n_chars").alias("size"), F.col("text").alias("content"))


def load_symbols(spark: SparkSession, index_dir: str) -> DataFrame:
    """All symbols of a stored index."""
    return spark.read.parquet(f"{index_dir.rstrip('/')}/symbols")


def file_symbols(symbols: DataFrame, path: str) -> DataFrame:
    """Symbols of one file by line; the filter reaches the scan."""
    return symbols.where(F.col("path") == path).orderBy("line_start", "symbol_name")


def is_indexed(files: DataFrame, paths: DataFrame) -> DataFrame:
    """path, indexed for each path asked for."""
    return paths.join(files.select("path", F.lit(True).alias("found")).distinct(), "path", "left").select("path", F.coalesce("found", F.lit(False)).alias("indexed"))

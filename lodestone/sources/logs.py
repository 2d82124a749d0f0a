"""Log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def severity(line: Column) -> Column:
    """The first of error, warning, success that the line mentions."""
    return F.when(line.contains("ERROR"), "error").when(line.contains("WARNING"), "warning").when(line.contains("SUCCESS") | line.contains("✓"), "success").otherwise("other")


def read_log(spark, path: str) -> DataFrame:
    """line_no, value of a text file of any size. line_no orders the lines: where their split begins, then the order within it."""
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(place.alias("line_no"), "value")


def tail(lines: DataFrame, n: int = 50) -> DataFrame:
    """The last n lines in order, with their severity. lines: line_no (anything that sorts), value."""
    last = lines.orderBy(F.desc("line_no")).limit(n)  # top-n per task, never a full sort
    return last.orderBy("line_no").select("line_no", "value", severity(F.col("value")).alias("severity"))


def tail_by_source(lines: DataFrame, n: int = 50, key: str = "source") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("line_no"))
    return lines.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r").withColumn("severity", severity(F.col("value")))

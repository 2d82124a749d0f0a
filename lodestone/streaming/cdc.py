"""File-change events to index changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import watch_ignored
from ..operators.store import SnapshotStore, remove_files, replace_files

#: What an event does to its path; a move does two things.
UPSERT, DELETE = "upsert", "delete"


def file_changes(events: DataFrame) -> DataFrame:
    """event_id, ts, part, path, op of events (op: created, modified, deleted, moved; path, dest_path, is_directory). Ignored paths drop out one by one, so of a move either half may stay."""
    none = F.lit(None).cast("string")
    pair = lambda part, op, path: F.struct(F.lit(part).alias("part"), F.lit(op).alias("op"), path.alias("path"))
    moved = F.array(pair(0, DELETE, F.col("path")), pair(1, UPSERT, F.col("dest_path")))
    one = F.when(F.col("op") == "deleted", F.array(pair(0, DELETE, F.col("path")))).when(F.col("op").isin("created", "modified"), F.array(pair(0, UPSERT, F.col("path")))).otherwise(F.array(pair(0, none, none)))
    steps = events.where(~F.col("is_directory")).select("event_id", "ts", F.explode(F.when(F.col("op") == "moved", moved).otherwise(one)).alias("e"))
    return steps.select("event_id", "ts", "e.part", "e.path", "e.op").where(F.col("op").isNotNull() & F.col("path").isNotNull() & ~watch_ignored(F.col("path")))


def last_changes(changes: DataFrame) -> DataFrame:
    """path, op: of each path what happened last."""
    return changes.groupBy("path").agg(F.max_by("op", F.struct("ts", "event_id", "part")).alias("op"))


def apply_changes(tables: dict[str, DataFrame], last: DataFrame, index: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame | None]]) -> dict[str, DataFrame]:
    """tables after the changes. index: paths to (files, symbols with symbol_id, embeddings or None)."""
    files, symbols, embeddings = index(last.where(F.col("op") == UPSERT).select("path"))
    left = remove_files(tables, last.select("path"))
    return replace_files(left, files, symbols, embeddings)


def diff_listing(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, op between two listings (path, last_modified, size): file sources report no deletions, a comparison does."""
    o, n = old.select("path", F.struct("last_modified", "size").alias("o")), new.select("path", F.struct("last_modified", "size").alias("n"))
    return o.join(n, "path", "full_outer").where(~F.col("o").eqNullSafe(F.col("n"))).select("path", F.when(F.col("n").isNull(), DELETE).otherwise(UPSERT).alias("op"))


def watch(events: DataFrame, store: SnapshotStore, index: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame | None]], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Applies a stream of events to the store, a snapshot per micro-batch, which writes the buckets of the changed paths alone.

    A batch that is tried again replaces the same paths by the same content, so its effect is that
    of one try. Within a batch only the last change of a path counts, as order is by arrival.
    """

    def one(batch: DataFrame, number: int) -> None:
        last = last_changes(file_changes(batch)).persist()
        try:
            if not last.isEmpty():
                store.update(last, lambda tables: apply_changes(tables, last, index))
        finally:
            last.unpersist()

    writer = events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()



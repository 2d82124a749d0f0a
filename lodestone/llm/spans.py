"""What the two span-removing operators share: row keys, first occurrences and the final cut."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Stands for a null id inside the operators; sorts first. A real id of that value has other hashes.
NULL_ID = -(1 << 63)


def keyed(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, rid, text, none (whether the id is null): rows that share id and text are one document, rows that share an id alone are told apart by the hash of the text."""
    t, none = text_or_empty(text), F.col(id_column).isNull()
    return docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("doc"), F.when(none, F.xxhash64(t, F.lit("none"))).otherwise(F.xxhash64(t)).alias("rid"), t.alias("text"), none.alias("none"))


def not_first(keys: tuple[np.ndarray, ...], places: tuple[np.ndarray, ...]) -> np.ndarray:
    """True for each row with an earlier place among those of equal keys. Equal places are one and the same."""
    order = np.lexsort((*reversed(places), *reversed(keys)))
    same = np.ones(len(order), dtype=bool)
    same[:1] = False
    for k in keys:
        same[1:] &= k[order[1:]] == k[order[:-1]]
    tied = same.copy()
    for p in places:
        tied[1:] &= p[order[1:]] == p[order[:-1]]
    # A row is first if it begins its group or ties with the row that does.
    group = np.cumsum(~same) - 1
    level = np.cumsum(~tied) - 1
    first_level = level[np.flatnonzero(~same)][group]
    out = np.empty(len(order), dtype=bool)
    out[order] = level != first_level
    return out


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc, rid, text, none, cuts (array of start, end; null where nothing goes). spans: doc, rid, start, end."""
    cuts = spans.groupBy("doc", "rid").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    return docs.join(cuts, ["doc", "rid"], "left")


def merged(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(cuts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out

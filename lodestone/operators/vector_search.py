"""Exact nearest neighbours by cosine for many queries in one job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, l2_normalise

#: Text to vectors; made once per worker by the factory that is given. Batches of this size.
Embedder = Callable[[list[str]], np.ndarray]
EMBED_BATCH = 32
#: Queries scored at once against one slice of the corpus, and numbers in all query vectors that may be broadcast.
BROADCAST_NUMBERS = 16_000_000
MATRIX_ROWS = 8192


def embed_symbols(symbols: DataFrame, factory: Callable[[], Embedder], id_column: str = "symbol_id") -> DataFrame:
    """symbol_id, embedding of each symbol's name, type and content."""
    text = F.concat_ws(" ", "symbol_name", "symbol_type", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = factory()
        for batch in batches:
            for k in range(0, batch.num_rows, EMBED_BATCH):
                part = batch.slice(k, EMBED_BATCH)
                vectors = np.asarray(embed(part.column(1).to_pylist()), dtype=np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], ["symbol_id", "embedding"])

    return symbols.select(F.col(id_column).alias("symbol_id"), text.alias("text")).mapInArrow(run, "symbol_id long, embedding array<float>")


def onnx_embedder(model_file: str, tokenizer_file: str, most_tokens: int = 256) -> Callable[[], Embedder]:
    """A factory for sentence-embedding models in ONNX form: masked mean pooling, then unit length."""

    def factory() -> Embedder:
        import onnxruntime
        from tokenizers import Tokenizer

        session = onnxruntime.InferenceSession(model_file, providers=["CPUExecutionProvider"])
        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.enable_truncation(most_tokens)
        tokenizer.enable_padding(pad_id=0)
        wanted = {i.name for i in session.get_inputs()}

        def embed(texts: list[str]) -> np.ndarray:
            encoded = tokenizer.encode_batch(texts)
            ids, mask = (np.array([getattr(e, k) for e in encoded], dtype=np.int64) for k in ("ids", "attention_mask"))
            given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            hidden = session.run(None, {k: v for k, v in given.items() if k in wanted})[0]
            pooled = (hidden * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1e-9)
            return pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12)

        return embed

    return factory


def normalised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.withColumn(column, l2_normalise(F.col(column)))


def top_k(queries: DataFrame, corpus: DataFrame, k: int | Column, digits: int | None = None) -> DataFrame:
    """query_id, symbol_id, score: the k best rows of corpus (symbol_id, embedding) for each query (query_id, embedding[, k]).

    Each task scores its slice of the corpus against a block of queries as one matrix product and
    keeps k a query, so what is shuffled is tasks times queries times k rows. Queries are a bounded
    set: they are broadcast in blocks of BROADCAST_NUMBERS. Ties go to the smaller symbol_id.
    """
    spark = queries.sparkSession
    has_k = isinstance(k, str) or "k" in queries.columns
    rows = queries.select("query_id", "embedding", *(["k"] if has_k else [])).collect()
    if not rows:
        return corpus.select(F.lit(0).cast("long").alias("query_id"), "symbol_id", F.lit(0.0).alias("score")).limit(0)
    size = max(1, BROADCAST_NUMBERS // max(1, len(rows[0].embedding)))
    out = None
    for at in range(0, len(rows), size):
        block = rows[at : at + size]
        ids = np.array([r.query_id for r in block], dtype=np.int64)
        limits = np.array([r.k if has_k else k for r in block], dtype=np.int64)
        matrix = np.array([r.embedding for r in block], dtype=np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
        part = _best(corpus, spark.sparkContext.broadcast((ids, limits, matrix)), digits)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "symbol_id")
    return out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("k")).select("query_id", "symbol_id", "score")


def _best(corpus: DataFrame, shipped, digits: int | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, limits, matrix = shipped.value
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for batch in batches:
            for a in range(0, batch.num_rows, MATRIX_ROWS):
                part = batch.slice(a, MATRIX_ROWS)
                symbols, vectors = part.column(0).to_numpy(), part.column(1)
                x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1).astype(np.float64)
                scores = matrix @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).T
                if digits is not None:
                    scores = np.round(scores, digits)
                for q, most in enumerate(limits.tolist()):
                    s, i = np.concatenate([kept[q][0], scores[q]]), np.concatenate([kept[q][1], symbols])
                    if len(s) > most > 0:  # only what is as good as the last that is kept is sorted
                        near = np.flatnonzero(s >= np.partition(s, len(s) - most)[len(s) - most])
                        s, i = s[near], i[near]
                    best = np.lexsort((i, -s))[:most]
                    kept[q] = (s[best], i[best])
        n = [len(s) for s, _ in kept]
        if sum(n):
            cols = [np.repeat(ids, n), np.concatenate([i for _, i in kept]), np.concatenate([s for s, _ in kept]), np.repeat(limits, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "symbol_id", "score", "k"])

    usable = corpus.where(F.col("symbol_id").isNotNull() & (F.size("embedding") > 0)).select(F.col("symbol_id").cast("long").alias("symbol_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return usable.mapInArrow(run, "query_id long, symbol_id long, score double, k long")


def similarity(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with their cosine as score, row by row in the JVM."""
    return pairs.withColumn("score", cosine(F.col(a), F.col(b)))


def with_symbols(hits: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Hits joined to their symbols and languages after the limit: a hit without a symbol is lost and not replaced."""
    return hits.join(symbols, "symbol_id").join(files.select("path", "language"), "path")

"""Hybrid search as one plan: three retrievers over a table of queries, fused by reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.operators import fuse, index, retrieve

DEFAULT = Settings()
MODES = ("keyword", "semantic", "fallback", "hybrid")


def retrieved(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None, k: int = DEFAULT.topk_per_mode, among: DataFrame | None = None, modes: tuple[str, ...] = MODES[:3], stored: index.Index | None = None) -> dict[str, DataFrame]:
    """The ranked list of each retriever; without vectors (or query vectors) there is no semantic one.

    Vectors come from ``vectors`` or from the stored index, whose model then makes those of queries without one.
    """
    lists = {}
    if vectors is None and stored is not None:
        vectors = stored.vectors
        if vectors is not None and stored.embed is not None and "vector" not in queries.columns:
            queries = queries.withColumn("vector", stored.embed(F.col("query")))
    if "keyword" in modes:
        lists["keyword"] = retrieve.keyword(queries, chunks, k, among, stored=stored)
    if "semantic" in modes and vectors is not None and "vector" in queries.columns:
        lists["semantic"] = retrieve.semantic(queries, vectors, k, among=among)
    if "fallback" in modes:
        lists["fallback"] = retrieve.fallback(queries, chunks, k, among, stored=stored)
    return lists


def search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, mode: str = "hybrid", top_n: int = 0, among: DataFrame | None = None, stored: index.Index | None = None) -> DataFrame:
    """``query_id``, ``chunk_id``, ``score``, ``hits`` (comma-joined), ``rk``; an unknown mode means hybrid.

    A single mode that can't search (semantic without vectors) finds nothing.
    """
    n = top_n or DEFAULT.top_n
    if mode in MODES[:3]:
        lists = retrieved(queries, chunks, vectors, among=among, modes=(mode,), stored=stored)
        if not lists:
            nothing = F.lit(None).cast(chunks.schema["chunk_id"].dataType)
            return queries.where(F.lit(False)).select("query_id", nothing.alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(mode).alias("hits"), F.lit(0).alias("rk"))
        ((name, rows),) = lists.items()
        return rows.where(F.col("rk") <= n).select("query_id", "chunk_id", "score", F.lit(name).alias("hits"), "rk")
    fused = fuse.rrf(fuse.together(retrieved(queries, chunks, vectors, among=among, stored=stored)), top_n=n)
    return fused.select("query_id", "chunk_id", F.col("rrf").alias("score"), F.array_join("hits", ", ").alias("hits"), "rk")


def with_chunks(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Titles and bodies for results, joined only after the ranking; ids without a chunk vanish."""
    return found.join(chunks, "chunk_id")

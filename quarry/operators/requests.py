"""Search requests of a tool, a table at once: arguments made safe, filters relaxed where they leave nothing, contexts within a budget.

A request has ``query_id``, ``query``, ``mode``, ``top_n``, ``facets`` (values that the chunk's ``facet`` may have; null or none: any) and
``exclude_toc``; all but the first two may be null. Each request has filters of its own, so they are applied to pairs of
request and chunk before anything is ranked.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import context, fuse, library, retrieve, term_blocks
from quarry.operators import index as I

MODES = ("keyword", "semantic", "fallback", "hybrid")
DEFAULT_TOP, MOST_TOP, BUDGET = 8, 20, 2500


def safe(requests: DataFrame) -> DataFrame:
    """Requests with stripped queries, a known mode (else hybrid), 1 to 20 results (8 if not given) and no tables of contents unless asked for."""
    mode = F.when(F.col("mode").isin(*MODES), F.col("mode")).otherwise("hybrid")
    given = F.when(F.col("top_n") == 0, None).otherwise(F.col("top_n"))
    top = F.greatest(F.lit(1), F.least(F.coalesce(given, F.lit(DEFAULT_TOP)), F.lit(MOST_TOP)))
    facets = F.when(F.size("facets") > 0, F.col("facets"))
    return requests.select("query_id", T.strip(F.coalesce("query", F.lit(""))).alias("query"), mode.alias("mode"), top.cast("int").alias("top_n"), facets.alias("facets"), F.coalesce("exclude_toc", F.lit(True)).alias("exclude_toc"))


def _fits() -> Column:
    return (F.col("facets").isNull() | F.array_contains("facets", F.col("facet"))) & ~(F.col("exclude_toc") & (F.coalesce("is_toc", F.lit(0)) == 1))


def _fits_block(queries: pd.DataFrame, rows: pd.DataFrame) -> np.ndarray:
    """The same for a block of queries and a block of vectors."""
    names, code = np.unique(rows["facet"].fillna("").astype(str), return_inverse=True)
    facets = np.array([[f is None or n in set(f) for n in names] for f in queries["facets"]], bool)
    toc = rows["is_toc"].fillna(0).to_numpy() == 1
    return facets[:, code] & ~(queries["exclude_toc"].to_numpy(bool)[:, None] & toc)


def found(requests: DataFrame, chunks: DataFrame, stored: I.Index, k: int = retrieve.DEFAULT.topk_per_mode, hits: DataFrame | None = None) -> DataFrame:
    """``query_id``, ``chunk_id``, ``rk`` of ``safe`` requests, each by its own mode and filters; ``chunks`` has ``chunk_id``, ``facet``, ``is_toc``."""
    facts = chunks.select("chunk_id", "facet", "is_toc")

    def kept(rows: DataFrame) -> DataFrame:
        asked = I.sent(requests, requests.select("query_id", "facets", "exclude_toc"))
        return rows.join(facts.hint("shuffle_hash"), "chunk_id").join(asked, "query_id").where(_fits()).drop("facet", "is_toc", "facets", "exclude_toc")

    def of(mode: str) -> DataFrame:
        return requests.where(F.col("mode").isin(mode, "hybrid"))

    if stored.chunks is not None and term_blocks.fit(retrieve.query_terms(of("keyword"), stored.analyse)):
        lists = {"keyword": retrieve.keyword(of("keyword"), chunks, k, stored=replace(stored, chunks=chunks), fits=_fits_block, facts=("facet", "is_toc"))}
    else:
        lists = {"keyword": retrieve.ranked(kept(retrieve.keyword_scores(of("keyword"), chunks, stored=stored)), k)}
    if stored.vectors is not None and stored.embed is not None:
        asked = of("semantic").withColumn("vector", stored.embed(F.col("query")))
        lists["semantic"] = retrieve.semantic(asked, stored.vectors.join(facts, "chunk_id"), k, fits=_fits_block)
    lists["fallback"] = retrieve.fallback(of("fallback"), chunks, k, stored=stored, keep=kept, hits=hits)
    every = library.kept(fuse.together(lists), "lists").join(requests.select("query_id", "mode", "top_n"), "query_id")
    single = every.where("mode <> 'hybrid' and rk <= top_n").select("query_id", "chunk_id", "rk")
    mixed = fuse.rrf(every.where("mode = 'hybrid'").drop("mode", "top_n"), top_n=MOST_TOP).join(requests.select("query_id", "top_n"), "query_id")
    return single.union(mixed.where("rk <= top_n").select("query_id", "chunk_id", "rk"))


def answered(requests: DataFrame, chunks: DataFrame, stored: I.Index, budget: int = BUDGET) -> DataFrame:
    """For each request ``status`` (``empty query``, ``no results`` or ``ok``), ``was_relaxed``, ``context``, ``served`` (the ids in it, in order) and ``used``.

    A request whose facets leave nothing is searched once more without them. What is served is what an answer may cite.
    """
    every = safe(requests)
    asked = every.where("query <> ''")
    hits = None
    if stored.chunks is not None:  # made once for both searches
        stored = replace(stored, stats=library.kept(stored.stats, "stats"), vectors=stored.vectors and library.kept(stored.vectors, "vectors"))
        hits = retrieve.word_hits(retrieve.query_words(asked.where(F.col("mode").isin("fallback", "hybrid"))), stored)
    first = library.kept(found(asked, chunks, stored, hits=hits), "found")  # at most ``MOST_TOP`` rows a request
    bare = asked.where("facets is not null").join(first.select("query_id").distinct(), "query_id", "left_anti")
    again = library.kept(found(bare.withColumn("facets", F.lit(None).cast("array<string>")), chunks, stored, hits=hits), "found-again")
    results = first.withColumn("was_relaxed", F.lit(False)).union(again.withColumn("was_relaxed", F.lit(True)))
    blocks = context.within_budget(I.sent(results), chunks.drop("facet", "is_toc"), budget)
    parts = F.array_sort(F.collect_list(F.struct("rk", "block", "chunk_id")))  # at most ``MOST_TOP``
    served = blocks.groupBy("query_id").agg(parts.alias("parts"), F.max("used").alias("used"))
    counted = results.groupBy("query_id").agg(F.max("was_relaxed").alias("was_relaxed"))
    rows = every.select("query_id", "query").join(counted, "query_id", "left").join(served, "query_id", "left")
    status = F.when(F.col("query") == "", "empty query").when(F.col("was_relaxed").isNull(), "no results").otherwise("ok")
    none = F.array().cast(f"array<{chunks.schema['chunk_id'].dataType.simpleString()}>")
    return rows.select(
        "query_id", status.alias("status"), F.coalesce("was_relaxed", F.lit(False)).alias("was_relaxed"),
        F.coalesce(F.array_join(F.transform("parts", lambda p: p["block"]), "\n---\n"), F.lit("")).alias("context"),
        F.coalesce(F.transform("parts", lambda p: p["chunk_id"]), none).alias("served"), F.coalesce("used", F.lit(0)).alias("used"),
    )

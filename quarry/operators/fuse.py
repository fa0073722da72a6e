"""Reciprocal rank fusion of ranked lists, and the operators around it."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.config import Settings

DEFAULT = Settings()
#: Retrievers in the order that breaks ties, with their weights.
WEIGHTS = {"keyword": DEFAULT.weight_keyword, "semantic": DEFAULT.weight_semantic, "fallback": DEFAULT.weight_fallback}
#: The seven combinations of retrievers of an ablation.
COMBINATIONS = (("keyword",), ("semantic",), ("fallback",), ("keyword", "semantic"), ("keyword", "fallback"), ("semantic", "fallback"), ("keyword", "semantic", "fallback"))


def together(lists: Mapping[str, DataFrame]) -> DataFrame:
    """Ranked lists as one table with ``src``, the list's name."""
    return reduce(DataFrame.unionByName, (d.select("query_id", F.lit(name).alias("src"), "chunk_id", "score", "rk") for name, d in lists.items()))


def rrf(lists: DataFrame, weights: Mapping[str, float] | None = None, k: int = 0, top_n: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """``query_id``, ``chunk_id``, ``rrf``, ``hits`` (``src#rank``, by rank) and ``rk``; only ranks count.

    0 for ``k`` or ``top_n`` means the default; a list without a weight has weight 1; equal sums go by ``chunk_id``.
    """
    weights = WEIGHTS if weights is None else weights
    weight = F.lit(1.0)
    for name, value in weights.items():
        weight = F.when(F.col("src") == name, F.lit(float(value))).otherwise(weight)
    hit = F.struct("rk", "src", F.concat("src", F.lit("#"), F.col("rk").cast("string")).alias("hit"))
    fused = lists.groupBy("query_id", *by, "chunk_id").agg(
        F.round(F.sum(weight / ((k or DEFAULT.rrf_k) + F.col("rk"))), 9).alias("rrf"),
        F.array_sort(F.collect_list(hit)).alias("hits"),  # one for each list
    )
    order = Window.partitionBy("query_id", *by).orderBy(F.desc("rrf"), "chunk_id")
    return (
        fused.withColumn("hits", F.transform("hits", lambda h: h["hit"]))
        .withColumn("rk", F.row_number().over(order))
        .where(F.col("rk") <= (top_n or DEFAULT.top_n))
    )


def combinations_fused(lists: DataFrame, top_n: int = 0) -> DataFrame:
    """``rrf`` for each combination of retrievers, with the column ``combo``; a single list keeps its own order."""
    spark = lists.sparkSession
    rows = spark.createDataFrame([("+".join(c), s) for c in COMBINATIONS for s in c], "combo string, src string")
    return rrf(lists.join(F.broadcast(rows), "src"), top_n=top_n, by=("combo",))  # 12 rows


def agreement(single: DataFrame, hybrid: DataFrame, n: int = DEFAULT.top_n) -> DataFrame:
    """For each query and list: how many of its first ``n`` the hybrid list has, and how many hybrid ids no list has."""
    first = single.where(F.col("rk") <= n).select("query_id", "src", "chunk_id")
    fused = hybrid.where(F.col("rk") <= n).select("query_id", "chunk_id")
    shared = first.join(fused.withColumn("in_hybrid", F.lit(1)), ["query_id", "chunk_id"], "left")
    lifted = fused.join(first, ["query_id", "chunk_id"], "left_anti").groupBy("query_id").agg(F.count("*").alias("lifted"))
    return (
        shared.groupBy("query_id", "src")
        .agg(F.count("*").alias("n"), F.count("in_hybrid").alias("overlap_hybrid"))
        .join(lifted, "query_id", "left")
        .select("query_id", "src", "n", "overlap_hybrid", F.coalesce("lifted", F.lit(0)).cast("long").alias("lifted"))
    )


def relaxed(filtered: DataFrame, unfiltered: DataFrame, queries: DataFrame) -> DataFrame:
    """Filtered results, and unfiltered ones for the queries that have none; ``was_relaxed`` tells which."""
    empty = queries.select("query_id").join(filtered.select("query_id").distinct(), "query_id", "left_anti")
    return filtered.withColumn("was_relaxed", F.lit(0)).unionByName(unfiltered.join(empty, "query_id", "left_semi").withColumn("was_relaxed", F.lit(1)))


def hit_list(hits: Column) -> Column:
    """Hits as an array, from a text with commas between them."""
    return F.filter(F.transform(F.split(hits, ","), lambda h: F.trim(h)), lambda h: h != "")

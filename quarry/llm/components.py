"""Connected components of a link table: each task contracts the links it holds, then alternating star contraction in DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import checkpointed, joined_by_key


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From links ``v``, ``m`` of one task to a star for each component they form: every node with its smallest one.

    Each pass hangs every root that has a smaller neighbour on it, so that at most half of them are left.
    """
    links = [batch for batch in batches if len(batch)]
    if not links:
        return
    both = pd.concat([batch[c] for c in ("v", "m") for batch in links], ignore_index=True)
    codes, names = pd.factorize(both, sort=True)
    v, m = np.split(codes, 2)
    root = np.arange(len(names))
    while (root[v] != root[m]).any():
        least = np.minimum(root[v], root[m])
        hung = root.copy()
        np.minimum.at(hung, root[v], least)
        np.minimum.at(hung, root[m], least)
        while (hung[hung] != hung).any():
            hung = hung[hung]
        root = hung[root]
    own = np.flatnonzero(root != np.arange(len(names)))
    yield pd.DataFrame({"v": names[own], "m": names[root[own]]})


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Hangs every neighbour larger than a node on the node's smallest neighbour (or itself)."""
    both = edges.union(edges.select("m", "v")).toDF("u", "n")
    least = both.groupBy("u").agg(F.min("n").alias("least"), F.count("*").alias("links"))
    joined = joined_by_key(both.where("n > u"), least, ["u"], 2 * total, "links")
    return joined.select(F.col("n").alias("v"), F.least("u", "least").alias("m")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Hangs a node and its smaller neighbours on the smallest of them; edges come as (larger, smaller)."""
    least = edges.groupBy("v").agg(F.min("m").alias("least"), F.count("*").alias("links"))
    joined = joined_by_key(edges, least, ["v"], total, "links")
    moved = joined.select(F.col("m").alias("v"), F.col("least").alias("m")).where("v > m")
    return moved.union(least.select("v", F.col("least").alias("m"))).distinct()


#: Links of a partition, at least, where there are more than ``LEAST_PARTITIONS``: many empty ones would cost each round.
LINKS, LEAST_PARTITIONS = 250_000, 8


def _gathered(edges: DataFrame, rows: int) -> DataFrame:
    return edges.coalesce(max(LEAST_PARTITIONS, -(-rows // LINKS)))


def _in_rounds(edges: DataFrame, most_rounds: int) -> DataFrame:
    before = None
    for _ in range(most_rounds):
        row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "m"))).first()
        now = (row[0], row[1])
        if now == before or not row[0]:
            return edges
        before = now
        half = checkpointed(_large_star(_gathered(edges, row[0]), row[0]))
        edges = checkpointed(_gathered(_small_star(half, row[0]), row[0]))
    raise RuntimeError("components did not settle")


def connected_components(links: DataFrame, a: str, b: str, most_rounds: int = 60, in_a_task: int = LINKS) -> DataFrame:
    """Columns ``node`` and ``root`` (smallest node reachable) for every node that has a link.

    Links are undirected; loops, repeats and nulls are ignored. First every task contracts about ``in_a_task`` links to
    stars; links that are no more than that are thereby done. Otherwise rounds of star contraction follow: each
    halves path lengths at least, so rounds grow with the logarithm of the longest path; each is cut off by a
    checkpoint. Nodes with very many links meet only in partial aggregates and in joins by broadcast of their one row.
    """
    edges = checkpointed(links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where("v > m"))
    rows = edges.count()
    done = rows <= in_a_task
    dealt = edges if done else edges.distinct()  # by hash, so that tasks get like numbers
    edges = checkpointed(dealt.coalesce(max(1, -(-rows // in_a_task))).mapInPandas(_contracted, edges.schema))
    edges = edges if done else _in_rounds(edges, most_rounds)
    roots = edges.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("m").alias("root")).union(roots)

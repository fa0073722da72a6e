"""Nearest vectors of many queries: products of blocks inside the tasks, the best of each task, then the best of all.

Each task multiplies its vectors by the queries block by block and keeps the best ``k`` for each query; only these, ``k``
rows a task and query, are shuffled. Queries reach the tasks by broadcast, at most ``MOST_BYTES`` of them at once; a larger
table of queries takes several passes over the vectors, each written to the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.library import shared_folder

#: Takes some rows of queries and of vectors, gives a matrix that says which vectors each query may find.
Fits = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]
#: Bytes of query vectors that a pass broadcasts; rows of a block of vectors, and of queries, that are multiplied at once.
MOST_BYTES = 64 << 20
ROWS, QUERIES = 4096, 512


def scores_of(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Larger is nearer; NaN for the cosine with a zero vector."""
    products = queries @ vectors.T
    squares_q, squares_v = np.einsum("ij,ij->i", queries, queries), np.einsum("ij,ij->i", vectors, vectors)
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return products / np.sqrt(squares_q)[:, None] / np.sqrt(squares_v)
    if metric != "l2":
        raise ValueError(f"unknown metric {metric}")
    # differences, not the expanded square, which loses digits where vectors are near
    out = np.empty_like(products)
    for i, q in enumerate(queries):
        gap = vectors - q
        out[i] = -np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def best_places(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest of each row, of equal ones the first; NaN is never chosen."""
    scores = np.where(np.isnan(scores), -np.inf, scores)
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
        row, column = np.nonzero((scores >= least) & (scores > -np.inf))
    else:
        row, column = np.nonzero(scores > -np.inf)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], column[nth < k]


def matrix_of(column: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``size`` numbers without null as doubles, and which rows they are."""
    good = np.array([v is not None and len(v) == size for v in column], bool)
    rows = np.array([np.asarray(v, float) for v in column[good]], float).reshape(int(good.sum()), size)
    good[good] = whole = np.isfinite(rows).all(1)
    return rows[whole], np.flatnonzero(good)


def best_of(found: list[pd.DataFrame], k: int) -> pd.DataFrame | None:
    """The best ``k`` of each query among lists of a task; None if there are none."""
    found = [f for f in found if len(f)]
    if not found:
        return None
    every = pd.concat(found, ignore_index=True).sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True], kind="stable")
    return every[every.groupby("query_id", sort=False).cumcount() < k]


def shape_of(queries: DataFrame, vectors: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, score double"


def usable(queries: DataFrame) -> DataFrame:
    """Queries whose vectors have components, all of them finite."""
    return queries.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))))


def in_passes(asked: DataFrame, most_bytes: int, one: Callable[[pd.DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``one`` makes of the queries, of at most about ``most_bytes`` of vectors at once; more than one pass are written."""
    spark = asked.sparkSession
    total = asked.agg(F.coalesce(F.sum(8 * F.size("vector")), F.lit(0))).first()[0]
    passes = max(1, -(-total // most_bytes))
    if passes == 1:
        return one(asked.toPandas())
    folder, parts = f"{shared_folder(spark)}/nearest-{uuid.uuid4().hex}", []
    for i in range(passes):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).toPandas()
        if len(part):
            one(part).write.parquet(f"{folder}/{i}")
            parts.append(spark.read.parquet(f"{folder}/{i}"))
    return reduce(DataFrame.unionByName, parts)


def _pass(pool: DataFrame, asked: pd.DataFrame, k: int, metric: str, shape: str, fits: Fits | None) -> DataFrame:
    by_size = [(g.drop(columns="vector").reset_index(drop=True), np.stack([np.asarray(v, float) for v in g["vector"]])) for _, g in asked.groupby(asked["vector"].map(len))]
    sent = pool.sparkSession.sparkContext.broadcast(by_size)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for batch in batches:
            batch = batch.sort_values("chunk_id", kind="stable").reset_index(drop=True)
            found = [] if best is None else [best]
            for facts, queries in sent.value:
                vectors, at = matrix_of(batch["embedding"], queries.shape[1])
                rows = batch.iloc[at]
                names, ids = rows["chunk_id"].to_numpy(), facts["query_id"].to_numpy()
                for i in range(0, len(queries), QUERIES):
                    for j in range(0, len(vectors), ROWS):
                        scores = np.round(scores_of(queries[i : i + QUERIES], vectors[j : j + ROWS], metric), 9)
                        if fits is not None:
                            scores[~fits(facts.iloc[i : i + QUERIES], rows.iloc[j : j + ROWS])] = -np.inf
                        row, column = best_places(scores, k)
                        found.append(pd.DataFrame({"query_id": ids[i + row], "chunk_id": names[j + column], "score": scores[row, column]}))
            best = best_of(found, k)
        if best is not None:
            yield best

    return pool.mapInPandas(search, shape)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", most_bytes: int = MOST_BYTES, fits: Fits | None = None) -> DataFrame:
    """``query_id``, ``chunk_id`` and ``score`` of at least the ``k`` nearest vectors of each query: the best of each task.

    ``queries`` has ``query_id`` and ``vector``, ``vectors`` has ``chunk_id`` and ``embedding``. Scores are rounded to nine decimals,
    equal ones go by ``chunk_id``. Null vectors, such with null or non-finite components, of another length than the query's, and for cosines zero
    ones, are near nothing. With ``fits`` both tables keep their further columns for it.
    """
    pool = (vectors if fits else vectors.select("chunk_id", "embedding")).where("embedding is not null")
    asked = usable(queries)
    asked = asked if fits else asked.select("query_id", "vector")
    return in_passes(asked, most_bytes, lambda part: _pass(pool, part, k, metric, shape_of(queries, vectors), fits))

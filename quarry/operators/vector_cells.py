"""A stored vector table in cells around pivots, of which an exact search reads only those that may hold a neighbour.

A cell is a folder of the table. For each the pivot and the least and largest distance to it are known, so that the triangle
inequality bounds how near any of its vectors can be. A search looks into each query's most promising cells first, until they hold
``k`` vectors; the distance of the k-th one found then rules out cells, and the rest are searched. The results are those of
``nearest``; how much is spared depends on how far the vectors cluster.

For cosines distances are those of vectors scaled to length one. Vectors of another length than the pivots' form a cell that is
always searched; null vectors, such with null or non-finite components, and for cosines zero ones are near nothing and not
stored. An empty table has no cells and finds nothing. Ids of queries are unique.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import library, nearest, retrieve

#: Pivots at most, chosen by the least hash of their ids; what reaches the driver and the tasks of a table is their number.
CELLS = 256
#: The cell of vectors of another length.
OTHER = -1
#: Bytes of query vectors of a pass; the driver holds a bound for each of them and each cell.
MOST_BYTES = 16 << 20
#: What rounding may take from a bound.
SLACK = 1e-9


_WRITTEN: dict[tuple[str, str], VectorCells] = {}


@dataclass
class VectorCells:
    """The stored rows (``chunk_id``, ``embedding``, ``radius``, ``cell``), and by cell its number, pivot, least and largest radius and count."""

    rows: DataFrame
    metric: str
    cell: np.ndarray
    pivot: np.ndarray
    least: np.ndarray
    most: np.ndarray
    count: np.ndarray
    others: bool


def _placed(vectors: np.ndarray, metric: str) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1)[:, None] if metric == "cosine" else vectors


def _finite(vectors: DataFrame, metric: str) -> DataFrame:
    good = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select("chunk_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & good)
    return rows.where(F.exists("embedding", lambda x: x != 0)) if metric == "cosine" else rows


def write_cells(vectors: DataFrame, path: str, metric: str = "cosine", cells: int = CELLS) -> None:
    """Writes ``vectors`` (``chunk_id``, ``embedding``) to ``path``; a cell with very many rows is dealt over tasks by radius and id."""
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric}")
    spark, rows = vectors.sparkSession, _finite(vectors, metric)
    chosen = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(cells).toPandas()
    size = int(chosen["embedding"].map(len).mode()[0]) if len(chosen) else 0
    pivots = nearest.matrix_of(chosen["embedding"], size)[0]
    pivots = np.unique(_placed(pivots, metric), axis=0) if len(pivots) else pivots
    sent = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, radius = np.full(len(batch), OTHER), np.zeros(len(batch))
            found, at = nearest.matrix_of(batch["embedding"], sent.value.shape[1])
            if len(at):
                found = _placed(found, metric)
                squares = np.einsum("ij,ij->i", sent.value, sent.value) - 2 * found @ sent.value.T  # but for a term of the row's own
                cell[at] = squares.argmin(axis=1)
                gap = found - sent.value[cell[at]]
                radius[at] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            yield batch.assign(radius=radius, cell=cell.astype("int32"))

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    placed = rows.mapInPandas(assign, f"chunk_id {kind['chunk_id']}, embedding {kind['embedding']}, radius double, cell int")
    placed.repartitionByRange("cell", "radius", "chunk_id").sortWithinPartitions("cell", "chunk_id").write.partitionBy("cell").parquet(f"{path}/rows")
    if not len(pivots):
        facts = []
    else:
        stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
        facts = [(r.cell, pivots[r.cell].tolist() if r.cell != OTHER else [], r.least, r.most, r.n, metric) for r in stored.groupBy("cell").agg(F.min("radius").alias("least"), F.max("radius").alias("most"), F.count("*").alias("n")).collect()]
    shape = "cell int, pivot array<double>, least double, most double, n long, metric string"
    spark.createDataFrame([*facts, (None, None, None, None, None, metric)], shape).coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame([], placed.schema).write.parquet(f"{path}/schema")


def read_cells(spark: SparkSession, path: str) -> VectorCells:
    facts = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    known = [r for r in facts if r.cell is not None and r.cell != OTHER]
    rows = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")
    numbers = (np.array([r[c] for r in known], float) for c in ("least", "most", "n"))
    return VectorCells(rows, facts[0].metric, np.array([r.cell for r in known], int), np.array([r.pivot for r in known], float), *numbers, any(r.cell == OTHER for r in facts))


def cells_of(vectors: DataFrame, source: DataFrame, metric: str = "cosine") -> VectorCells:
    """The stored cells of ``vectors``, which come from the files of ``source``: written by a session's first search, and again when these change."""
    spark = vectors.sparkSession
    key = (spark.sparkContext.applicationId, f"{metric}-{library.state_of(source)}")
    if key not in _WRITTEN:
        path = f"{library.shared_folder(spark)}/cells-{key[0]}-{key[1]}-{uuid.uuid4().hex}"
        write_cells(vectors, path, metric)
        _WRITTEN[key] = read_cells(spark, path)
    return _WRITTEN[key]


def _bounds(queries: np.ndarray, cells: VectorCells) -> tuple[np.ndarray, np.ndarray]:
    """Distances of queries to pivots, and how near a vector of each cell may be."""
    away = -nearest.scores_of(queries, cells.pivot, "l2")
    return away, np.maximum(0, np.maximum(away - cells.most, cells.least - away))


def _first(away: np.ndarray, low: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """For each query its most promising cells that hold ``k`` vectors together."""
    order = np.lexsort((away, low), axis=1)
    before = np.cumsum(count[order], axis=1) - count[order]
    wanted = np.zeros(low.shape, bool)
    np.put_along_axis(wanted, order, before < k, axis=1)
    return wanted


def _within(cells: VectorCells, ids: np.ndarray, queries: np.ndarray, wanted: np.ndarray, k: int, shape: str) -> DataFrame:
    """The best ``k`` of each task and query in the wanted cells; files of other cells are not read."""
    used = np.flatnonzero(wanted.any(axis=0))
    by_cell = {int(cells.cell[c]): np.flatnonzero(wanted[:, c]) for c in used}
    sent, metric = cells.rows.sparkSession.sparkContext.broadcast((ids, queries, by_cell)), cells.metric

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, queries, by_cell = sent.value
        best: pd.DataFrame | None = None
        for batch in batches:
            found = [] if best is None else [best]
            for cell, rows in batch.groupby("cell"):
                rows = rows.sort_values("chunk_id", kind="stable")
                vectors, names = nearest.matrix_of(rows["embedding"], queries.shape[1])[0], rows["chunk_id"].to_numpy()
                for i in range(0, len(by_cell[cell]), nearest.QUERIES):
                    asked = by_cell[cell][i : i + nearest.QUERIES]
                    scores = np.round(nearest.scores_of(queries[asked], vectors, metric), 9)
                    row, column = nearest.best_places(scores, k)
                    found.append(pd.DataFrame({"query_id": ids[asked[row]], "chunk_id": names[column], "score": scores[row, column]}))
            best = nearest.best_of(found, k)
        if best is not None:
            yield best

    return cells.rows.where(F.col("cell").isin(list(by_cell))).select("chunk_id", "embedding", "cell").mapInPandas(search, shape)


def _kth(found: DataFrame, k: int) -> dict:
    """The k-th best score of each query that has so many."""
    return {r.query_id: r.score for r in retrieve.ranked(found, k).where(F.col("rk") == k).collect()}


def nearest_in_cells(queries: DataFrame, cells: VectorCells, k: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """As ``nearest.nearest`` over the stored vectors: at least the ``k`` nearest of each query, equal scores by ``chunk_id``."""
    shape, size = nearest.shape_of(queries, cells.rows), cells.pivot.shape[-1] if len(cells.pivot) else 0
    asked = nearest.usable(queries).select("query_id", "vector")

    def one(part: pd.DataFrame) -> DataFrame:
        matrix, at = nearest.matrix_of(part["vector"], size)
        if cells.metric == "cosine":
            at, matrix = at[matrix.any(axis=1)], matrix[matrix.any(axis=1)]
        if not size or not len(at):
            return cells.rows.sparkSession.createDataFrame([], shape)
        ids = part["query_id"].to_numpy()[at]
        away, low = _bounds(_placed(matrix, cells.metric), cells)
        first = _first(away, low, cells.count, k)
        near = library.kept(_within(cells, ids, matrix, first, k, shape), "cells")
        kth = _kth(near, k)
        score = np.array([kth.get(i, -np.inf) for i in ids.tolist()], float)
        reach = np.sqrt(np.maximum(0, 2 - 2 * (score - SLACK))) if cells.metric == "cosine" else -score + SLACK
        return near.unionByName(_within(cells, ids, matrix, (low <= (reach + SLACK * (1 + reach))[:, None]) & ~first, k, shape))

    found = nearest.in_passes(asked, most_bytes, one)
    if cells.others:
        found = found.unionByName(nearest.nearest(queries, cells.rows.where(F.col("cell") == OTHER), k, cells.metric, most_bytes))
    return found

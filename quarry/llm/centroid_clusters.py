"""Clusters of integer vectors around centroids (k-means), found through a vantage-point tree over the centroids.

Each round builds a tree over the centroids on the driver, broadcasts it, and assigns every vector to its nearest
centroid by a best-first search of its own: the node with the least possible distance comes first, a node is passed
over only if that bound lies beyond the best distance found (a bound equal to it is not, since a tie may go to a
smaller number), and distances are exact integers. A batch of vectors goes down the tree together, each in its own
order. Tasks return one sum for each centroid; centroids, the tree and these sums are all that the driver sees.

Defined results: vectors of another length, null ones and such with null or non-finite components are left out;
equal vectors are all kept and get the same centroid; a null id counts as an empty one where the first centroids are
chosen, equal ids go by their vectors; with fewer vectors than centroids there are as many centroids as vectors, with none the
result is empty; ties go to the smaller number; a component of more than ``LARGEST`` in size after scaling is an
error, since squared distances would leave a long. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import written

#: Integer components are at most so large: squared distances of 64 of them fit in a long.
LARGEST = 1 << 27
#: Centroids of a leaf at most, vectors of a batch that share one matrix of bounds.
LEAF, BLOCK = 4, 4096


@dataclass
class VantageTree:
    """Nodes in arrays. A node has its own centroid, the vantage point, or, as a leaf, a few of them.

    ``near[i]`` and ``far[i]`` bound the distances from the parent's vantage point to all centroids under node ``i``.
    """

    points: np.ndarray
    members: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    near: list[float] = field(default_factory=list)
    far: list[float] = field(default_factory=list)

    @classmethod
    def over(cls, points: np.ndarray) -> VantageTree:
        tree = cls(points)
        tree._grow(np.arange(len(points)), 0.0, 0.0)
        return tree

    def _grow(self, numbers: np.ndarray, near: float, far: float) -> int:
        node = len(self.members)
        self.members.append(numbers if len(numbers) <= LEAF else numbers[:1])
        self.children.append([])
        self.near.append(near)
        self.far.append(far)
        if len(numbers) > LEAF:
            rest = numbers[1:]
            distances = np.sqrt(squared(self.points[rest], self.points[numbers[0]]).astype(float))
            order = np.argsort(distances, kind="stable")
            for half in np.array_split(order, 2):
                self.children[node].append(self._grow(rest[np.sort(half)], distances[half].min(), distances[half].max()))
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of its nearest centroid (the smallest of equally near ones) and the squared distance."""
        number, distance = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
        for start in range(0, len(vectors), BLOCK):
            part = slice(start, start + BLOCK)
            number[part], distance[part] = self._search(vectors[part])
        return number, distance

    def _search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number, best = np.full(len(rows), len(self.points)), np.full(len(rows), np.iinfo(np.int64).max)
        bounds = np.full((len(rows), len(self.members)), np.inf)  # of nodes that wait; infinite for all others
        bounds[:, 0] = 0
        active = np.arange(len(rows))
        while len(active):
            first = bounds[active].argmin(1)
            bound = bounds[active, first]
            going = bound <= np.sqrt(best[active].astype(float)) * (1 + 2.0**-50)  # inclusive; waiting nodes have finite bounds
            active, first, bound = active[going], first[going], bound[going]
            bounds[active, first] = np.inf
            for node in np.unique(first):
                at = active[first == node]
                for c in self.members[node]:
                    d = squared(rows[at], self.points[c])
                    better = (d < best[at]) | ((d == best[at]) & (c < number[at]))
                    number[at[better]], best[at[better]] = c, d[better]
                if self.children[node]:  # ``d`` is the distance to the vantage point
                    root, under = np.sqrt(d.astype(float)), bound[first == node]
                    for child in self.children[node]:
                        least = np.maximum(root - self.far[child], self.near[child] - root)
                        slack = 2.0**-50 * (root + self.far[child])  # more than all roundings together
                        bounds[at, child] = np.maximum(under, least - slack)
        return number, best


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to an integer point, exactly."""
    gap = rows - point
    return np.einsum("ij,ij->i", gap, gap)


def scaled(vector: Column, factor: int = 1024) -> Column:
    """Components as floor(factor * x), as integers; an error beyond ``LARGEST``."""
    exact = lambda x: F.floor(x.cast("double") * factor).cast("int")
    text = f"a component is larger than {LARGEST} after scaling"
    return F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) * factor > LARGEST, F.raise_error(F.lit(text)).cast("int")).otherwise(exact(x)))


def whole_vectors(vectors: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """``key`` and ``v``, integers, of the vectors with ``size`` components, all of them numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) == size) & finite).select(F.col(key).alias("key"), scaled(F.col(vector)).alias("v"))


def _matrix(batch: pd.Series) -> np.ndarray:
    return np.stack(batch.to_numpy()).astype(np.int64)


def _sums(rows: DataFrame, tree: object, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and componentwise sums of the vectors nearest to each centroid: one row a task and centroid, then one a centroid."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            if len(batch):
                v = _matrix(batch["v"])
                number, _ = tree.value.nearest(v)
                counts += np.bincount(number, minlength=k)
                np.add.at(sums, number, v)
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"number": some, "n": counts[some], "sums": pd.Series(list(sums[some]), dtype=object)})

    each = rows.select("v").mapInPandas(partial, "number long, n long, sums array<long>")
    total = each.groupBy("number").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(size))).alias("sums"))
    counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
    for r in total.collect():  # at most one row a centroid
        counts[r["number"]], sums[r["number"]] = r["n"], r["sums"]
    return counts, sums


def clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """``key``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of each whole vector.

    Centroids start as the ``k`` vectors with the least sha256 of ``seed:key``; each of ``rounds`` rounds puts every
    non-empty one at the floor of its vectors' mean. Integer vectors are written once and read in each round.
    """
    spark = vectors.sparkSession
    rows = written(whole_vectors(vectors, key, vector, size), "integer-vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    first = rows.select(name.alias("hash"), "v").orderBy("hash", "v").limit(k).collect()
    points = np.array([r["v"] for r in first], np.int64).reshape(len(first), size)
    shape = "key {}, cluster int, distance long".format(rows.schema["key"].dataType.simpleString())
    if len(points):
        for _ in range(rounds):
            tree = spark.sparkContext.broadcast(VantageTree.over(points))
            counts, sums = _sums(rows, tree, len(points), size)
            tree.unpersist()
            some = counts > 0
            points = points.copy()
            points[some] = sums[some] // counts[some, None]
        last = spark.sparkContext.broadcast(VantageTree.over(points))

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                number, distance = last.value.nearest(_matrix(batch["v"]))
                yield pd.DataFrame({"key": batch["key"], "cluster": number, "distance": distance})

    found = written(rows.mapInPandas(assigned, shape) if len(points) else rows.where(F.lit(False)).select("key", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "clusters")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = [(c, hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for c, p in enumerate(points.tolist())]
    ends = spark.createDataFrame(digests, "cluster int, centroid_sha256 string").join(sums, "cluster", "left")
    ends = ends.crossJoin(sums.agg(F.sum("cluster_inertia").alias("inertia")))  # one row
    return found.join(F.broadcast(ends), "cluster").select(  # ``k`` rows are broadcast
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )

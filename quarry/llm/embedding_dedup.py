"""Near duplicates among embeddings: int8 tile products with error bounds, exact recomputation near the threshold.

Equal vectors form one class first, so that large groups of copies cost no more than one vector. Classes are dealt
over cells, each of the vectors nearest to one pivot, and cells over tiles of bounded size. Of a pair of tiles each
side ships, as int8 values with scale and error, the vectors that can have a link in the other's cell: by the
triangle inequality of angles those no further from its pivot than its radius and the threshold's angle.

For unit vectors x = s q + e with |e| = err, the product of two differs from the quantised one by at most
err_x + err_y + err_x err_y. Pairs whose quantised product less that bound reaches the threshold are links; only vectors
with a pair for which the bound leaves it open are fetched whole, and those pairs computed again in double precision.
A task returns link counts and a spanning forest, never its pairs.

No link is missed. Where vectors lie in clusters, most pairs of tiles stay empty; where they point everywhere alike, no
pivot tells any apart, and the work and what is shipped grow with the square of the distinct vectors (over the
tile's size). The rows in memory and in any one group do not grow.

Defined results: a vector that is null, empty, zero, or holds a null or a component that is not finite links
with nothing; vectors of different lengths do not link; rows with equal ids are taken as one vector, with the
links of all of them; a row with a null id takes no part (no links, null component, not kept); an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected_components
from quarry.llm.shared import checkpointed, joined_by_key

#: Distinct vectors of a tile, at most about; pivots, at most, which are the first vectors by hash.
TILE, PIVOTS = 16_384, 256
#: Rows of two tiles multiplied at once, and pairs recomputed at once.
ROWS, PAIRS = 512, 1 << 14
#: Covers what double and single precision lose in bounds, products and angles.
SLACK = 1e-6


def _usable(vector: Column) -> Column:
    size = lambda x: F.abs(x.cast("double"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (size(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: size(x) > 0), F.lit(False))


def _packed(kind: str):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "full": [np.asarray(v, kind).tobytes() for v in batch["vector"]]})

    return pack


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales and error norms of the rows of ``unit``, which have length 1."""
    scale = np.abs(unit).max(axis=1) / 127
    values = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - scale[:, None] * values, axis=1)
    return values.astype(np.int8), scale, error


def _units(full: Sequence[bytes], kind: str) -> np.ndarray:
    """Rows of length 1 from the bytes of vectors of one size."""
    rows = np.frombuffer(b"".join(full), kind).reshape(len(full), -1).astype(np.float64)
    rows /= np.abs(rows).max(axis=1)[:, None]  # first, so that squares neither overflow nor vanish
    return rows / np.linalg.norm(rows, axis=1)[:, None]


class Tile:
    """Quantised rows in order of their scales, so that the rows of a block have nearly the same; ``unit`` where they came whole."""

    def __init__(self, rows: pd.DataFrame, kind: str | None = None) -> None:
        if kind:
            self.unit = _units(rows["full"].tolist(), kind)
            values, scale, error = quantised(self.unit)
        else:
            values = np.frombuffer(b"".join(rows["q"]), np.int8).reshape(len(rows), -1)
            scale, error = rows["scale"].to_numpy(float), rows["error"].to_numpy(float)
        order = np.argsort(scale, kind="stable")
        self.scale, self.error = scale[order], error[order]
        # products of int8 values are exact in single precision up to 1040 components, in double far beyond
        self.values = values[order].astype(np.float32 if values.shape[1] <= 1040 else np.float64)
        if kind:
            self.unit = self.unit[order]
        self.ids, self.marks, self.weight = (rows[c].to_numpy(np.int64)[order] for c in ("id", "mark", "copies"))


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j, pair by pair; afterwards every entry of ``root`` is a root."""
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return
        np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (up := root[root] != root).any():
            root[up] = root[root[up]]


def tile_links(a: Tile, b: Tile | None, threshold: float) -> pd.DataFrame:
    """Links between two tiles, or within one: ``id``, ``mark``, ``links`` (counting copies), ``root`` in a forest, ``unsure``.

    From quantised rows come the links that are sure, and which rows have pairs that are not; from whole rows come the
    links among the latter pairs.
    """
    exact = hasattr(a, "unit")
    other = a if b is None else b
    shift = 0 if b is None else len(a.ids)
    ids, marks, weight = (x if b is None else np.concatenate([x, y]) for x, y in ((a.ids, other.ids), (a.marks, other.marks), (a.weight, other.weight)))
    root, links, unsure = np.arange(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    starts = [(x, y) for x in range(0, len(a.ids), ROWS) for y in range(0, len(other.ids), ROWS) if b is not None or x <= y]
    for x, y in starts:
        left, right = slice(x, x + ROWS), slice(y, y + ROWS)
        product = a.values[left] @ other.values[right].T
        error, across = a.error[left], other.error[right]
        widest = error.max() + across.max() + error.max() * across.max() + SLACK
        largest = a.scale[left].max() * other.scale[right].max()
        least = (threshold - widest) / largest if threshold > widest else -np.inf
        i, j = np.divmod(np.flatnonzero(product >= least), product.shape[1])
        i, j, close = i + x, j + y, product[i, j].astype(np.float64)
        if b is None:
            i, j, close = (v[i < j] for v in (i, j, close))
        close = close * (a.scale[i] * other.scale[j])
        bound = a.error[i] + other.error[j] + a.error[i] * other.error[j] + SLACK
        sure = close - bound >= threshold
        open_ = ~sure & (close + bound >= threshold)
        if exact:
            p, q = i[open_], j[open_]
            parts = [(p[at : at + PAIRS], q[at : at + PAIRS]) for at in range(0, len(p), PAIRS)]
            found = [np.einsum("ij,ij->i", a.unit[p], other.unit[q]) >= threshold for p, q in parts]
            linked = np.concatenate(found) if found else np.zeros(0, bool)
            p, q = p[linked], q[linked] + shift
        else:
            unsure[i[open_]] = unsure[j[open_] + shift] = True
            p, q = i[sure], j[sure] + shift
        np.add.at(links, p, weight[q])
        np.add.at(links, q, weight[p])
        _merge(root, p, q)
    return pd.DataFrame({"id": ids, "mark": marks, "links": links, "root": ids[root], "unsure": unsure})[(links > 0) | unsure]


@dataclass
class Layout:
    """Pivots by vector size (rows of length 1), radius of each cell, and the number of its first tile and of its tiles."""

    pivots: dict[int, np.ndarray]
    radius: dict[int, np.ndarray] = field(default_factory=dict)
    first: dict[int, np.ndarray] = field(default_factory=dict)
    tiles: dict[int, np.ndarray] = field(default_factory=dict)

    def angles(self, unit: np.ndarray, size: int) -> np.ndarray:
        pivots = self.pivots.get(size)
        if pivots is None:  # a size of which there is no pivot has one cell
            return np.zeros((len(unit), 1))
        return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _layout(classes: DataFrame, kind: str, tile: int) -> Layout:
    """Pivots from the first vectors in order of their hash, then the radius and tiles of their cells, counted over all."""
    most = max(1, min(PIVOTS, -(-classes.count() // tile)))
    chosen = classes.orderBy("mark", "id").limit(most).select("size", "full").toPandas() if most > 1 else pd.DataFrame({"size": [], "full": []})
    layout = Layout({int(size): _units(part["full"].tolist(), kind) for size, part in chosen.groupby("size")})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                angles = layout.angles(_units(part["full"].tolist(), kind), int(size))
                cell = angles.argmin(axis=1)
                yield pd.DataFrame({"size": size, "cell": cell, "angle": angles[np.arange(len(part)), cell]})

    cells = classes.select("size", "full").mapInPandas(place, "size int, cell int, angle double").groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    for size, part in cells.toPandas().groupby("size"):
        n, radius = np.zeros(int(part["cell"].max()) + 1, np.int64), np.full(int(part["cell"].max()) + 1, -np.inf)
        n[part["cell"]], radius[part["cell"]] = part["n"], part["radius"]
        layout.radius[int(size)], layout.tiles[int(size)] = radius, -(-n // tile)
        layout.first[int(size)] = np.cumsum(layout.tiles[int(size)]) - layout.tiles[int(size)]
    return layout


def _shipped(layout: Layout, kind: str, threshold: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """From classes to their quantised rows with their tile and the other tiles in which they can have links."""
    reach = np.arccos(np.clip(threshold, -1, 1)) + SLACK

    def ship(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                first, tiles, radius = (x[int(size)] for x in (layout.first, layout.tiles, layout.radius))
                unit = _units(part["full"].tolist(), kind)
                values, scale, error = quantised(unit)
                angles = layout.angles(unit, int(size))
                cell = angles.argmin(axis=1)
                near = angles[:, : len(radius)] <= radius + reach
                others = [np.concatenate([np.arange(first[c], first[c] + tiles[c]) for c in np.flatnonzero(row)]) for row in near]
                tile = first[cell] + (part["mark"].to_numpy(np.int64) ^ part["id"].to_numpy(np.int64)) % tiles[cell]
                yield pd.DataFrame({
                    "size": size, "id": part["id"].to_numpy(), "mark": part["mark"].to_numpy(), "copies": part["copies"].to_numpy(), "tile": tile,
                    "q": [v.tobytes() for v in values], "scale": scale, "error": error, "others": others,
                })

    return ship


def _compared(cell: pd.DataFrame, whole: str | None, threshold: float) -> pd.DataFrame:
    """The links of a pair of tiles, from quantised rows, or from whole ones of kind ``whole``."""
    tiles, low, high = cell["tile"].to_numpy(), cell["low"].iloc[0], cell["high"].iloc[0]
    if low != high and (tiles == tiles[0]).all():
        return pd.DataFrame(columns=[c.split()[0] for c in _FOUND.split(", ")])
    found = tile_links(Tile(cell[tiles == low], whole), None if low == high else Tile(cell[tiles == high], whole), threshold)
    return found.merge(cell[["id", "mark", "tile"]], on=["id", "mark"]).assign(size=cell["size"].iloc[0], low=low, high=high)


_FOUND = "size int, low int, high int, tile int, id long, mark long, links long, root long, unsure boolean"


def embedding_groups(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """One row per row of ``rows``: the id, ``n_links``, ``component_id`` and ``kept``; links have cosine >= ``threshold`` (over 0)."""
    kind = "<f4" if "array<float>" in rows.schema[vector].dataType.simpleString() else "<f8"
    rows = rows.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    usable = rows.where(_usable(F.col("vector")) & F.col("id").isNotNull())
    packed = checkpointed(usable.mapInPandas(_packed(kind), "id long, full binary"))
    classes = checkpointed(
        packed.groupBy("full").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("*", F.xxhash64("full").alias("mark"), F.length("full").alias("size"))
    )
    layout = _layout(classes, kind, tile)
    shipped = classes.mapInPandas(_shipped(layout, kind, threshold), "size int, id long, mark long, copies long, tile int, q binary, scale double, error double, others array<int>")
    cells = shipped.withColumn("other", F.explode("others")).drop("others").withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        return _compared(cell, None, threshold)

    def recompute(cell: pd.DataFrame) -> pd.DataFrame:
        return _compared(cell, kind, threshold)

    first = checkpointed(cells.groupBy("size", "low", "high").applyInPandas(compare, _FOUND))
    unsure = first.where("unsure").select("size", "low", "high", "tile", "id", "mark").join(classes.drop("size"), ["id", "mark"])
    found = checkpointed(first.where("links > 0").union(unsure.groupBy("size", "low", "high").applyInPandas(recompute, _FOUND)).select("id", "links", "root"))
    roots = connected_components(found, "id", "root")
    members = (
        classes.select("full", "id", "copies")
        .join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select("full", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "id").alias("root"), F.col("copies").alias("n"))
    )
    answered = joined_by_key(packed, checkpointed(members), ["full"], packed.count()).select("id", "links", "root")
    alone = rows.where(~_usable(F.col("vector")) | F.col("id").isNull()).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("root"))
    return answered.union(alone).select(
        F.col("id").alias(key),
        F.col("links").alias("n_links"),
        F.col("root").alias("component_id"),
        F.coalesce(F.col("id") == F.col("root"), F.lit(False)).alias("kept"),
    )

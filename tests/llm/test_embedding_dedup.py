import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import embedding_dedup as E


def brute(rows, threshold=0.9):
    """rows: (id, vector or None); returns {id: (links, root)} for distinct ids."""
    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    units = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows if good(v)}
    ids = sorted(units)
    linked = {i: {j for j in ids if j != i and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold} for i in ids}
    root = {}
    for i in ids:
        stack = [i] if i not in root else []
        while stack:
            j = stack.pop()
            if j not in root:
                root[j] = i
                stack += linked[j]
    return {i: (len(linked.get(i, ())), root.get(i, i)) for i, _ in rows}


def vectors(n, seed=0, size=16):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, size))
    for i in range(0, n, 3):
        rows[i] = rows[(i * 7) % n] + rng.normal(size=size) * rng.choice([0, 0.05, 0.12])
    return rows.astype(np.float32)


@pytest.mark.parametrize("tile", [4096, 20])
def test_groups_equal_brute_force(spark, tile):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors(120))]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] + [1.0] * 15), (204, [None] + [1.0] * 15), (205, [float("inf")] * 16)]
    rows += [(206, [1.0] * 8), (207, [1.0] * 8), (208, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "'x' AS links")
    found = {r.vec_id: (r.n_links, r.component_id) for r in E.embedding_groups(df, tile=tile).collect()}
    assert found == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in E.embedding_groups(df, tile=tile).collect())


def test_null_and_repeated_ids_and_no_rows(spark):
    rows = [(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in E.embedding_groups(df).collect()))
    assert found == [(-1, 0, None, False), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False)]
    assert E.embedding_groups(df.limit(0)).count() == 0


def test_quantisation_bound_holds():
    for seed in range(5):
        unit = vectors(60, seed, 32).astype(float)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        q, scale, error = E.quantised(unit)
        close = (q.astype(float) @ q.T.astype(float)) * scale[:, None] * scale
        bound = error[:, None] + error + error[:, None] * error
        assert (np.abs(close - unit @ unit.T) <= bound + 1e-12).all()


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 40), st.integers(0, 10**6), st.sampled_from([0.5, 0.9, 0.99, 0.01]))
def test_tile_links_miss_nothing(n, seed, threshold):
    rows = vectors(n, seed, 6)
    unit = E._units([v.tobytes() for v in rows], "<f4")
    values, scale, error = E.quantised(unit)
    frame = pd.DataFrame({"id": range(n), "mark": 7, "copies": 1, "full": [v.tobytes() for v in rows], "q": [v.tobytes() for v in values], "scale": scale, "error": error})
    links, half = np.zeros(n, int), n // 2
    for low, high in [(slice(0, half), None), (slice(half, n), None), (slice(0, half), slice(half, n))] if half else [(slice(0, n), None)]:
        a, b = E.Tile(frame[low]), None if high is None else E.Tile(frame[high])
        found = E.tile_links(a, b, threshold)
        links[found["id"]] += found["links"]
        open_ = set(found[found["unsure"]]["id"])
        a, b = (None if part is None else frame[part][frame[part]["id"].isin(open_)] for part in (low, high))
        if len(a) and (b is None or len(b)):
            found = E.tile_links(E.Tile(a, "<f4"), None if b is None else E.Tile(b, "<f4"), threshold)
            links[found["id"]] += found["links"]
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1)[:, None]
    products = unit @ unit.T
    sure = np.abs(products - threshold) > 1e-12
    assert (links == ((products >= threshold).sum(axis=1) - 1))[sure.all(axis=1)].all()


@pytest.mark.parametrize("spread", [0.02, 0.12])
def test_clusters_equal_brute_force_and_far_tiles_are_not_met(spark, spread):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 32))
    rows = [(i, [float(x) for x in (centres[i % 30] + spread * np.linalg.norm(centres[i % 30]) * rng.normal(size=32) / np.sqrt(8)).astype(np.float32)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in E.embedding_groups(df, tile=10).collect()}
    assert found == brute(rows)
    full = pd.DataFrame({"id": range(300), "mark": range(300), "copies": 1, "size": 128, "full": [np.array(v, "<f4").tobytes() for _, v in rows]})
    layout = E._layout(spark.createDataFrame(full), "<f4", 10)
    shipped = pd.concat(E._shipped(layout, "<f4", 0.9)([full]))
    tiles = layout.tiles[128].sum()
    assert shipped["others"].map(len).sum() < (0.5 if spread < 0.1 else 1) * 300 * tiles

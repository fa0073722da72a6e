import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import centroid_clusters as C
from quarry.llm import queries as Q


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.integers(0, 50), st.integers(1, 4), st.integers(0, 6), st.integers(0, 10**6))
def test_tree_finds_the_nearest_with_ties(k, n, size, spread, seed):
    rng = np.random.default_rng(seed)
    points, rows = rng.integers(-spread, spread + 1, (k, size)), rng.integers(-spread - 1, spread + 2, (n, size))
    number, distance = C.VantageTree.over(points).nearest(rows)
    every = ((rows[:, None] - points[None]) ** 2).sum(2)
    assert (number == (every.argmin(1) if n else 0)).all() and (distance == every.min(1)).all()


def test_tree_is_exact_for_large_components():
    far = C.LARGEST
    points = np.array([[far, -far], [far - 1, -far], [-far, far], [0, 0], [1, 0], [far, far], [far, far]])
    number, distance = C.VantageTree.over(points).nearest(np.array([[-far, far], [far - 1, -far], [far, far], [0, 1]]))
    assert number.tolist() == [2, 1, 5, 3] and distance.tolist() == [0, 0, 0, 1]


def test_search_passes_over_far_nodes(monkeypatch):
    rng = np.random.default_rng(0)
    points = (rng.integers(0, 4, (512, 1)) * 10_000 + rng.integers(0, 50, (512, 8))).astype(np.int64)
    tree, asked = C.VantageTree.over(points), []
    exact = C.squared
    monkeypatch.setattr(C, "squared", lambda rows, point: asked.append(len(rows)) or exact(rows, point))
    rows = points[:64] + 1
    number, _ = tree.nearest(rows)
    assert (number == ((rows[:, None] - points[None]) ** 2).sum(2).argmin(1)).all()
    assert sum(asked) < 64 * 512 / 2


def brute(rows, k=8, rounds=10, size=64):
    """The contract by plain loops over (id, vector)."""
    ok = lambda v: v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if ok(v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in kept[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in last)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(repr((i, j, d, sum(e for _, m, e in last if m == j), total, sha[j])) for i, j, d in last)


def test_query_equals_loops(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = Q.op12_centroid_clusters(spark, "/root/testdata/sf0.001").collect()
    assert sorted(repr(tuple(r)) for r in found) == brute(rows)


def odd():
    rng = np.random.default_rng(1)
    v = lambda: rng.integers(-3, 4, 64).astype(float).tolist()
    twin = v()
    bad = [None, [], [1.0] * 63, [1.0] * 65, [float("nan")] + [0.0] * 63, [float("inf")] + [0.0] * 63, [-float("inf")] * 64, [None] + [0.0] * 63]
    return [(i, x) for i, x in enumerate(bad)] + [(50, twin)] * 5 + [(51, twin), (None, v()), (None, twin), (52, [0.0] * 64), (52, [1e-9] * 64)] + [(100 + i, v()) for i in range(40)]


@pytest.mark.parametrize("n", [0, 10, 12, 100])
def test_odd_rows(spark, n):
    rows = odd()[:n]
    table = spark.createDataFrame([(i, v, "clash", 0, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int, key string")
    assert sorted(repr(tuple(r)) for r in C.clusters(table).collect()) == brute(rows)


def test_too_large_components_are_an_error(spark):
    table = spark.createDataFrame([(1, [1e9] + [0.0] * 63)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="larger than"):
        C.clusters(table).collect()

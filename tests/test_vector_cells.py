import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import nearest, retrieve, vector_cells

SHAPE = "chunk_id long, embedding array<double>"


def clustered(n, centres, seed=1, size=8):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, size)) * 5
    return (at[rng.integers(0, centres, n)] + rng.normal(size=(n, size)) * 0.1).tolist()


def top(rows, k):
    return {(r.query_id, r.chunk_id, r.score, r.rk) for r in retrieve.ranked(rows, k).collect()}


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("n", [400, 4000])
def test_cells_find_what_all_vectors_hold(spark, tmp_path, metric, n):
    """Clusters, a hot group of copies, ties and odd vectors; also in several passes."""
    rows = list(enumerate(clustered(n, 20))) + [(10**6 + i, [1.0] * 8) for i in range(n // 3)] + [(10**7 + i, [float(x) for x in np.random.default_rng(i).integers(-1, 2, 8)]) for i in range(60)]
    rows += [(-1, None), (-2, [1.0]), (-3, [float("nan")] * 8), (-4, [0.0] * 8), (-5, [None] * 8), (-6, []), (-7, [2.0])]
    vectors = spark.createDataFrame(rows, SHAPE).withColumn("cell", F.lit("clash")).withColumn("radius", F.lit(None).cast("int")).repartition(5)
    asked = [(i, v) for i, v in rows if i % 37 == 0] + [(-8, [1.0] * 8), (-9, [3.0]), (-10, None), (-11, []), (-12, [0.0] * 8), (-13, [1.0, 2.0])]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    vector_cells.write_cells(vectors, str(tmp_path / "v"), metric, cells=40)
    cells = vector_cells.read_cells(spark, str(tmp_path / "v"))
    want = top(nearest.nearest(queries, vectors, 9, metric), 9)
    assert want and top(vector_cells.nearest_in_cells(queries, cells, 9), 9) == want
    if n == 400:
        assert top(vector_cells.nearest_in_cells(queries, cells, 9, most_bytes=500), 9) == want
        assert top(vector_cells.nearest_in_cells(queries, cells, 10_000), 10_000) == top(nearest.nearest(queries, vectors, 10_000, metric), 10_000)


def test_far_cells_are_not_read(spark, tmp_path):
    """Every cell that the bounds rule out is made unreadable: the search doesn't notice, a scan of everything does."""
    rows = list(enumerate(clustered(3000, 12)))
    vectors, queries = spark.createDataFrame(rows, SHAPE), spark.createDataFrame([(1, rows[0][1])], "query_id long, vector array<double>")
    vector_cells.write_cells(vectors, str(tmp_path / "v"), "l2", cells=60)
    cells = vector_cells.read_cells(spark, str(tmp_path / "v"))
    want = top(nearest.nearest(queries, vectors, 5, "l2"), 5)
    low = vector_cells._bounds(np.array([rows[0][1]]), cells)[1][0]
    far = {int(c) for c, b in zip(cells.cell, low, strict=True) if b > -min(w[2] for w in want) + 1e-6}
    assert len(far) > len(cells.cell) / 2
    for c in far:
        for file in (tmp_path / "v" / "rows" / f"cell={c}").glob("*.parquet"):
            file.write_bytes(b"no parquet")
    assert top(vector_cells.nearest_in_cells(queries, cells, 5), 5) == want
    with pytest.raises(Exception, match="(?i)parquet"):
        cells.rows.collect()


def test_empty_tables_and_unknown_metrics(spark, tmp_path):
    empty, queries = spark.createDataFrame([], SHAPE), spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<double>")
    vector_cells.write_cells(empty, str(tmp_path / "e"))
    cells = vector_cells.read_cells(spark, str(tmp_path / "e"))
    assert vector_cells.nearest_in_cells(queries, cells, 3).collect() == []
    vector_cells.write_cells(spark.createDataFrame([(1, [1.0, 2.0])], SHAPE), str(tmp_path / "o"))
    cells = vector_cells.read_cells(spark, str(tmp_path / "o"))
    assert vector_cells.nearest_in_cells(queries.limit(0), cells, 3).collect() == []
    assert [r.chunk_id for r in vector_cells.nearest_in_cells(queries, cells, 3).collect()] == [1]
    with pytest.raises(ValueError, match="metric"):
        vector_cells.write_cells(empty, str(tmp_path / "x"), "cos")

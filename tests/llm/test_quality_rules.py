import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import quality_rules as R
from quarry.llm import queries as Q
from quarry.llm.text_statistics import repeated_words, statistics


def slow_repeated(words, span=8):
    counts = Counter(tuple(words[i : i + span]) for i in range(len(words) - span + 1))
    covered = set()
    for i in range(len(words) - span + 1):
        if counts[tuple(words[i : i + span])] > 1:
            covered |= set(range(i, i + span))
    return len(covered)


def test_statistics_equal_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        assert repeated_words(words) == slow_repeated(words)
    s = statistics("é a#\n\n a\u00a0b\x0b|\n é a#\né a#\n \t")
    assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"]) == (8, 13, 4, 1)
    assert statistics(None)["n_words"] == statistics("")["word_chars"] == 0


def squares(x, centre, covariance):
    z = x - centre
    return np.einsum("ij,jk,ik->i", z, np.linalg.inv(covariance + R.RIDGE * np.eye(x.shape[1])), z)


def slow_estimate(x):
    """The same estimate with plain sorting instead of classes of distance."""
    size = x.shape[1]
    centre = np.median(x, axis=0)
    spread = (np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349
    z = (x - centre) / np.sqrt(spread**2 + R.RIDGE)
    signs = z / np.linalg.norm(z, axis=1)[:, None]
    directions = signs.T @ signs
    directions *= size / np.trace(directions)
    starts = [(centre, np.diag(spread**2)), (x.mean(axis=0), np.cov(x.T, bias=True)), (centre, directions * np.outer(*[np.sqrt(spread**2 + R.RIDGE)] * 2))]

    def step(estimate):
        near = np.argsort(squares(x, *estimate))[: int(np.ceil(R.SHARE * len(x)))]
        return x[near].mean(axis=0), np.cov(x[near].T, bias=True)

    for _ in range(R.TRIALS):
        starts = [step(e) for e in starts]
    best = min(starts, key=lambda e: np.linalg.det(e[1] + R.RIDGE * np.eye(size)))
    for _ in range(R.STEPS):
        best = step(best)
    d = squares(x, *best)
    near = d * 6.346 / np.median(d) <= 16.013  # median and 97.5 % quantile of chi-square with 7 degrees of freedom
    d = squares(x, x[near].mean(axis=0), np.cov(x[near].T, bias=True))
    return np.sqrt(d / np.median(d))


def test_quantiles_of_chi_square():
    for share, value in ((0.5, 6.3458), (0.025, 16.0128), (0.001, 24.3219), (0.0001, 29.8775)):
        assert abs(R.chi_square(share) / value - 1) < 1e-5


def test_result_does_not_depend_on_how_texts_are_dealt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = (sorted(R.judged(docs.repartition(n), least=20).collect()) for n in (1, 7))
    assert one == many


def test_groups_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(R.judged(docs, least=20).collect())
    monkeypatch.setattr(R, "FEW", 0)
    assert sorted(R.judged(docs, least=20).collect()) == want


def test_planted_outliers_in_a_third_of_a_group(spark):
    """A fifth of the rows stands far off together: mean and covariance hide it, the estimate does not."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(1000, 7)) * 1024) / 1024
    x[:200] += 6
    rows = spark.createDataFrame([(*map(float, r), ["all"]) for r in x], ", ".join(f"x{i} double" for i in range(7)) + ", groups array<string>")
    model = R.estimates(rows).first()
    one = spark.createDataFrame([(model.state, model["median"])], "state array<double>, median double")
    d = rows.crossJoin(one).select((R._square() * R.chi_square(0.5) / F.col("median")).alias("d")).toPandas()["d"].to_numpy()
    assert d[:200].min() > R.chi_square(R.TAIL) > d[200:].max()


def test_distances_follow_the_plain_estimate(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 7)) * [1, 0.2, 0.1, 0.1, 0.1, 0.3, 0.05]
    x[:40] += 4
    rows = spark.createDataFrame([(*map(float, r), ["a", "all"]) for r in x], ", ".join(f"x{i} double" for i in range(7)) + ", groups array<string>")
    model = {r.g: r for r in R.estimates(rows).collect()}["all"]
    assert model.n == 600
    one = spark.createDataFrame([(model.state, model["median"])], "state array<double>, median double")
    found = rows.crossJoin(one).select(F.sqrt(R._square() / F.col("median")).alias("d")).toPandas()["d"].to_numpy()
    want = slow_estimate(x)
    assert np.abs(np.log(found / want)).max() < 0.15
    assert found[:40].min() > 2 * found[40:].max()


def test_junk_goes_and_clean_texts_stay(spark):
    found = Q.op7_quality_rules(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {(r.quality, r.kept): r["count"] for r in found.where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert rows.get((1, False), 0) <= 0.01 * rows[1, True]
    assert rows.get((0, True), 0) <= 0.25 * (rows.get((0, False), 0) + rows.get((0, True), 0))
    assert found.count() == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "x", "s"), (None, "w " * 30, "x", None), (4, " ".join(map(str, range(100))), None, "s"), (4, "long " * 100_000, "x", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"g": F.lit(1), "kept": F.lit("clash")})
    found = {(r.doc_id, r.n_words): (r.base_failed, r.kept) for r in R.judged(docs).collect()}
    assert found == {(1, 0): (True, False), (2, 0): (True, False), (None, 30): (True, False), (4, 100): (False, True), (4, 100_000): (True, False)}
    assert R.judged(docs.limit(0)).count() == 0
    assert R.judged(docs.where("text is null")).count() == 1

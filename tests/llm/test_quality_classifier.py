import numpy as np
from pyspark.sql import functions as F

from quarry.llm import quality_classifier as C
from quarry.llm import queries as Q


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    ones = label == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() - 1) / 2) / (ones.sum() * (~ones).sum())


def test_model_learns_steps_and_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 16))
    y = (((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)) | (x[:, 2] > 0.9)).astype(float)
    model = C.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert auc(model.probability(x[3000:]), y[3000:]) > 0.97
    assert auc(C.AdditiveModel(model.base, model.cuts, model.tables).probability(x[3000:]), y[3000:]) < 0.9


def test_degenerate_labels():
    x = np.zeros((5, 16))
    assert np.allclose(C.fit(x, np.ones(5)).probability(x), 6 / 7)
    assert np.allclose(C.fit(x[:0], np.zeros(0)).probability(x), 0.5)


def test_tree_is_the_best_of_four_leaves():
    g, h = np.array([1.0, 1, -3, -3, 2, 2]), np.ones(6)
    leaves = C._tree(g, h)
    assert len(set(leaves[:2])) == len(set(leaves[2:4])) == len(set(leaves[4:])) == 1 and leaves[0] > 0 > leaves[2]


def test_held_out_documents(spark):
    found = Q.op10_quality_classifier(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    data = found.where("held_out").join(labels, "doc_id").toPandas()
    assert auc(data["score"].to_numpy(), data["quality"].to_numpy()) > 0.97
    assert (data[data.quality == 1]["predicted"] == 1).mean() > 0.99
    assert set(found.agg(F.min("score") >= 0, F.max("score") <= 1).first()) == {True}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b c"), (3, "x " * 100_000), (3, "B!! C!!")], "doc_id long, text string").withColumns({"y": F.lit(1), "x": F.lit("clash")})
    labels = spark.createDataFrame([(1, None), (2, 0), (3, 1), (3, 1), (None, 1), (77, 0)], "doc_id long, quality int")
    model = C.learn(docs, labels)
    scores = [r.s for r in docs.select(C.score(F.col("text"), model).alias("s")).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    assert C.learn(docs.limit(0), labels).base == C.learn(docs, labels.limit(0)).base == 0


def slow_fit(x, y, rounds, pair_rounds, pairs):
    """The same boosting by loops over rows; returns the score function's total for each row."""
    n, size = x.shape
    share = (sum(y) + 1) / (n + 2)
    total = [float(np.log(share / (1 - share)))] * n

    def slopes():
        p = [1 / (1 + np.exp(-t)) for t in total]
        return [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p]

    def gain(rows, g, h):
        return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + C.SMOOTH)

    def leaf(rows, g, h):
        return sum(g[i] for i in rows) / (sum(h[i] for i in rows) + C.SMOOTH)

    def binned(j, bins):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))
        return [sum(c <= v for c in cuts) for v in x[:, j]], len(cuts) + 1

    def tree(rows, bins, low, high, g, h, depth):
        best = (gain(rows, g, h) + 1e-9, None)
        for at in range(low + 1, high if depth else low + 1):
            sides = [i for i in rows if bins[i] < at], [i for i in rows if bins[i] >= at]
            found = sum(gain(s, g, h) for s in sides)
            if found > best[0]:
                best = (found, at)
        at = best[1]
        if at is None:
            return dict.fromkeys(rows, leaf(rows, g, h))
        left, right = [i for i in rows if bins[i] < at], [i for i in rows if bins[i] >= at]
        return tree(left, bins, low, at, g, h, depth - 1) | tree(right, bins, at, high, g, h, depth - 1)

    fine = [binned(j, C.BINS) for j in range(size)]
    for _ in range(rounds):
        for bins, count in fine:
            step = tree(list(range(n)), bins, 0, count, *slopes(), 2)
            total = [t + C.RATE * step[i] for i, t in enumerate(total)]

    coarse = [binned(j, C.PAIR_BINS) for j in range(size)]

    def quarters(i, j):
        g, h = slopes()
        whole, best = gain(range(n), g, h), (1e-9, None)
        for a in range(1, coarse[i][1]):
            for b in range(1, coarse[j][1]):
                cells = {}
                for r in range(n):
                    cells.setdefault((coarse[i][0][r] < a, coarse[j][0][r] < b), []).append(r)
                found = sum(gain(c, g, h) for c in cells.values()) - whole
                if found > best[0] + 1e-12:
                    best = (found, {r: leaf(c, g, h) for c in cells.values() for r in c})
        return best

    ranked = sorted((-quarters(i, j)[0], i, j) for i in range(size) for j in range(i + 1, size))[:pairs]
    for _ in range(pair_rounds):
        for _, i, j in ranked:
            step = quarters(i, j)[1]
            total = [t + C.RATE * step[r] for r, t in enumerate(total)]
    return 1 / (1 + np.exp(-np.array(total)))


def test_scores_equal_boosting_by_loops(monkeypatch):
    for name, value in {"ROUNDS": 4, "PAIR_ROUNDS": 3, "PAIRS": 1, "BINS": 6, "PAIR_BINS": 4}.items():
        monkeypatch.setattr(C, name, value)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(80, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = C.fit(x, y)
    assert len(model.pairs) == 1 and np.allclose(model.probability(x), slow_fit(x, y, 4, 3, 1))


def slow_features(text):
    data = (text or "").encode()
    words = [w for w in data.replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
    if not words:
        return [0.0] * 16
    n, size = len(words), sum(len(w) for w in words)
    share = lambda signs: sum(data.count(bytes([s])) for s in signs) / size
    lines = [x for x in data.split(b"\n") if x]
    return [
        np.log1p(n), size / n, share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"), share(b"#*$%&<>^~=_{}[]\\@"), share(b"!?"), share(b"|"), share(b".:;"), share(b","),
        np.log1p(len(data) / len(lines)), len(set(words)) / n**0.8, max(words.count(w) for w in words) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(set(lines)) / len(lines), sum(len(w) <= 2 for w in words) / n, sum(len(w) >= 12 for w in words) / n,
    ]


def test_features_equal_plain_counts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in [*texts, None, "", " \n\t", "a a b\n\nA,B! 12|#", "é é ßß"]:
        assert np.allclose(C.features(t), slow_features(t))


def test_the_bound_holds_for_joined_rows(spark):
    docs = spark.createDataFrame([(7, f"text {i % 300} of one id") for i in range(600)] + [(8, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0), *((1000 + i, 1) for i in range(200))], "doc_id long, quality int")
    assert C.labelled(docs, labels, "text", "doc_id", "quality", 50).count() == 50
    every = C.labelled(docs, labels, "text", "doc_id", "quality", 10_000)
    assert every.count() == 301 and every.where("y = 0").count() == 1

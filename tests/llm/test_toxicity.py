import numpy as np
from pyspark.sql import functions as F

from quarry.llm import queries as Q
from quarry.llm import toxicity as T
from tests.llm.test_quality_classifier import auc

SF = "/root/testdata/sf0.1"


def test_terms_are_words_and_beginnings():
    assert list(T.terms("Go go GO!")) == list(T.terms("go")) and len(T.terms("go")) == 1
    assert len(T.terms("idiots")) == 2 and set(T.terms("idiots")) & set(T.terms("idiotic"))
    assert not len(T.terms(None)) and not len(T.terms(" .,! "))


def test_total_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = T.FactorizationMachine(0.3, np.arange(0, 40, 4), rng.normal(size=10), rng.normal(size=(10, 3)))
    at = m.rows(np.array([0, 3, 8, 9, 36, 50]))
    assert at.tolist() == [0, 2, 9]
    pairs = sum(m.factors[a] @ m.factors[b] for i, a in enumerate(at) for b in at[i + 1 :])
    assert np.isclose(m.total(at), 0.3 + m.weights[at].sum() + pairs)
    assert T.FactorizationMachine(0.3, np.zeros(0, int), np.zeros(0), np.zeros((0, 3))).total(m.rows(np.array([7]))[:0]) == 0.3


def test_pairs_learn_what_weights_miss():
    rng = np.random.default_rng(2)
    insults, groups = [f"insult{i}" for i in "abcd"], [f"group{i}" for i in "abcd"]
    texts, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        words = [f"w{i}" for i in rng.integers(0, 300, 20)] + [rng.choice(insults)] * int(a) + [rng.choice(groups)] * int(b)
        texts.append(T.terms(" ".join(rng.permutation(words))))
        y.append(float(a and b))
    y = np.array(y)
    m = T.fit(texts[:2000], y[:2000])
    plain = T.FactorizationMachine(m.base, m.buckets, m.weights, 0 * m.factors)
    right = lambda model: np.mean([(model.total(model.rows(t)) > 0) == v for t, v in zip(texts[2000:], y[2000:])])
    assert right(m) > 0.99
    # one insult without a group, and one group without an insult, are clean; together they are not
    alone, both = (m.total(m.rows(T.terms(x))) for x in ("insulta w1", "insulta groupb w1"))
    assert alone < 0 < both and right(m) >= right(plain)


def test_degenerate_labels():
    t = [T.terms("a b")] * 5
    assert np.isclose(T.fit(t, np.ones(5)).probability("a"), 6 / 7) and np.isclose(T.fit([], np.zeros(0)).probability(None), 0.5)


def test_held_out_documents(spark):
    found = Q.op11_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    data = found.where("held_out").join(labels, "doc_id").toPandas()
    assert auc(data["score"].to_numpy(), data["toxic"].to_numpy()) > 0.95
    toxic = data["toxic"] == 1
    assert (data[toxic]["predicted"] == 1).mean() > 0.85 and (data[~toxic]["predicted"] == 1).mean() < 0.01
    every = found.agg(F.min("score") >= 0, F.max("score") <= 1, F.count("*") == F.count("score")).first()
    assert set(every) == {True}


def test_held_out_labels_are_not_read(spark, tmp_path):
    for name in ("documents", "labels"):
        rows = spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
        if name == "labels":
            held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
            rows = rows.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    one, two = (sorted(map(tuple, Q.op11_toxicity(spark, d).collect())) for d in ("/root/testdata/sf0.01", str(tmp_path)))
    assert one == two


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b c"), (3, "x " * 100_000), (3, "you idiot")], "doc_id long, text string").withColumns({"y": F.lit(1), "x": F.lit("clash"), "toxic": F.lit(1)})
    labels = spark.createDataFrame([(1, None), (2, 0), (3, 1), (3, 1), (3, 0), (None, 1), (77, 0)], "doc_id long, toxic int")
    model = T.learn(docs, labels)
    scores = [r.s for r in docs.select(T.score(F.col("text"), model).alias("s")).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    assert T.learn(docs.limit(0), labels).base == T.learn(docs, labels.limit(0)).base == 0
    assert docs.limit(0).select(T.score(F.col("text"), model)).count() == 0

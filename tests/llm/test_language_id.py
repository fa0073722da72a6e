import collections
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import language_id as L
from quarry.llm import queries as Q


def slow_counts(text):
    padded = re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")
    found = collections.Counter()
    for n in (1, 2, 3):
        for gram in (padded[i : i + n] for i in range(len(padded) - n + 1)):
            if gram != " ":
                code = 0
                for c in gram:
                    code = code << 21 | ord(c)
                found[code] += 1
    return found


@pytest.mark.parametrize("block", [1 << 20, 7, 3])
def test_counts_equal_brute_force(monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    for text in ("Hello, wörld 42 abc", "a", "", "  x  y", "日本語 テキスト", "ab" * 40):
        codes, counts = L.gram_counts(text)
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == slow_counts(text)


def test_learning_counts_every_text_and_ranks_ties_by_code(spark):
    rows = [("x", "abab ab"), ("x", "ba"), ("y", "zz zz"), (None, "qq"), ("y", None)]
    profiles = L.learn(spark.createDataFrame(rows, "lang string, text string"), length=5)
    want = slow_counts("abab ab") + slow_counts("ba")
    best = sorted(want, key=lambda c: (-want[c], c))[:5]
    at = profiles.languages.index("x")
    got = sorted((r, c) for c, r in zip(profiles.codes.tolist(), profiles.ranks[at].tolist(), strict=True) if r >= 0)
    assert [c for _, c in got] == best
    assert profiles.languages == ["x", "y"]


def test_texts_without_letters_and_without_a_model(spark):
    profiles = L.learn(spark.createDataFrame([("x", "hello there")], "lang string, text string"))
    rows = spark.createDataFrame([(None,), ("",), ("123 %%",), ("hello",), ("hello " * 50_000,)], "text string").withColumn("lang", F.lit("clash"))
    found = [(r.p.lang_pred, 0 <= r.p.score <= 1) for r in rows.select(L.predicted(F.col("text"), profiles).alias("p")).collect()]
    assert found == [("und", True)] * 3 + [("x", True)] * 2
    empty = L.learn(spark.createDataFrame([], "lang string, text string"))
    assert empty.closest("hello") == ("und", 0.0)


def test_held_out_documents_are_recognised(spark):
    found = Q.op3_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = found.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert row[0] > 0.97 and row[1] > 150
    assert found.count() == docs.count()


def slow_ranking(text, length):
    counts, blanked = {}, "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + " ".join(blanked.split(" ")).strip() + " "
    while "  " in padded:
        padded = padded.replace("  ", " ")
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if gram != " ":
                counts[gram] = counts.get(gram, 0) + 1

    def code(gram):
        value = 0
        for c in gram:
            value = value << 21 | ord(c)
        return value << 21 * (3 - len(gram)) if len(gram) > 1 else value

    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:length]


def test_distances_equal_plain_counting(spark):
    docs = [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text and r.lang]
    train, test = docs[::2], docs[1::2]
    frame = spark.createDataFrame(train, "text string, lang string")
    profiles = L.learn(frame, length=150)
    grams = {}
    for lang in sorted({x for _, x in train}):
        counts = {}
        for text, of in train:
            if of == lang:
                codes, n = L.gram_counts(text)
                for c, k in zip(codes.tolist(), n.tolist(), strict=True):
                    counts[c] = counts.get(c, 0) + k
        grams[lang] = {c: i for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c))[:150])}
    for text, _ in test[:60]:
        own = L.ranking(text, 150).tolist()
        assert len(own) == len(slow_ranking(text, 150))
        out = {lang: sum(abs(ranks[c] - i) if c in ranks else 150 for i, c in enumerate(own)) for lang, ranks in grams.items()}
        best = min(sorted(out), key=out.get)
        assert profiles.closest(text) == (best, 1 - out[best] / (150 * len(own)))

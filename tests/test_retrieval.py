import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import evaluation, fuse, index, logs, retrieve
from quarry.plans import hybrid

DOCS = [
    ("a", "apple pie", "apple tart and cream"), ("b", "", "banana bread aaaa"), ("c", "bread", "bread bread banana"),
    ("d", "x", "cream"), ("e", "", "tart"), ("f", "y", ""),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(DOCS, "chunk_id string, title string, body string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def slow_bm25(query):
    tokens = {i: (t.split(), b.split()) for i, t, b in DOCS}
    mean = sum(len(t) + len(b) for t, b in tokens.values()) / len(tokens)
    scores = {}
    for term in query.split():
        df = sum(term in t + b for t, b in tokens.values())
        idf = max(math.log((len(DOCS) - df + 0.5) / (df + 0.5)), 0) or 1e-6
        for i, (t, b) in tokens.items():
            tf = 3 * t.count(term) + b.count(term)
            if tf:
                scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(t) + len(b)) / mean))
    return sorted(((-round(s, 9), i) for i, s in scores.items()))


@pytest.mark.parametrize("query", ["bread", "bread bread", "cream tart bread", "apple", "nothing"])
def test_bm25_by_hand(spark, chunks, query):
    """With a term in half of the chunks (floor of the idf) and a repeated query term."""
    rows = retrieve.keyword(asked(spark, query), chunks).orderBy("rk").collect()
    assert [(-r.score, r.chunk_id) for r in rows] == slow_bm25(query)
    assert [r.rk for r in rows] == list(range(1, len(rows) + 1))


def test_and_match_and_filters(spark, chunks):
    both = retrieve.keyword(asked(spark, "banana bread"), chunks, match="AND")
    assert {r.chunk_id for r in both.collect()} == {"b", "c"}
    some = retrieve.keyword(asked(spark, "bread"), chunks, among=chunks.where("chunk_id = 'b'")).collect()
    whole = {r.chunk_id: r.score for r in retrieve.keyword(asked(spark, "bread"), chunks).collect()}
    assert [(r.chunk_id, r.score) for r in some] == [("b", whole["b"])]
    assert retrieve.allowed(chunks.withColumn("is_toc", F.lit(None).cast("int")), "chunk_id", ["a", "b"], True).count() == 2
    assert retrieve.allowed(chunks, "chunk_id", None).count() == 6


def test_fallback_adds_reciprocal_ranks(spark, chunks):
    rows = {r.chunk_id: r.score for r in retrieve.fallback(asked(spark, "READ read art"), chunks).collect()}
    ranks = {"read": ["c", "b"], "art": ["e", "a"]}
    assert rows == {i: round((2 if w == "read" else 1) / (10 + ranks[w].index(i) + 1), 9) for w in ranks for i in ranks[w]}
    assert retrieve.fallback(asked(spark, "ab"), chunks).count() == 0


def test_fused_ranks_hits_and_ties(spark):
    rows = [(1, "keyword", "p", 1), (1, "semantic", "p", 1), (1, "fallback", "p", 1), (1, "keyword", "q", 2), (1, "semantic", "r", 2)]
    lists = spark.createDataFrame([(q, s, c, 0.0, k) for q, s, c, k in rows], "query_id long, src string, chunk_id string, score double, rk int")
    found = fuse.rrf(lists).orderBy("rk").collect()
    assert found[0].rrf == round(1 / 61 + 1 / 61 + 0.5 / 61, 9)
    assert found[0].hits == ["fallback#1", "keyword#1", "semantic#1"]
    assert [r.chunk_id for r in found] == ["p", "q", "r"]
    zero = fuse.rrf(lists, {"keyword": 0.0}).where("chunk_id = 'q'").first()
    assert (zero.rrf, zero.hits) == (0.0, ["keyword#2"])
    combos = fuse.combinations_fused(lists).where("combo = 'semantic'").orderBy("rk").collect()
    assert [r.chunk_id for r in combos] == ["p", "r"]
    agreed = {r.src: (r.n, r.overlap_hybrid, r.lifted) for r in fuse.agreement(lists, fuse.rrf(lists, top_n=1), 10).collect()}
    assert agreed == {"keyword": (2, 1, 0), "semantic": (2, 1, 0), "fallback": (1, 1, 0)}


def test_search_modes_without_vectors(spark, chunks):
    for mode in ("keyword", "fallback", "hybrid", "unknown"):
        rows = hybrid.search(asked(spark, "bread"), chunks, mode=mode, top_n=1).collect()
        assert [(r.chunk_id, r.rk) for r in rows] == [("c", 1)]


def test_relaxed_filter(spark):
    schema = "query_id long, chunk_id string, score double, rk int"
    some = spark.createDataFrame([(1, "a", 1.0, 1)], schema)
    every = spark.createDataFrame([(1, "b", 1.0, 1), (2, "c", 1.0, 1)], schema)
    rows = fuse.relaxed(some, every, asked(spark, "", "", "")).collect()
    assert sorted((r.query_id, r.chunk_id, r.was_relaxed) for r in rows) == [(1, "a", 0), (2, "c", 1)]


def test_overfetch_filters_late(spark):
    rows = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(20)], "chunk_id long, embedding array<double>")
    query = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    odd = rows.where("chunk_id % 2 = 1")
    assert [r.chunk_id for r in retrieve.semantic(query, rows, 3, among=odd).orderBy("rk").collect()] == [1, 3, 5]
    assert [r.chunk_id for r in retrieve.semantic(query, rows, 2, among=odd, overfetch=1).orderBy("rk").collect()] == [1]
    assert [r.rk for r in retrieve.semantic(query, rows, 3, "l2").orderBy("rk").collect()] == [1, 2, 3]


def test_metrics_grow_with_k_and_count_empty_queries(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "z", 4)], "query_id long, chunk_id string, rk int")
    gold = spark.createDataFrame([(1, "b"), (1, "c"), (2, "z"), (3, "q")], "query_id long, chunk_id string")
    rows = {r.query_id: r for r in evaluation.judged(ranked, gold, spark.range(1, 5).withColumnRenamed("id", "query_id")).collect()}
    assert (rows[1].hit_1, rows[1].hit_3, rows[1].recall_3, rows[1].rr) == (0, 1, 0.5, 0.5)
    assert (rows[2].hit_3, rows[2].hit_5, rows[2].rr) == (0, 1, 0.25)
    assert (rows[3].recall_10, rows[4].recall_10, rows[4].rr) == (0.0, 0.0, 0.0)
    mean = evaluation.means(evaluation.judged(ranked, gold, spark.range(1, 5).withColumnRenamed("id", "query_id"))).first()
    assert mean.mrr == round((0.5 + 0.25) / 4, 6)
    assert evaluation.means(evaluation.judged(ranked, gold, spark.range(0).withColumnRenamed("id", "query_id"))).first().mrr == 0.0


def test_index_percentiles(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 5)], "x double")
    assert tuple(rows.agg(evaluation.upper_median(F.col("x")), evaluation.p95(F.col("x"))).first()) == (3.0, 4.0)


def test_text_functions(spark):
    row = spark.createDataFrame([("aaaaaa bb É4.5",)], "t string").select(
        T.occurrences(F.col("t"), F.lit("aaa")), T.occurrences(F.lit("a"), F.lit("aaa")), T.tokens(F.col("t")), T.grams(F.lit("abcd"), 3), T.grams(F.lit("ab"), 3),
        T.fts_query(F.lit('x "y"')), T.fts_query(F.lit("--")), T.ts_query(F.lit("v 4.5")), T.year_month(F.lit("brief_202504")), T.year_month(F.lit("x")),
        T.title_tail(F.lit("a > b > c")), T.nfc(F.lit("é")), T.occurrences(F.lit(r"a\Eb"), F.lit(r"\E")),
    ).first()
    assert list(row) == [4, 0, ["aaaaaa", "bb", "é4", "5"], ["abc", "bcd"], [], '"x" OR "y"', None, "'v' | '4.5'", "2025-04", "", "c", "é", 1]


def test_vector_functions(spark):
    row = spark.range(1).select(
        V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), V.l2(F.array(F.lit(0.0)), F.array(F.lit(3.0))),
        V.norm(V.hashed_embedding(F.array(F.lit("a"), F.lit("b"), F.lit("a")))), V.norm(V.hashed_embedding(F.array().cast("array<string>"))),
    ).first()
    assert row[0] == pytest.approx(0.5**0.5) and row[1] == 3.0 and row[2] == pytest.approx(1, abs=1e-6) and row[3] == 0.0


def test_plans(spark):
    """A rank with a limit is a top k; filters and columns reach the scan; a search shuffles no bodies before its end."""
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    from quarry.plans import catalogue

    text = catalogue.rownumber_trap(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text or "WindowGroupLimit" in text
    plan = rows.where("l_orderkey = 5").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_orderkey,5)" in plan and "ReadSchema: struct<l_orderkey:bigint>" in plan
    plan = catalogue.knn_cosine_top30(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_grams_of_any_characters(spark):
    texts = ["", "ab", "abc", "aé日b\nc", "a👍🏽bc𝒳", "👍", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.grams(F.col("t"), 3)).collect()]
    assert got == [[t[i : i + 3] for i in range(len(t) - 2)] for t in (t or "" for t in texts)]


def test_percentiles_of_large_groups_equal_those_by_index(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, -3.5, rng.random() * 1000, 7.0])) for _ in range(3000)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "mode string, latency_ms double")
    got = {r["mode"]: (r.n, r.p50, r.p95) for r in logs.latencies_of_large(df, "mode").collect()}
    want = {}
    for mode in {m for m, v in rows if v is not None}:
        v = sorted(x for m, x in rows if m == mode and x is not None)
        want[mode] = (len(v), v[len(v) // 2], v[min(len(v) - 1, int(len(v) * 0.95))])
    assert got == want


def test_a_mode_that_cannot_search_finds_nothing(spark):
    queries = spark.createDataFrame([(1, "words")], "query_id long, query string")
    chunks = spark.createDataFrame([(7, "title", "some words")], "chunk_id long, title string, body string")
    found = hybrid.search(queries, chunks, mode="semantic")
    assert found.columns == hybrid.search(queries, chunks, mode="keyword").columns and found.count() == 0


def test_a_stored_index_finds_what_a_built_one_finds(spark, chunks, tmp_path):
    path = str(tmp_path / "index")
    index.write_index(chunks, path)
    stored = index.read_index(spark, path)
    queries = asked(spark, "bread banana", "cream tart", "nothing such", "")
    among = chunks.where("chunk_id <> 'c'")
    no_texts = chunks.select("chunk_id")  # the stored index is read in their place

    def rows(found):
        return sorted(map(tuple, found.collect()))

    for some in (None, among):
        for match in ("OR", "AND"):
            assert rows(retrieve.keyword(queries, no_texts, among=some, match=match, stored=stored)) == rows(retrieve.keyword(queries, chunks, among=some, match=match))
        assert rows(retrieve.cover_density(queries, no_texts, among=some, stored=stored)) == rows(retrieve.cover_density(queries, chunks, among=some))
    assert rows(hybrid.search(queries, chunks, stored=stored)) == rows(hybrid.search(queries, chunks))
    assert rows(hybrid.search(queries, no_texts, mode="keyword", stored=stored))


def test_embedding_by_a_model_of_ones_own(spark):
    def load():
        def model(texts):
            assert 0 < len(texts) <= 3
            return [[len(t), t.count("a")] for t in texts]

        return model

    texts = [None, "", "banana", "a" * 100_000] + [f"text {i}" for i in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    found = {r.id: r.v for r in rows.select("id", V.embedding(F.col("text"), load, block=3).alias("v")).collect()}
    assert found == {i: None if t is None else [len(t), t.count("a")] for i, t in enumerate(texts)}
    nulls = spark.createDataFrame([(None,)], "text string").select(V.embedding(F.col("text"), load).alias("v"))
    assert nulls.first().v is None
    assert rows.where("false").select(V.embedding(F.col("text"), load)).count() == 0
    with pytest.raises(Exception, match="the model gave 0 vectors for 1 texts"):
        spark.createDataFrame([("x",)], "text string").select(V.embedding(F.col("text"), lambda: lambda t: [])).collect()

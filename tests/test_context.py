import pytest
from pyspark.sql import functions as F

from quarry.operators import context as C
from quarry.operators import logs, miner

CASES = [
    ("First claim [doc_1#0001]. Second claim [doc_1#0002].", (True, 1.0, [], "pass")), ("One [doc_1#0001]. Two [other#9999].", (False, 1.0, ["other#9999"], "reject")),
    ("No citation at all.", (False, 0.0, [], "retry")), ("Cited [doc_1#0001]. Not cited.", (True, 0.5, [], "retry")), ("", (False, 1.0, [], "pass")),
    ("A first one. [doc_1#0001] Then another. [doc_1#0002]", (True, 0.67, [], "retry")),
]


@pytest.mark.parametrize(("answer", "want"), CASES)
def test_citation_cases(spark, answer, want):
    df = spark.createDataFrame([(answer, ["doc_1#0001", "doc_1#0002"])], "answer string, allowed array<string>")
    r = C.gate(C.citation_report(df)).first()
    assert (r.ok, r.coverage, r.invalid, r.gate) == want


def test_budget_stops_at_the_first_overflow(spark):
    chunks = spark.createDataFrame([(i, "", b) for i, b in ((1, "x" * 5), (2, "y" * 7), (3, "z"))], "chunk_id long, title string, body string")
    ranked = spark.createDataFrame([(1, i, i) for i in (1, 2, 3)] + [(1, 99, 0)], "query_id long, chunk_id long, rk int")
    kept = C.within_budget(ranked, chunks, 24)  # the blocks cost 13, 15 and 9
    assert [r.chunk_id for r in kept.collect()] == [1]
    assert C.within_budget(ranked, chunks, 5).count() == 0
    row = C.context(ranked, chunks, 10_000).first()
    assert row.n_blocks == 3 and row.context.count("\n---\n") == 2 and row.used == len(row.context) - 2 * 5
    assert {r.budget: r.n_blocks for r in C.budget_scan(ranked, chunks, (14, 30, 100)).collect()} == {14: 1, 30: 2, 100: 3}


def test_topics_keep_the_first_and_replace_nothing(spark):
    rows = [(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "c", 2), (2, "d", 6)]
    found = C.collected(spark.createDataFrame(rows, "query_id long, chunk_id string, rk int"), 5)
    assert sorted((r.query_id, r.chunk_id) for r in found.collect()) == [(1, "a"), (1, "b"), (2, "c")]


def test_miner_counts_other_documents(spark):
    docs = spark.createDataFrame([(1, "(well-known) well-known,"), (2, "well-known known"), (3, "Known well"), (4, "well done 3-way")], "doc_id long, text string")
    (row,) = miner.candidates(docs).collect()
    assert (row.word, row.n, row.docs, row.collide, row.worst) == ("well-known", 3, 2, 2, "well")
    known = spark.createDataFrame([("x", True), ("well-known", True)], "word string, accepted boolean")
    assert sorted(map(tuple, miner.upserted(known, miner.candidates(docs)).collect())) == [("well-known", True), ("x", True)]


def test_log_summaries(spark):
    rows = [(i, "a" if i % 2 else "b", i, i % 4, int(i == 3), int(i == 4), None if i == 5 else 0.5) for i in range(1, 8)]
    log = spark.createDataFrame(rows, "id long, mode string, latency_ms long, n_results long, refused int, invalid int, coverage double")
    assert tuple(logs.kpis(log).first()) == (7, round(1 / 7, 6), 1, 0.5)
    assert sorted(map(tuple, logs.latencies(log, "mode").collect())) == sorted(map(tuple, logs.latencies_of_large(log, "mode").collect())) == [("a", 4, 5, 7), ("b", 3, 4, 6)]
    assert [r.id for r in logs.latest(log, 2).collect()] == [7, 6]
    assert logs.poor(log).where(F.col("refused") == 1).count() == 1

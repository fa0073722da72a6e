"""The stored index: what is read of it, and searches through it against plain loops."""

import math
import random
import sys
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import __main__ as cli
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import chunk_table, chunking, evaluation, index, library, nearest, requests, retrieve, substring
from quarry.plans import hybrid

BODIES = ["ab", "a", "", None, "abcabcabc", "ABC abd", "xx ΑΣ ΑΣΒ", "aaaa", "no match here", "the quick brown fox", "ab\nc", "İstanbul", "bc abc"]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, "", b) for i, b in enumerate(BODIES)], "chunk_id long, title string, body string")


@pytest.fixture(scope="module")
def stored(chunks, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    index.write_index(chunks, path, buckets=7, embed=V.hashed_words)
    return index.read_index(spark, path, embed=V.hashed_words)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("case", [False, True])
def test_substrings_of_any_length_are_exact(spark, chunks, stored, case):
    needles = ["", "a", "b", "ab", "abc", "abcabc", "bcabca", "ABC", "c a", "ΑΣ", "ΑΣΒ", "ς", "quick brown", "b\nc", "zzz", "İ", "aaa", "fox ", " "]
    asked = spark.createDataFrame([(n,) for n in needles], "needle string").distinct()
    text = None if case else F.lower("body")
    low = (lambda t: t) if case else str.lower
    want = {(n, i) for n in needles for i, b in enumerate(BODIES) if b is not None and n in low(b)}
    for found in (stored, index.built(chunks)):
        assert {(r.needle, r.chunk_id) for r in substring.containing(asked, found, text).collect()} == want


def test_substring_plans_have_no_nested_loop_and_read_few_buckets(spark, stored):
    asked = spark.createDataFrame([("quick brown",)], "needle string")
    text = plan(substring.containing(asked, stored, least=3))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_a_search_reads_its_buckets_only(spark, chunks, tmp_path):
    """All other buckets are made unreadable: the search doesn't notice, a scan of everything does."""
    path = str(tmp_path / "index")
    index.write_index(chunks, path, buckets=7)
    asked = spark.createDataFrame([(1, "fox")], "query_id long, query string")
    bucket = spark.range(1).select(F.pmod(F.hash(F.lit("fox")), F.lit(7))).first()[0]
    found = index.read_index(spark, path)
    for part in ("postings", "terms"):
        for file in (tmp_path / "index" / part).glob("*.parquet"):
            if f"_{bucket:05d}." not in file.name:
                file.write_bytes(b"no parquet")
    hits = retrieve.term_hits(retrieve.query_terms(asked), found)
    assert "EqualTo(term,fox)" in plan(hits) and [r.chunk_id for r in hits.collect()] == [9]
    with pytest.raises(Exception, match="(?i)parquet"):
        spark.table(index._table(path, "postings")).collect()


def test_joins_on_terms_move_no_postings(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        many = spark.createDataFrame([(f"w{i}",) for i in range(2000)] + [("fox",)], "term string").repartition(7, "term")
        joined = stored.postings.join(many, "term")
        scan = [line for line in plan(joined).splitlines() if "FileScan" in line]
        exchanges = [line for line in plan(joined).splitlines() if "Exchange" in line]
        assert len(scan) == 1 and "Bucketed: true" in scan[0] and len(exchanges) == 1 and joined.count() == 1  # the one of ``many``
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_phrases_by_hand(spark):
    rows = [(1, "new york", "york new york times 4.5"), (2, "new", "york"), (3, "", "4 x 5 and 4, 5"), (4, "a a a", "a a")]
    chunks = spark.createDataFrame(rows, "chunk_id long, title string, body string")
    asked = spark.createDataFrame([(1, '"new york"'), (2, "4.5"), (3, '"a a"'), (4, '"york times" "new york"'), (5, "none.such")], "query_id long, query string")
    phrases = retrieve.query_phrases(asked).collect()
    assert {(r.query_id, tuple(r.phrase)) for r in phrases} == {(1, ("new", "york")), (2, ("4", "5")), (3, ("a", "a")), (4, ("york", "times")), (4, ("new", "york")), (5, ("none", "such"))}
    hits = {(r.query_id, " ".join(r.phrase), r.chunk_id): (r.tf_title, r.tf_body, r.df) for r in retrieve.phrase_hits(retrieve.query_phrases(asked), index.built(chunks)).collect()}
    assert hits == {(1, "new york", 1): (1, 1, 1), (4, "new york", 1): (1, 1, 1), (4, "york times", 1): (0, 1, 1), (2, "4 5", 1): (0, 1, 2), (2, "4 5", 3): (0, 1, 2), (3, "a a", 4): (2, 1, 1)}
    assert {r.chunk_id for r in retrieve.keyword(asked.where("query_id = 4"), chunks, match="AND", phrases=True).collect()} == {1}


def slow_covers(places, terms):
    """Every stretch from a match to a match that has all terms and no shorter one inside."""
    at = sorted((p, t, w) for t in terms for p, w in places.get(t, []))
    whole = [(a[0], b[0]) for a in at for b in at if a[0] <= b[0] and {t for p, t, _ in at if a[0] <= p <= b[0]} == set(terms)]
    least = [s for s in whole if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in whole)]
    total = 0
    for a, b in set(least):
        inverse = [1 / w for p, _, w in at if a <= p <= b]
        total += len(inverse) / sum(inverse) / (1 + (b - a + 1 - len(inverse)))
    return total


def test_covers_equal_every_stretch_tried(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcd", k=rng.randint(0, 4))), " ".join(rng.choices("abcdefg", k=rng.randint(0, 25)))) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id long, title string, body string")
    queries = [(1, "a"), (2, "a b"), (3, "c a b a"), (4, "a zz"), (5, "a b c d e"), (6, "")]
    got = {(r.query_id, r.chunk_id): r.score for r in retrieve.cover_density(spark.createDataFrame(queries, "query_id long, query string"), chunks, 100, match="AND").collect()}
    want = {}
    for q, query in queries:
        for i, title, body in rows:
            t, b = title.split(), body.split()
            places = {}
            for p, w in [*enumerate(t), *((len(t) + 1 + k, w) for k, w in enumerate(b))]:
                places.setdefault(w, []).append((p, 1.0 if p < len(t) else 0.4))
            terms = set(query.split())
            if terms and terms <= set(places):
                want[q, i] = round(slow_covers(places, terms) / (1 + math.log(len(t) + len(b))), 9)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-9) for k in got)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_nearest_equals_all_pairs_with_ties_and_odd_vectors(spark, metric):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 4), (903, [0.0] * 4), (904, [None] * 4)] + [(1000 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(3)
    asked = [(i, v) for i, v in rows[:20]] + [(50, None), (51, []), (52, [2.0])]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    want = set()
    for q, v in asked:
        if not v:
            continue
        scores = []
        for i, e in rows:
            if e is None or len(e) != len(v) or any(x is None or math.isnan(x) for x in e):
                continue
            a, b = np.array(v), np.array(e)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) if metric == "cosine" else -np.sqrt(((a - b) ** 2).sum())
            if not math.isnan(s):
                scores.append((-round(float(s), 9), i))
        want |= {(q, i, n + 1) for n, (_, i) in enumerate(sorted(scores)[:7])}
    for most in (nearest.MOST_BYTES, 200):
        found = retrieve.ranked(nearest.nearest(queries, vectors, 7, metric, most), 7)
        assert {(r.query_id, r.chunk_id, r.rk) for r in found.collect()} == want


def test_analysers(spark):
    words = T.tokens_with_words(["New York", "new", "c++", "york times"])
    row = spark.createDataFrame([("in New York times, new c++ xc++ newt", "Éclair É ﬁ çà Ωμέγα ß", "éa")], "a string, b string, c string").select(
        words(F.col("a")), T.folded_tokens(F.col("b")), T.tokens_with_words([])(F.col("b")), T.tokens_by(lambda: lambda t: [str(len(t)), t[:1]])(F.col("c"))
    ).first()
    assert row[0] == ["in", "new york", "times", "new", "c++", "xc", "newt"]
    assert row[1] == ["eclair", "e", "ﬁ", "ca", "ωμεγα", "ß"] and row[2][0] == "éclair"
    assert row[3] == ["2", unicodedata.normalize("NFC", "é")]


def test_an_index_is_built_once_and_again_when_files_change(spark, tmp_path, monkeypatch):
    built, write = [], index.write_index
    monkeypatch.setattr(index, "write_index", lambda *a, **k: built.append(a[1]) or write(*a, **k))
    path = str(tmp_path / "chunks")
    asked = spark.createDataFrame([(1, "cat")], "query_id long, query string")

    def search():
        rows = spark.read.parquet(path)
        return {r.chunk_id for r in retrieve.keyword(asked, rows, stored=library.index_of(rows, rows, "test")).collect()}

    spark.createDataFrame([(1, "cat", "dog")], "chunk_id long, title string, body string").write.parquet(path)
    assert search() == search() == {1} and len(built) == 1
    spark.createDataFrame([(2, "", "cat")], "chunk_id long, title string, body string").write.mode("append").parquet(path)
    assert search() == {1, 2} and len(built) == 2


def test_requests_are_made_safe(spark):
    rows = [(1, " x ", None, None, [], None), (2, None, "bogus", 0, ["a"], False), (3, "q", "semantic", 99, None, True), (4, "q", "keyword", -3, None, None)]
    got = {r.query_id: tuple(r)[1:] for r in requests.safe(spark.createDataFrame(rows, "query_id int, query string, mode string, top_n int, facets array<string>, exclude_toc boolean")).collect()}
    assert got == {1: ("x", "hybrid", 8, None, True), 2: ("", "hybrid", 8, ["a"], False), 3: ("q", "semantic", 20, None, True), 4: ("q", "keyword", 1, None, True)}


def test_fuzzy_contexts(spark):
    retrieved = spark.createDataFrame([(1, 1, "zzzzzzzz"), (1, 2, "abcdefgx"), (1, 3, "hello world"), (2, 1, "short")], "query_id int, rk int, text string")
    references = spark.createDataFrame([(1, 1, "abcdefgh"), (1, 2, "nothing like"), (2, 1, ""), (3, 1, "x")], "query_id int, ref int, text string")
    got = {r.query_id: (r.recall, r.precision) for r in evaluation.fuzzy_context(retrieved, references, 0.8).collect()}
    assert got == {1: (0.5, 0.5), 2: (0.0, 0.0), 3: (0.0, 0.0)}


def test_misspelt_words_differ_by_one_edit(spark):
    words = ["abcdef", "abc", "ab", "a", "", "aabb", "abba"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(evaluation.misspelt(F.col("w"))).collect()]
    assert got == ["abdcef", "bac", "ba", "a", "", "abab", "aba"]


def test_the_table_function_equals_the_windows(spark):
    texts = ["", None, "## A\n\nshort", "intro text that is long enough to be kept as one chunk\n## T  \n### S\nbody " + "w " * 40 + "\n### S\n" + "x" * 60, "p" * 2000 + "\n\n" + "One sentence here. " * 200 + "\n\n\ntail", "## x\r\nbody " + "q" * 100, "word " * 60_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, md string")
    columns = ["doc_id", "chunk_id", "seq", "title", "body"]
    assert sorted(map(tuple, chunk_table.chunk_table(docs).select(columns).collect())) == sorted(map(tuple, chunking.chunks(docs).select(columns).collect()))


def test_command_line_finds_by_meaning(spark, tmp_path, monkeypatch, capsys):
    rows = [("a#0000", "cats", "cats and dogs"), ("b#0000", "ships", "ships at sea")]
    spark.createDataFrame(rows, "chunk_id string, title string, body string").write.parquet(str(tmp_path / "chunks"))
    hook = "quarry.functions.vectors:hashed_words"
    for arguments in (["index", "chunks", "index", "--embed", hook], ["search", "chunks", "ships sea", "--mode", "semantic", "--index", "index", "--embed", hook, "--top", "1"]):
        monkeypatch.setattr(sys, "argv", ["quarry", arguments[0], *(str(tmp_path / a) if a in ("chunks", "index") and i else a for i, a in enumerate(arguments[1:], 1))])
        cli.main()
    shown = capsys.readouterr().out
    assert "b#0000" in shown and "a#0000" not in shown


def test_modes_through_the_stored_index_equal_those_without(spark, chunks, stored):
    asked = spark.createDataFrame([(1, "quick abc"), (2, "ab"), (3, "nothing")], "query_id long, query string")
    rows = lambda found: sorted(map(tuple, found.collect()))
    for mode in ("keyword", "fallback"):
        assert rows(hybrid.search(asked, chunks, mode=mode, stored=stored)) == rows(hybrid.search(asked, chunks, mode=mode))
    found = hybrid.search(asked, chunks, mode="semantic", stored=stored).collect()
    assert {r.query_id for r in found} == {1, 2, 3} and max(r.score for r in found if r.query_id == 1) > 0.4

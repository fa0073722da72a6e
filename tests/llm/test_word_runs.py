import hashlib
import random
from zlib import crc32

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import queries as Q
from quarry.llm import word_runs as R

SF = "/root/testdata/sf0.01"


def brute(words, least_length=6, least_periods=4):
    """Every maximal stretch for every period; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(words) // least_periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_length, least_periods * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


letters = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40)
repeated = st.builds(lambda a, p, n, b: a + (p * 9)[:n] + b, letters, st.lists(st.sampled_from([b"a", b"b", b"\xc3\xa9"]), min_size=1, max_size=7), st.integers(0, 60), letters)


@settings(max_examples=300, deadline=None)
@given(st.lists(letters | repeated, max_size=5))
def test_runs_equal_brute_force(texts):
    assert R.runs_of(texts) == [brute(t) for t in texts]
    assert R.runs_of(texts, 4, 2) == [brute(t, 4, 2) for t in texts]


def test_long_texts_of_few_words():
    rng = random.Random(3)
    assert R.runs_of([[b"a"] * 300_000]) == [[(0, 300_000, 1)]]
    assert R.runs_of([[b"a", b"b", b"a", b"c"] * 20_000]) == [[(0, 80_000, 4)]]
    words = [b"%d" % rng.randrange(2) for _ in range(3000)]
    assert R.runs_of([words]) == [brute(words)]


def test_peeling_of_rare_words_changes_nothing(monkeypatch):
    rng = random.Random(5)
    texts = [[b"%d" % min(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(400))] + [b"x", b"y"] * rng.randrange(6) for _ in range(40)]
    whole = R.runs_of(texts)
    for passes in (0, 1, 2):
        monkeypatch.setattr(R, "PASSES", passes)
        assert R.runs_of(texts) == whole == [brute(t) for t in texts]


def test_collapsed_keeps_the_first_period():
    words = b"x a b a b a b a b y".split()
    assert R.runs_of([words]) == [[(1, 8, 2)]]
    assert R.collapsed(words, [(1, 8, 2)]) == b"x a b y"
    assert R.collapsed([], []) == b""


def expected(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h, n = crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
    milli = best[1] * 1000 // best[2] if runs else None
    return (len(runs), *best, milli, sha(listed), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark):
    found = {r["doc_id"]: tuple(r)[1:] for r in Q.op13_word_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs) and any(v[0] for v in found.values())
    for doc_id, text in docs:
        if len(text.split()) < 1500:
            assert found[doc_id] == expected(doc_id, text), doc_id


def test_odd_rows(spark, tmp_path):
    same = "a b a b a b a b"
    rows = [(i, t, "clash", "clash") for i, t in enumerate([None, "", " \t\n", "x " * 1200, same, same, "a b a b " * 5, "né " * 6])] + [(None, same, "x", "y"), (4, same, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, key string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = Q.op13_word_runs(spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(r)) for r in found) == sorted(repr((i, *expected(i, t))) if i is not None else repr((i, *plain(t))) for i, t, _, _ in rows)
    kept = {r["doc_id"]: r for r in R.word_runs(docs).collect()}
    assert kept[5]["collapsed"] == "a b" and kept[0]["n_words"] == 0 and kept[3]["runs"][0]["length"] == 1200
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert Q.op13_word_runs(spark, str(tmp_path / "none")).count() == 0


def plain(text):
    """A null id: the text as it is."""
    runs = brute(text.encode().split())
    (a, n, q), = runs
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return 1, a, n, q, 1000 * n // q, sha(f"{a},{n},{q}\n".encode()), sha(b"a b")

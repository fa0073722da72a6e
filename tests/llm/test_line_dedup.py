import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import line_dedup as L
from quarry.llm.queries import OP9_SQL


def chunks(text):
    lines, out, cur = text.split("\n"), [], []
    hashes = [hashlib.md5(x.encode()).hexdigest() for x in lines]
    for i, line in enumerate(lines):
        cur.append(line)
        rolled = hashlib.md5("".join(hashes[max(0, i - L.WINDOW + 1) : i + 1]).encode()).hexdigest()
        if i == len(lines) - 1 or rolled[-1] in L.CUTS:
            out.append(cur)
            cur = []
    return out


def brute(rows):
    seen, out = {}, []
    for place, (i, text) in sorted(enumerate(rows), key=lambda x: x[1][0]):
        if text is None:
            out.append((place, None, 0))
            continue
        kept, removed = [], 0
        for c in chunks(text):
            if len(c) > 1 and seen.setdefault(tuple(c), (i, len(kept) + removed)) != (i, len(kept) + removed):
                removed += 1
            else:
                kept.append("\n".join(c))
        out.append((place, "\n".join(kept), removed))
    return [(t, n) for _, t, n in sorted(out)]


def rows():
    passage = "\n".join(f"shared line {i} of a passage that goes round" for i in range(25))
    found = [(i, f"own start {i}\n" + "\n".join(f"own {i} {j}" for j in range(i % 5)) + ("\n" + passage if i % 3 == 0 else "") + f"\nown end {i}") for i in range(30)]
    return [*found, (30, None), (31, ""), (32, passage), (33, "same\n" * 300), (34, "\n\n"), (35, passage + "\n" + passage)]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").withColumns({"id": F.lit(1), "k": F.lit("clash"), "n_lines": F.lit("replaced")})
    found = L.without_repeated_chunks(docs)
    assert found.columns == ["doc_id", "text", "id", "k", "n_lines", "n_removed_lines", "n_removed_chunks"]
    got = {r.doc_id: (r.text, r.n_removed_chunks) for r in found.collect()}
    assert got == {i: w for (i, _), w in zip(rows(), brute(rows()), strict=True)}
    assert sum(n for _, n in got.values()) > 50
    assert L.without_repeated_chunks(docs.limit(0)).count() == 0


def test_chunks_of_equal_hash_and_other_bytes_are_told_apart(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(L.F, "xxhash64", lambda *c: (real(*c) * 0) if c == ("lines",) else real(*c))
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed_chunks) for r in L.without_repeated_chunks(docs).collect()}
    assert got == {i: w for (i, _), w in zip(rows(), brute(rows()), strict=True)}


def test_rows_equal_in_id_and_text_and_null_ids(spark):
    text = "\n".join(f"line {i} with words" for i in range(20))
    docs = spark.createDataFrame([(None, text), (None, text), (5, text), (5, text), (None, None)], "doc_id long, text string")
    found = sorted(((r.doc_id or 0, r.text or "", r.n_removed_chunks) for r in L.without_repeated_chunks(docs).collect()))
    assert [f[1] == text for f in found] == [False, True, True, False, False]
    assert found[3][2] == found[4][2] > 0
    assert L.shortened(docs).columns == docs.columns


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '/root/testdata/{sf}/documents.parquet'")
    want = sorted(db.execute(f"SELECT doc_id, text, n_lines, n_removed_lines, n_removed_chunks FROM ({OP9_SQL})").fetchall())
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, L.without_repeated_chunks(docs).collect())) == want


def whole_chunks(text):
    lines = text.split("\n")
    hashes = [hashlib.md5(x.encode()).hexdigest() for x in lines]
    out, begin, run = [], 0, 0
    for i in range(1, len(lines) + 1):
        rolled = hashlib.md5("".join(hashes[max(0, i - L.WINDOW) : i]).encode()).hexdigest()
        run = run + 1 if 1 < i < len(lines) - 1 and rolled[-1] in L.CUTS else 0
        if i == len(lines) or run % 2:
            out.append(lines[begin:i])
            begin = i
    return out


def test_of_an_exact_copy_nothing_stays_in_whole_chunks(spark):
    texts = ["\n".join(f"document {i} line {j}" for j in range(n)) for i, n in enumerate([2, 3, 4, 7, 12, 25, 60] * 3)]
    texts += ["one line of few words", "one line of many words " * 12]
    docs = spark.createDataFrame([(i + k, t) for i, t in enumerate(texts) for k in (0, 1000)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.shortened(docs).collect()}
    assert got == dict(enumerate(texts)) | {1021: texts[21]}


def test_whole_chunks_equal_brute_force(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    seen, want = {}, {}
    for i, text in sorted(rows()):
        every = [] if text is None else whole_chunks(text)
        assert all(len(c) > 1 for c in every) or len(every) == 1
        left = ["\n".join(c) for k, c in enumerate(every) if len(c) == 1 or seen.setdefault(tuple(c), (i, k)) == (i, k)]
        if left or text is None:
            want[i] = None if text is None else "\n".join(left)
    assert {r.doc_id: r.text for r in L.shortened(docs).collect()} == want

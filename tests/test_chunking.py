import pytest
from pyspark.sql import functions as F

from quarry.config import Settings, env_file, settings
from quarry.functions import text as T
from quarry.operators import chunking as C


BODIES = [
    "", "one", "a " * 900, "Sentence one here. " * 200, ("p" * 500 + "\n\n") * 6, "x" * 2000, "s" * 100 + "\n\n" + "t" * 39 + "\n\n\n" + "u" * 899, "é! " * 700 + "\n\n" + "end?",
]


def whole_pieces(spark, s):
    df = spark.createDataFrame(list(enumerate(BODIES)), "i int, body string")
    return df.select("i", C.pieces(F.col("body"), s.chunk_max).alias("pieces"), C.split_long(F.col("body"), s).alias("chunks")).collect()


@pytest.mark.parametrize("s", [Settings(), Settings(chunk_target=50, chunk_overlap=7, chunk_max=80)])
def test_chunks_hold_all_pieces_in_order_and_are_as_long_as_the_target_lets_them(spark, s):
    for r in whole_pieces(spark, s):
        at = 0
        for k, chunk in enumerate(r.chunks):
            repeated = r.chunks[k - 1][-s.chunk_overlap :].lstrip() if k else ""
            assert chunk.startswith(repeated)
            held = repeated
            first = at
            while held != chunk:
                piece = r.pieces[at]
                assert at == first or len(held) + len(piece) + 1 <= s.chunk_target  # only a chunk's first piece may go beyond
                held, at = f"{held} {piece}".strip(), at + 1
                assert chunk.startswith(held)
            assert at > first
            assert at == len(r.pieces) or len(chunk) + len(r.pieces[at]) + 1 > s.chunk_target
        assert at == len(r.pieces)


def test_pieces_are_paragraphs_and_sentences_of_long_ones(spark):
    df = spark.createDataFrame([("a b\n\n\n c. d \n\n" + "e. " * 9,)], "t string")
    assert df.select(C.pieces(F.col("t"), 20)).first()[0] == ["a b", "c. d", *["e."] * 9]


MD = "intro text\n## One\nbody one\n### Sub \nsub body\n#### not a heading\n## Two\n\n### Empty\n## Three\n### Skipped\nlast\n##nospace"


def test_sections(spark):
    rows = C.sections(spark.createDataFrame([("d", MD), ("e", ""), ("f", "### only\nx")], "doc_id string, md string")).orderBy("doc_id", "section").collect()
    assert [(r.doc_id, r.title, r.body) for r in rows] == [
        ("d", "", "intro text"), ("d", "One", "body one"), ("d", "One > Sub", "sub body\n#### not a heading"), ("d", "Three > Skipped", "last\n##nospace"), ("f", "only", "x"),
    ]


def test_chunks_drop_merge_and_number(spark):
    long, tail, tiny = "L" * 130, "m" * 119, "n" * 39
    md = f"## A\n{long}\n## A\n{tail}\n## A\n{tiny}\n## B\n{tail}\n## B\n{tail}\n"
    rows = C.chunks(spark.createDataFrame([("doc", md)], "doc_id string, md string")).orderBy("seq").collect()
    assert [(r.chunk_id, r.title, r.body) for r in rows] == [("doc#0000", "A", f"{long} {tail}"), ("doc#0001", "B", f"{tail} {tail}")]
    many = C.merged(spark.range(10001).select(F.lit("d").alias("doc_id"), F.col("id").alias("seq"), F.col("id").cast("string").alias("title"), F.lit("b").alias("body")))
    assert many.where("seq = 10000").first().chunk_id == "d#10000"


def test_toc(spark):
    rows = [(7, "Contents 12", "x"), (8, "Contents 12", "x"), (0, "a > b 3", ""), (0, "t", "one 1\ntwo 2\nthree 3\nfour\nfive"), (0, "t", "one 1\ntwo 2\nthree\nfour\n \nfive"), (None, "t 1", ""), (0, "t", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, seq int, title string, body string")
    assert [r.is_toc for r in C.with_toc(df).orderBy("i").collect()] == [1, 0, 1, 1, 0, 0, 0]


def test_markdown_from_lines(spark):
    lines = [
        (1, 1, "Running head", 10.0), (1, 2, "Big Title", 14.0), (1, 3, "first part of", 10.0), (1, 4, "a sentence.", 10.0), (1, 5, "■ marked and", 10.0), (1, 6, "12", 10.0),
        (2, 1, "Running head", 10.0), (2, 2, "goes on", 10.0), (2, 3, "Small Title", 11.5), (2, 4, "the end of  it.", 10.0), (3, 1, "Running head", 10.0), (3, 2, "a", 10.0),
    ]
    df = spark.createDataFrame([("d", *x) for x in lines], "doc_id string, page int, line_no int, text string, size double")
    assert C.markdown(df).first().md == "## Big Title\n\nfirst part of a sentence.\n\nmarked and goes on\n\n### Small Title\n\nthe end of it."
    assert C.body_font(df).first().body_size == 10.0
    assert [(r.text, r.n) for r in C.repeated_lines(df).collect()] == [("Running head", 3)]


def test_noise(spark):
    rows = spark.createDataFrame([("ab",), ("a",), ("",), ("123",), ("1234",), ("Contents",), ("-",), ("가나",), ("words here",)], "t string")
    assert [r[0] for r in rows.select(T.is_noise(F.col("t"))).collect()] == [False, True, True, True, False, True, True, False, False]


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# comment\nRRF_K=7\nTOP_N = 3\nNAME='a=b'\n")
    assert env_file(str(tmp_path / ".env"))["NAME"] == "a=b"
    monkeypatch.setenv("TOP_N", "5")
    found = settings(str(tmp_path / ".env"))
    assert (found.rrf_k, found.top_n, found.topk_per_mode) == (7, 5, 30)

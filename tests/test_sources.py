import json

from pyspark.sql import functions as F

from quarry.operators import index
from quarry.sources import readers as R
from quarry.sources import sinks as S
from quarry.streaming import query_log as L


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "brief_202504.md").write_text("## A\nx")
    (tmp_path / "notes.md").write_text("y")
    (tmp_path / "other.txt").write_text("z")
    rows = sorted(map(tuple, R.markdown_folder(spark, str(tmp_path)).collect()))
    assert rows == [("brief_202504", "brief_202504.md", "2025-04", "## A\nx"), ("notes", "notes.md", "", "y")]


def test_json_sources(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "a#0000", "seq": 0, "body": "é"}\n\n{"chunk_id": "a#0001"}\n')
    assert [r.chunk_id for r in R.json_lines(spark, str(tmp_path / "c.jsonl")).collect()] == ["a#0000", "a#0001"]
    (tmp_path / "e.json").write_text(json.dumps([{"id": "auto-01", "query": "q", "gold": ["a#0000"], "kind": "auto"}]))
    assert R.eval_set(spark, str(tmp_path / "e.json")).first().gold == ["a#0000"]
    assert R.eval_set(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "w.json").write_text(json.dumps({"words": {"x": True, "y": False}}))
    assert [r.word for r in R.user_words(spark, str(tmp_path / "w.json")).collect()] == ["x"]
    assert R.user_words(spark, str(tmp_path / "w.json"), None).count() == 2


def test_binary_files_by_signature(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    files = R.files_with_signature(spark, str(tmp_path))
    assert files.count() == 1
    lines = R.page_lines(files, lambda content: [(1, 1, content[:4].decode(), 10.0)])
    assert tuple(lines.first()) == ("a", 1, 1, "%PDF", 10.0)


def test_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([("a#0000", "2025-04", "t", "b b"), ("b#0000", "", "t", "c")], "chunk_id string, year_month string, title string, body string")
    S.write_chunks(chunks, str(tmp_path / "chunks"))
    plan = spark.read.parquet(str(tmp_path / "chunks")).where("year_month = '2025-04'")
    assert plan.count() == 1 and "PartitionFilters: [isnotnull(year_month" in plan._jdf.queryExecution().executedPlan().toString()
    index.write_index(chunks, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index/postings")).where("term = 'b'").first().tf_body == 2
    log = spark.createDataFrame([("q", 3)], "query string, n_results int")
    S.append_log(log, str(tmp_path / "log"))
    S.append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    known = spark.createDataFrame([("m-1", "manual"), ("auto-01", "auto")], "id string, kind string")
    S.replace_auto(known, spark.createDataFrame([("auto-09", "auto", "q")], "id string, kind string, query string"), str(tmp_path / "evals"))
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "evals")).collect()) == ["auto-09", "m-1"]
    counts = S.write_markdown(spark.createDataFrame([("d", "## a\n### b\n### c")], "doc_id string, md string"), str(tmp_path / "md")).first()
    assert (counts.h2, counts.h3) == (1, 2)
    assert "1 sources" in S.report("T", [("s", "b")], spark.createDataFrame([("a",), ("a",)], "chunk_id string"))
    assert R.with_column_default(known, "is_toc", 0).columns == ["id", "kind", "is_toc"] and R.with_column_default(known, "kind", 0) is known
    S.write_json_lines(known, str(tmp_path / "jsonl"))
    S.write_bucketed(known, "known_words", "id", 2)
    assert spark.table("known_words").count() == 2
    spark.sql("DROP TABLE known_words")


def test_streamed_summary_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", F.col("event_type").alias("mode"), F.col("value").alias("latency_ms"), (F.col("event_type") == "error").cast("int").alias("refused"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = L.log_stream(spark, str(tmp_path / "in"), events._jdf.schema().toDDL())
    L.to_table(L.windowed_kpis(stream, "1 day", "60 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    found = spark.read.schema("start timestamp, mode string, n long, refused long, mean_ms double").parquet(str(tmp_path / "out"))
    want = L.windowed_kpis(events, "1 day").withColumnRenamed("n", "m")
    joined = want.join(found, ["start", "mode"], "left")
    assert joined.where("n is not null and n <> m").count() == 0

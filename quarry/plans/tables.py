"""The driver's tables in the roles of this engine's data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled queries that show where retrievers differ: common words, rare words, several languages, word parts.
QUERIES = [
    (1, "the ofthstthor of rend"),
    (2, "und der einlich chstau"),
    (3, "que ciónmente de la"),
    (4, "le tionment éelle"),
    (5, "licensed under the apache license version"),
    (6, "thstinnt"),
    (7, "password token"),
]

#: Words that must all stand in a chunk; phrases; words with marks, and with what a user's list keeps together.
AND_QUERIES = [(1, "the of and"), (2, "der die und"), (3, "de la que"), (4, "license apache version"), (5, "in the in of"), (6, "licensed unheardof"), (7, "")]
PHRASE_QUERIES = [(1, '"the apache license"'), (2, "2.0"), (3, '"version 2.0" licensed'), (4, '"license the"'), (5, '"of the" "of the"'), (6, '"and the" ing.'), (7, '"" .')]
USER_WORDS = ["Apache License", "apache", "version 2.0", "que de", "Éuxé"]
WORD_QUERIES = [(1, "APACHE LICENSE"), (2, "licensé apaché"), (3, "version 2.0 version"), (4, "eleve tre"), (5, "QUE DE la cion"), (6, "fur uber")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the first line is the title, the rest the body."""
    docs = table(spark, sf_dir, "documents")
    cut = F.instr("text", "\n")
    return docs.select(
        F.col("doc_id").alias("chunk_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(cut > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise("").alias("body"),
        "lang",
        "source",
    )


def documents_as_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("md"))


def documents_as_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the pages of one file for each source; sizes follow the lines' lengths."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return lines.withColumn("size", 10.0 + F.length("text") % 4)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id long, query string")


def _asked(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "query_id long, query string")


def and_queries(spark: SparkSession) -> DataFrame:
    return _asked(spark, AND_QUERIES)


def phrase_queries(spark: SparkSession) -> DataFrame:
    return _asked(spark, PHRASE_QUERIES)


def word_queries(spark: SparkSession) -> DataFrame:
    return _asked(spark, WORD_QUERIES)


def queries_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled queries, each with a row's vector in place of a model's."""
    rows = vectors(spark, sf_dir).where(F.col("chunk_id") % 50 == 0).select((F.col("chunk_id") / 50).cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    return queries(spark).join(rows, "query_id")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, as a query."""
    return vectors(spark, sf_dir).where(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"), "label")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def events_as_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a query log: an error is a refusal, a value serves as latency and for coverage."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("mode"), F.col("value").alias("latency_ms"),
        (F.col("user_id") % 10).alias("n_results"), (F.col("user_id") % 7 == 0).cast("int").alias("invalid"),
        (F.col("event_type") == "error").cast("int").alias("refused"),
        F.when(F.col("event_type") != "view", F.least(F.lit(1.0), F.abs("value") / 100)).alias("coverage"),
    )


def documents_as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a file of pages of eight lines; sizes follow the lines' lengths."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return lines.select("doc_id", F.floor(F.col("i") / 8).alias("page"), (F.col("i") % 8).alias("line_no"), "text", (10.0 + F.length("text") % 4).alias("size"))


def lines_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks without titles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "body"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.format_string("%04d", "n"))
    return docs.where("body <> ''").select(name.alias("chunk_id"), F.lit("").alias("title"), "body")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as requests of a tool: the first six words, with all kinds of arguments, some of them unknown, too large or blank."""
    items, at = table(spark, sf_dir, "benchmark"), F.col("item_id")
    words = F.array_join(F.slice(F.split("text", " "), 1, 6), " ")
    pick = lambda *values: F.get(F.array(*(F.lit(v) for v in values)), (at % len(values)).cast("int"))
    facets = F.when(at % 4 == 1, F.array(F.lit("en"))).when(at % 4 == 2, F.array(F.lit("fr"), F.lit("xx"))).when(at % 4 == 3, F.array(F.lit("none")))
    return items.select(
        at.alias("query_id"), F.when(at % 17 == 0, "  ").otherwise(words).alias("query"), pick("keyword", "semantic", "fallback", "hybrid", "other").alias("mode"),
        pick(None, 0, 5, 50, 3, 12, 1).cast("int").alias("top_n"), facets.alias("facets"), pick(None, True, False).cast("boolean").alias("exclude_toc"),
    )

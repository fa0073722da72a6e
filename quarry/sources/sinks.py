"""Sinks: chunk and index tables, logs, evaluation sets, word lists, markdown and reports."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import miner


def write_chunks(chunks: DataFrame, path: str, by: str | None = "year_month") -> None:
    """Parquet, in a folder for each value of ``by``, so that a filter on it reads only its folders."""
    writer = chunks.write.mode("overwrite")
    (writer.partitionBy(by) if by and by in chunks.columns else writer).parquet(path)


def write_bucketed(rows: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by ``key``: later joins on the key need no shuffle of it."""
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_markdown(docs: DataFrame, path: str) -> DataFrame:
    """One folder of text for each document; returns the counts of headings by document."""
    docs.select("doc_id", F.col("md").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)
    counts = [F.regexp_count("md", F.lit(f"(?m)^{mark} ")).cast("long").alias(name) for mark, name in (("##", "h2"), ("###", "h3"))]
    return docs.select("doc_id", *counts)


def append_log(entries: DataFrame, path: str) -> None:
    """Entries of a query log, stamped; the log only grows."""
    entries.withColumn("ts", F.current_timestamp()).write.mode("append").parquet(path)


def replace_auto(known: DataFrame, new: DataFrame, path: str) -> None:
    """An evaluation set with its automatic items replaced; ``path`` must not be what ``known`` reads."""
    known.where("kind <> 'auto'").unionByName(new, allowMissingColumns=True).write.mode("overwrite").json(path)


def save_words(known: DataFrame, candidates: DataFrame, path: str, top: int = 40) -> None:
    """The word list with the ``top`` candidates added as not yet accepted; known flags stay."""
    best = candidates.orderBy(F.desc("collide"), F.desc("n"), "word").limit(top)
    miner.upserted(known, best).write.mode("overwrite").json(path)


def report(title: str, sections: list[tuple[str, str]], cited: DataFrame) -> str:
    """A markdown report; ``cited`` has ``chunk_id``, of which only the number is fetched."""
    n = cited.agg(F.countDistinct("chunk_id")).first()[0]
    parts = [f"# {title}", f"{datetime.date.today():%Y-%m-%d}, {n} sources"]
    return "\n\n".join([*parts, *(f"## {name}\n\n{body}" for name, body in sections)]) + "\n"


def analyzed(rows: DataFrame, name: str) -> None:
    """``rows`` as a table with statistics of all columns, from which later plans choose their joins; an older one of the name goes."""
    dropped(rows.sparkSession, name)
    rows.write.saveAsTable(name)
    rows.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def dropped(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")

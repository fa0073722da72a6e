"""Sources: markdown folders, JSON lines, JSON lists and maps, binary files with a signature, schema checks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.functions import text as T

CHUNK_SCHEMA = "chunk_id string, doc_id string, year_month string, title string, body string, seq int, source string"
EVAL_SCHEMA = "id string, query string, gold array<string>, kind string, year_month string"


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def markdown_folder(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id`` (file stem), ``source``, ``year_month`` and ``md`` of a folder's ``.md`` files, one row each."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select("*", F.col("_metadata.file_path").alias("path"))
    stem = _stem(F.col("path"))
    return rows.select(stem.alias("doc_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), T.year_month(stem).alias("year_month"), F.col("value").alias("md"))


def json_lines(spark: SparkSession, path: str, schema: str | StructType = CHUNK_SCHEMA) -> DataFrame:
    """One row per line that holds an object; blank lines are skipped; the schema is given, never inferred."""
    return spark.read.schema(schema).json(path).dropna("all")


def eval_set(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON list; a missing file is an empty set."""
    try:
        return spark.read.schema(EVAL_SCHEMA).json(path, multiLine=True)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EVAL_SCHEMA)


def user_words(spark: SparkSession, path: str, accepted: bool | None = True) -> DataFrame:
    """``word`` and ``accepted`` of a JSON file ``{"words": {word: flag}}``; by default only accepted words."""
    rows = spark.read.schema("words map<string, boolean>").json(path, multiLine=True).select(F.explode("words").alias("word", "accepted"))
    return rows if accepted is None else rows.where(F.col("accepted") == accepted)


def files_with_signature(spark: SparkSession, path: str, signature: bytes = b"%PDF") -> DataFrame:
    """``path``, ``length`` and ``content`` of binary files that begin with ``signature``."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.where(F.substring("content", 1, len(signature)) == F.lit(signature)).select("path", "length", "content")


def with_column_default(df: DataFrame, name: str, value: object) -> DataFrame:
    """``df`` with a column added if it is missing (a migration that only adds)."""
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def page_lines(files: DataFrame, lines_of) -> DataFrame:
    """``doc_id``, ``page``, ``line_no``, ``text``, ``size`` from binary files.

    ``lines_of`` (bytes to (page, line, text, size) tuples) wraps a PDF library, of which this engine needs none.
    """

    def read(batches):
        import pandas as pd

        for batch in batches:
            rows = [(d, *line) for d, content in zip(batch["doc_id"], batch["content"], strict=True) for line in lines_of(bytes(content))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "line_no", "text", "size"])

    return files.select(_stem(F.col("path")).alias("doc_id"), "content").mapInPandas(read, "doc_id string, page int, line_no int, text string, size double")

"""A corpus pipeline of five stages, each one operator of ``quarry.llm``, from raw documents to token windows.

Every stage takes any columns beside ``doc_id``, ``text`` and ``lang``, whatever their names, and an empty table, of which it
makes an empty one. What it does with null and empty texts, repeated rows and null ids is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import line_dedup as lines
from quarry.llm import packing, personal_data, quality_classifier
from quarry.llm.near_copies import without_near_copies
from quarry.llm.queries import fifty_thousand
from quarry.llm.shared import written


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``changed``; a column ``n_chars`` follows the text."""
    count = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return changed.select(*(count.alias(c) if c == "n_chars" else changed[c] for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, gives at least one half; the rest goes.

    A null text counts as empty; an empty one is judged like any other; equal texts are judged equally, so that repeated
    rows stay or go together; without labels of both kinds all go or all stay.
    """
    model = quality_classifier.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_classifier.score(F.col("text"), model) >= 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the multi-line chunks that an earlier document has; documents of which nothing is left go.

    A null text stays null and an empty one empty; rows equal in id and text count as one and stay or go together; of
    texts that share a chunk the smallest id keeps it, a null id first.
    """
    return _like(docs, lines.shortened(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: Jaccard similarity of five-word shingles 0.8 or more, each link compared.

    The smallest id stays, a null id only if there is no other; null and empty texts and texts of blanks are near copies of
    one another; of rows equal in id and text one stays. SimHash fingerprints of the shingles find the candidates, up to six of
    64 bits apart all of them; MinHash bands add near copies whose fingerprints lie further apart (see README).
    """
    return without_near_copies(docs, words=5)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind.

    Null stays null, empty stays empty, repeated rows are changed alike; no row goes; overlapping spans become one.
    """
    return _like(docs, personal_data.redacted(docs, personal_data.learn(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token windows of 2048.

    A null text counts as empty, an empty one is the end id alone; rows are packed as often as they stand; null ids stay null.
    """
    return packing.packed(docs, fifty_thousand(), near="lang")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("privacy", privacy), ("packing", pack)]
#: SQL can express neither the classifier nor fingerprints, models and packing; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written and read again, so that no later one repeats its work."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

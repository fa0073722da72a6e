"""Vocabulary mining: compounds whose pieces also stand elsewhere, and the user's word list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.functions import text as T

DEFAULT = Settings()


def words(docs: DataFrame, least: int = DEFAULT.miner_min_len) -> DataFrame:
    """``doc_id`` and ``word``: white-space words without marks around them, long enough, beginning with a letter."""
    raw = docs.select("doc_id", F.explode(F.split("text", r"(?U)\s+")).alias("raw"))
    word = F.btrim(F.col("raw"), F.lit(T.WORD_MARKS))
    return raw.select("doc_id", word.alias("word")).where((F.length("word") >= least) & F.col("word").rlike("^[가-힣A-Za-z]"))


def hyphen_pieces(word: Column) -> Column:
    """A stand-in for a morphological analyser: the parts between hyphens and apostrophes, in lower case."""
    return F.filter(F.split(F.lower(word), "[-'’]"), lambda p: p != "")


def candidates(docs: DataFrame, analyse=hyphen_pieces, s: Settings = DEFAULT) -> DataFrame:
    """``word``, ``n``, ``docs``, ``collide``, ``worst``: compounds by how many other documents have one of their pieces.

    ``analyse`` gives the pieces of a word; every word marks its document for all its pieces.
    """
    each = words(docs, s.miner_min_len).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    each = each.withColumn("pieces", analyse(F.col("word")))
    piece_docs = each.select("doc_id", F.explode("pieces").alias("piece")).distinct()
    split = each.where(F.size("pieces") >= 2)
    kept = split.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).where(F.col("n") >= s.miner_min_count)
    own = split.join(kept.select("word"), "word", "left_semi").select("word", "doc_id", F.posexplode(F.array_distinct("pieces")).alias("nth", "piece"))
    sizes = piece_docs.groupBy("piece").agg(F.count("*").alias("piece_docs"))
    # each of a candidate's documents has all its pieces, so the others are a difference of counts
    collide = own.groupBy("word", "nth", "piece").agg(F.count("*").alias("own")).join(sizes, "piece").withColumn("collide", F.col("piece_docs") - F.col("own"))
    worst = collide.groupBy("word").agg(F.max("collide").alias("collide"), F.max_by("piece", F.struct("collide", -F.col("nth"))).alias("worst"))
    return kept.join(worst, "word").select("word", "n", "docs", "collide", "worst")


def upserted(known: DataFrame, found: DataFrame) -> DataFrame:
    """``word``, ``accepted``: known words keep their flag, new ones get false."""
    new = found.select("word").distinct()
    return known.join(new, "word", "full_outer").select("word", F.coalesce("accepted", F.lit(False)).alias("accepted"))

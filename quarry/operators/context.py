"""Context within a budget, collection over topics, and checks of citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.config import Settings
from quarry.functions import text as T

DEFAULT = Settings()


def block(row: DataFrame) -> Column:
    """A chunk as a block of text: id, month and source, title, body."""
    get = lambda c: F.coalesce(row[c].cast("string"), F.lit("")) if c in row.columns else F.lit("")
    return F.concat(F.lit("["), row["chunk_id"].cast("string"), F.lit("]\n"), get("year_month"), F.lit(" "), get("source"), F.lit("\n"), get("title"), F.lit("\n"), get("body"), F.lit("\n"))


def within_budget(ranked: DataFrame, chunks: DataFrame, budget: int = DEFAULT.context_budget, cost: Callable[[Column], Column] = F.length) -> DataFrame:
    """The blocks of each query up to the first that would go beyond ``budget``, even if a later one would fit.

    Ids without a chunk are skipped and cost nothing.
    """
    rows = ranked.select("query_id", "chunk_id", "rk").join(chunks, "chunk_id")
    rows = rows.withColumn("block", block(rows))
    rows = rows.withColumn("cost", cost(F.col("block")).cast("long"))
    running = F.sum("cost").over(Window.partitionBy("query_id").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", running).where(F.col("used") <= budget).select("query_id", "chunk_id", "rk", "block", "cost", "used")


def context(ranked: DataFrame, chunks: DataFrame, budget: int = DEFAULT.context_budget) -> DataFrame:
    """``query_id``, ``context``, ``n_blocks``, ``used`` for each query with a block."""
    kept = within_budget(ranked, chunks, budget)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rk", "block"))), lambda x: x["block"])
    return kept.groupBy("query_id").agg(F.array_join(parts, "\n---\n").alias("context"), F.count("*").alias("n_blocks"), F.max("used").alias("used"))


def budget_scan(ranked: DataFrame, chunks: DataFrame, budgets: tuple[int, ...] = (1000, 2000, 3000, 6000)) -> DataFrame:
    """Blocks and cost of each query under each of a few budgets."""
    rows = within_budget(ranked, chunks, max(budgets))
    each = rows.select("query_id", "used", F.explode(F.array(*map(F.lit, budgets))).alias("budget")).where("used <= budget")
    return each.groupBy("query_id", "budget").agg(F.count("*").alias("n_blocks"), F.max("used").alias("used"))


def collected(ranked: DataFrame, per_topic: int = 5) -> DataFrame:
    """The first ``per_topic`` of each topic (``query_id``), less those an earlier topic has; none takes their place."""
    first = ranked.where(F.col("rk") <= per_topic)
    once = Window.partitionBy("chunk_id").orderBy("query_id")
    return first.withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth")


def collected_sums(ranked: DataFrame, chunks: DataFrame, per_topic: int = 5, cost: Callable[[Column], Column] = F.length) -> DataFrame:
    """``query_id``, ``n_blocks`` and ``cost`` of what each topic collects, and the sums over all topics under a null id."""
    rows = collected(ranked, per_topic).select("query_id", "chunk_id").join(chunks, "chunk_id")
    rows = rows.select("query_id", cost(block(rows)).cast("long").alias("cost"))
    return rows.rollup("query_id").agg(F.count("*").alias("n_blocks"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"))


def citation_report(answers: DataFrame) -> DataFrame:
    """``answers`` (``answer``, ``allowed``: array of ids) with what it cites, what is wrong with that, and the verdict."""
    rows = answers.withColumn("found", T.citations(F.col("answer")))
    parts = F.filter(T.sentences(F.col("answer")), lambda p: T.strip(p) != "")
    rows = rows.withColumns(
        {
            "cited": F.array_sort(F.array_distinct("found")),
            "invalid": F.array_sort(F.array_except("found", "allowed")),
            "unused": F.array_sort(F.array_except("allowed", "found")),
            "n_sentences": F.size(parts),
            "uncited_sentences": F.size(F.filter(parts, lambda p: ~p.rlike(r"\[[A-Za-z0-9_]+#\d{4}\]"))),
        }
    )
    rows = rows.withColumn("coverage", F.bround(1 - F.col("uncited_sentences") / F.greatest(F.lit(1), "n_sentences"), 2))
    return rows.withColumn("ok", (F.size("cited") > 0) & (F.size("invalid") == 0)).drop("found")


def gate(report: DataFrame, least: float = DEFAULT.gate_min_coverage) -> DataFrame:
    """Adds ``gate``: reject a wrong citation, retry for too little coverage, else pass."""
    return report.withColumn("gate", F.when(F.size("invalid") > 0, "reject").when(F.col("coverage") < least, "retry").otherwise("pass"))

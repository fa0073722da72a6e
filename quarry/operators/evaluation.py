"""Retrieval metrics, gold sets, ablation, and percentiles by index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import index, substring

KS = (1, 3, 5, 10)


def judged(ranked: DataFrame, gold: DataFrame, queries: DataFrame, by: tuple[str, ...] = (), ks: tuple[int, ...] = KS, size: DataFrame | None = None) -> DataFrame:
    """For each query (and each value of ``by``): ``hit_k``, ``recall_k`` and reciprocal rank ``rr``.

    ``gold`` has distinct ``query_id``, ``chunk_id``; queries without results or golds count as zero. Where golds are too many
    to list, ``size`` (``query_id``, ``golds``) counts them and ``gold`` has those among the results.
    """
    size = gold.groupBy("query_id").agg(F.count("*").alias("golds")) if size is None else size
    groups = ranked.select(*by).distinct() if by else None
    every = queries.select("query_id").distinct()
    every = every.crossJoin(groups) if groups is not None else every  # few modes
    right = ranked.join(gold.select("query_id", "chunk_id"), ["query_id", "chunk_id"]).groupBy("query_id", *by).agg(
        F.min("rk").alias("best"), *(F.count_if(F.col("rk") <= k).alias(f"n_{k}") for k in ks)
    )
    rows = every.join(right, ["query_id", *by], "left").join(size, "query_id", "left")
    found = [F.coalesce(F.col(f"n_{k}"), F.lit(0)) for k in ks]
    hits = [(n > 0).cast("int").alias(f"hit_{k}") for k, n in zip(ks, found, strict=True)]
    recalls = [F.coalesce(n / F.col("golds"), F.lit(0.0)).alias(f"recall_{k}") for k, n in zip(ks, found, strict=True)]
    return rows.select("query_id", *by, *hits, *recalls, F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("rr"))


def means(rows: DataFrame, by: tuple[str, ...] = (), ks: tuple[int, ...] = KS) -> DataFrame:
    """Means over queries, 0 over none."""
    mean = lambda c, n: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(n)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_queries"), *(mean(f"hit_{k}", f"hit_{k}") for k in ks), *(mean(f"recall_{k}", f"recall_{k}") for k in ks), mean("rr", "mrr")
    )


def gold_by_substring(queries: DataFrame, chunks: DataFrame, least: int = 1, most: int = 60, stored: index.Index | None = None) -> DataFrame:
    """Chunks whose body contains the query (ASCII case ignored), for queries with ``least`` to ``most`` of them."""
    asked = queries.select("query_id", F.lower("query").alias("needle"))
    hits = substring.containing(asked.select("needle").distinct(), stored or index.built(chunks), F.lower("body"))
    pairs = asked.join(hits.select("needle", "chunk_id"), "needle").select("query_id", "chunk_id")
    size = F.count("*").over(Window.partitionBy("query_id"))
    return pairs.withColumn("golds", size).where(F.col("golds").between(least, most)).select("query_id", "chunk_id")


def nth(values: Column, at: Column) -> Column:
    """The value at an index of the sorted values; for groups whose values fit in a row."""
    return F.get(F.array_sort(F.collect_list(values)), at)


def upper_median(values: Column) -> Column:
    return nth(values, F.floor(F.count(values) / 2).cast("int"))


def p95(values: Column) -> Column:
    return nth(values, F.least(F.count(values) - 1, F.floor(F.count(values) * 0.95)).cast("int"))


def overlap(a: DataFrame, b: DataFrame, n: int = 10) -> DataFrame:
    """``query_id``, ``n_a``, ``shared``: how many of the first ``n`` of one ranking another has among its first ``n``."""
    other = b.where(F.col("rk") <= n).select("query_id", "chunk_id", F.lit(1).alias("there"))
    joined = a.where(F.col("rk") <= n).join(other, ["query_id", "chunk_id"], "left")
    return joined.groupBy("query_id").agg(F.count("*").alias("n_a"), F.count("there").alias("shared"))


def context_quality(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """``recall`` and ``precision`` (mean of the precision at each right rank) of retrieved contexts, by exact id."""
    size = gold.groupBy("query_id").agg(F.count("*").alias("golds"))
    right = ranked.join(gold.select("query_id", "chunk_id"), ["query_id", "chunk_id"])
    upto = Window.partitionBy("query_id").orderBy("rk")
    right = right.withColumn("at", F.row_number().over(upto) / F.col("rk"))
    found = right.groupBy("query_id").agg(F.count("*").alias("right"), F.avg("at").alias("precision"))
    return size.join(found, "query_id", "left").select(
        "query_id", (F.coalesce("right", F.lit(0)) / F.col("golds")).alias("recall"), F.coalesce("precision", F.lit(0.0)).alias("precision")
    )


def against(rows: DataFrame, by: str, full: str) -> DataFrame:
    """Mean metrics by ``by`` with the difference of ``mrr`` to that of the value ``full``."""
    means_ = means(rows, (by,))
    whole = means_.where(F.col(by) == full).select(F.col("mrr").alias("whole"))
    return means_.crossJoin(whole).select("*", F.round(F.col("mrr") - F.col("whole"), 6).alias("delta_mrr")).drop("whole")  # one row


def fuzzy_context(retrieved: DataFrame, references: DataFrame, least: float = 0.5) -> DataFrame:
    """``query_id``, ``recall`` and ``precision`` of retrieved contexts by likeness of texts: 1 - edit distance / longer length.

    ``retrieved`` has ``query_id``, ``rk``, ``text``, ``references`` ``query_id``, ``ref``, ``text``. Recall is the share of references that a context is like
    (``least`` or more); precision the mean, over contexts like a reference, of the share of such ones up to their rank; 0 if there are none.
    Lengths too far apart are passed over, and a distance is given up where it leaves its bound.
    """
    r, c = references.select("query_id", "ref", F.col("text").alias("a")), retrieved.select("query_id", "rk", F.col("text").alias("b"))
    longer = F.greatest(F.length("a"), F.length("b"))
    most = F.floor(longer * (1 - least) + 1e-9).cast("int")
    near = r.join(c, "query_id").where((longer > 0) & (F.length("a") + most >= longer) & (F.length("b") + most >= longer)).withColumn("most", most)
    alike = near.where(F.expr("levenshtein(a, b, most)") >= 0).select("query_id", "ref", "rk")
    recall = r.groupBy("query_id").agg(F.count("*").alias("refs")).join(alike.groupBy("query_id").agg(F.countDistinct("ref").alias("met")), "query_id", "left")
    right = alike.select("query_id", "rk").distinct().withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("rk")) / F.col("rk"))
    rows = recall.join(right.groupBy("query_id").agg(F.avg("at").alias("precision")), "query_id", "left")
    return rows.select("query_id", (F.coalesce("met", F.lit(0)) / F.col("refs")).alias("recall"), F.coalesce("precision", F.lit(0.0)).alias("precision"))


def misspelt(word: Column) -> Column:
    """``word`` with one edit: its middle letter and the one before change places, or, where they are equal, the middle one is gone."""
    at = F.floor(F.length(word) / 2).cast("int")  # counts from 0
    a, b = F.substring(word, at, F.lit(1)), F.substring(word, at + 1, F.lit(1))
    head, tail = F.substring(word, F.lit(1), at - 1), F.substring(word, at + 2, F.length(word))
    return F.when(F.length(word) < 2, word).otherwise(F.concat(head, F.when(a == b, a).otherwise(F.concat(b, a)), tail))


def term_items(found: index.Index, n: int = 20, least: int = 3, most: int = 40, letters: int = 6) -> DataFrame:
    """Items of two kinds from an index: ``n`` rare terms, and the same misspelt; ``query_id``, ``kind``, ``query`` and ``correct``, whose golds count.

    Terms have ``letters`` or more and ``least`` to ``most`` chunks; they are chosen by hash.
    """
    some = found.terms.where(F.col("df").between(least, most) & (F.length("term") >= letters)).orderBy(F.md5(F.col("term").cast("binary")), "term").limit(n)
    kinds = F.array(F.struct(F.lit("term").alias("kind"), F.col("term").alias("query")), F.struct(F.lit("typo").alias("kind"), misspelt(F.col("term")).alias("query")))
    rows = some.select("term", F.explode(kinds).alias("k"))
    return rows.select(F.concat("k.kind", F.lit(":"), "term").alias("query_id"), "k.kind", "k.query", F.col("term").alias("correct"))


def best(rows: DataFrame, by: str, metric: str = "mrr") -> DataFrame:
    """One row: the value of ``by`` with the largest ``metric``, of equal ones the first, and that metric."""
    return rows.groupBy().agg(F.min_by(F.struct(by, metric), F.struct((-F.col(metric)).alias("less"), by)).alias("b")).select(f"b.{by}", f"b.{metric}")

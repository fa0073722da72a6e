"""Summaries of a query log: ``id``, ``ts``, ``query``, ``mode``, ``n_results``, ``latency_ms``, ``coverage``, ``invalid``, ``refused``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.evaluation import p95, upper_median


def kpis(log: DataFrame, *by: str) -> DataFrame:
    return log.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.round(F.avg("refused"), 6).alias("refused_share"),
        F.count_if(F.col("invalid") > 0).alias("n_invalid"),
        F.round(F.avg("coverage"), 6).alias("mean_coverage"),
    )


def poor(log: DataFrame, least: int = 3) -> DataFrame:
    return log.where((F.col("n_results") < least) | (F.col("refused") == 1))


def latest(log: DataFrame, n: int = 200) -> DataFrame:
    return log.orderBy(F.desc("id")).limit(n)


def latencies(log: DataFrame, *by: str) -> DataFrame:
    """Upper median and 95th percentile by index, over groups whose values fit in a row."""
    return log.groupBy(*by).agg(F.count("*").alias("n"), upper_median(F.col("latency_ms")).alias("p50"), p95(F.col("latency_ms")).alias("p95"))


def _class(value: Column) -> Column:
    """A number that grows with the value: sixteen to each doubling of its distance from zero."""
    of = F.signum(value) * F.floor(16 * F.log2(F.abs(value) + 1))
    return F.when(F.isnan(value), F.lit(2147483647)).otherwise(of.cast("int"))


#: Places in the order of ``n`` values, counted from 0.
PLACES = {"p50": lambda n: F.floor(n / 2), "p95": lambda n: F.least(n - 1, F.floor(n * 0.95))}


def latencies_of_large(log: DataFrame, *by: str, places: dict[str, Callable[[Column], Column]] = PLACES) -> DataFrame:
    """The same for groups of any size, and for any ``places``: equal values are counted first, then classes of near values.

    Running counts of the classes, a fixed number in each group, show which class holds a percentile; only the
    different values of that class are put in order.
    """
    value = F.col("latency_ms").cast("double")
    counted = log.where("latency_ms is not null").groupBy(*by, "latency_ms").agg(F.count("*").alias("c")).withColumn("class", _class(value))
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("class")
    classes = counted.groupBy(*by, "class").agg(F.sum("c").alias("m")).withColumns({"n": F.sum("m").over(group), "upto": F.sum("m").over(order)})
    classes = classes.withColumns({f"place_{name}": at(F.col("n")) for name, at in places.items()} | {"before": F.col("upto") - F.col("m")})
    holding = classes.where(reduce(or_, ((F.col(f"place_{name}") >= F.col("before")) & (F.col(f"place_{name}") < F.col("upto")) for name in places)))
    x, y = counted.alias("x"), holding.alias("y")
    same = reduce(and_, (F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*by, "class")))
    near = x.join(y, same).select("x.*", "y.n", "y.before", *(f"y.place_{name}" for name in places))
    ranked = near.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(*by, "class").orderBy("latency_ms")))
    at = lambda name: F.min(F.when(F.col("upto") > F.col(f"place_{name}"), F.col("latency_ms"))).alias(name)
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *map(at, places))

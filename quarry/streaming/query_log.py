"""Structured streaming over a query log: windowed summaries with late data, and running poor queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_kpis(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, refusals and mean latency by window and mode; rows later than ``late`` are dropped, state is bounded."""
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "mode")
    counted = rows.agg(F.count("*").alias("n"), F.sum("refused").cast("long").alias("refused"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"))
    return counted.select(F.col("window.start").alias("start"), "mode", "n", "refused", "mean_ms")


def to_table(summary: DataFrame, path: str, checkpoint: str) -> None:
    """Finished windows appended as Parquet, each once, until no input is left."""
    query = summary.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

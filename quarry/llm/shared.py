"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A key counts as hot if it has more than one in so many of all rows; so there are fewer hot keys than this.
HOT_KEYS = 1000


def _folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; only in local mode, if it names none, one of our own is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by ``checkpoint()`` in the folder that ``spark.checkpoint.dir`` names."""
    _folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a folder of its own beside the checkpoints, and read again."""
    path = f"{_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def joined_by_key(rows: DataFrame, side: DataFrame, on: list[str], total: int, n: str = "n") -> DataFrame:
    """``rows`` (read twice) joined with ``side``, which has each key once, and in ``n`` how many of the ``total`` rows have it.

    Rows of hot keys meet their part of ``side``, fewer than ``HOT_KEYS`` rows, by broadcast, so that they fill no single
    task; all others meet by a shuffle. Keys are not null.
    """
    hot = side.where(F.col(n) * HOT_KEYS > total)
    keys = F.broadcast(hot.select(*on))
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(keys, on, "left_anti").join(side.where(F.col(n) * HOT_KEYS <= total), on))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: Column, divisor: int) -> Column:
    """crc32 of an id's decimal text, modulo ``divisor``; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(divisor)

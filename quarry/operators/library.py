"""Indexes that are built once in a session and then serve all its searches."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import index

_BUILT: dict[tuple[str, str], index.Index] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which the driver and all executors share; in local mode one of our own if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once to the shared folder and read again, where a plan needs them several times."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def state_of(source: DataFrame) -> str:
    """A digest of the files that ``source`` reads: a file that is added, changed or gone makes another one."""
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = files.agg(F.count("*"), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()
    return hashlib.md5(repr(tuple(row)).encode()).hexdigest()


def index_of(chunks: DataFrame, source: DataFrame, name: str, **how: index.Analyser) -> index.Index:
    """The stored index of ``chunks``, which come from the files of ``source``; ``how`` may give ``analyse`` and ``embed``, ``name`` tells them apart.

    The first search of a session builds it; it is built again when the files change.
    """
    spark = chunks.sparkSession
    key = (spark.sparkContext.applicationId, f"{name}-{state_of(source)}")
    if key not in _BUILT:
        path = f"{shared_folder(spark)}/index-{key[0]}-{key[1]}"
        index.write_index(chunks, path, **how)
        _BUILT[key] = index.read_index(spark, path, **how)
    return _BUILT[key]

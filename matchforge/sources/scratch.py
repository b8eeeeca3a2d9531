"""The folder that all machines share, and small tables in it that tasks read by blocks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share; without one, a local folder on local masters only."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = "file:///tmp/checkpoints/matchforge"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str) -> str:
    """Write a table to a new path and return the path."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def blocks(path: str, rows: int) -> Iterator:
    """Arrow tables of at most about `rows` rows of a written table; a task holds one of them."""
    fs, inside = pafs.FileSystem.from_uri(path)
    for batch in ds.dataset(inside, filesystem=fs, format="parquet").to_batches(batch_size=rows):
        if batch.num_rows:
            yield batch

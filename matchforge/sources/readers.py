"""Readers and sinks: tables with columns and a predicate, JSON lines with defaults, run-stamped and full-refresh writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, path: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """A Parquet scan; column list and predicate reach the files."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, path: str, schema, defaults: dict | None = None) -> DataFrame:
    """JSON lines with a fixed schema; nulls become the column's default."""
    df = spark.read.schema(schema).json(path)
    return df.fillna(defaults) if defaults else df


def flatten_stats(df: DataFrame, stats: list[str], parts: tuple = ("flat", "perLevel")) -> DataFrame:
    """`stat.flat` and `stat.perLevel` as columns stat_flat, stat_perLevel."""
    plain = [c for c in df.columns if c not in stats]
    return df.select(*plain, *[F.col(f"{s}.{p}").alias(f"{s}_{p}") for s in stats for p in parts])


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """Rows of a run in a partition of their own: a run that is written again replaces what it wrote before."""
    df.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def rewrite_without(df: DataFrame, keys: DataFrame, on: list[str], path: str) -> int:
    """Delete by key from a table of files: what stays is written to a new path, and its number returned."""
    df.join(keys.select(*on).distinct(), on, "left_anti").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a table that nobody reads meanwhile: what was there goes first. ReplacingTable.replace_all keeps readers whole."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def backup_subset(df: DataFrame, ids: DataFrame, key: str, path: str) -> int:
    """Copy the rows of some ids and return their number, after checking that the copy has as many."""
    rows = df.join(ids.select(key).distinct(), key, "left_semi")
    rows.write.mode("overwrite").parquet(path)
    copied, wanted = df.sparkSession.read.parquet(path).count(), rows.count()
    if copied != wanted:
        raise ValueError(f"backup has {copied} rows of {wanted}")
    return copied


def next_page(df: DataFrame, key: str, last, n: int) -> DataFrame:
    return df.where(F.col(key) > last).orderBy(key).limit(n)

"""Live ingest: file streams, merging of two streams, minute roll-ups with a watermark, first-seen ids, idempotent multi-table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def merge_streams(summaries: DataFrame, timelines: DataFrame, key: str = "matchid", at: str = "ts", apart: str = "1 hour", late: str = "10 minutes", how: str = "inner") -> DataFrame:
    """One row per match from two streams (key, at, payload each): key, summary, timeline, their times.

    The two arrivals of a match are at most `apart` from each other, so state is bounded by that and the watermarks; with
    `left_outer` a summary whose timeline never came is given out when the watermark has passed.
    """
    s = summaries.select(F.col(key), F.col(at).alias("summary_at"), F.col("payload").alias("summary")).withWatermark("summary_at", late)
    t = timelines.select(F.col(key).alias("_key"), F.col(at).alias("timeline_at"), F.col("payload").alias("timeline")).withWatermark("timeline_at", late)
    near = F.expr(f"timeline_at between summary_at - interval {apart} and summary_at + interval {apart}")
    return s.join(t, (F.col(key) == F.col("_key")) & near, how).drop("_key")


def minute_rollup(events: DataFrame, at: str = "ts", late: str = "10 minutes", width: str = "1 minute", keys: tuple = ("event_type",)) -> DataFrame:
    """Counts and sums per window and key; events later than the watermark are dropped, so state stays bounded."""
    out = events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "value")


def first_seen_stream(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def write_tables(stream: DataFrame, split: dict, base: str, checkpoint: str, name: str = "ingest") -> StreamingQuery:
    """Each batch into several tables: `split` maps table names to functions of the batch.

    A batch writes under its own number, so a repeated batch replaces what its first attempt left.
    """

    def write(batch: DataFrame, number: int) -> None:
        for table, rows in split.items():
            rows(batch).write.mode("overwrite").parquet(f"{base}/{table}/batch={number}")

    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()

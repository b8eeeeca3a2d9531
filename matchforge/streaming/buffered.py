"""A sink for many tables that gathers rows until a table has enough of them, or has waited long enough.

Rows wait in state, keyed by table and shard, so they outlive a restart; a full buffer is given out at once, and a timer, set
when the first row comes, gives out what is there. A busy table is spread over its shards. What is given out carries the number of
the flush and its cause, and every batch writes under its own number, so a repeated batch replaces what its first attempt left.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Timers and lists of state need this provider; it is a setting of the session.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FLUSHED = "table string, shard int, flush long, cause string, payload string"


class Buffer(StatefulProcessor):
    """Holds payloads of one table and shard until there are `size` of them or the first has waited `wait_ms`."""

    def __init__(self, size: int, wait_ms: int):
        self.size, self.wait_ms = size, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "payload string")
        self.held = handle.getValueState("held", "n long, flush long")

    def _state(self) -> tuple[int, int]:
        return tuple(self.held.get()) if self.held.exists() else (0, 0)

    def _flush(self, key, cause: str) -> Iterator[Row]:
        _, number = self._state()
        rows = list(self.rows.get()) if self.rows.exists() else []
        for (payload,) in rows:
            yield Row(table=key[0], shard=key[1], flush=number, cause=cause, payload=payload)
        self.rows.clear()
        self.held.update((0, number + 1))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            n, number = self._state()
            self.rows.appendValue((row.payload,))
            self.held.update((n + 1, number))
            if n == 0:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
            if n + 1 >= self.size:
                yield from self._flush(key, "size")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self._state()[0]:
            yield from self._flush(key, "time")

    def close(self) -> None:
        pass


def buffered(stream: DataFrame, size: int, wait_ms: int, shards: int = 8) -> DataFrame:
    """(table, shard, flush, cause, payload) of a stream of (table, payload): rows in flushes of `size`, or of what came within `wait_ms`.

    `size` counts per shard, so a task holds at most that many rows of a table. Null payloads are rows too.
    """
    if stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    keyed = stream.select("table", "payload", F.pmod(F.xxhash64("payload"), F.lit(shards)).cast("int").alias("shard"))
    return keyed.groupBy("table", "shard").transformWithState(statefulProcessor=Buffer(size, wait_ms), outputStructType=FLUSHED, outputMode="Append", timeMode="ProcessingTime")


def write_flushes(flushes: DataFrame, schemas: dict[str, str], base: str, checkpoint: str, every: str = "1 second", name: str = "buffered") -> StreamingQuery:
    """Write flushed payloads (JSON) into one table per name in `schemas`, in folders by batch; payloads of other tables go to `_other` as text."""

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():  # most batches only look at timers
            return
        for table, schema in schemas.items():
            rows = batch.where(F.col("table") == table).select("flush", "shard", "cause", F.from_json("payload", schema).alias("d"))
            rows.select("flush", "shard", "cause", "d.*").write.mode("overwrite").parquet(f"{base}/{table}/batch={number}")
        other = batch.where(~F.col("table").isin(*schemas) | F.col("table").isNull())
        other.write.mode("overwrite").parquet(f"{base}/_other/batch={number}")

    return flushes.writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(processingTime=every).start()

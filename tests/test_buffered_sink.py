"""The buffered sink: flushes by size and by time, and a restart between them."""

import json
import time

import pytest

from matchforge.streaming import buffered


@pytest.fixture
def session(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, buffered.PROVIDER)
    yield spark
    spark.conf.set(key, before)


def rows_of(spark, path):
    try:
        return spark.read.option("pathGlobFilter", "*.parquet").parquet(path).collect()
    except Exception:
        return []


def wait_for(what, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if what():
            return True
        time.sleep(0.5)
    return False


def test_flushes_by_size_and_by_time_and_after_a_restart(session, tmp_path):
    spark = session

    def put(n, table, ids):
        rows = [(table, json.dumps({"id": i})) for i in ids]
        spark.createDataFrame(rows, "table string, payload string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    put(0, "kills", range(5))
    put(0, "wards", range(2))

    def start(wait_ms):
        stream = spark.readStream.schema("table string, payload string").parquet(f"{tmp_path}/in")
        return buffered.write_flushes(buffered.buffered(stream, 5, wait_ms, shards=1), {"kills": "id long", "wards": "id long"}, f"{tmp_path}/out", f"{tmp_path}/cp")

    q = start(3_600_000)
    try:
        assert wait_for(lambda: len(rows_of(spark, f"{tmp_path}/out/kills")) == 5)
        assert {r.cause for r in rows_of(spark, f"{tmp_path}/out/kills")} == {"size"} and rows_of(spark, f"{tmp_path}/out/wards") == []
    finally:
        q.stop()
    put(1, "wards", range(2, 5))  # what waits in state and what comes after the restart make one flush
    put(1, "kills", range(5, 7))
    put(1, "odd", [1])
    q = start(1_000)
    try:
        assert wait_for(lambda: len(rows_of(spark, f"{tmp_path}/out/wards")) == 5 and len(rows_of(spark, f"{tmp_path}/out/kills")) == 7 and len(rows_of(spark, f"{tmp_path}/out/_other")) == 1)
    finally:
        q.stop()
    wards, kills = (sorted((r.flush, r.cause, r.id) for r in rows_of(spark, f"{tmp_path}/out/{t}")) for t in ("wards", "kills"))
    assert wards == [(0, "size", i) for i in range(5)]
    assert kills == [(0, "size", i) for i in range(5)] + [(1, "time", i) for i in (5, 6)]


def test_the_provider_is_asked_for(spark, tmp_path):
    spark.createDataFrame([("t", "{}")], "table string, payload string").write.parquet(f"{tmp_path}/in")
    with pytest.raises(ValueError, match="providerClass"):
        buffered.buffered(spark.readStream.schema("table string, payload string").parquet(f"{tmp_path}/in"), 5, 10)

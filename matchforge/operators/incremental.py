"""Incremental ingestion as batch operators: anchors, queues, claims, outcomes, gaps, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.operators.windows import hash_order, interleave, limit_by


def latest_run(anchors: DataFrame, name: str) -> DataFrame:
    """The run id last stored under a name."""
    return anchors.where(F.col("name") == name).agg(F.max_by("run_id", F.struct("stored_at", "run_id")).alias("run_id"))


def latest_snapshot(df: DataFrame, anchors: DataFrame, name: str) -> DataFrame:
    return df.join(latest_run(anchors, name), "run_id", "left_semi")


def seed_queue(ids: DataFrame, done: list[DataFrame], queued: DataFrame, key: str = "matchid") -> DataFrame:
    """Distinct ids not yet complete (complete: in all of `done`) and not yet queued."""
    complete = done[0].select(key)
    for d in done[1:]:
        complete = complete.intersect(d.select(key))
    return ids.select(key).distinct().join(complete, key, "left_anti").join(queued.select(key), key, "left_anti")


def claim(queue: DataFrame, group: str, key: str, per_group: int, n: int, salt: str = "") -> DataFrame:
    """A batch of n: at most `per_group` of each group in hashed order, groups taken in turn."""
    some = limit_by(queue, [group], hash_order(key, salt), per_group)
    return interleave(some, group, hash_order(key, salt)).orderBy("turn", group).limit(n)


def resolve_batch(outcomes: DataFrame, streams: int = 2) -> DataFrame:
    """finish, retire or requeue each id from its streams' outcomes (success, terminal, other)."""
    out = outcomes.groupBy("matchid").agg(F.sum((F.col("outcome") == "success").cast("int")).alias("ok"), F.max((F.col("outcome") == "terminal").cast("int")).alias("dead"))
    return out.select("matchid", F.when(F.col("dead") == 1, "retire").when(F.col("ok") >= streams, "finish").otherwise("requeue").alias("action"))


def crawl_windows(players: DataFrame, collected: DataFrame, floor, now) -> DataFrame:
    """From when to crawl each player: the last collection, not before `floor`, not after `now`."""
    last = collected.groupBy("puuid").agg(F.max("collected_at").alias("last"))
    return players.select("puuid").distinct().join(last, "puuid", "left").select("puuid", F.least(F.greatest(F.coalesce("last", F.lit(floor)), F.lit(floor)), F.lit(now)).alias("since"))


def presence(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Which of two sources has each key; `partial` where only one does."""
    rows = a.select(key, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(key, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    return rows.groupBy(key).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b")).withColumn("partial", (F.col("in_a") != F.col("in_b")).cast("int"))


def classify_gaps(ids: DataFrame, info: DataFrame, timeline: DataFrame, metadata: DataFrame, valid: DataFrame, key: str = "matchid") -> DataFrame:
    """complete, stream_partial, metadata_only or blocked, for each id."""
    out = ids.select(key).distinct()
    for name, d in (("info", info), ("tl", timeline), ("meta", metadata), ("ok", valid)):
        out = out.join(d.select(key).distinct().withColumn(name, F.lit(1)), key, "left").fillna(0, [name])
    both = (F.col("info") == 1) & (F.col("tl") == 1)
    cls = F.when(both & (F.col("meta") == 1), "complete").when(F.col("info") != F.col("tl"), "stream_partial").when(both & (F.col("ok") == 1), "metadata_only").otherwise("blocked")
    return out.select(key, cls.alias("gap"))


def rebuild_metadata(participants: DataFrame, size: int = 10) -> DataFrame:
    """Ordered player ids of matches that have exactly `size` distinct participants."""
    rows = participants.groupBy("matchid").agg(F.array_sort(F.collect_set(F.struct("participantid", "puuid"))).alias("p"))
    return rows.where(F.size("p") == size).select("matchid", F.transform("p", lambda x: x["puuid"]).alias("participants"))


def delete_where(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows that a delete by key leaves."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def first_seen(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return limit_by(df, key, order, 1)


def missing_streams(ids: DataFrame, streams: dict[str, DataFrame], key: str = "matchid") -> DataFrame:
    """key, missing: the stream that each id lacks, or `both`; ids that lack none are left out."""
    out = ids.select(key).distinct()
    for name, rows in streams.items():
        out = out.join(rows.select(key).distinct().withColumn(f"_{name}", F.lit(1)), key, "left")
    lacking = {n: F.col(f"_{n}").isNull() for n in streams}
    first, second = streams
    missing = F.when(lacking[first] & lacking[second], "both").when(lacking[first], first).when(lacking[second], second)
    return out.select(key, missing.alias("missing")).where("missing is not null")


def anchored(rows: DataFrame, anchors: DataFrame, run: str = "run_id") -> DataFrame:
    """Rows of runs that an anchor names; what failed runs have left is not among them."""
    return rows.join(anchors.select(run).distinct(), run, "left_semi")


def merge_payloads(info: DataFrame, timeline: DataFrame, key: str, one: str, two: str) -> DataFrame:
    """One row per match from two streams: key, both payloads, complete (1 where both are there)."""
    out = info.select(key, one).join(timeline.select(key, two), key, "full")
    return out.withColumn("complete", (F.col(one).isNotNull() & F.col(two).isNotNull()).cast("int"))

"""Identity profiles: sufficient statistics and their roll-ups, shares, opponents, standardising, minute buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchforge.functions.scalar import clip, over_one, signed_log
from matchforge.operators.selection import middle_rows, quantiles


def identity_base(players: DataFrame, keys: list[str], stats: list[str]) -> DataFrame:
    """Sums of statistics per identity, with the number of games and the time played; players without champion or role are left out."""
    known = players.where("championid is not null and teamposition not in ('', 'UNKNOWN')")
    return known.groupBy(*keys).agg(F.count("*").alias("matchups"), F.sum("timeplayed").alias("timeplayed_sum"), *[F.sum(s).cast("double").alias(s) for s in stats])


def rollup_level(base: DataFrame, keys: list[str], stats: list[str]) -> DataFrame:
    """A coarser level from sufficient statistics: no second scan of games."""
    return base.groupBy(*keys).agg(F.sum("matchups").alias("matchups"), F.sum("timeplayed_sum").alias("timeplayed_sum"), *[F.sum(s).alias(s) for s in stats])


def metric_values(level: DataFrame, keys: list[str], rates: list[str], per_minute: list[str]) -> DataFrame:
    minute = lambda s: F.when(F.col("timeplayed_sum") > 0, 60.0 * F.col(s) / F.col("timeplayed_sum")).otherwise(0.0)
    return level.select(*keys, "matchups", *[(F.col(s) / F.col("matchups")).alias(s) for s in rates], *[minute(s).alias(f"{s}_per_min") for s in per_minute])


def final_snapshot(frames: DataFrame, keys: list[str], at: str, stats: list[str]) -> DataFrame:
    """The last frame's statistics of each key."""
    return frames.groupBy(*keys).agg(F.max_by(F.struct(*stats), F.col(at)).alias("s")).select(*keys, "s.*")


def team_shares(players: DataFrame, stats: list[str]) -> DataFrame:
    """Own part of the team's sum, and how concentrated the team is (sum of squared shares); all sums in one window over the team."""
    team = Window.partitionBy("matchid", "teamid")
    own = lambda s: F.col(s).cast("double")
    sums = [x for s in stats for x in (F.sum(own(s)).over(team).alias(f"_total_{s}"), F.sum(own(s) * F.col(s)).over(team).alias(f"_squares_{s}"))]
    out = players.select("*", *sums)
    made = []
    for s in stats:
        total = F.col(f"_total_{s}")
        made += [over_one(own(s), total).alias(f"{s}_share"), F.when(total > 0, F.col(f"_squares_{s}") / (total * total)).otherwise(0.0).alias(f"{s}_concentration")]
    return out.select(*players.columns, *made)


def versus_opponent(players: DataFrame, stats: list[str]) -> DataFrame:
    """Difference and relative advantage to the opponent in one's role, where exactly two play it: pair sum less self; one window over the role."""
    role = Window.partitionBy("matchid", "teamposition")
    own = lambda s: F.col(s).cast("double")
    out = players.select("*", F.count("*").over(role).alias("_n"), *[F.sum(own(s)).over(role).alias(f"_pair_{s}") for s in stats]).where("_n = 2")
    made = []
    for s in stats:
        other = F.col(f"_pair_{s}") - own(s)
        made += [(own(s) - other).alias(f"{s}_diff"), ((own(s) - other) / F.greatest(F.abs(own(s)) + F.abs(other), F.lit(1.0))).alias(f"{s}_advantage")]
    return out.select(*players.columns, *made)


def median_mad(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long table (metric, median, mad): exact medians of rows of metric and value, found by selection."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]))).where("value is not null")
    centre = quantiles(long, ["metric"], "value", {"median": 0.5}, few=True)
    spread = long.join(F.broadcast(centre), "metric").select("metric", F.abs(F.col("value") - F.col("median")).alias("value"))
    return centre.join(quantiles(spread, ["metric"], "value", {"mad": 0.5}, few=True), "metric")


def standardise(df: DataFrame, columns: list[str], keys: list[str], limit: float = 8.0) -> DataFrame:
    """Long table (keys, metric, z): signed log, median and 1.4826 MAD (1 where it is about 0), cut at the limit."""
    logged = df.select(*keys, *[signed_log(F.col(c).cast("double")).alias(c) for c in columns])
    scale = median_mad(logged, columns)
    long = logged.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in columns])))
    width = F.when(F.col("mad") * 1.4826 > 1e-9, F.col("mad") * 1.4826).otherwise(1.0)
    return long.join(F.broadcast(scale), "metric").select(*keys, "metric", clip((F.col("value") - F.col("median")) / width, -limit, limit).alias("z"))


def temporal_bins(events: DataFrame, keys: list[str], bucket: Column, stats: dict[str, Column]) -> DataFrame:
    """Sums per key and time bucket, with the number of frames."""
    return events.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("frames"), *[F.sum(v).alias(k) for k, v in stats.items()])


def temporal_shrink(bins: DataFrame, key: str, parent: str, value: str, parent_strength: float = 1000.0, strength: float = 100.0) -> DataFrame:
    """Bucket means shrunk twice: parents to the bucket's overall mean, keys to their parent; unobserved buckets get the parent's.

    `bins` holds key, parent, bucket, frames and the sum `value`.
    """
    world = bins.groupBy("bucket").agg((F.sum(value) / F.sum("frames")).alias("_world"))
    parents = bins.groupBy(parent, "bucket").agg(F.sum(value).alias("_pv"), F.sum("frames").alias("_pn"))
    ids = bins.select(key, parent).distinct()
    grid = ids.join(parents.join(world, "bucket"), parent)
    near = (F.col("_pv") + parent_strength * F.col("_world")) / (F.col("_pn") + parent_strength)
    own = grid.join(bins.select(key, "bucket", "frames", value), [key, "bucket"], "left")
    n = F.coalesce("frames", F.lit(0))
    shrunk = (F.coalesce(F.col(value), F.lit(0.0)) + strength * near) / (n + strength)
    return own.select(key, parent, "bucket", shrunk.alias("mean"), (n > 0).cast("int").alias("observed"))


def combine_contexts(shares: DataFrame, duels: DataFrame, keys: list[str], counts: dict[str, str]) -> DataFrame:
    """Two aggregates of the same keys side by side, each value over its own count (one at least); what one lacks is 0."""
    out = shares.join(duels, keys, "left").fillna(0, [c for c in (*counts, *counts.values())])
    return out.withColumns({v: F.col(v) / F.greatest(F.col(n), F.lit(1)) for v, n in counts.items()})


def temporal_events(events: DataFrame) -> DataFrame:
    """Kills, assists, deaths and plates by lane of every participant and minute: one row per event, exploded by whom it counts for."""
    kill, plate = F.col("type") == "CHAMPION_KILL", F.col("type") == "TURRET_PLATE_DESTROYED"
    one = lambda who, what: F.array(F.struct(who.cast("int").alias("participantid"), what.alias("what")))
    none = F.array().cast("array<struct<participantid:int,what:string>>")
    helped = F.transform(F.coalesce("assistingParticipantIds", F.array().cast("array<int>")), lambda a: F.struct(a.alias("participantid"), F.lit("assists").alias("what")))
    lane = F.when(F.col("laneType") == "TOP_LANE", "plate_top").when(F.col("laneType") == "MID_LANE", "plate_mid").otherwise("plate_bot")
    parts = F.when(kill, F.concat(one(F.col("killerId"), F.lit("kills")), one(F.col("victimId"), F.lit("deaths")), helped)).when(plate, one(F.col("killerId"), lane)).otherwise(none)
    rows = events.where(kill | plate).select("matchid", "frame_timestamp", F.inline(parts)).where("participantid > 0")
    names = ["kills", "assists", "deaths", "plate_top", "plate_mid", "plate_bot"]
    return rows.groupBy("matchid", "participantid", "frame_timestamp").agg(*[F.count(F.when(F.col("what") == n, 1)).alias(n) for n in names])


def temporal_standardise(df: DataFrame, keys: list[str], bucket: str, value: str, limit: float = 8.0) -> DataFrame:
    """keys, bucket, mask (1 where observed), z: signed log by the median and MAD of its bucket, cut at the limit; 0 where unobserved.

    Medians are the middle row of each bucket (the lower of two), found by selection.
    """
    logged = df.select(*keys, bucket, signed_log(F.col(value).cast("double")).alias("_v"))
    centre = middle_rows(logged.where("_v is not null"), [bucket], "_v").withColumnRenamed("_v", "_m")
    near = logged.join(centre, bucket, "left").withColumn("_a", F.abs(F.col("_v") - F.col("_m")))
    width = middle_rows(near.where("_a is not null"), [bucket], "_a").withColumnRenamed("_a", "_s")
    scale = F.when(F.col("_s") * 1.4826 > 1e-9, F.col("_s") * 1.4826).otherwise(1.0)
    z = F.coalesce(clip((F.col("_v") - F.col("_m")) / scale, -limit, limit), F.lit(0.0))
    return near.join(width, bucket, "left").select(*keys, bucket, F.col("_v").isNotNull().cast("int").alias("mask"), z.alias("z"))


def prior_levels(base: DataFrame, levels: dict[str, list[str]], sums: list[str], sibling_keys: list[str], sibling_build: Column) -> DataFrame:
    """Coarser levels of sufficient statistics as one table (level, key, sums), and the sibling level: the same table under the sibling build.

    A null in a key reads as a zero character, so it is never taken for another key.
    """
    text = lambda keys: F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys])
    out = None
    for name, keys in levels.items():
        part = base.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums]).select(F.lit(name).alias("level"), text(keys).alias("key"), *sums)
        out = part if out is None else out.unionByName(part)
    sibling = base.withColumn("build", sibling_build)
    return out.unionByName(sibling.select(F.lit("sibling").alias("level"), text(sibling_keys).alias("key"), *sums))


def static_champion(stats: DataFrame, levels: int = 18) -> DataFrame:
    """Champion statistics with their values at the last level: flat + (levels - 1) * per level, for every pair of such columns."""
    names = [c.removesuffix("_flat") for c in stats.columns if c.endswith("_flat")]
    return stats.select("*", *[(F.coalesce(f"{n}_flat", F.lit(0.0)) + (levels - 1) * F.coalesce(f"{n}_perLevel", F.lit(0.0))).alias(f"{n}_at_{levels}") for n in names])

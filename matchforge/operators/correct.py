"""Correction of statistics that are padded after a match is decided: what happens in the last seconds is taken out again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.operators.joins import tail_window

WINDOW_MS = 15_000
#: Share of an item's price that a sale returns.
SALE_SHARE = 0.7
DELTAS = ["kills", "deaths", "assists", "damage_dealt", "damage_taken", "goldspent"]


def match_ends(events: DataFrame, at: str = "timestamp") -> DataFrame:
    return events.groupBy("matchid").agg(F.max(at).alias("end_at"))


def padding(events: DataFrame, ends: DataFrame, keys: list[str], width=WINDOW_MS) -> DataFrame:
    """Events in the tail of their match, one row per key."""
    return tail_window(events, ends, "matchid", "timestamp", "end_at", width).dropDuplicates(keys)


def delta_totals(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Sum of partial deltas: parts hold the keys and some of the columns of DELTAS."""
    full = [p.select(*keys, *[(F.col(d) if d in p.columns else F.lit(0)).cast("double").alias(d) for d in DELTAS]) for p in parts]
    return reduce(DataFrame.unionByName, full).groupBy(*keys).agg(*[F.sum(d).alias(d) for d in DELTAS])


def kill_deltas(kills: DataFrame) -> list[DataFrame]:
    """Deltas of padded kills: killer, victim, and each assistant."""
    one = F.lit(1.0)
    return [
        kills.where("killerid > 0").select("matchid", F.col("killerid").alias("participantid"), one.alias("kills")),
        kills.select("matchid", F.col("victimid").alias("participantid"), one.alias("deaths")),
        kills.select("matchid", F.explode("assistingparticipantids").alias("participantid"), one.alias("assists")),
    ]


def gold_deltas(bought: DataFrame, sold: DataFrame, undone: DataFrame, prices: DataFrame) -> list[DataFrame]:
    """Gold spent in the tail: prices of purchases, less what sales return, less what undoing returns. `prices`: itemid, price."""
    priced = lambda d: d.join(prices, "itemid", "left").withColumn("price", F.coalesce("price", F.lit(0)).cast("double"))
    return [
        priced(bought).select("matchid", "participantid", F.col("price").alias("goldspent")),
        priced(sold).select("matchid", "participantid", (-F.floor(F.col("price") * SALE_SHARE + 0.5)).alias("goldspent")),
        undone.select("matchid", "participantid", (-F.col("goldgain")).alias("goldspent")),
    ]


def apply_deltas(stats: DataFrame, deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics less their deltas, never below 0; rows without deltas stay as they are."""
    named = deltas.withColumnsRenamed({d: f"_d_{d}" for d in DELTAS})
    out = stats.join(named, keys, "left")
    return out.withColumns({d: F.greatest(F.col(d) - F.coalesce(F.col(f"_d_{d}"), F.lit(0.0)), F.lit(0.0)) for d in DELTAS if d in stats.columns}).drop(*[f"_d_{d}" for d in DELTAS])


def damage_deltas(instances: DataFrame) -> list[DataFrame]:
    """Deltas of padded damage, both directions: `instances` holds matchid, dealer, victimid and three kinds of damage."""
    total = (F.col("physicaldamage") + F.col("magicdamage") + F.col("truedamage")).cast("double")
    return [
        instances.select("matchid", F.col("dealer").alias("participantid"), total.alias("damage_dealt")),
        instances.select("matchid", F.col("victimid").alias("participantid"), total.alias("damage_taken")),
    ]

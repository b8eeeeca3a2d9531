"""Corrected statistics in full: what happens in the last seconds of a long match of the latest season is taken out of twelve columns.

Kills of the tail give kills, deaths and assists; the damage tables, joined by the kill's event id, give damage of three kinds in both
directions; items bought, sold and undone give gold. Every source is read once, its rows become signed deltas, and one
aggregate adds them up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchforge.operators.correct import SALE_SHARE, WINDOW_MS

# Kinds of damage, and statistics that are corrected.
KINDS = ["physical", "magic", "true"]
DEALT = {"totaldamagedealttochampions": KINDS} | {f"{k}damagedealttochampions": [k] for k in KINDS}
TAKEN = {"totaldamagetaken": KINDS} | {f"{k}damagetaken": [k] for k in KINDS}
CORRECTED = ["kills", "deaths", "assists", *DEALT, *TAKEN, "goldspent"]
DELTAS = ["kills", "deaths", "assists", *[f"{k}_{way}" for way in ("dealt", "taken") for k in KINDS], "goldspent"]


def population(info: DataFrame, least_seconds: int = 990) -> DataFrame:
    """matchid of matches of the latest season that last longer than `least_seconds`. `info`: matchid, season, gameduration."""
    latest = info.agg(F.max("season").alias("_latest"))  # one row
    return info.join(latest, F.col("season") == F.col("_latest"), "left_semi").where(F.col("gameduration") > least_seconds).select("matchid").distinct()


def tails(game_ends: DataFrame, matches: DataFrame, width_ms: int = WINDOW_MS) -> DataFrame:
    """matchid, from_at: where the tail of each match of the population begins; matches without an end have none."""
    return game_ends.join(matches, "matchid", "left_semi").groupBy("matchid").agg((F.max("timestamp") - width_ms).alias("from_at"))


def in_tail(events: DataFrame, tail: DataFrame) -> DataFrame:
    return events.join(tail, "matchid").where(F.col("timestamp") >= F.col("from_at")).drop("from_at")


def _deltas(rows: DataFrame, *parts: tuple) -> DataFrame:
    """matchid, participantid, what, v; `parts`: (participant, what, value, whether it counts)."""
    each = F.array(*[F.when(counts, F.struct(who.cast("int").alias("participantid"), F.lit(what).alias("what"), value.cast("double").alias("v"))) for who, what, value, counts in parts])
    return rows.select("matchid", F.inline(F.array_compact(each)))


def delta_totals(tail: DataFrame, kills: DataFrame, dealt: DataFrame, received: DataFrame, bought: DataFrame, sold: DataFrame, undone: DataFrame, prices: DataFrame) -> DataFrame:
    """matchid, participantid and the sum of every delta of DELTAS.

    Kills count once per event id, purchases and sales once per match, frame, time, participant and item, undone purchases once per
    match, frame, time and participant; of rows that differ beyond that the smallest counts. Participants of number 0 are nobody. Items without a price are free.
    """
    one, yes = F.lit(1), F.lit(True)
    k = in_tail(kills, tail).groupBy("matchid", "champion_kill_event_id").agg(F.min(F.struct("killerId", "victimId", "assistingParticipantIds")).alias("_k")).select("matchid", "champion_kill_event_id", "_k.*")
    killer, victim = F.col("killerId"), F.col("victimId")
    parts = [
        _deltas(k, (killer, "kills", one, killer > 0), (victim, "deaths", one, victim > 0)),
        k.select("matchid", F.explode("assistingParticipantIds").alias("participantid"), F.lit("assists").alias("what"), F.lit(1.0).alias("v")),
    ]
    held = k.select("matchid", "champion_kill_event_id", F.col("victimId").alias("_victim"))
    for damage, dealer, taker in ((received, F.col("participantId"), F.col("_victim")), (dealt, F.col("_victim"), F.col("participantId"))):
        rows = damage.select("matchid", "champion_kill_event_id", "participantId", *[f"{kind}Damage" for kind in KINDS]).join(held, ["matchid", "champion_kill_event_id"])
        way = [(who, f"{kind}_{name}", F.coalesce(F.col(f"{kind}Damage"), F.lit(0)), who > 0) for who, name in ((dealer, "dealt"), (taker, "taken")) for kind in KINDS]
        parts.append(_deltas(rows, *way))
    price = F.coalesce("price", F.lit(0)).cast("double")
    for items, value in ((bought, price), (sold, -F.floor(price * SALE_SHARE + 0.5))):
        rows = in_tail(items, tail).select("matchid", "frame_timestamp", "timestamp", "participantId", F.col("itemId").cast("long").alias("itemid")).distinct()
        parts.append(_deltas(rows.join(prices, "itemid", "left"), (F.col("participantId"), "goldspent", value, yes)))
    back = in_tail(undone, tail).groupBy("matchid", "frame_timestamp", "timestamp", "participantId").agg(F.min("goldGain").alias("goldGain"))
    parts.append(_deltas(back, (F.col("participantId"), "goldspent", -F.col("goldGain"), yes)))
    total: dict[str, Column] = {d: F.coalesce(F.sum(F.when(F.col("what") == d, F.col("v"))), F.lit(0.0)) for d in DELTAS}
    return reduce(DataFrame.unionByName, parts).groupBy("matchid", "participantid").agg(*[v.alias(d) for d, v in total.items()])


def corrected_statistics(stats: DataFrame, matches: DataFrame, deltas: DataFrame) -> DataFrame:
    """Statistics of the population with the columns of CORRECTED less their deltas, never below 0; totals lose all three kinds.

    Other columns, and participants without deltas, stay as they are; other matches are left out.
    """
    out = stats.join(matches, "matchid", "left_semi").join(deltas.withColumnsRenamed({d: f"_d_{d}" for d in DELTAS}), ["matchid", "participantid"], "left")
    of = {"kills": ["kills"], "deaths": ["deaths"], "assists": ["assists"], "goldspent": ["goldspent"]}
    of |= {c: [f"{k}_dealt" for k in kinds] for c, kinds in DEALT.items()} | {c: [f"{k}_taken" for k in kinds] for c, kinds in TAKEN.items()}
    less = lambda names: reduce(lambda a, b: a + b, [F.coalesce(F.col(f"_d_{n}"), F.lit(0.0)) for n in names])
    fixed = {c: F.greatest(F.col(c) - less(of[c]), F.lit(0.0)).cast(stats.schema[c].dataType) for c in CORRECTED if c in stats.columns}
    return out.withColumns(fixed).select(*stats.columns)

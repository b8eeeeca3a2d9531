"""Metrics of timeline events per participant and minute, per participant, and per match.

Every event gives its parts (who, metric, amount) inside its row; one aggregate per grain sums them, with partial sums before
the shuffle. Metrics that are made from others are columns over these sums. A participant, minute or match that no event
names has no row; where it has one, what is missing counts as 0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchforge.functions.formulas import COMPOSED, COUNTED

KEYS = {"minute": ["matchid", "participantid", "frame_timestamp"], "player": ["matchid", "participantid"], "match": ["matchid"]}
LANES = ["TOP_LANE", "MID_LANE", "BOT_LANE"]
_TOWERS = [("OUTER_TURRET", LANES), ("INNER_TURRET", LANES), ("BASE_TURRET", LANES), ("NEXUS_TURRET", ["MID_LANE"])]
# Monsters and their kinds in the order of their metrics.
_MONSTERS = [("ATAKHAN", None), ("BARON_NASHOR", None), *(("DRAGON", f"{k}_DRAGON") for k in ("AIR", "CHEMTECH", "EARTH", "ELDER", "FIRE", "HEXTECH", "WATER")), ("HORDE", None), ("RIFTHERALD", None)]


def rules() -> dict[str, tuple[str, str, str]]:
    """Number of a metric: (condition on an event, column of whom it counts for, amount), as SQL expressions."""
    kill, special, building, monster = (f"type = '{t}'" for t in ("CHAMPION_KILL", "CHAMPION_SPECIAL_KILL", "BUILDING_KILL", "ELITE_MONSTER_KILL"))
    out = {"E024": (kill, "killerId", "1"), "E025": (kill, "victimId", "1"), "E026": (kill, "assistingParticipantIds", "1")}
    out |= {f"E06{i}": (f"{special} AND killType = '{k}'", "killerId", "1") for i, k in ((2, "KILL_FIRST_BLOOD"), (3, "KILL_ACE"), (4, "KILL_MULTI"))}
    out |= {f"E06{k + 3}": (f"{special} AND killType = 'KILL_MULTI' AND multiKillLength = {k}", "killerId", "multiKillLength") for k in (2, 3, 4, 5)}
    who = {"E027": ("WARD_KILL", "killerId"), "E028": ("WARD_PLACED", "creatorId"), "E029": ("ITEM_DESTROYED", "participantId"), "E030": ("ITEM_PURCHASED", "participantId"), "E031": ("ITEM_UNDO", "participantId")}
    out |= {i: (f"type = '{t}'", w, "1") for i, (t, w) in who.items()}
    out |= {f"E{69 + i:03}": (f"type = 'TURRET_PLATE_DESTROYED' AND laneType = '{lane}'", "killerId", "1") for i, lane in enumerate(LANES)}
    out |= {"E033": (kill, "killerId", "bounty"), "E035": (kill, "killerId", "shutdownBounty"), "E049": (building, "killerId", "bounty"), "E050": (monster, "killerId", "bounty")}
    places = [(f"buildingType = 'TOWER_BUILDING' AND towerType = '{t}'", lane) for t, lanes in _TOWERS for lane in lanes] + [("buildingType = 'INHIBITOR_BUILDING' AND towerType IS NULL", lane) for lane in LANES]
    out |= {f"E{36 + i:03}": (f"{building} AND {kind} AND laneType = '{lane}'", "killerId", "1") for i, (kind, lane) in enumerate(places)}
    kinds = [f"monsterType = '{m}' AND monsterSubType " + ("IS NULL" if s is None else f"= '{s}'") for m, s in _MONSTERS]
    out |= {f"E{51 + i:03}": (f"{monster} AND {kind}", "matchid", "involved") for i, kind in enumerate(kinds)}
    return out


def composed(number: str) -> Column:
    """Column of a metric made from others, over columns that are named by number."""
    formula = COMPOSED[number][2]
    while nested := [m for m in dict.fromkeys(re.findall(r"E\d{3}", formula)) if m in COMPOSED]:
        for m in nested:
            formula = formula.replace(m, f"({COMPOSED[m][2]})")
    return F.expr(formula).cast("double")


def event_metrics(events: DataFrame, grain: str) -> DataFrame:
    """All metrics of one grain (minute, player or match), one row per key and one column per metric, by its name."""
    wanted = {n: r for n, r in rules().items() if COUNTED[n][1] == grain}
    rows = events.withColumn("involved", 1 + F.size(F.coalesce("assistingParticipantIds", F.array().cast("array<int>"))))
    parts = []
    for number, (condition, who, amount) in wanted.items():
        whom = F.col(who) if who == "assistingParticipantIds" else F.array(F.lit(0) if grain == "match" else F.col(who))
        made = F.transform(whom, lambda w: F.struct(w.cast("int").alias("participantid"), F.lit(number).alias("metric"), F.expr(amount).cast("double").alias("amount")))  # noqa: B023
        parts.append(F.coalesce(F.when(F.expr(condition), made), F.array().cast("array<struct<participantid:int,metric:string,amount:double>>")))
    sums = [F.coalesce(F.sum(F.when(F.col("metric") == n, F.col("amount"))), F.lit(0.0)).alias(n) for n in wanted]
    if grain == "player":
        # The timer and the average streak are no sums; a player who has none of them counts as 0.
        none = "array<struct<participantid:int,metric:string,amount:double>>"
        one = lambda kind, who, number, amount: F.when(F.col("type") == kind, F.array(F.struct(F.col(who).cast("int").alias("participantid"), F.lit(number).alias("metric"), amount.cast("double").alias("amount"))))
        parts.append(F.coalesce(one("LEVEL_UP", "participantId", "E032", F.col("timestamp") / 1000), F.array().cast(none)))
        parts.append(F.coalesce(one("CHAMPION_KILL", "killerId", "E034", F.col("killStreakLength")), F.array().cast(none)))
        sums.append(F.coalesce(F.max(F.when(F.col("metric") == "E032", F.col("amount"))), F.lit(0.0)).alias("E032"))
        sums.append(F.coalesce(F.avg(F.when(F.col("metric") == "E034", F.col("amount"))), F.lit(0.0)).alias("E034"))
    flat = rows.select("matchid", "frame_timestamp", F.inline(F.concat(*parts)))
    out = flat.groupBy(*KEYS[grain]).agg(*sums)
    names = [F.col(n).alias(COUNTED[n][0]) for n in COUNTED if COUNTED[n][1] == grain]
    return out.select(*KEYS[grain], *names, *[composed(n).alias(name) for n, (name, g, _) in COMPOSED.items() if g == grain])


def damage_per_death(frames: DataFrame, events: DataFrame) -> DataFrame:
    """Champion damage of a participant's minute by its deaths in that minute, one at least; the join is on the grain."""
    deaths = events.where("type = 'CHAMPION_KILL'").groupBy("matchid", F.col("victimId").alias("participantid"), "frame_timestamp").agg(F.count("*").alias("_deaths"))
    out = frames.join(deaths, KEYS["minute"], "left")
    return out.withColumn("champion_damage_per_death", F.col("totaldamagedonetochampions") / F.greatest(F.coalesce("_deaths", F.lit(0)), F.lit(1))).drop("_deaths")

"""Semantic group features of the ten slots of a match: context axes of identities, thresholds and soft ramps over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchforge.functions.scalar import clip

# The pressure at which an axis is full, and the metric behind it.
PRESSURES = {
    "damage": ("totaldamagedealttochampions", 1005.0244969622133),
    "damage_taken": ("totaldamagetaken", 1405.9442238710412),
    "heal_shield": ("ally_support", 306.31772381539395),
    "cc": ("timeccingothers", 1.8998332504215742),
    "siege": ("structure_damage", 779.2227412050119),
    "scaling": ("goldearned", 504.62949220513315),
}
# Axes that are shares of champion damage.
SHARES = {"physical": "physicaldamagedealttochampions_share", "magic": "magicdamagedealttochampions_share", "true_damage": "truedamagedealttochampions_share"}
# Thresholds, widths of ramps, champions and builds of the groups.
BURST, HARD_CC, HEAVY, HIGH_HP, RANGED = 0.952, 0.696, 0.822, 2478.5, 250.0
TANKS = ["ar_tank", "mr_tank", "ad_off_tank", "ap_off_tank"]
ENCHANTERS = ["utility_enchanter", "utility_protection"]
SKIRMISHERS, SELECTED = [887, 24, 39, 114, 77, 5], [37, 43, 117, 26]


def context_axes(metrics: DataFrame) -> DataFrame:
    """Nine axes of identities from their metrics: three damage shares, and six pressures cut to 0 to 1."""
    pressures = {a: clip(F.coalesce(F.col(m), F.lit(0.0)) / cap, 0.0, 1.0) for a, (m, cap) in PRESSURES.items()}
    return metrics.select("*", *[F.col(m).alias(a) for a, m in SHARES.items()], *[p.alias(a) for a, p in pressures.items()])


def ramp(x: Column, threshold: float, width: float) -> Column:
    """0 below threshold - width, 1 above threshold + width, straight between them."""
    return clip((x - (threshold - width)) / (2 * width), 0.0, 1.0)


def group_features(slots: DataFrame) -> DataFrame:
    """All group features of slots that hold the axes, hp (at level 18) and attack_range; names of copied axes get `group_`.

    The opponent of a slot is the other team's slot of the same role; without one its range counts as 0. One window over
    the match and role finds it, so slots meet no other slots.
    """
    c = F.col
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    tank, ranged = flag(c("build").isin(TANKS)), flag(c("attack_range") > RANGED)
    role = Window.partitionBy("matchid", "teamposition")
    other = F.coalesce(F.max(F.when(c("teamid") == 100, c("attack_range"))).over(role), F.lit(0.0)), F.coalesce(F.max(F.when(c("teamid") == 200, c("attack_range"))).over(role), F.lit(0.0))
    enchanter = flag(c("championid").isin(SELECTED) & c("build").isin(ENCHANTERS))
    whole = c("physical") + c("magic") + c("true_damage")
    most = F.when(whole > 0, F.greatest("physical", "magic", "true_damage") / whole).otherwise(1.0)
    features = {f"group_{a}": c(a) for a in (*SHARES, *PRESSURES)} | {
        "burst": flag((c("damage") >= BURST) & (tank == 0)),
        "hard_cc": flag(c("cc") >= HARD_CC),
        "frontline": tank,
        "heavy_taken": flag(c("damage_taken") >= HEAVY),
        "high_hp": flag(c("hp") >= HIGH_HP),
        "ranged": ranged,
        "skirmish": flag(c("championid").isin(SKIRMISHERS)),
        "selected_enchanter": enchanter,
        "same_role_range": flag(F.when(c("teamid") == 100, other[1]).otherwise(other[0]) > RANGED),
        "hard_cc_reliability": ramp(c("cc"), HARD_CC, 0.15),
        "frontline_intensity": F.greatest(tank, ramp(c("damage_taken"), HEAVY, 0.12), ramp(c("hp"), HIGH_HP, 225.0)),
        "range_pressure": clip((c("attack_range") - RANGED) / 400.0, 0.0, 1.0),
        "burst_pressure": ramp(c("damage"), BURST, 0.08) * (1.0 - tank),
        "scaling_pressure": c("scaling"),
        "sustain_protection": F.greatest(c("heal_shield"), enchanter),
        "mixed_damage": clip((1.0 - most) / (2.0 / 3.0), 0.0, 1.0),
    }
    return slots.select("*", *[f.alias(n) for n, f in features.items()])

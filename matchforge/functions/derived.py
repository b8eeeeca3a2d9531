"""Derived metrics of an identity as Column expressions, by name."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from matchforge.functions.scalar import ratio

c = F.col
DURABILITY = ("damageselfmitigated", "totalheal", "-totalhealsonteammates", "totaldamagetaken")
WARDS = ("detectorwardsplaced", "wardsplaced")
JUNGLE = ("totalallyjungleminionskilled", "totalenemyjungleminionskilled")
STRUCTURES = ("turretkills", "turrettakedowns", "inhibitorkills", "inhibitortakedowns")
STRUCTURE_DAMAGE = ("damagedealttobuildings", "damagedealttoturrets")
LOSSES = ("turretslost", "inhibitorslost")
SUPPORT = ("totalhealsonteammates", "totaldamageshieldedonteammates")
EPIC = ("baronkills", "dragonkills")

#: Plain sums (a leading - subtracts).
SUMS = {
    "first_blood_participation": ("firstbloodkill", "firstbloodassist"),
    "first_tower_participation": ("firsttowerkill", "firsttowerassist"),
    "early_snowball_participation": ("firstbloodkill", "firstbloodassist", "firsttowerkill", "firsttowerassist"),
    "durability_total": DURABILITY,
    "vamp_sustain": ("lifesteal", "omnivamp", "spellvamp", "physicalvamp"),
    "takedowns": ("kills", "assists"),
    "jungle_minions": JUNGLE,
    "total_farm": (*JUNGLE, "totalminionskilled"),
    "structure_takedowns": STRUCTURES,
    "structure_losses": LOSSES,
    "structure_damage": STRUCTURE_DAMAGE,
    "structure_net_control": (*STRUCTURES, "-turretslost", "-inhibitorslost"),
    "epic_kills": EPIC,
    "objective_neutral_minions": ("neutralminionskilled",),
    "objective_damage": ("damagedealttoobjectives",),
    "ally_support": SUPPORT,
    "net_combat_damage": ("totaldamagedealttochampions", "-totaldamagetaken"),
    "net_kills": ("kills", "-deaths"),
}
#: Numerator over denominator; both may be sums, or the name of another derived metric.
RATIOS = {
    "durability_total_to_deaths_ratio": (DURABILITY, "deaths"),
    "self_heal_to_durability_total_ratio": ("self_heal", DURABILITY),
    "healthmax_to_goldearned_ratio": ("healthmax", "goldearned"),
    "durability_total_to_healthmax_ratio": (DURABILITY, "healthmax"),
    "magicdamagetaken_to_durability_total_ratio": ("magicdamagetaken", DURABILITY),
    "physicaldamagetaken_to_durability_total_ratio": ("physicaldamagetaken", DURABILITY),
    "damageselfmitigated_to_durability_total_ratio": ("damageselfmitigated", DURABILITY),
    "damageselfmitigated_to_goldearned_ratio": ("damageselfmitigated", "goldearned"),
    "durability_total_to_goldearned_ratio": (DURABILITY, "goldearned"),
    "damage_taken_to_goldearned_ratio": ("totaldamagetaken", "goldearned"),
    "totaldamagetaken_to_deaths_ratio": ("totaldamagetaken", "deaths"),
    "self_heal_to_goldearned_ratio": ("self_heal", "goldearned"),
    "self_heal_to_deaths_ratio": ("self_heal", "deaths"),
    "totalheal_to_goldearned_ratio": ("totalheal", "goldearned"),
    "armor_to_goldearned_ratio": ("armor", "goldearned"),
    "magicresist_to_goldearned_ratio": ("magicresist", "goldearned"),
    "physicaldamagedealttochampions_share": ("physicaldamagedealttochampions", "totaldamagedealttochampions"),
    "magicdamagedealttochampions_share": ("magicdamagedealttochampions", "totaldamagedealttochampions"),
    "truedamagedealttochampions_share": ("truedamagedealttochampions", "totaldamagedealttochampions"),
    "champion_damage_to_total_damage_ratio": ("totaldamagedealttochampions", "totaldamagedealt"),
    "champion_damage_share_to_deaths_ratio": ("champion_damage_to_total_damage_ratio", "deaths"),
    "totaldamagedealttochampions_to_goldearned_ratio": ("totaldamagedealttochampions", "goldearned"),
    "totaldamagedealttochampions_to_deaths_ratio": ("totaldamagedealttochampions", "deaths"),
    "physicaldamagedealt_share": ("physicaldamagedealt", "totaldamagedealt"),
    "magicdamagedealt_share": ("magicdamagedealt", "totaldamagedealt"),
    "truedamagedealt_share": ("truedamagedealt", "totaldamagedealt"),
    "abilitypower_to_goldearned_ratio": ("abilitypower", "goldearned"),
    "attackdamage_to_goldearned_ratio": ("attackdamage", "goldearned"),
    "kills_to_deaths_ratio": ("kills", "deaths"),
    "assists_to_deaths_ratio": ("assists", "deaths"),
    "takedowns_to_deaths_ratio": (("kills", "assists"), "deaths"),
    "kills_to_assists_ratio": ("kills", "assists"),
    "kills_to_assists_ratio_to_goldearned_ratio": ("kills_to_assists_ratio", "goldearned"),
    "visionscore_to_ward_actions_ratio": ("visionscore", (*WARDS, "wardskilled")),
    "visionscore_to_goldearned_ratio": ("visionscore", "goldearned"),
    "wardskilled_to_wardsplaced_ratio": ("wardskilled", WARDS),
    "jungle_minion_share": (JUNGLE, (*JUNGLE, "totalminionskilled")),
    "jungle_minions_to_lane_minions_ratio": (JUNGLE, "totalminionskilled"),
    "enemy_to_ally_jungle_minions_ratio": ("totalenemyjungleminionskilled", "totalallyjungleminionskilled"),
    "enemy_jungle_minion_share": ("totalenemyjungleminionskilled", JUNGLE),
    "total_farm_to_goldearned_ratio": ((*JUNGLE, "totalminionskilled"), "goldearned"),
    "total_farm_to_deaths_ratio": ((*JUNGLE, "totalminionskilled"), "deaths"),
    "champexperience_to_goldearned_ratio": ("champexperience", "goldearned"),
    "structure_damage_to_goldearned_ratio": (STRUCTURE_DAMAGE, "goldearned"),
    "structure_damage_to_deaths_ratio": (STRUCTURE_DAMAGE, "deaths"),
    "structure_takedowns_to_goldearned_ratio": (STRUCTURES, "goldearned"),
    "structure_takedowns_to_deaths_ratio": (STRUCTURES, "deaths"),
    "cc_to_assists_ratio": ("timeccingothers", "assists"),
    "objective_damage_to_goldearned_ratio": ("damagedealttoobjectives", "goldearned"),
    "objective_damage_to_total_damage_ratio": ("damagedealttoobjectives", "totaldamagedealt"),
    "epic_monster_damage_to_objective_damage_ratio": ("damagedealttoepicmonsters", "damagedealttoobjectives"),
    "epic_kills_to_goldearned_ratio": (EPIC, "goldearned"),
    "damage_per_epic_kill": ("damagedealttoobjectives", EPIC),
    "damagedealttoobjectives_per_epic_kill_per_gold": ("damage_per_epic_kill", "goldearned"),
    "totalhealsonteammates_to_goldearned_ratio": ("totalhealsonteammates", "goldearned"),
    "totaldamageshieldedonteammates_to_goldearned_ratio": ("totaldamageshieldedonteammates", "goldearned"),
    "ally_support_to_goldearned_ratio": (SUPPORT, "goldearned"),
    "ally_support_to_assists_ratio": (SUPPORT, "assists"),
    "totalhealsonteammates_to_deaths_ratio": ("totalhealsonteammates", "deaths"),
    "totaldamageshieldedonteammates_to_deaths_ratio": ("totaldamageshieldedonteammates", "deaths"),
    "ally_support_to_deaths_ratio": (SUPPORT, "deaths"),
    "physicaldamagetaken_share": ("physicaldamagetaken", "totaldamagetaken"),
    "magicdamagetaken_share": ("magicdamagetaken", "totaldamagetaken"),
    "truedamagetaken_share": ("truedamagetaken", "totaldamagetaken"),
    "champion_damage_to_damage_taken_ratio": ("totaldamagedealttochampions", "totaldamagetaken"),
    "largestcriticalstrike_to_attackdamage_ratio": ("largestcriticalstrike", "attackdamage"),
    "goldearned_to_deaths_ratio": ("goldearned", "deaths"),
}
#: Numerator over a denominator that counts as 1 at least.
FLOORED = {
    "structure_takedowns_to_structure_damage_ratio": (STRUCTURES, STRUCTURE_DAMAGE),
    "structure_takedowns_to_losses_ratio": (STRUCTURES, LOSSES),
    "cc_effectiveness_ratio": ("timeccingothers", "totaltimeccdealt"),
    "epic_kills_to_damagedealttoobjectives_ratio": (EPIC, "damagedealttoobjectives"),
}
HELPERS = ["damage_per_epic_kill"]


def _sum(parts):
    out = F.lit(0.0)
    for p in parts:
        out = out - c(p[1:]) if p[0] == "-" else out + c(p)
    return out


def _side(x):
    if isinstance(x, tuple):
        return _sum(x)
    return expression(x) if x == "self_heal" or x in RATIOS else c(x).cast("double")


def expression(name: str):
    """The Column of a derived metric."""
    if name == "self_heal":
        return F.greatest(c("totalheal") - c("totalhealsonteammates"), F.lit(0.0))
    if name in SUMS:
        return _sum(SUMS[name])
    if name in FLOORED:
        return ratio(_side(FLOORED[name][0]), F.greatest(_side(FLOORED[name][1]), F.lit(1.0)))
    return ratio(*map(_side, RATIOS[name]))


def _parts(x) -> set:
    if isinstance(x, tuple):
        return {p.removeprefix("-") for p in x}
    return inputs(x) if x == "self_heal" or x in RATIOS else {x}


def inputs(name: str) -> set:
    """Raw columns that a derived metric reads."""
    if name == "self_heal":
        return {"totalheal", "totalhealsonteammates"}
    if name in SUMS:
        return _parts(SUMS[name])
    a, b = FLOORED.get(name) or RATIOS[name]
    return _parts(a) | _parts(b)


NAMES = [n for n in ["self_heal", *SUMS, *RATIOS, *FLOORED] if n not in HELPERS]


def add_derived(df, names: list[str] | None = None):
    """All derived metrics whose columns are there, as one select."""
    wanted = [n for n in names or NAMES if inputs(n) <= set(df.columns)]
    return df.select("*", *[expression(n).alias(n) for n in wanted])


def registry_hash() -> str:
    """Changes if any definition does: guards tables built from an older registry."""
    return hashlib.sha256(repr([(n, SUMS.get(n) or RATIOS.get(n) or FLOORED.get(n)) for n in sorted(NAMES)]).encode()).hexdigest()

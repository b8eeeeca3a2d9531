"""Formulas of metrics as text, by name: fixed values that users compare results with.

Frame, total and quantity formulas are SQL expressions over raw statistics. Event metrics that are built from others name them by
number. Formulas of identity metrics are kept here only for the SQL that the metrics of `functions.derived` are compared with.
"""

from __future__ import annotations

# Metrics of one participant in one minute frame.
FRAME = {
    "nonChampionDamageDone": "totaldamagedone - totaldamagedonetochampions",
    "nonChampionPhysicalDamageDone": "physicaldamagedone - physicaldamagedonetochampions",
    "nonChampionMagicDamageDone": "magicdamagedone - magicdamagedonetochampions",
    "nonChampionTrueDamageDone": "truedamagedone - truedamagedonetochampions",
    "spentGold": "totalgold - currentgold",
    "spentGoldRatio": "(totalgold - currentgold) / greatest(totalgold, 1)",
    "championDamageShare": "totaldamagedonetochampions / greatest(totaldamagedone, 1)",
    "nonChampionDamageShare": "(totaldamagedone - totaldamagedonetochampions) / greatest(totaldamagedone, 1)",
    "physicalChampionDamageShare": "physicaldamagedonetochampions / greatest(physicaldamagedone, 1)",
    "physicalNonChampionDamageShare": "(physicaldamagedone - physicaldamagedonetochampions) / greatest(physicaldamagedone, 1)",
    "magicChampionDamageShare": "magicdamagedonetochampions / greatest(magicdamagedone, 1)",
    "magicNonChampionDamageShare": "(magicdamagedone - magicdamagedonetochampions) / greatest(magicdamagedone, 1)",
    "trueChampionDamageShare": "truedamagedonetochampions / greatest(truedamagedone, 1)",
    "trueNonChampionDamageShare": "(truedamagedone - truedamagedonetochampions) / greatest(truedamagedone, 1)",
    "physicalDamageShare": "physicaldamagedone / greatest(totaldamagedone, 1)",
    "magicDamageShare": "magicdamagedone / greatest(totaldamagedone, 1)",
    "trueDamageShare": "truedamagedone / greatest(totaldamagedone, 1)",
    "physicalChampionDamageTypeShare": "physicaldamagedonetochampions / greatest(totaldamagedonetochampions, 1)",
    "magicChampionDamageTypeShare": "magicdamagedonetochampions / greatest(totaldamagedonetochampions, 1)",
    "trueChampionDamageTypeShare": "truedamagedonetochampions / greatest(totaldamagedonetochampions, 1)",
    "physicalNonChampionDamageTypeShare": "(physicaldamagedone - physicaldamagedonetochampions) / greatest(totaldamagedone - totaldamagedonetochampions, 1)",
    "magicNonChampionDamageTypeShare": "(magicdamagedone - magicdamagedonetochampions) / greatest(totaldamagedone - totaldamagedonetochampions, 1)",
    "trueNonChampionDamageTypeShare": "(truedamagedone - truedamagedonetochampions) / greatest(totaldamagedone - totaldamagedonetochampions, 1)",
    "physicalDamageTakenShare": "physicaldamagetaken / greatest(totaldamagetaken, 1)",
    "magicDamageTakenShare": "magicdamagetaken / greatest(totaldamagetaken, 1)",
    "trueDamageTakenShare": "truedamagetaken / greatest(totaldamagetaken, 1)",
    "totalFarm": "minionskilled + jungleminionskilled",
    "laneFarmShare": "minionskilled / greatest(minionskilled + jungleminionskilled, 1)",
    "jungleFarmShare": "jungleminionskilled / greatest(minionskilled + jungleminionskilled, 1)",
    "championDamageToDamageTakenRatio": "totaldamagedonetochampions / greatest(totaldamagetaken, 1)",
    "championDamagePerGoldEarned": "totaldamagedonetochampions / greatest(totalgold, 1)",
}

# Metrics of one participant over a whole match.
TOTAL = {
    "monsterDamageDone": "totaldamagedealt - totaldamagedealttochampions",
    "monsterPhysicalDamageDone": "physicaldamagedealt - physicaldamagedealttochampions",
    "monsterMagicDamageDone": "magicdamagedealt - magicdamagedealttochampions",
    "monsterTrueDamageDone": "truedamagedealt - truedamagedealttochampions",
    "physicalDamageChampionRatio": "physicaldamagedealttochampions / greatest(physicaldamagedealt, 1)",
    "physicalDamageMonsterRatio": "(physicaldamagedealt - physicaldamagedealttochampions) / greatest(physicaldamagedealt, 1)",
    "magicDamageChampionRatio": "magicdamagedealttochampions / greatest(magicdamagedealt, 1)",
    "magicDamageMonsterRatio": "(magicdamagedealt - magicdamagedealttochampions) / greatest(magicdamagedealt, 1)",
    "trueDamageChampionRatio": "truedamagedealttochampions / greatest(truedamagedealt, 1)",
    "trueDamageMonsterRatio": "(truedamagedealt - truedamagedealttochampions) / greatest(truedamagedealt, 1)",
    "totalDamageToChampionsToDamageTakenRatio": "totaldamagedealttochampions / greatest(totaldamagetaken, 1)",
}

# Quantities of which team shares and differences to the role opponent are taken.
QUANTITY = {
    "kills": "kills",
    "deaths": "deaths",
    "assists": "assists",
    "takedowns": "kills + assists",
    "gold": "goldearned",
    "xp": "champexperience",
    "total_farm": "totalminionskilled + totalallyjungleminionskilled + totalenemyjungleminionskilled",
    "lane_farm": "totalminionskilled",
    "jungle_farm": "totalallyjungleminionskilled + totalenemyjungleminionskilled",
    "champion_damage": "totaldamagedealttochampions",
    "total_damage": "totaldamagedealt",
    "damage_taken": "totaldamagetaken",
    "self_mitigated": "damageselfmitigated",
    "durability_total": "damageselfmitigated + totalheal - totalhealsonteammates + totaldamagetaken",
    "ally_support": "totalhealsonteammates + totaldamageshieldedonteammates",
    "cc": "timeccingothers",
    "vision_score": "visionscore",
    "ward_actions": "detectorwardsplaced + wardsplaced + wardskilled",
    "objective_damage": "damagedealttoobjectives",
    "structure_damage": "damagedealttobuildings + damagedealttoturrets",
    "epic_kills": "baronkills + dragonkills",
    "structure_takedowns": "turretkills + turrettakedowns + inhibitorkills + inhibitortakedowns",
}

# Event metrics made from others, by number: name, grain, formula.
COMPOSED = {
    "E076": ("killParticipationEventsPerMinuteBin", "minute", "E024 + E026"),
    "E077": ("kdaActivityPerMinuteBin", "minute", "E024 + E025 + E026"),
    "E078": ("netTakedownMarginPerMinuteBin", "minute", "E024 + E026 - E025"),
    "E079": ("visionActivityPerMinuteBin", "minute", "E027 + E028"),
    "E081": ("itemActivityPerMinuteBin", "minute", "E029 + E030 + E031"),
    "E082": ("netItemPurchaseActionsPerMinuteBin", "minute", "E030 - E031"),
    "E084": ("totalPlatesDestroyedPerMinuteSum", "minute", "E069 + E070 + E071"),
    "E092": ("totalObjectiveBountyGold", "player", "E049 + E050"),
    "E093": ("totalEventBountyGold", "player", "E033 + E049 + E050"),
    "E085": ("totalTowerKillsSum", "player", "E036 + E037 + E038 + E039 + E040 + E041 + E042 + E043 + E044 + E045"),
    "E086": ("totalInhibitorKillsSum", "player", "E046 + E047 + E048"),
    "E087": ("totalStructureKillsSum", "player", "E085 + E086"),
    "E088": ("totalDragonKillAssistInvolvementSum", "match", "E053 + E054 + E055 + E056 + E057 + E058 + E059"),
    "E089": ("elementalDragonKillAssistInvolvementSum", "match", "E053 + E054 + E055 + E057 + E058 + E059"),
    "E090": ("nonDragonEpicMonsterKillAssistInvolvementSum", "match", "E051 + E052 + E060 + E061"),
    "E091": ("totalEpicMonsterKillAssistInvolvementSum", "match", "E051 + E052 + E053 + E054 + E055 + E056 + E057 + E058 + E059 + E060 + E061"),
    "E072": ("kdaPerMinuteBin", "minute", "(E024 + E026) / greatest(E025, 1)"),
    "E073": ("kdPerMinuteBin", "minute", "E024 / greatest(E025, 1)"),
    "E075": ("kaPerMinuteBin", "minute", "E024 / greatest(E026, 1)"),
    "E083": ("multiKillKillSharePerMinuteBin", "minute", "(E065 + E066 + E067 + E068) / greatest(E024, 1)"),
    "E080": ("visionDenialSharePerMinuteBin", "minute", "E027 / greatest(E027 + E028, 1)"),
    "E095": ("wardPlacementToKillRatioPerMinuteBin", "minute", "E028 / greatest(E027, 1)"),
    "E094": ("shutdownBountyShare", "player", "E035 / greatest(E033, 1)"),
    "E096": ("killToBuildingBountyRatio", "player", "E033 / greatest(E049, 1)"),
    "E097": ("killToMonsterBountyRatio", "player", "E033 / greatest(E050, 1)"),
    "E098": ("buildingToMonsterBountyRatio", "player", "E049 / greatest(E050, 1)"),
    "E099": ("topLanePlateSharePerMinuteBin", "minute", "E069 / greatest(E084, 1)"),
    "E100": ("midLanePlateSharePerMinuteBin", "minute", "E070 / greatest(E084, 1)"),
    "E101": ("botLanePlateSharePerMinuteBin", "minute", "E071 / greatest(E084, 1)"),
    "E102": ("topLaneStructureShare", "player", "(E036 + E039 + E042 + E046) / greatest(E087, 1)"),
    "E103": ("midLaneStructureShare", "player", "(E037 + E040 + E043 + E045 + E047) / greatest(E087, 1)"),
    "E104": ("botLaneStructureShare", "player", "(E038 + E041 + E044 + E048) / greatest(E087, 1)"),
    "E105": ("dragonToHordeKillAssistInvolvementRatio", "match", "E088 / greatest(E060, 1)"),
    "E106": ("dragonToHeraldKillAssistInvolvementRatio", "match", "E088 / greatest(E061, 1)"),
    "E107": ("hordeToHeraldKillAssistInvolvementRatio", "match", "E060 / greatest(E061, 1)"),
    "E108": ("dragonObjectiveTrioShare", "match", "E088 / greatest(E088 + E060 + E061, 1)"),
    "E109": ("hordeObjectiveTrioShare", "match", "E060 / greatest(E088 + E060 + E061, 1)"),
    "E110": ("heraldObjectiveTrioShare", "match", "E061 / greatest(E088 + E060 + E061, 1)"),
    "E111": ("objectiveBountyShareOfEventGold", "player", "E092 / greatest(E093, 1)"),
    "E112": ("buildingBountyShareOfEventGold", "player", "E049 / greatest(E093, 1)"),
    "E113": ("monsterBountyShareOfEventGold", "player", "E050 / greatest(E093, 1)"),
    "E114": ("killBountyShareOfEventGold", "player", "E033 / greatest(E093, 1)"),
    "E115": ("shutdownShareOfEventGold", "player", "E035 / greatest(E093, 1)"),
    "E116": ("objectiveTrioConcentration", "match", "E108 * E108 + E109 * E109 + E110 * E110"),
    "E117": ("structureLaneConcentration", "player", "E102 * E102 + E103 * E103 + E104 * E104"),
    "E118": ("plateLaneConcentrationPerMinuteBin", "minute", "E099 * E099 + E100 * E100 + E101 * E101"),
    "E119": ("eventGoldSourceConcentration", "player", "E112 * E112 + E113 * E113 + E114 * E114"),
}

# Event metrics counted from events, by number: name, grain.
COUNTED = {
    "E024": ("championKillEventsPerMinuteBin", "minute"),
    "E025": ("championDeathEventsPerMinuteBin", "minute"),
    "E026": ("championAssistEventsPerMinuteBin", "minute"),
    "E062": ("firstBloodEventsPerMinuteBin", "minute"),
    "E063": ("aceEventsPerMinuteBin", "minute"),
    "E064": ("multiKillEventsPerMinuteBin", "minute"),
    "E027": ("wardsKilledPerMinuteBin", "minute"),
    "E028": ("wardsPlacedPerMinuteBin", "minute"),
    "E029": ("itemsDestroyedPerMinuteBin", "minute"),
    "E030": ("itemsPurchasedPerMinuteBin", "minute"),
    "E031": ("itemUndosPerMinuteBin", "minute"),
    "E032": ("levelUpTimerSeconds", "player"),
    "E034": ("averageKillStreakLength", "player"),
    "E065": ("doubleKillTotalKillsPerMinuteSum", "minute"),
    "E066": ("tripleKillTotalKillsPerMinuteSum", "minute"),
    "E067": ("quadraKillTotalKillsPerMinuteSum", "minute"),
    "E068": ("pentaKillTotalKillsPerMinuteSum", "minute"),
    "E069": ("topLanePlatesDestroyedPerMinuteSum", "minute"),
    "E070": ("midLanePlatesDestroyedPerMinuteSum", "minute"),
    "E071": ("botLanePlatesDestroyedPerMinuteSum", "minute"),
    "E033": ("totalKillBountyGold", "player"),
    "E035": ("totalShutdownBountyGold", "player"),
    "E049": ("totalBuildingBountyGold", "player"),
    "E050": ("totalEliteMonsterBountyGold", "player"),
    "E036": ("outerTowerKillsTopLaneSum", "player"),
    "E037": ("outerTowerKillsMidLaneSum", "player"),
    "E038": ("outerTowerKillsBotLaneSum", "player"),
    "E039": ("innerTowerKillsTopLaneSum", "player"),
    "E040": ("innerTowerKillsMidLaneSum", "player"),
    "E041": ("innerTowerKillsBotLaneSum", "player"),
    "E042": ("baseTowerKillsTopLaneSum", "player"),
    "E043": ("baseTowerKillsMidLaneSum", "player"),
    "E044": ("baseTowerKillsBotLaneSum", "player"),
    "E045": ("nexusTowerKillsMidLaneSum", "player"),
    "E046": ("inhibitorBuildingKillsTopLaneSum", "player"),
    "E047": ("inhibitorBuildingKillsMidLaneSum", "player"),
    "E048": ("inhibitorBuildingKillsBotLaneSum", "player"),
    "E051": ("atakhanKillAssistInvolvementSum", "match"),
    "E052": ("baronNashorKillAssistInvolvementSum", "match"),
    "E053": ("dragonAirKillAssistInvolvementSum", "match"),
    "E054": ("dragonChemtechKillAssistInvolvementSum", "match"),
    "E055": ("dragonEarthKillAssistInvolvementSum", "match"),
    "E056": ("dragonElderKillAssistInvolvementSum", "match"),
    "E057": ("dragonFireKillAssistInvolvementSum", "match"),
    "E058": ("dragonHextechKillAssistInvolvementSum", "match"),
    "E059": ("dragonWaterKillAssistInvolvementSum", "match"),
    "E060": ("hordeKillAssistInvolvementSum", "match"),
    "E061": ("riftHeraldKillAssistInvolvementSum", "match"),
}

# Metrics of an identity; sdiv(a, b) is a / b where b is above 1e-9, else 0.
IDENTITY = {
    "first_blood_participation": "(firstbloodkill + firstbloodassist)",
    "first_tower_participation": "(firsttowerkill + firsttowerassist)",
    "early_snowball_participation": "(firstbloodkill + firstbloodassist + firsttowerkill + firsttowerassist)",
    "durability_total": "(DUR)",
    "durability_total_to_deaths_ratio": "sdiv(DUR, deaths)",
    "self_heal": "SELFHEAL",
    "self_heal_to_durability_total_ratio": "sdiv(SELFHEAL, DUR)",
    "vamp_sustain": "(lifesteal + omnivamp + spellvamp + physicalvamp)",
    "healthmax_to_goldearned_ratio": "sdiv(healthmax, goldearned)",
    "durability_total_to_healthmax_ratio": "sdiv(DUR, healthmax)",
    "magicdamagetaken_to_durability_total_ratio": "sdiv(magicdamagetaken, DUR)",
    "physicaldamagetaken_to_durability_total_ratio": "sdiv(physicaldamagetaken, DUR)",
    "damageselfmitigated_to_durability_total_ratio": "sdiv(damageselfmitigated, DUR)",
    "damageselfmitigated_to_goldearned_ratio": "sdiv(damageselfmitigated, goldearned)",
    "durability_total_to_goldearned_ratio": "sdiv(DUR, goldearned)",
    "damage_taken_to_goldearned_ratio": "sdiv(totaldamagetaken, goldearned)",
    "totaldamagetaken_to_deaths_ratio": "sdiv(totaldamagetaken, deaths)",
    "self_heal_to_goldearned_ratio": "sdiv(SELFHEAL, goldearned)",
    "self_heal_to_deaths_ratio": "sdiv(SELFHEAL, deaths)",
    "totalheal_to_goldearned_ratio": "sdiv(totalheal, goldearned)",
    "armor_to_goldearned_ratio": "sdiv(armor, goldearned)",
    "magicresist_to_goldearned_ratio": "sdiv(magicresist, goldearned)",
    "physicaldamagedealttochampions_share": "sdiv(physicaldamagedealttochampions, totaldamagedealttochampions)",
    "magicdamagedealttochampions_share": "sdiv(magicdamagedealttochampions, totaldamagedealttochampions)",
    "truedamagedealttochampions_share": "sdiv(truedamagedealttochampions, totaldamagedealttochampions)",
    "champion_damage_to_total_damage_ratio": "sdiv(totaldamagedealttochampions, totaldamagedealt)",
    "champion_damage_share_to_deaths_ratio": "sdiv(sdiv(totaldamagedealttochampions, totaldamagedealt), deaths)",
    "totaldamagedealttochampions_to_goldearned_ratio": "sdiv(totaldamagedealttochampions, goldearned)",
    "totaldamagedealttochampions_to_deaths_ratio": "sdiv(totaldamagedealttochampions, deaths)",
    "physicaldamagedealt_share": "sdiv(physicaldamagedealt, totaldamagedealt)",
    "magicdamagedealt_share": "sdiv(magicdamagedealt, totaldamagedealt)",
    "truedamagedealt_share": "sdiv(truedamagedealt, totaldamagedealt)",
    "abilitypower_to_goldearned_ratio": "sdiv(abilitypower, goldearned)",
    "attackdamage_to_goldearned_ratio": "sdiv(attackdamage, goldearned)",
    "takedowns": "(kills + assists)",
    "kills_to_deaths_ratio": "sdiv(kills, deaths)",
    "assists_to_deaths_ratio": "sdiv(assists, deaths)",
    "takedowns_to_deaths_ratio": "sdiv(kills + assists, deaths)",
    "kills_to_assists_ratio": "sdiv(kills, assists)",
    "kills_to_assists_ratio_to_goldearned_ratio": "sdiv(sdiv(kills, assists), goldearned)",
    "visionscore_to_ward_actions_ratio": "sdiv(visionscore, detectorwardsplaced + wardsplaced + wardskilled)",
    "visionscore_to_goldearned_ratio": "sdiv(visionscore, goldearned)",
    "wardskilled_to_wardsplaced_ratio": "sdiv(wardskilled, detectorwardsplaced + wardsplaced)",
    "jungle_minions": "(JUNGLE)",
    "jungle_minion_share": "sdiv(JUNGLE, JUNGLE + totalminionskilled)",
    "jungle_minions_to_lane_minions_ratio": "sdiv(JUNGLE, totalminionskilled)",
    "total_farm": "(JUNGLE + totalminionskilled)",
    "enemy_to_ally_jungle_minions_ratio": "sdiv(totalenemyjungleminionskilled, totalallyjungleminionskilled)",
    "enemy_jungle_minion_share": "sdiv(totalenemyjungleminionskilled, JUNGLE)",
    "total_farm_to_goldearned_ratio": "sdiv(JUNGLE + totalminionskilled, goldearned)",
    "total_farm_to_deaths_ratio": "sdiv(JUNGLE + totalminionskilled, deaths)",
    "champexperience_to_goldearned_ratio": "sdiv(champexperience, goldearned)",
    "structure_takedowns": "(STRUCT)",
    "structure_losses": "turretslost + inhibitorslost",
    "structure_damage": "(damagedealttobuildings + damagedealttoturrets)",
    "structure_takedowns_to_structure_damage_ratio": "sdiv(STRUCT, greatest(damagedealttobuildings + damagedealttoturrets, 1.0))",
    "structure_damage_to_goldearned_ratio": "sdiv(damagedealttobuildings + damagedealttoturrets, goldearned)",
    "structure_damage_to_deaths_ratio": "sdiv(damagedealttobuildings + damagedealttoturrets, deaths)",
    "structure_takedowns_to_goldearned_ratio": "sdiv(STRUCT, goldearned)",
    "structure_takedowns_to_deaths_ratio": "sdiv(STRUCT, deaths)",
    "structure_takedowns_to_losses_ratio": "sdiv(STRUCT, greatest(turretslost + inhibitorslost, 1.0))",
    "structure_net_control": "(STRUCT - turretslost - inhibitorslost)",
    "cc_effectiveness_ratio": "sdiv(timeccingothers, greatest(totaltimeccdealt, 1.0))",
    "cc_to_assists_ratio": "sdiv(timeccingothers, assists)",
    "epic_kills": "baronkills + dragonkills",
    "objective_neutral_minions": "neutralminionskilled",
    "objective_damage": "damagedealttoobjectives",
    "epic_kills_to_damagedealttoobjectives_ratio": "sdiv(baronkills + dragonkills, greatest(damagedealttoobjectives, 1.0))",
    "objective_damage_to_goldearned_ratio": "sdiv(damagedealttoobjectives, goldearned)",
    "objective_damage_to_total_damage_ratio": "sdiv(damagedealttoobjectives, totaldamagedealt)",
    "epic_monster_damage_to_objective_damage_ratio": "sdiv(damagedealttoepicmonsters, damagedealttoobjectives)",
    "epic_kills_to_goldearned_ratio": "sdiv(baronkills + dragonkills, goldearned)",
    "damagedealttoobjectives_per_epic_kill_per_gold": "sdiv(sdiv(damagedealttoobjectives, baronkills + dragonkills), goldearned)",
    "ally_support": "(totalhealsonteammates + totaldamageshieldedonteammates)",
    "totalhealsonteammates_to_goldearned_ratio": "sdiv(totalhealsonteammates, goldearned)",
    "totaldamageshieldedonteammates_to_goldearned_ratio": "sdiv(totaldamageshieldedonteammates, goldearned)",
    "ally_support_to_goldearned_ratio": "sdiv(totalhealsonteammates + totaldamageshieldedonteammates, goldearned)",
    "ally_support_to_assists_ratio": "sdiv(totalhealsonteammates + totaldamageshieldedonteammates, assists)",
    "totalhealsonteammates_to_deaths_ratio": "sdiv(totalhealsonteammates, deaths)",
    "totaldamageshieldedonteammates_to_deaths_ratio": "sdiv(totaldamageshieldedonteammates, deaths)",
    "ally_support_to_deaths_ratio": "sdiv(totalhealsonteammates + totaldamageshieldedonteammates, deaths)",
    "physicaldamagetaken_share": "sdiv(physicaldamagetaken, totaldamagetaken)",
    "magicdamagetaken_share": "sdiv(magicdamagetaken, totaldamagetaken)",
    "truedamagetaken_share": "sdiv(truedamagetaken, totaldamagetaken)",
    "champion_damage_to_damage_taken_ratio": "sdiv(totaldamagedealttochampions, totaldamagetaken)",
    "net_combat_damage": "(totaldamagedealttochampions - totaldamagetaken)",
    "net_kills": "(kills - deaths)",
    "largestcriticalstrike_to_attackdamage_ratio": "sdiv(largestcriticalstrike, attackdamage)",
    "goldearned_to_deaths_ratio": "sdiv(goldearned, deaths)",
}

"""Registered queries of the metric tables: identity, frame, total, quantity, event and semantic metrics, with their SQL."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchforge.functions import hooks, metrics
from matchforge.functions import scalar as S
from matchforge.functions.derived import NAMES, add_derived
from matchforge.functions.formulas import COMPOSED, COUNTED, FRAME, IDENTITY, QUANTITY, TOTAL
from matchforge.operators import catalog, event_metrics, hierarchy, profiles, semantic
from matchforge.plans.adapters import EVENTS, FRAME_ROWS, RAW, TIMELINE, WIDE, minute_frames, timeline, wide_players
from matchforge.plans.queries import WORLDS, query, r
from matchforge.plans.queries import _worlds as worlds

KEYS = ["championid", "teamposition", "build"]


def off(c, digits: int = 6):
    """Rounded, a little off the half, so that engines round what lies on it to one side."""
    return F.round(F.col(c) + 1e-9, digits)


def rounded(df, keys: list[str], names: dict[str, str], shift: float = 0.0, digits: int = 6):
    """Keys and columns under new names, rounded as one array: dozens of roundings in a row make a generated method too long to be compiled.

    Values are scaled as doubles before they are rounded, as DuckDB does, so that ties such as 0.2590625 go to the same side.
    """
    scale = float(10**digits)
    values = F.transform(F.array(*names), lambda x: F.round((x + shift) * scale) / scale)
    return df.select(*keys, values.alias("_v")).select(*keys, *[F.col("_v")[i].alias(n) for i, n in enumerate(names.values())])


def _closing(text: str, at: int) -> int:
    """Place of the bracket that closes the one at `at`."""
    depth = 0
    for i in range(at, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if depth == 0:
            return i
    raise ValueError(text)


def identity_sql(formula: str) -> str:
    """A formula of IDENTITY as SQL: short names and sdiv written out."""
    short = {
        "SELFHEAL": "greatest(totalheal - totalhealsonteammates, 0)",
        "DUR": "(damageselfmitigated + totalheal - totalhealsonteammates + totaldamagetaken)",
        "JUNGLE": "(totalallyjungleminionskilled + totalenemyjungleminionskilled)",
        "STRUCT": "(turretkills + turrettakedowns + inhibitorkills + inhibitortakedowns)",
    }
    for name, full in short.items():
        formula = formula.replace(name, full)
    while "sdiv(" in formula:
        at = formula.rindex("sdiv(")
        end = _closing(formula, at + 4)
        inside, depth, comma = formula[at + 5 : end], 0, None
        for i, ch in enumerate(inside):
            depth += {"(": 1, ")": -1}.get(ch, 0)
            if ch == "," and depth == 0:
                comma = i
        a, b = inside[:comma], inside[comma + 1 :]
        formula = f"{formula[:at]}(CASE WHEN ({b}) > 1e-9::DOUBLE THEN ({a}) / ({b}) ELSE 0 END){formula[end + 1 :]}"
    return formula


@query(
    "WITH " + WIDE + f", ident AS (SELECT championid, teamposition, build, count(*) AS matchups, {', '.join(f'sum({n})::DOUBLE / count(*) AS {n}' for n in RAW)} FROM wide GROUP BY ALL) SELECT championid, teamposition, build, "
    + ", ".join(f"round(({identity_sql(f)})::DOUBLE + 1e-9::DOUBLE, 5) AS m_{n}" for n, f in IDENTITY.items()) + " FROM ident"
)
def der_all_identity_metrics(spark, d):
    """All 89 derived metrics of every identity."""
    base = profiles.identity_base(wide_players(spark, d), KEYS, RAW)
    level = profiles.metric_values(base, KEYS, RAW, [])
    return add_derived(level).select(*KEYS, *[off(n, 5).alias(f"m_{n}") for n in NAMES])


@query("WITH " + EVENTS + ", " + FRAME_ROWS + " SELECT event_id, " + ", ".join(f"round(({f})::DOUBLE, 6) AS {n}" for n, f in FRAME.items()) + " FROM frames")
def frm_all_frame_metrics(spark, d):
    return metrics.frame_metrics(minute_frames(spark, d)).select("event_id", *[r(n).alias(n) for n in FRAME])


@query("WITH " + WIDE + " SELECT matchid, participantid, " + ", ".join(f"round(({f})::DOUBLE, 6) AS {n}" for n, f in TOTAL.items()) + " FROM wide")
def tot_all_total_metrics(spark, d):
    return metrics.total_metrics(wide_players(spark, d)).select("matchid", "participantid", *[r(n).alias(n) for n in TOTAL])


# Quantities compared with the role opponent, as they are and as team shares, and those with a concentration.
DUEL = ["kills", "deaths", "takedowns", "gold", "xp", "total_farm", "lane_farm", "champion_damage", "damage_taken", "vision_score", "objective_damage", "structure_damage"]
DUEL_SHARES = ["gold", "xp", "total_farm", "champion_damage"]
CONCENTRATED = ["gold", "xp", "total_farm", "champion_damage", "kills", "damage_taken"]
TEAM = "OVER (PARTITION BY matchid, teamid)"
SHARES = (
    "WITH " + WIDE + ", q AS (SELECT matchid, participantid, teamid, teamposition, " + ", ".join(f"({f})::DOUBLE AS {n}" for n, f in QUANTITY.items()) + " FROM wide), "
    + "sh AS (SELECT *, " + ", ".join(f"{n} / greatest(sum({n}) {TEAM}, 1) AS {n}_share" for n in QUANTITY) + ", "
    + ", ".join(f"CASE WHEN sum({n}) {TEAM} > 0 THEN sum({n} * {n}) {TEAM} / (sum({n}) {TEAM} * sum({n}) {TEAM}) ELSE 0 END AS {n}_concentration" for n in CONCENTRATED) + " FROM q)"
)


def _shares(spark, d):
    q = metrics.quantities(wide_players(spark, d)).select("matchid", "participantid", "teamid", "teamposition", *[F.col(f"q_{n}").alias(n) for n in QUANTITY])
    return profiles.team_shares(q, list(QUANTITY))


@query(SHARES + " SELECT matchid, participantid, " + ", ".join([f"round({n}_share + 1e-9::DOUBLE, 6) AS {n}_team_share" for n in QUANTITY] + [f"round({n}_concentration + 1e-9::DOUBLE, 6) AS {n}_team_concentration" for n in CONCENTRATED]) + " FROM sh")
def qty_all_team_shares(spark, d):
    """Team shares of all 22 quantities and concentrations of six."""
    names = {f"{n}_share": f"{n}_team_share" for n in QUANTITY} | {f"{n}_concentration": f"{n}_team_concentration" for n in CONCENTRATED}
    return rounded(_shares(spark, d), ["matchid", "participantid"], names, 1e-9)


ROLE = "OVER (PARTITION BY matchid, teamposition)"
COMPARED = DUEL + [f"{n}_share" for n in DUEL_SHARES]


@query(
    SHARES + ", o AS (SELECT *, count(*) " + ROLE + " AS n_role, " + ", ".join(f"sum({n}) {ROLE} - {n} AS other_{n}" for n in COMPARED) + " FROM sh) SELECT matchid, participantid, "
    + ", ".join(f"round({n} - other_{n}, 6) AS {n}_diff, round(({n} - other_{n}) / greatest(abs({n}) + abs(other_{n}), 1), 6) AS {n}_advantage" for n in COMPARED) + " FROM o WHERE n_role = 2"
)
def qty_all_role_opponents(spark, d):
    """The 32 features of a participant against the opponent in its role."""
    out = profiles.versus_opponent(_shares(spark, d), COMPARED)
    return rounded(out, ["matchid", "participantid"], {c: c for c in [f"{n}_{k}" for n in COMPARED for k in ("diff", "advantage")]})


SHARE_FEATURES = [f"{n}_share" for n in QUANTITY]


@query(
    SHARES + ", o AS (SELECT *, count(*) " + ROLE + " AS n_role, kills - (sum(kills) " + ROLE + " - kills) AS kills_diff FROM sh), ids AS (SELECT matchid, participantid, championid, teamposition AS role, build FROM wide)"
    + " SELECT championid, role AS teamposition, build, count(*) AS matchups, (count(*) FILTER (WHERE n_role = 2))::BIGINT AS opponents, round(sum(gold_share) / greatest(count(*), 1), 6) AS gold_share,"
    + " round(coalesce(sum(kills_diff) FILTER (WHERE n_role = 2), 0) / greatest(count(*) FILTER (WHERE n_role = 2), 1), 6) AS kills_diff FROM o JOIN ids USING (matchid, participantid) GROUP BY ALL"
)
def pro5_context_combine(spark, d):
    """Team shares and opponent differences of identities, each with its own count (JOI-16)."""
    ids = wide_players(spark, d).select("matchid", "participantid", "championid", "build")
    rows = _shares(spark, d).join(ids, ["matchid", "participantid"])
    shares = rows.groupBy(*KEYS).agg(F.count("*").alias("matchups"), F.sum("gold_share").alias("gold_share"))
    duels = profiles.versus_opponent(rows, ["kills"]).groupBy(*KEYS).agg(F.count("*").alias("opponents"), F.sum("kills_diff").alias("kills_diff"))
    out = profiles.combine_contexts(shares, duels, KEYS, {"gold_share": "matchups", "kills_diff": "opponents"})
    return out.select(*KEYS, "matchups", "opponents", r("gold_share").alias("gold_share"), r("kills_diff").alias("kills_diff"))


# --- events --------------------------------------------------------------------------------------------------------


def _event_sql(grain: str) -> str:
    """SQL of all event metrics of a grain: every rule one select, summed by metric."""
    keys = {"minute": "matchid, who, frame_timestamp", "player": "matchid, who", "match": "matchid"}[grain]
    parts = []
    for number, (condition, who, amount) in event_metrics.rules().items():
        if COUNTED[number][1] != grain:
            continue
        amount = amount.replace("involved", "1 + len(coalesce(\"assistingParticipantIds\", []))")
        whom = f'unnest("{who}")::INT' if who == "assistingParticipantIds" else ("0" if grain == "match" else f'"{who}"')
        parts.append(f"SELECT matchid, {whom} AS who, frame_timestamp, '{number}' AS m, ({amount})::DOUBLE AS v FROM tl WHERE {condition}")
    if grain == "player":
        parts.append("SELECT matchid, \"participantId\" AS who, frame_timestamp, 'E032' AS m, \"timestamp\" / 1000 AS v FROM tl WHERE type = 'LEVEL_UP'")
        parts.append("SELECT matchid, \"killerId\" AS who, frame_timestamp, 'E034' AS m, \"killStreakLength\"::DOUBLE AS v FROM tl WHERE type = 'CHAMPION_KILL'")
    how = {"E032": "max", "E034": "avg"}
    mine = [n for n, (_, g) in COUNTED.items() if g == grain]
    sums = ", ".join(f"coalesce({how.get(n, 'sum')}(v) FILTER (WHERE m = '{n}'), 0)::DOUBLE AS {n}" for n in mine)
    made = ", ".join(f"({f})::DOUBLE AS {n}" for n, (_, g, f) in COMPOSED.items() if g == grain)
    names = ", ".join([f"round({n}, 6) AS {COUNTED[n][0]}" for n in mine] + [f"round({n}, 6) AS {name}" for n, (name, g, _) in COMPOSED.items() if g == grain])
    head = keys.replace("who", "who AS participantid")
    return f"WITH {TIMELINE}, parts AS ({' UNION ALL '.join(parts)}), sums AS (SELECT {keys}, {sums} FROM parts GROUP BY {keys}), made AS (SELECT *, {made} FROM sums) SELECT {head}, {names} FROM made"


def _event_metrics(spark, d, grain):
    out = event_metrics.event_metrics(timeline(spark, d), grain)
    keys = event_metrics.KEYS[grain]
    return out.select(*keys, *[r(c).alias(c) for c in out.columns if c not in keys])


@query(_event_sql("minute"))
def met_minute_event_metrics(spark, d):
    return _event_metrics(spark, d, "minute")


@query(_event_sql("player"))
def met_player_event_metrics(spark, d):
    return _event_metrics(spark, d, "player")


@query(_event_sql("match"))
def met_match_event_metrics(spark, d):
    return _event_metrics(spark, d, "match")


@query(
    "WITH " + TIMELINE + ", " + FRAME_ROWS + ", dd AS (SELECT matchid, \"victimId\" AS participantid, frame_timestamp, count(*) AS deaths FROM tl WHERE type = 'CHAMPION_KILL' GROUP BY ALL)"
    + " SELECT event_id, round(totaldamagedonetochampions / greatest(coalesce(deaths, 0), 1), 6) AS champion_damage_per_death FROM frames LEFT JOIN dd USING (matchid, participantid, frame_timestamp)"
)
def met8_damage_per_death(spark, d):
    out = event_metrics.damage_per_death(minute_frames(spark, d), timeline(spark, d))
    return out.select("event_id", r("champion_damage_per_death").alias("champion_damage_per_death"))


# --- semantic groups -----------------------------------------------------------------------------------------------

_CAPS = {a: c for a, (_, c) in semantic.PRESSURES.items()}
AXES = """, im AS (SELECT championid, teamposition, build, avg(physicaldamagedealttochampions) AS ph, avg(magicdamagedealttochampions) AS mg, avg(truedamagedealttochampions) AS tr, avg(totaldamagedealttochampions) AS td, avg(totaldamagetaken) AS dt,
  avg(totalhealsonteammates + totaldamageshieldedonteammates) AS sup, avg(timeccingothers) AS ccs, avg(damagedealttobuildings + damagedealttoturrets) AS sd, avg(goldearned) AS gold FROM wide GROUP BY ALL),
ax AS (SELECT championid, teamposition, build, CASE WHEN td > 1e-9 THEN ph / td ELSE 0 END AS physical, CASE WHEN td > 1e-9 THEN mg / td ELSE 0 END AS magic, CASE WHEN td > 1e-9 THEN tr / td ELSE 0 END AS true_damage,
""" + ", ".join(f"least(greatest({c} * 20 / {_CAPS[a]!r}::DOUBLE, 0), 1) AS {a}" for a, c in (("damage", "td"), ("damage_taken", "dt"), ("heal_shield", "sup"))) + ", " + ", ".join(f"least(greatest({c} * {k} / {_CAPS[a]!r}::DOUBLE, 0), 1) AS {a}" for a, c, k in (("cc", "ccs", "0.05::DOUBLE"), ("siege", "sd", "20"), ("scaling", "gold", "10"))) + " FROM im)"  # fmt: skip
_AXIS_NAMES = [*semantic.SHARES, *semantic.PRESSURES]


def _axes(spark, d):
    """Axes of identities. The made statistics are small numbers; they are scaled so that pressures take all values."""
    base = profiles.identity_base(wide_players(spark, d), KEYS, RAW)
    level = add_derived(profiles.metric_values(base, KEYS, RAW, []))
    scale = {"totaldamagedealttochampions": 20, "totaldamagetaken": 20, "ally_support": 20, "timeccingothers": 0.05, "structure_damage": 20, "goldearned": 10}
    return semantic.context_axes(level.withColumns({c: F.col(c) * k for c, k in scale.items()})).select(*KEYS, *_AXIS_NAMES)


@query("WITH " + WIDE + AXES + " SELECT championid, teamposition, build, " + ", ".join(f"round({a}, 6) AS {a}" for a in _AXIS_NAMES) + " FROM ax")
def pro17_context_axes(spark, d):
    return _axes(spark, d).select(*KEYS, *[r(a).alias(a) for a in _AXIS_NAMES])


_BUILD = "['ar_tank', 'crit', 'utility_enchanter', 'mr_tank', 'ability_power', 'ap_off_tank', 'lethality'][(championid % 7 + 1)::INT]"
_WHOLE = "(physical + magic + true_damage)"
_RAMP = lambda x, t, w: f"least(greatest(({x} - ({t} - {w})::DOUBLE) / (2 * {w})::DOUBLE, 0), 1)"
_TANK = "(build IN ('ar_tank', 'mr_tank', 'ad_off_tank', 'ap_off_tank'))"
_ENCHANTER = "(championid IN (37, 43, 117, 26) AND build IN ('utility_enchanter', 'utility_protection'))::INT"
_GROUPS = {
    **{f"group_{a}": a for a in _AXIS_NAMES},
    "burst": f"(damage >= 0.952::DOUBLE AND NOT {_TANK})::INT", "hard_cc": "(cc >= 0.696::DOUBLE)::INT", "frontline": f"{_TANK}::INT", "heavy_taken": "(damage_taken >= 0.822::DOUBLE)::INT", "high_hp": "(hp >= 2478.5)::INT", "ranged": "(attack_range > 250)::INT",
    "skirmish": "(championid IN (887, 24, 39, 114, 77, 5))::INT", "selected_enchanter": _ENCHANTER,
    "same_role_range": "(coalesce(max(CASE WHEN teamid = 100 THEN attack_range END) OVER w, 0) > 250 AND teamid = 200 OR coalesce(max(CASE WHEN teamid = 200 THEN attack_range END) OVER w, 0) > 250 AND teamid = 100)::INT",
    "hard_cc_reliability": _RAMP("cc", "0.696", "0.15"), "frontline_intensity": f"greatest({_TANK}::INT::DOUBLE, {_RAMP('damage_taken', '0.822', '0.12')}, {_RAMP('hp', '2478.5', '225.0')})", "range_pressure": "least(greatest((attack_range - 250) / 400, 0), 1)",
    "burst_pressure": f"{_RAMP('damage', '0.952', '0.08')} * (1 - {_TANK}::INT)", "scaling_pressure": "scaling", "sustain_protection": f"greatest(heal_shield, {_ENCHANTER})",
    "mixed_damage": f"least(greatest((1 - CASE WHEN {_WHOLE} > 0 THEN greatest(physical, magic, true_damage) / {_WHOLE} ELSE 1 END) / (2.0::DOUBLE / 3), 0), 1)",
}


@query(
    "WITH " + WIDE + AXES + f", sl AS (SELECT wide.matchid, wide.participantid, wide.teamid, wide.teamposition, wide.championid, {_BUILD.replace('championid', 'wide.championid')} AS build, (wide.championid * 61 % 1500 + 1200)::DOUBLE AS hp, (wide.championid * 37 % 600)::DOUBLE AS attack_range, ax.* EXCLUDE (championid, teamposition, build) FROM wide JOIN ax USING (championid, teamposition, build))"
    + " SELECT matchid, participantid, " + ", ".join(f"round(({f})::DOUBLE, 6) AS {n}" for n, f in _GROUPS.items()) + " FROM sl WINDOW w AS (PARTITION BY matchid, teamposition)"
)
def sem_all_group_features(spark, d):
    """The 25 semantic group features of every slot; health, range and build label follow from the champion here."""
    builds = F.array(*map(F.lit, ["ar_tank", "crit", "utility_enchanter", "mr_tank", "ability_power", "ap_off_tank", "lethality"]))
    slots = wide_players(spark, d).select("matchid", "participantid", "teamid", *KEYS).join(_axes(spark, d), KEYS)
    c = F.col("championid")
    slots = slots.withColumn("build", F.element_at(builds, (c % 7 + 1).cast("int"))).withColumn("hp", (c * 61 % 1500 + 1200).cast("double")).withColumn("attack_range", (c * 37 % 600).cast("double"))
    return semantic.group_features(slots).select("matchid", "participantid", *[r(n).alias(n) for n in _GROUPS])


# --- temporal metrics ------------------------------------------------------------------------------------------------


@query(
    "WITH " + TIMELINE + """, pe AS (SELECT matchid, "killerId" AS participantid, frame_timestamp, 'kills' AS e FROM tl WHERE type = 'CHAMPION_KILL' UNION ALL SELECT matchid, "victimId", frame_timestamp, 'deaths' FROM tl WHERE type = 'CHAMPION_KILL'
UNION ALL SELECT matchid, unnest("assistingParticipantIds")::INT, frame_timestamp, 'assists' FROM tl WHERE type = 'CHAMPION_KILL' UNION ALL SELECT matchid, "killerId", frame_timestamp, CASE "laneType" WHEN 'TOP_LANE' THEN 'plate_top' WHEN 'MID_LANE' THEN 'plate_mid' ELSE 'plate_bot' END FROM tl WHERE type = 'TURRET_PLATE_DESTROYED')
SELECT matchid, participantid, frame_timestamp, """ + ", ".join(f"count(*) FILTER (WHERE e = '{e}') AS {e}" for e in ("kills", "assists", "deaths", "plate_top", "plate_mid", "plate_bot")) + " FROM pe WHERE participantid > 0 GROUP BY ALL"
)
def pro14_temporal_events(spark, d):
    return profiles.temporal_events(timeline(spark, d))


@query(
    "WITH " + EVENTS + ", " + FRAME_ROWS + ", lv AS (SELECT event_id, matchid % 4 AS bucket, sign(totalgold) * ln(1 + abs(totalgold)) AS v FROM frames), md AS (SELECT bucket, quantile_disc(v, 0.5) AS m FROM lv GROUP BY bucket), ad AS (SELECT bucket, quantile_disc(abs(v - m), 0.5) AS s, any_value(m) AS m FROM lv JOIN md USING (bucket) GROUP BY bucket)"
    + " SELECT event_id, bucket, (v IS NOT NULL)::INT AS mask, round(least(greatest((v - m) / CASE WHEN s * 1.4826::DOUBLE > 1e-9::DOUBLE THEN s * 1.4826::DOUBLE ELSE 1 END, -8), 8), 5) AS z FROM lv JOIN ad USING (bucket)"
)
def pro16_temporal_standardise(spark, d):
    rows = minute_frames(spark, d).select("event_id", (F.col("matchid") % 4).alias("bucket"), "totalgold")
    out = profiles.temporal_standardise(rows, ["event_id"], "bucket", "totalgold")
    return out.select("event_id", "bucket", "mask", r("z", 5).alias("z"))


# --- smoothing of all metrics by five levels --------------------------------------------------------------------------

_RATES, _TIMED = RAW[:20], RAW[20:]
_SIBLING = {"SMALL": "LARGE", "LARGE": "SMALL", "MEDIUM": "STANDARD", "STANDARD": "MEDIUM"}
_LEVEL_KEYS = [("championid", "teamposition", "build"), ("championid", "teamposition"), ("championid", "build"), ("teamposition", "build"), ("build",)]


def _hierarchy_sql(mode: str) -> str:
    """Five joins and one expression per metric."""
    caps, sums = (20, 7, 12, 7, 4), ", ".join(f"sum({m})::DOUBLE AS {m}" for m in RAW)
    parts = [WIDE, f"b AS (SELECT championid, teamposition, build, count(*)::DOUBLE AS n, sum(timeplayed)::DOUBLE / 60 AS t, {sums} FROM wide GROUP BY ALL)"]
    parts.append("b1 AS (SELECT *, CASE build " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SIBLING.items()) + " END AS sib FROM b)")
    joins = ""
    for i, keys in enumerate(_LEVEL_KEYS):
        parts.append(f"l{i} AS (SELECT {', '.join(keys)}, sum(n) AS n, sum(t) AS t, {sums} FROM b GROUP BY ALL)")
        joins += f" LEFT JOIN l{i} ON " + " AND ".join(f"l{i}.{k} = b1.{'sib' if i == 0 and k == 'build' else k}" for k in keys) + (" AND b1.teamposition NOT IN ('UTILITY', 'JUNGLE')" if i in (2, 4) else "")
    held = ", ".join(f"l{i}.n AS n{i}, l{i}.t AS t{i}, " + ", ".join(f"l{i}.{m} AS {m}{i}" for m in RAW) for i in range(5))
    parts.append(f"j AS (SELECT b1.*, sqrt(1 + 50 / greatest(b1.n, 1)) AS amp, {held} FROM b1{joins})")
    weights = ", ".join(f"CASE WHEN n{i} > 0 THEN least(n{i}, {c}) * amp ELSE 0 END AS p{i}, CASE WHEN n{i} > 0 THEN least(n{i} * 200, {c * 200}) * amp ELSE 0 END AS q{i}" for i, c in enumerate(caps))
    chosen = "CASE " + " ".join(f"WHEN n{i} >= 50 THEN {i}" for i in range(5)) + " " + " ".join(f"WHEN n{i} IS NOT NULL THEN {i}" for i in reversed(range(5))) + " END AS chosen"
    parts.append(f"w AS (SELECT *, {weights}, {chosen} FROM j)")
    if mode == "cascade":
        parts.append("x AS (SELECT * REPLACE (" + ", ".join(f"CASE WHEN chosen IS NULL THEN {k}{i} WHEN chosen = {i} THEN {' + '.join(f'{k}{h}' for h in range(5))} ELSE 0 END AS {k}{i}" for k in "pq" for i in range(5)) + ") FROM w)")
    else:
        parts.append("x AS (SELECT * FROM w)")
    blend = lambda m, k, own, per: f"({m} + " + " + ".join(f"CASE WHEN {k}{i} > 0 AND {per}{i} > 0 THEN {m}{i} * ({k}{i} / {per}{i}) ELSE 0 END" for i in range(5)) + f") / ({own} + " + " + ".join(f"{k}{i}" for i in range(5)) + ")"
    out = [f"round({blend(m, 'p', 'n', 'n')} + 1e-9::DOUBLE, 5) AS {m}" for m in _RATES] + [f"round({blend(m, 'q', 't', 't')} + 1e-9::DOUBLE, 5) AS {m}" for m in _TIMED]
    return "WITH " + ", ".join(parts) + f" SELECT championid, teamposition, build, n::BIGINT AS matchups, {', '.join(out)} FROM x"


def _hierarchy(spark, d, mode):
    rows = wide_players(spark, d)
    base = hierarchy.identities(rows, KEYS, RAW, F.col("timeplayed") / 60.0)
    levels = hierarchy.default_levels(S.lookup_map(_SIBLING, F.col("build")))
    out = hierarchy.smooth(base, KEYS, levels, _RATES, _TIMED, mode)
    return out.select(*KEYS, "matchups", *[off(m, 5).alias(m) for m in RAW])


@query(_hierarchy_sql("cascade"))
def smo18_all_metrics_cascade(spark, d):
    """All 57 metrics of each identity drawn to one of five levels: rates by matchups, values per minute by time; two roles stay apart."""
    return _hierarchy(spark, d, "cascade")


@query(_hierarchy_sql("additive"))
def smo18_all_metrics_additive(spark, d):
    """The same, drawn to all levels at once."""
    return _hierarchy(spark, d, "additive")


# --- metrics and scores of one's own ----------------------------------------------------------------------------------


def _own_metrics() -> hooks.MetricRegistry:
    """Two metrics that build on each other and on one of the library's."""
    own = hooks.MetricRegistry()
    own.register("pressure", lambda kda, kills: kda + F.sqrt(kills), ["takedowns_to_deaths_ratio", "kills"])
    own.register("pressure_share", lambda p, gold: p / F.greatest(gold, F.lit(1.0)), ["pressure", "goldearned"], "minutes")
    return own


@query("WITH " + WIDE + ", i AS (SELECT championid, teamposition, build, sum(kills)::DOUBLE / count(*) AS kills, sum(deaths)::DOUBLE / count(*) AS deaths, sum(assists)::DOUBLE / count(*) AS assists, sum(goldearned)::DOUBLE / count(*) AS gold FROM wide GROUP BY ALL), p AS (SELECT *, CASE WHEN deaths > 1e-9::DOUBLE THEN (kills + assists) / deaths ELSE 0 END + sqrt(kills) AS pressure FROM i) SELECT championid, teamposition, build, round(pressure + 1e-9::DOUBLE, 6) AS pressure, round(pressure / greatest(gold, 1) + 1e-9::DOUBLE, 6) AS pressure_share FROM p")
def pro9_own_metrics(spark, d):
    """Metrics of one's own beside those of the library, on identities (PRO-8): only the columns they read are aggregated."""
    own = _own_metrics()
    names = sorted(own.inputs())
    level = profiles.metric_values(profiles.identity_base(wide_players(spark, d), KEYS, names), KEYS, names, [])
    return own.add(level).select(*KEYS, *[off(m).alias(m) for m in own.columns()])


@query(WORLDS + "SELECT g, round(sum(w / (1 + exp(-(10 * w + (g % 7) - 3)))) / sum(w) + 1e-9::DOUBLE, 6) AS score, round(sum(w), 6) AS retained_mass FROM c WHERE before < 0.9 GROUP BY g")
def cat5_own_model(spark, d):
    """Worlds scored by a pandas UDF and marginalised (CAT-5)."""

    @F.pandas_udf("double")
    def model(weight: pd.Series, game: pd.Series) -> pd.Series:
        import numpy as np

        return 1 / (1 + np.exp(-(10 * weight + game % 7 - 3)))

    scored = hooks.score(worlds(spark, d), model, ["weight", "g"])
    return catalog.marginalise(scored, "g").select("g", off("score").alias("score"), r("retained_mass").alias("retained_mass"))

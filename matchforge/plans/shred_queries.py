"""Registered queries of the shredded tables: payloads made from the test tables, taken apart again, one query per table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.operators import correction
from matchforge.plans.adapters import TIMELINE, timeline
from matchforge.plans.queries import QUERIES, SQL, WITH, participants, query
from matchforge.sources import drift
from matchforge.sources.shred import BEHAVIOUR, CHAMPION_STATS, DAMAGE_STATS, EVENTS, FRAME_STATS, schema_drift, shred_match, shred_timeline, stage_matches, stage_timelines, staged_match_tables, staged_timeline_tables

# --- timelines -----------------------------------------------------------------------------------------------------

#: Events, and participants of summaries, whose texts a task makes, sorts and parses at most, as a mean: some 2 KB an event, 1 KB a participant.
EVENTS_OF_A_TASK = 100_000
PEOPLE_OF_A_TASK = 200_000

_FRAME_COLUMNS = [*CHAMPION_STATS, *DAMAGE_STATS, *FRAME_STATS]


def _stat(i: int) -> str:
    """Value of a participant's i-th frame statistic, by match and participant."""
    return f"(matchid * {i + 2} + participantId * {i % 9 + 1}) % {31 + i}"


def timelines(spark, d):
    """Timelines as JSON text, one per match, with frames of participants and events of all kinds.

    Events are dealt to tasks by match while they are narrow; each makes its text by itself, and matches join finished texts.
    """
    tl = timeline(spark, d, EVENTS_OF_A_TASK)
    stat = {n: F.expr(_stat(i)).cast("int").alias(n) for i, n in enumerate(_FRAME_COLUMNS)}
    instance = lambda i: F.struct(F.lit("hero").alias("name"), (F.col("participantId") + i).cast("int").alias("participantId"), (F.col("level") * 10 + i).cast("int").alias("physicalDamage"), (F.col("bounty") + i).cast("int").alias("magicDamage"), i.cast("int").alias("trueDamage"), F.lit("OTHER").alias("type"))
    damage = F.when(F.col("type") == "CHAMPION_KILL", F.transform(F.sequence(F.lit(0), F.col("killStreakLength")), instance))
    alias = F.col("event_id") % 2 == 1
    keyed = [F.when(~alias, damage).alias("victimDamageDealt"), F.when(alias, damage).alias("victimTeamfightDamageDealt"), damage.alias("victimDamageReceived")]
    fields = [c for c in tl.columns if c not in ("matchid", "frame_timestamp", "position_x", "position_y")]
    event = F.struct(*fields, F.struct(F.col("position_x").alias("x"), F.col("position_y").alias("y")).alias("position"), *keyed)
    stats = lambda names: [stat[n] for n in names]
    place = F.when(F.col("participantId") % 3 > 0, F.struct(stat["health"].alias("x"), stat["level"].alias("y")))
    person = F.struct("participantId", F.struct(*stats(CHAMPION_STATS)).alias("championStats"), F.struct(*stats(DAMAGE_STATS)).alias("damageStats"), *stats(FRAME_STATS), place.alias("position"))
    texts = tl.select("matchid", "frame_timestamp", F.to_json(event).alias("event"), F.concat(F.lit('"'), F.col("participantId").cast("string"), F.lit('":'), F.to_json(person)).alias("person"))
    frames = texts.groupBy("matchid", "frame_timestamp").agg(F.array_join(F.collect_list("event"), ",").alias("events"), F.array_join(F.collect_set("person"), ",").alias("people"))
    inside = F.concat_ws(",", F.concat(F.lit('"timestamp":'), "frame_timestamp"), F.concat(F.lit('"participantFrames":{'), "people", F.lit("}")), F.concat(F.lit('"events":['), "events", F.lit("]")))
    g = frames.select("matchid", F.concat(F.lit("{"), inside, F.lit("}")).alias("frame")).groupBy("matchid").agg(F.array_join(F.collect_list("frame"), ",").alias("frames"))
    metadata = F.to_json(F.struct(F.col("matchid").cast("string").alias("matchId")))
    return g.select(F.concat(F.lit('{"metadata":'), metadata, F.lit(',"info":{"frames":['), "frames", F.lit("]}}")).alias("payload"))


BASE = 'matchid::VARCHAR AS matchid, frame_timestamp, "timestamp"'


def _event_table(number: int, name: str) -> None:
    kind, fields = EVENTS[name]
    columns = []
    for f in fields.split():
        if f == "position":
            columns += ["position_x", "position_y"]
        elif f.endswith("+"):
            columns.append(f"array_to_string(coalesce(\"{f[:-1]}\", []), '-') AS \"{f[:-1]}\"")
        else:
            columns.append(f'"{f}"')

    def run(spark, d):
        out = shred_timeline(timelines(spark, d))[name]
        lists = [f[:-1] for f in fields.split() if f.endswith("+")]
        return out.withColumns({c: F.array_join(c, "-") for c in lists}) if lists else out

    key = f"shr11_{number}_{name.removeprefix('tl_')}"
    QUERIES[key] = run
    SQL[key] = f"WITH {TIMELINE} SELECT {BASE}, {', '.join(columns)} FROM tl WHERE type = '{kind}'"


for _number, _name in enumerate(EVENTS, 1):
    _event_table(_number, _name)


@query(
    f"WITH {TIMELINE} SELECT DISTINCT matchid::VARCHAR AS matchid, frame_timestamp, \"participantId\", " + ", ".join(f'({_stat(i)})::INT AS "{n}"'.replace("participantId *", '"participantId" *') for i, n in enumerate(_FRAME_COLUMNS))
    + f", CASE WHEN \"participantId\" % 3 > 0 THEN ({_stat(CHAMPION_STATS.index('health'))})::INT ELSE 0 END AS position_x, CASE WHEN \"participantId\" % 3 > 0 THEN ({_stat(_FRAME_COLUMNS.index('level'))})::INT ELSE 0 END AS position_y FROM tl"
)
def shr10_participant_frames(spark, d):
    return shred_timeline(timelines(spark, d))["tl_participant_stats"]


KILL_ID = "matchid::VARCHAR || ':' || \"timestamp\" || ':' || \"killerId\" || ':' || \"victimId\" AS champion_kill_event_id"
DAMAGE = (
    'SELECT *, unnest(range("killStreakLength" + 1))::INT AS idx FROM tl WHERE type = \'CHAMPION_KILL\''
)


@query(f"WITH {TIMELINE} SELECT {BASE}, {KILL_ID}, \"killerId\", \"victimId\", bounty, \"shutdownBounty\", \"killStreakLength\", array_to_string(coalesce(\"assistingParticipantIds\", []), '-') AS \"assistingParticipantIds\", position_x, position_y FROM tl WHERE type = 'CHAMPION_KILL'")
def shr12_champion_kills_of_timelines(spark, d):
    out = shred_timeline(timelines(spark, d))["tl_champion_kill"]
    return out.withColumn("assistingParticipantIds", F.array_join("assistingParticipantIds", "-"))


for _side in ("dealt", "received"):

    def _damage(spark, d, side=_side):
        return shred_timeline(timelines(spark, d))[f"tl_ck_victim_damage_{side}"]

    QUERIES[f"shr13_victim_damage_{_side}"] = _damage
    SQL[f"shr13_victim_damage_{_side}"] = f"WITH {TIMELINE}, dmg AS ({DAMAGE}) SELECT {BASE}, {KILL_ID}, '{_side.upper()}' AS direction, idx, 'hero' AS name, (\"participantId\" + idx)::INT AS \"participantId\", (level * 10 + idx)::INT AS \"physicalDamage\", (bounty + idx)::INT AS \"magicDamage\", idx AS \"trueDamage\", 'OTHER' AS type FROM dmg"

# --- summaries -----------------------------------------------------------------------------------------------------


def _person(x):
    """A participant of a summary from its row."""
    n = x["kills"] + x["participantid"]
    text = lambda c: c.cast("string")
    challenges = F.create_map(F.lit("goldPerMinute"), text(x["deaths"] / 4), F.lit("SWARM_x"), F.lit("3"), F.lit("note"), F.lit("none"), F.lit("kda"), text(x["kills"]))
    pick = lambda i: F.struct((n * (i + 3) % 9000).cast("int").alias("perk"), (n + i).cast("int").alias("var1"), (n * 2 + i).cast("int").alias("var2"), F.lit(i).cast("int").alias("var3"))
    style = lambda name, picks: F.struct(F.lit(name).alias("description"), F.array(*map(pick, picks)).alias("selections"))
    perks = F.struct(F.array(style("subStyle", (4, 5)), style("primaryStyle", (0, 1, 2, 3))).alias("styles"))
    behaviour = [F.when(x["participantid"] % 2 == 0, (n + i) % 2 == 1).alias(b) for i, b in enumerate(BEHAVIOUR)]
    third = F.exists(F.array(x["participantid"]), lambda i: i % 3 == 0)  # a higher-order function for the reason given in adapters.py
    combat = F.when(third, F.struct(n.cast("int").alias("PlayerBehavior_IsHeroInCombat")))
    same = [x[c].alias(c) for c in ("kills", "deaths", "assists")]
    return F.struct(x["participantid"].cast("int").alias("participantId"), text(x["puuid"]).alias("puuid"), x["teamid"].alias("teamId"), x["championid"].alias("championId"), x["teamposition"].alias("teamPosition"), (x["win"] == 1).alias("win"), *same, (x["kills"] * 100).alias("unrealKills"), challenges.alias("challenges"), perks.alias("perks"), combat.alias("PlayerBehavior"), *behaviour)


def summaries(spark, d):
    """Match summaries as JSON text with teams, bans, objectives, feats, challenges, perks and behaviour flags.

    Each participant's text is made from its own row; a match joins the finished texts, so that nothing nested is gathered, and puts them last.
    """
    p = participants(spark, d, PEOPLE_OF_A_TASK)
    rows = p.select("matchid", "season", "patch", F.struct("participantid", F.col("puuid").cast("string").alias("puuid"), F.to_json(_person(p)).alias("text")).alias("one"))
    g = rows.groupBy("matchid", "season", "patch").agg(F.array_sort(F.collect_list("one")).alias("people"))
    m = F.col("matchid")
    ban = lambda t, i: F.struct((m * (i + t) % 171).cast("int").alias("championId"), F.lit(i).alias("pickTurn"))
    goal = lambda name, k: F.struct(F.lit(name), F.when(m % 3 != k % 3, F.struct((m % 2 == k % 2).alias("first"), ((m + k) % 13).cast("int").alias("kills"))))
    goals = F.map_from_entries(F.array(*[goal(x, k) for k, x in enumerate(OBJECTIVES)]))
    feats = F.map_from_entries(F.array(F.struct(F.lit("EPIC"), F.struct((m % 4).cast("int").alias("featState"))), F.struct(F.lit("FIRST"), F.when(m % 5 > 0, F.struct((m % 1001).cast("int").alias("featState"))))))
    team = lambda t: F.struct(F.lit(t).alias("teamId"), F.array(ban(t, 1), ban(t, 2)).alias("bans"), goals.alias("objectives"), feats.alias("feats"))
    result = F.when(m % 7 == 0, "Abort_Early").otherwise("GameComplete")
    info = F.struct(result.alias("endOfGameResult"), F.when(m % 11 == 0, "STRAWBERRY").otherwise("CLASSIC").alias("gameMode"), F.concat_ws(".", "season", "patch", F.lit("7"), F.lit("1")).alias("gameVersion"), F.array(team(100), team(200)).alias("teams"))
    meta = F.struct(m.cast("string").alias("matchId"), F.lit("2").alias("dataVersion"), F.col("people.puuid").alias("participants"))
    head = F.rtrim(F.to_json(F.struct(meta.alias("metadata"), info.alias("info"))), F.lit("}"))  # a list is last in it
    return g.select(F.concat(head, F.lit(',"participants":['), F.array_join("people.text", ","), F.lit("]}}")).alias("payload"))


# Objectives of a team.
OBJECTIVES = ["atakhan", "baron", "champion", "dragon", "horde", "inhibitor", "riftHerald", "tower"]
GATED = WITH + ", sg AS (SELECT matchid FROM players GROUP BY matchid HAVING count(*) >= 5 AND matchid % 7 <> 0 AND matchid % 11 <> 0), sp1 AS (SELECT * FROM players SEMI JOIN sg USING (matchid)), tm AS (SELECT matchid, t AS teamid FROM sg, (SELECT unnest([100, 200]) AS t)) "


def _summary(spark, d, name):
    return shred_match(summaries(spark, d))[name]


@query(GATED + "SELECT matchid::VARCHAR AS matchid, '2' AS \"dataVersion\", string_agg(puuid::VARCHAR, ',' ORDER BY participantid) AS participants FROM sp1 GROUP BY matchid")
def shr1_metadata(spark, d):
    return _summary(spark, d, "metadata").withColumn("participants", F.array_join("participants", ","))


@query(GATED + "SELECT matchid::VARCHAR AS matchid, teamid, (matchid * (i + teamid) % 171)::INT AS \"championId\", i AS \"pickTurn\" FROM tm, (SELECT unnest([1, 2]) AS i)")
def shr3_bans(spark, d):
    return _summary(spark, d, "bans")


@query(GATED + "SELECT matchid::VARCHAR AS matchid, teamid, 'EPIC' AS feat, (matchid % 4)::INT AS \"featState\" FROM tm UNION ALL SELECT matchid::VARCHAR, teamid, 'FIRST', (matchid % 1001)::INT FROM tm WHERE matchid % 5 > 0")
def shr4_feats(spark, d):
    return _summary(spark, d, "feats")


@query(GATED + f"SELECT matchid::VARCHAR AS matchid, teamid, objective, (matchid % 2 = k % 2)::INT AS first, ((matchid + k) % 13)::INT AS kills FROM tm, (VALUES {', '.join(f'({k}, {x!r})' for k, x in enumerate(OBJECTIVES))}) o(k, objective) WHERE matchid % 3 <> k % 3")
def shr5_objectives(spark, d):
    return _summary(spark, d, "objectives")


@query(GATED + f"SELECT matchid::VARCHAR AS matchid, participantid AS \"participantId\", kills::INT AS kills, least(kills * 100, 255)::INT AS \"unrealKills\", CASE WHEN participantid % 3 = 0 THEN (kills + participantid)::INT END AS \"playerBehaviorIsHeroInCombat\", {', '.join(f'CASE WHEN participantid % 2 = 0 THEN ((kills + participantid + {i}) % 2)::INT END AS {chr(34)}{b}{chr(34)}' for i, b in enumerate(BEHAVIOUR))} FROM sp1")
def shr6_behaviour_lifted(spark, d):
    return _summary(spark, d, "participant_stats").select("matchid", "participantId", "kills", "unrealKills", "playerBehaviorIsHeroInCombat", *BEHAVIOUR)


@query(GATED + "SELECT matchid::VARCHAR AS matchid, participantid, 'goldPerMinute' AS challenge, deaths / 4 AS value FROM sp1 UNION ALL SELECT matchid::VARCHAR, participantid, 'kda', kills::DOUBLE FROM sp1 UNION ALL SELECT matchid::VARCHAR, participantid, 'note', NULL FROM sp1")
def shr7_challenges(spark, d):
    return _summary(spark, d, "participant_challenges")


_N = "(kills + participantid)"


@query(GATED + "SELECT matchid::VARCHAR AS matchid, participantid, " + ", ".join(f"({x})::INT AS perk{i}_var{v}" for i in range(6) for v, x in ((1, f"{_N} + {i}"), (2, f"{_N} * 2 + {i}"), (3, str(i)))) + " FROM sp1")
def shr8_perk_values(spark, d):
    return _summary(spark, d, "participant_perk_values")


@query(GATED + "SELECT matchid::VARCHAR AS matchid, participantid, " + ", ".join(f"({_N} * {i + 3} % 9000)::INT AS perk{i}" for i in range(6)) + ", (" + " + ".join(f"({_N} * {i + 3} % 9000)::HUGEINT * {1 << 14 * i}::HUGEINT" for i in range(6)) + ")::VARCHAR AS perk_combo_key FROM sp1")
def shr9_perk_ids(spark, d):
    return _summary(spark, d, "participant_perk_ids").withColumn("perk_combo_key", F.col("perk_combo_key").cast("string"))


@query(
    "SELECT o_orderkey AS matchid, path, kind, names FROM (SELECT o_orderkey, '$' AS path, 'missing' AS kind, 'later' AS names FROM orders UNION ALL SELECT o_orderkey, '$', 'unexpected', 'price' FROM orders WHERE o_orderkey % 3 = 0"
    " UNION ALL SELECT o_orderkey, '$.info', 'missing', 'mode,version' FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, '$.info', 'missing', 'version' FROM orders WHERE o_orderkey % 3 = 0)"
)
def shr15_schema_drift(spark, d):
    from matchforge.plans.adapters import table

    o, third = table(spark, d, "orders"), F.col("o_orderkey") % 3 == 0
    obj = F.struct(F.col("o_orderkey").alias("id"), F.when(third, F.col("o_totalprice")).alias("price"), F.when(third, F.struct(F.lit("x").alias("mode"))).alias("info"))
    raw = o.select(F.col("o_orderkey").alias("matchid"), F.to_json(obj).alias("payload"))
    raw = raw.withColumn("payload", F.when(F.col("payload").contains("info"), F.col("payload")).otherwise(F.regexp_replace("payload", r"\}$", ',"info":{}}')))
    found = schema_drift(raw, {"$": ["id", "info", "later"], "$.info": ["mode", "version"]})
    return found.withColumn("names", F.array_join("names", ","))


# --- corrected statistics ----------------------------------------------------------------------------------------------


def _made_stat(i: int) -> str:
    """Value of a participant's i-th corrected statistic, summed over the events of a match."""
    return f"(event_id * {i + 3} + matchid) % {5 + 13 * i}"


_INFO = "matchid % 2 AS season, matchid * 37 % 2000 AS gameduration"
_DELTA_SQL = (
    f"WITH {TIMELINE}, info AS (SELECT DISTINCT matchid, {_INFO} FROM tl), pop AS (SELECT matchid FROM info WHERE season = (SELECT max(season) FROM info) AND gameduration > 990), "
    "en AS (SELECT matchid, max(\"timestamp\") - 540000000 AS from_at FROM tl SEMI JOIN pop USING (matchid) WHERE type = 'GAME_END' GROUP BY matchid), tt AS (SELECT tl.* FROM tl JOIN en USING (matchid) WHERE \"timestamp\" >= from_at), "
    "kr AS (SELECT *, matchid || ':' || \"timestamp\" || ':' || \"killerId\" || ':' || \"victimId\" AS kid FROM tt WHERE type = 'CHAMPION_KILL'), kl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY matchid, kid ORDER BY event_id) AS i FROM kr) WHERE i = 1), "
    "dm AS (SELECT kr.matchid, kr.\"participantId\" + idx AS other, kr.\"victimId\" AS victim, level * 10 + idx AS physical, bounty + idx AS magic, idx AS tru FROM (SELECT *, unnest(range(\"killStreakLength\" + 1)) AS idx FROM kr) kr), pc AS (SELECT p_partkey AS item, floor(p_retailprice)::DOUBLE AS price FROM part), "
    "dl AS (SELECT matchid, \"killerId\" AS pid, 'kills' AS w, 1.0::DOUBLE AS v FROM kl WHERE \"killerId\" > 0 UNION ALL SELECT matchid, \"victimId\", 'deaths', 1 FROM kl WHERE \"victimId\" > 0 UNION ALL SELECT matchid, unnest(\"assistingParticipantIds\"), 'assists', 1 FROM kl "
    + "".join(f"UNION ALL SELECT matchid, {who}, '{kind}_{way}', {'tru' if kind == 'true' else kind} FROM dm WHERE {who} > 0 " for kind in correction.KINDS for who, way in (("other", "dealt"), ("victim", "taken"), ("victim", "dealt"), ("other", "taken")))
    + "UNION ALL SELECT matchid, pid, 'goldspent', coalesce(price, 0) FROM (SELECT DISTINCT matchid, frame_timestamp, \"timestamp\", \"participantId\" AS pid, \"itemId\" AS item FROM tt WHERE type = 'ITEM_PURCHASED') LEFT JOIN pc USING (item) "
    "UNION ALL SELECT matchid, pid, 'goldspent', -floor(coalesce(price, 0) * 0.7::DOUBLE + 0.5::DOUBLE) FROM (SELECT DISTINCT matchid, frame_timestamp, \"timestamp\", \"participantId\" AS pid, \"itemId\" AS item FROM tt WHERE type = 'ITEM_SOLD') LEFT JOIN pc USING (item) "
    "UNION ALL SELECT matchid, \"participantId\", 'goldspent', -\"goldGain\" FROM tt WHERE type = 'ITEM_UNDO'), "
    "ds AS (SELECT matchid, pid, " + ", ".join(f"coalesce(sum(v) FILTER (WHERE w = '{x}'), 0) AS d_{x}" for x in correction.DELTAS) + " FROM dl GROUP BY ALL), "
    "st AS (SELECT matchid, \"participantId\" AS pid, " + ", ".join(f"sum({_made_stat(i)})::BIGINT AS {c}" for i, c in enumerate(correction.CORRECTED)) + " FROM tl GROUP BY ALL) "
)


def _less_sql(column: str) -> str:
    way = "dealt" if column in correction.DEALT else "taken"
    names = [f"{k}_{way}" for k in (correction.DEALT | correction.TAKEN)[column]] if column in correction.DEALT | correction.TAKEN else [column]
    return f"greatest({column} - ({' + '.join(f'coalesce(d_{n}, 0)' for n in names)}), 0)::BIGINT AS {column}"


@query(_DELTA_SQL + "SELECT matchid::VARCHAR AS matchid, pid::INT AS participantid, " + ", ".join(_less_sql(c) for c in correction.CORRECTED) + " FROM st SEMI JOIN pop USING (matchid) LEFT JOIN ds USING (matchid, pid)")
def cor1_6_corrected_statistics(spark, d):
    """Twelve corrected columns of long matches of the latest season, from the shredded tables of kills, damage and items."""
    from matchforge.plans.adapters import table
    from matchforge.plans.source_queries import _path

    path = _path(spark, "timelines")
    stage_timelines(timelines(spark, d), path)
    t = staged_timeline_tables(spark, path)
    tl = timeline(spark, d)
    info = tl.selectExpr("matchid", *_INFO.split(", ")).distinct().withColumn("matchid", F.col("matchid").cast("string"))
    stats = tl.groupBy(F.col("matchid").cast("string").alias("matchid"), F.col("participantId").alias("participantid")).agg(*[F.sum(F.expr(_made_stat(i))).cast("long").alias(c) for i, c in enumerate(correction.CORRECTED)])
    matches = correction.population(info)
    prices = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("itemid"), F.floor("p_retailprice").alias("price"))
    tail = correction.tails(t["tl_game_end"], matches, 540_000_000)
    deltas = correction.delta_totals(tail, t["tl_champion_kill"], t["tl_ck_victim_damage_dealt"], t["tl_ck_victim_damage_received"], t["tl_item_purchased"], t["tl_item_sold"], t["tl_item_undo"], prices)
    return correction.corrected_statistics(stats, matches, deltas)


#: Queries whose SQL tells how many rows the staged tables must have.
_STAGED = {"metadata": "shr1_metadata", "bans": "shr3_bans", "feats": "shr4_feats", "objectives": "shr5_objectives", "participant_stats": "shr6_behaviour_lifted", "participant_challenges": "shr7_challenges", "participant_perk_values": "shr8_perk_values", "participant_perk_ids": "shr9_perk_ids", "tl_participant_stats": "shr10_participant_frames", "tl_champion_kill": "shr12_champion_kills_of_timelines", "tl_ck_victim_damage_dealt": "shr13_victim_damage_dealt", "tl_ck_victim_damage_received": "shr13_victim_damage_received"}
_STAGED |= {name: f"shr11_{i}_{name.removeprefix('tl_')}" for i, name in enumerate(EVENTS, 1)}


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM ({SQL[held]})" for name, held in _STAGED.items()))
def shr_staged_tables(spark, d):
    """Every payload is parsed once; rows of all tables come from the typed units."""
    from matchforge.plans.source_queries import _path

    paths = [_path(spark, name) for name in ("matches", "timelines")]
    stage_matches(summaries(spark, d), paths[0])
    stage_timelines(timelines(spark, d), paths[1])
    tables = staged_match_tables(spark, paths[0]) | staged_timeline_tables(spark, paths[1])
    return reduce(DataFrame.unionAll, [tables[name].agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in _STAGED])


@query(SQL["shr11_3_elite_monster_kill"])
def shr_staged_elite_monsters(spark, d):
    """One table in full from the units, where the other query counts all of them."""
    from matchforge.plans.source_queries import _path

    path = _path(spark, "timelines")
    stage_timelines(timelines(spark, d), path)
    return staged_timeline_tables(spark, path)["tl_elite_monster_kill"].withColumn("assistingParticipantIds", F.array_join("assistingParticipantIds", "-"))


#: A payload per order: teams are an object in place of a list in one of five, a team lacks its bans in one of three, one event in seven is
#: of a type that nobody knows, one in eleven lacks its time; one payload in thirteen is cut off.
_DRIFT = """'{"info":{"teams":' || CASE WHEN k % 5 = 0 THEN '{"id":1}' ELSE '[{"id":100,"bans":[1,2]},{"id":200' || CASE WHEN k % 3 = 0 THEN ',"extra":null' ELSE ',"bans":[]' END || '}]' END || '},"events":[{"type":"KILL","at":1},{"type":"' || CASE WHEN k % 7 = 0 THEN 'DANCE' ELSE 'WARD' END || '"' || CASE WHEN k % 11 = 0 THEN '' ELSE ',"at":2.5' END || '}]' || CASE WHEN k % 13 = 0 THEN '' ELSE '}' END"""
_PAYLOADS = f"WITH o AS (SELECT o_orderkey AS matchid, o_orderkey AS k FROM orders), p AS (SELECT *, {_DRIFT} AS payload FROM o), g AS (SELECT * FROM p WHERE k % 13 > 0), t AS (SELECT * FROM g WHERE k % 5 > 0), "


#: Payloads that a task makes and looks through at most, as a mean. Order keys are small on disk, so a scan alone would have too few tasks.
PAYLOADS_OF_A_TASK = 100_000


def _drift_payloads(spark, d):
    from matchforge.plans.adapters import table

    keys = table(spark, d, "orders").select("o_orderkey")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // PAYLOADS_OF_A_TASK))
    keys = keys.repartition(tasks, "o_orderkey")
    return keys.select(F.col("o_orderkey").alias("matchid"), F.col("o_orderkey").alias("k")).select("matchid", F.expr(_DRIFT).alias("payload"))


@query(_PAYLOADS + """f AS (
SELECT matchid, 'payload' AS object, '$' AS path, 'not_json' AS kind, '' AS names FROM p WHERE k % 13 = 0
UNION ALL SELECT matchid, 'teams', '$.info.teams', 'expected_list', '' FROM g WHERE k % 5 = 0
UNION ALL SELECT matchid, 'teams', '$.info.teams[1]', 'missing_keys', 'bans' FROM t WHERE k % 3 = 0
UNION ALL SELECT matchid, 'teams', '$.info.teams[1]', 'unexpected_keys', 'extra' FROM t WHERE k % 3 = 0
UNION ALL SELECT matchid, 'bans', '$.info.teams', 'expected_list', '' FROM g WHERE k % 5 = 0
UNION ALL SELECT matchid, 'bans', '$.info.teams[1]', 'missing_path', 'bans' FROM t WHERE k % 3 = 0
UNION ALL SELECT matchid, 'bans', '$.info.teams[0].bans[' || i || ']', 'expected_object', '' FROM t, (VALUES (0), (1)) x(i)
UNION ALL SELECT matchid, 'notes', '$.info', 'missing_path', 'notes' FROM g
UNION ALL SELECT matchid, 'payload', '$', 'not_json', '' FROM p WHERE k % 13 = 0
UNION ALL SELECT matchid, 'event', '$.events[1]', 'unknown_event_type', 'DANCE' FROM g WHERE k % 7 = 0
UNION ALL SELECT matchid, 'event:WARD', '$.events[1]', 'missing_keys', 'at' FROM g WHERE k % 7 > 0 AND k % 11 = 0) SELECT * FROM f""")
def shr15_drift_findings(spark, d):
    """Keys, containers, paths and event types that payloads have wrong, one row per finding."""
    raw = _drift_payloads(spark, d)
    checks = {
        "teams": {"path": ["info", "teams", "*"], "required": ["id", "bans"]},
        "bans": {"path": ["info", "teams", "*", "bans", "*"], "required": ["championId"]},
        "notes": {"path": ["info", "notes"], "required": []},
        "feats": {"path": ["info", "feats"], "required": ["x"], "may_lack": True},
    }
    events = {"KILL": {"required": ["type", "at"]}, "WARD": {"required": ["type", "at"], "optional": ["by"]}}
    return drift.drift(raw, checks, events, ["events"]).select("matchid", "object", "path", "kind", F.array_join("names", ",").alias("names"))


@query(_PAYLOADS + """x AS (
SELECT '$' AS path, CASE WHEN k % 13 = 0 THEN 'INVALID' ELSE 'OBJECT' END AS type FROM p
UNION ALL SELECT '$.info', 'OBJECT' FROM g UNION ALL SELECT '$.events', 'ARRAY' FROM g UNION ALL SELECT '$.events[*]', 'OBJECT' FROM g, range(2)
UNION ALL SELECT '$.events[*].type', 'STRING' FROM g, range(2) UNION ALL SELECT '$.events[*].at', 'BIGINT' FROM g UNION ALL SELECT '$.events[*].at', 'DECIMAL' FROM g WHERE k % 11 > 0
UNION ALL SELECT '$.info.teams', CASE WHEN k % 5 = 0 THEN 'OBJECT' ELSE 'ARRAY' END FROM g UNION ALL SELECT '$.info.teams.id', 'BIGINT' FROM g WHERE k % 5 = 0
UNION ALL SELECT '$.info.teams[*]', 'OBJECT' FROM t, range(2) UNION ALL SELECT '$.info.teams[*].id', 'BIGINT' FROM t, range(2) UNION ALL SELECT '$.info.teams[*].bans', 'ARRAY' FROM t
UNION ALL SELECT '$.info.teams[*].bans', 'ARRAY' FROM t WHERE k % 3 > 0 UNION ALL SELECT '$.info.teams[*].bans[*]', 'BIGINT' FROM t, range(2) UNION ALL SELECT '$.info.teams[*].extra', 'VOID' FROM t WHERE k % 3 = 0)
SELECT path, type, count(*) AS n FROM x GROUP BY ALL""")
def shr15_observed_paths(spark, d):
    """All paths and types that payloads hold, found and not listed."""
    return drift.observed_paths(_drift_payloads(spark, d))

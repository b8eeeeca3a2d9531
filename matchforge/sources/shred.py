"""Shredding of nested match and timeline payloads into flat tables, with gates and a drift report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUMMARY = (
    "metadata struct<matchId:string,dataVersion:string,participants:array<string>>, info struct<endOfGameResult:string,gameMode:string,gameCreation:bigint,gameDuration:bigint,gameVersion:string,gameStartTimestamp:bigint,"
    "teams:array<struct<teamId:int,bans:array<struct<championId:int,pickTurn:int>>,objectives:map<string,struct<first:boolean,kills:int>>,feats:map<string,struct<featState:int>>>>,"
    "participants:array<struct<participantId:int,puuid:string,teamId:int,championId:int,teamPosition:string,win:boolean,kills:int,deaths:int,assists:int,unrealKills:int,challenges:map<string,string>,PlayerBehavior:struct<PlayerBehavior_IsHeroInCombat:int>,gameEndedInIGNBSurrender:boolean,causedGameEndFromIGNBSurrender:boolean,teamIGNBSurrendered:boolean,wasPremadeWithIGNBGameEndCauser:boolean,wasSevereTransgressor:boolean,wasPremadeWithSevereTransgressor:boolean,"
    "perks:struct<styles:array<struct<description:string,style:int,selections:array<struct<perk:int,var1:int,var2:int,var3:int>>>>>>>>"
)
# Statistics of a participant frame that are kept, by the object that holds them.
CHAMPION_STATS = "abilityHaste abilityPower armor armorPen armorPenPercent attackDamage attackSpeed bonusArmorPenPercent bonusMagicPenPercent ccReduction cooldownReduction health healthMax healthRegen lifesteal magicPen magicPenPercent magicResist movementSpeed omnivamp physicalVamp power powerMax powerRegen spellVamp".split()
DAMAGE_STATS = "magicDamageDone magicDamageDoneToChampions magicDamageTaken physicalDamageDone physicalDamageDoneToChampions physicalDamageTaken totalDamageDone totalDamageDoneToChampions totalDamageTaken trueDamageDone trueDamageDoneToChampions trueDamageTaken".split()
FRAME_STATS = "currentGold goldPerSecond jungleMinionsKilled level minionsKilled timeEnemySpentControlled totalGold xp".split()


def _ints(names: list[str]) -> str:
    return ",".join(f"{n}:int" for n in names)


_DAMAGE = "array<struct<name:string,participantId:int,physicalDamage:int,magicDamage:int,trueDamage:int,type:string>>"
TIMELINE = (
    "metadata struct<matchId:string>, info struct<endOfGameResult:string,frames:array<struct<timestamp:bigint,"
    f"participantFrames:map<string,struct<participantId:int,championStats:struct<{_ints(CHAMPION_STATS)}>,damageStats:struct<{_ints(DAMAGE_STATS)}>,{_ints(FRAME_STATS)},position:struct<x:int,y:int>>>,"
    "events:array<struct<type:string,timestamp:bigint,participantId:int,creatorId:int,killerId:int,victimId:int,itemId:int,beforeId:int,afterId:int,goldGain:int,level:int,skillSlot:int,levelUpType:string,wardType:string,"
    "killType:string,multiKillLength:int,killStreakLength:int,bounty:int,shutdownBounty:int,monsterType:string,monsterSubType:string,killerTeamId:int,teamId:int,name:string,buildingType:string,towerType:string,laneType:string,"
    "winningTeam:int,gameId:bigint,realTimestamp:bigint,actualStartTime:bigint,featType:int,featValue:int,transformType:string,assistingParticipantIds:array<int>,position:struct<x:int,y:int>,"
    f"victimDamageDealt:{_DAMAGE},victimDamageReceived:{_DAMAGE},victimTeamfightDamageDealt:{_DAMAGE},victimTeamfightDamageReceived:{_DAMAGE}>>>>>"
)
# Nullable behaviour flags of a participant.
BEHAVIOUR = ["gameEndedInIGNBSurrender", "causedGameEndFromIGNBSurrender", "teamIGNBSurrendered", "wasPremadeWithIGNBGameEndCauser", "wasSevereTransgressor", "wasPremadeWithSevereTransgressor"]
#: table: (event type, its own fields); a + marks fields of which a missing value is an empty list.
EVENTS = {
    "tl_champion_special_kill": ("CHAMPION_SPECIAL_KILL", "type killType killerId multiKillLength position"),
    "tl_dragon_soul_given": ("DRAGON_SOUL_GIVEN", "type name teamId"),
    "tl_elite_monster_kill": ("ELITE_MONSTER_KILL", "type killerId killerTeamId monsterType monsterSubType bounty assistingParticipantIds+ position"),
    "tl_ward_placed": ("WARD_PLACED", "creatorId wardType"),
    "tl_ward_kill": ("WARD_KILL", "killerId wardType"),
    "tl_item_purchased": ("ITEM_PURCHASED", "participantId itemId"),
    "tl_item_sold": ("ITEM_SOLD", "participantId itemId"),
    "tl_item_destroyed": ("ITEM_DESTROYED", "participantId itemId"),
    "tl_item_undo": ("ITEM_UNDO", "participantId beforeId afterId goldGain"),
    "tl_level_up": ("LEVEL_UP", "participantId level"),
    "tl_skill_level_up": ("SKILL_LEVEL_UP", "participantId skillSlot levelUpType"),
    "tl_pause_end": ("PAUSE_END", "realTimestamp"),
    "tl_game_end": ("GAME_END", "gameId realTimestamp winningTeam"),
    "tl_objective_bounty_prestart": ("OBJECTIVE_BOUNTY_PRESTART", "actualStartTime teamId"),
    "tl_objective_bounty_finish": ("OBJECTIVE_BOUNTY_FINISH", "teamId"),
    "tl_feat_update": ("FEAT_UPDATE", "featType featValue teamId"),
    "tl_champion_transform": ("CHAMPION_TRANSFORM", "participantId transformType"),
    "tl_turret_plate_destroyed": ("TURRET_PLATE_DESTROYED", "type killerId laneType teamId position"),
    "tl_building_kill": ("BUILDING_KILL", "type killerId teamId buildingType towerType laneType bounty assistingParticipantIds+ position"),
}


def nearest_minute(ms):
    return F.when(ms <= 0, F.lit(0)).otherwise(F.floor((ms + 30_000) / 60_000) * 60_000).cast("long")


# Fields by which payloads are told apart and gated.
_GATED = ["metadata.matchId", "info.endOfGameResult", "info.gameMode", "info.participants.participantId"]


def _passes(d, listed: bool):
    """Whether a parsed payload is to be shredded; `listed`: it lists its participants and has a mode."""
    good = ~F.coalesce(d["info"]["endOfGameResult"].startswith("Abort"), F.lit(False))
    if listed:
        good = good & (F.coalesce(d["info"]["gameMode"], F.lit("")) != "STRAWBERRY") & (F.coalesce(F.size(d["info"]["participants"]), F.lit(-1)) >= 5)
    return good


def _only(kind, paths: list[str]):
    """A type with only the fields that dotted paths name; a path that ends takes all below it. Lists and maps are passed through."""
    if "" in paths:
        return kind
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_only(kind.elementType, paths))
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _only(kind.valueType, paths))
    below = lambda name: [p[len(name) + 1 :] for p in paths if p == name or p.startswith(f"{name}.")]
    return T.StructType([T.StructField(f.name, _only(f.dataType, below(f.name))) for f in kind.fields if below(f.name)])


def opened(raw: DataFrame, schema: str, payload: str = "payload", fields: list[str] | None = None) -> DataFrame:
    """Payloads to shred, parsed: not aborted, a supported mode, five participants at least where participants are listed.

    The gate stands inside the generator that gives the rows: as a filter on a parsed column it would be pushed below the parse,
    with a parse of its own for each field it reads. `fields` (dotted paths) are read beside those of the gate; all, if there are none.
    """
    kind = T.StructType.fromDDL(schema)
    d = F.from_json(payload, _only(kind, [*_GATED, *fields]) if fields else kind)
    return raw.select(F.inline_outer(F.filter(F.array(d), lambda x: _passes(x, "gameMode" in schema)))).where("metadata IS NOT NULL OR info IS NOT NULL")


def game_version(version):
    """(season, patch, sub version) of a dotted version; -1, -1 and unknown where it has fewer than three parts."""
    parts = F.split(version, r"\.")
    whole = F.size(parts) >= 3
    season, patch = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    number = whole & season.isNotNull() & patch.isNotNull()
    sub = F.when(whole, F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), ".")).otherwise("unknown")
    return F.when(number, season).otherwise(-1).alias("season"), F.when(number, patch).otherwise(-1).alias("patch"), sub.alias("sub_version")


# Fields of a match itself, and the fields of a payload that each table reads.
_OWN = ["metadata.dataVersion", "metadata.participants", "info.gameCreation", "info.gameDuration", "info.gameStartTimestamp", "info.gameVersion"]
_TEAM, _PERSON = (lambda *names, base=base: [f"info.{base}.{n}" for n in names] for base in ("teams", "participants"))
_READ = {
    "metadata": _OWN[:2],
    "info": _OWN[2:],
    "bans": _TEAM("teamId", "bans"),
    "feats": _TEAM("teamId", "feats"),
    "objectives": _TEAM("teamId", "objectives"),
    "participant_stats": _PERSON(*"puuid teamId championId teamPosition win kills deaths assists unrealKills PlayerBehavior".split(), *BEHAVIOUR),
    "participant_challenges": _PERSON("challenges"),
    "participant_perk_values": _PERSON("perks"),
    "participant_perk_ids": _PERSON("perks"),
}


def _matches(raw: DataFrame, payload: str, fields: list[str] | None = None) -> DataFrame:
    """matchid, m (fields of the match itself), teams, people of the payloads that pass the gate; of `fields` only, if they are given."""
    held = lambda c: fields is None or any(f.startswith(c) for f in fields)
    own = [c for c in _OWN if held(c)]
    more = [F.col(f"info.{c}").alias(n) for c, n in (("teams", "teams"), ("participants", "people")) if held(f"info.{c}")]
    return opened(raw, SUMMARY, payload, fields).select(F.col("metadata.matchId").alias("matchid"), *([F.struct(*own).alias("m")] if own else []), *more)


def _match_tables(match, teams, people) -> dict[str, DataFrame]:
    """Tables from functions that give, for the name of a table, the rows (matchid, m), (matchid, t) and (matchid, p) that it is made of."""
    styles = lambda kind: F.try_element_at(F.filter("p.perks.styles", lambda s: s["description"] == kind), F.lit(1))
    perks = F.concat(F.coalesce(styles("primaryStyle")["selections"], F.array()), F.coalesce(styles("subStyle")["selections"], F.array()))
    slots = lambda name: people(name).select("matchid", F.col("p.participantId").alias("participantid"), perks.alias("s"))
    perk = lambda i, f: F.coalesce(F.try_element_at("s", F.lit(i + 1))[f], F.lit(0))
    key = sum((perk(i, "perk").cast("decimal(38,0)") * F.lit(str(1 << 14 * i)).cast("decimal(26,0)")).cast("decimal(38,0)") for i in range(6))
    return {
        "metadata": match("metadata").select("matchid", "m.dataVersion", "m.participants"),
        "info": match("info").select("matchid", "m.gameCreation", "m.gameDuration", "m.gameStartTimestamp", *game_version(F.col("m.gameVersion"))),
        "bans": teams("bans").select("matchid", F.col("t.teamId").alias("teamid"), F.inline("t.bans")),
        "feats": teams("feats").select("matchid", F.col("t.teamId").alias("teamid"), F.explode("t.feats").alias("feat", "v")).where("v is not null").select("matchid", "teamid", "feat", "v.featState"),
        "objectives": teams("objectives").select("matchid", F.col("t.teamId").alias("teamid"), F.explode("t.objectives").alias("objective", "v")).where("v is not null").select("matchid", "teamid", "objective", F.col("v.first").cast("int").alias("first"), "v.kills"),
        "participant_stats": people("participant_stats").select("matchid", "p.participantId", "p.puuid", "p.teamId", "p.championId", "p.teamPosition", F.col("p.win").cast("int").alias("win"), "p.kills", "p.deaths", "p.assists", F.least("p.unrealKills", F.lit(255)).alias("unrealKills"), F.col("p.PlayerBehavior.PlayerBehavior_IsHeroInCombat").alias("playerBehaviorIsHeroInCombat"), *[F.col(f"p.{b}").cast("int").alias(b) for b in BEHAVIOUR]),
        "participant_challenges": people("participant_challenges").select("matchid", F.col("p.participantId").alias("participantid"), F.explode(F.map_filter("p.challenges", lambda k, v: ~k.startswith("SWARM_"))).alias("challenge", "v")).select("matchid", "participantid", "challenge", F.col("v").try_cast("double").alias("value")),
        "participant_perk_values": slots("participant_perk_values").select("matchid", "participantid", *[perk(i, f"var{v}").alias(f"perk{i}_var{v}") for i in range(6) for v in (1, 2, 3)]),
        "participant_perk_ids": slots("participant_perk_ids").select("matchid", "participantid", *[perk(i, "perk").alias(f"perk{i}") for i in range(6)], key.alias("perk_combo_key")),
    }


def shred_match(raw: DataFrame, payload: str = "payload") -> dict[str, DataFrame]:
    """The flat tables of summary payloads, each from a parse of its own that reads its fields only; see stage_matches for many tables of the same payloads."""
    d = lambda name: _matches(raw, payload, _READ[name])
    part = lambda column, one: lambda name: d(name).select("matchid", F.explode(column).alias(one))
    return _match_tables(d, part("teams", "t"), part("people", "p"))


def _frames(raw: DataFrame, payload: str, fields: list[str] | None = None) -> DataFrame:
    read = fields and ["info.frames.timestamp", *[f"info.frames.{f}" for f in fields]]
    d = opened(raw, TIMELINE, payload, read).select(F.col("metadata.matchId").alias("matchid"), F.explode("info.frames").alias("f"))
    return d.withColumn("frame_timestamp", nearest_minute(F.col("f.timestamp")))


def _timeline_tables(people: DataFrame, events) -> dict[str, DataFrame]:
    """Tables from (matchid, frame_timestamp, p) and from `events`, which gives the rows (matchid, frame_timestamp, fields) of an event type."""
    place = [F.coalesce(F.col(f"p.position.{a}"), F.lit(0)).alias(f"position_{a}") for a in "xy"]
    stats = [*[F.col(f"p.championStats.{c}") for c in CHAMPION_STATS], *[F.col(f"p.damageStats.{c}") for c in DAMAGE_STATS], *[F.col(f"p.{c}") for c in FRAME_STATS]]
    out = {"tl_participant_stats": people.select("matchid", "frame_timestamp", "p.participantId", *stats, *place)}
    for name, (kind, fields) in EVENTS.items():
        columns = []
        for f in fields.split():
            if f == "position":
                columns += [F.col(f"position.{a}").alias(f"position_{a}") for a in "xy"]
            elif f.endswith("+"):
                columns.append(F.coalesce(F.col(f[:-1]), F.array().cast("array<int>")).alias(f[:-1]))
            else:
                columns.append(F.col(f))
        out[name] = events(kind).select("matchid", "frame_timestamp", "timestamp", *columns)
    kills = events("CHAMPION_KILL").withColumn("champion_kill_event_id", F.concat_ws(":", "matchid", "timestamp", "killerId", "victimId"))
    ids = ["matchid", "frame_timestamp", "timestamp", "champion_kill_event_id"]
    out["tl_champion_kill"] = kills.select(*ids, "killerId", "victimId", "bounty", "shutdownBounty", "killStreakLength", F.coalesce("assistingParticipantIds", F.array().cast("array<int>")).alias("assistingParticipantIds"), *[F.col(f"position.{a}").alias(f"position_{a}") for a in "xy"])
    for name in ("Dealt", "Received"):
        held = F.coalesce(f"victimDamage{name}", f"victimTeamfightDamage{name}")
        rows = kills.select(*ids, F.posexplode(held).alias("idx", "v"))
        out[f"tl_ck_victim_damage_{name.lower()}"] = rows.select(*ids, F.lit(name.upper()).alias("direction"), "idx", "v.*")
    return out


def shred_timeline(raw: DataFrame, payload: str = "payload") -> dict[str, DataFrame]:
    """The flat tables of timeline payloads, each from a parse of its own; payloads without participant frames give no rows."""
    people = _frames(raw, payload, ["participantFrames"]).select("matchid", "frame_timestamp", F.explode(F.map_values("f.participantFrames")).alias("p"))
    rows = _frames(raw, payload, ["events"]).select("matchid", "frame_timestamp", F.explode("f.events").alias("e")).select("matchid", "frame_timestamp", "e.*")
    return _timeline_tables(people, lambda kind: rows.where(F.col("type") == kind))


def _units(df: DataFrame, keep: list[str], kinds: list[tuple]) -> DataFrame:
    """One row per unit of a payload: keep columns, unit (a tag), and one column per kind, of which the unit fills one.

    `kinds`: (column, array of its values, function of a value that gives its tag).
    """
    def row_of(name, tag):
        return lambda x: F.struct(tag(x).alias("unit"), *[(x if n == name else F.lit(None).cast(kind)).alias(n) for n, kind in types.items()])

    types = {name: df.select(values.alias("x")).schema["x"].dataType.elementType for name, values, _ in kinds}
    parts = []
    for name, values, tag in kinds:
        row = row_of(name, tag)
        parts.append(F.coalesce(F.transform(values, row), F.slice(F.transform(F.array(F.lit(None).cast(types[name])), row), 1, 0)))
    return df.select(*keep, F.explode(F.concat(*parts)).alias("_u")).select(*keep, "_u.*")


def stage_matches(raw: DataFrame, path: str, payload: str = "payload") -> None:
    """Parse summary payloads once and write their matches, teams and participants as typed rows, in a folder per tag."""
    d = _matches(raw, payload)
    tag = lambda name: lambda x: F.lit(name)
    units = _units(d, ["matchid"], [("m", F.array("m"), tag("match")), ("t", F.col("teams"), tag("team")), ("p", F.col("people"), tag("participant"))])
    units.write.partitionBy("unit").parquet(path)


def staged_match_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of shred_match from what stage_matches wrote: no JSON, and each reads its own folder and columns."""
    rows = spark.read.parquet(path)
    unit = lambda name, column: rows.where(F.col("unit") == name).select("matchid", column)
    return _match_tables(lambda _: unit("match", "m"), lambda _: unit("team", "t"), lambda _: unit("participant", "p"))


def stage_timelines(raw: DataFrame, path: str, payload: str = "payload") -> None:
    """Parse timeline payloads once and write participant frames and events as typed rows, in a folder per event type."""
    d = _frames(raw, payload)
    people, events = F.map_values("f.participantFrames"), F.col("f.events")
    units = _units(d, ["matchid", "frame_timestamp"], [("p", people, lambda x: F.lit("participant")), ("e", events, lambda x: F.concat(F.lit("event-"), F.coalesce(x["type"], F.lit(""))))])
    units.write.partitionBy("unit").parquet(path)


def staged_timeline_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of shred_timeline from what stage_timelines wrote."""
    rows = spark.read.parquet(path)
    people = rows.where("unit = 'participant'").select("matchid", "frame_timestamp", "p")
    return _timeline_tables(people, lambda kind: rows.where(F.col("unit") == f"event-{kind}").select("matchid", "frame_timestamp", "e.*"))


def write_tables(tables: dict[str, DataFrame], base: str) -> None:
    """Write every table to its own folder."""
    for name, rows in tables.items():
        rows.write.parquet(f"{base}/{name}")


def schema_drift(raw: DataFrame, expected: dict[str, list[str]], payload: str = "payload", key: str = "matchid") -> DataFrame:
    """(key, path, kind, names): keys that objects at the given paths lack or have too many, one row per finding."""
    parts = []
    for path, names in expected.items():
        held = F.map_keys(F.from_json(F.get_json_object(payload, path), "map<string,string>"))
        want = F.array(*[F.lit(n) for n in names])
        for kind, diff in (("missing", F.array_except(want, held)), ("unexpected", F.array_except(held, want))):
            parts.append(F.struct(F.lit(path).alias("path"), F.lit(kind).alias("kind"), F.array_sort(F.coalesce(diff, want if kind == "missing" else F.array().cast("array<string>"))).alias("names")))
    return raw.select(key, F.inline(F.array(*parts))).where(F.size("names") > 0)

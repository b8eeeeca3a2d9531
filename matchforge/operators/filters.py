"""Match filters: flags of participants and teams, their bits, and which games are valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchforge.functions.scalar import bitmask
from matchforge.operators.windows import suffix_rate

# Bit of each flag in masks; 18 is unused.
BITS = {
    "low_kda": 0, "gold_spent": 1, "high_winrate": 2, "team_kd": 3, "solo_carried": 4, "too_little_damage": 5,
    "low_minions": 6, "team_cs_gap": 7, "team_damage_ratio": 8, "low_build_value": 9, "unknown_teamposition": 10,
    "game_ruining": 11, "was_severe_transgressor": 12, "caused_game_end_from_ignb_surrender": 13,
    "team_ignb_surrendered": 14, "was_premade_with_ignb_game_end_causer": 15,
    "was_premade_with_severe_transgressor": 16, "zero_spell_casts_loss": 17, "zero_item_purchases_loss": 19,
}
TEAM = ["team_kd", "team_cs_gap", "team_damage_ratio"]
BEHAVIOUR = ["was_severe_transgressor", "caused_game_end_from_ignb_surrender", "team_ignb_surrendered", "was_premade_with_ignb_game_end_causer", "was_premade_with_severe_transgressor"]


def base_population(info: DataFrame, least_seconds: int = 990) -> DataFrame:
    """Matches of the newest season that lasted longer than the least duration."""
    newest = info.agg(F.max("season").alias("_newest"))
    return info.join(newest, F.col("season") == F.col("_newest")).where(F.col("gameduration") > least_seconds).drop("_newest")


def participant_rules() -> dict[str, Column]:
    """Flags of a participant row that has team_kills and team_damage: name to 0/1 column."""
    c = F.col
    farm = c("totalminionskilled") + c("neutralminionskilled")
    not_support = c("teamposition") != "UTILITY"
    rules = {
        "low_kda": (c("kills") + c("assists")) * 10 < c("deaths") * 2,
        "gold_spent": (c("win") == 0) & (c("goldearned") > 0) & (c("goldspent") * 100 < c("goldearned") * 50),
        "solo_carried": (c("win") == 1) & (c("team_kills") > 0) & (c("kills") * 100 > c("team_kills") * 75),
        "too_little_damage": not_support & (c("team_damage") > 0) & (c("damage") * 50 < c("team_damage")),
        "low_minions": not_support & (c("timeplayed") > 0) & (farm * 60 < c("timeplayed") * 3),
        "unknown_teamposition": c("teamposition").isin("", "UNKNOWN", "Invalid"),
        "zero_spell_casts_loss": (c("win") == 0) & (c("spellcasts") == 0),
        "zero_item_purchases_loss": (c("win") == 0) & (c("itemspurchased") == 0),
    }
    return {k: F.coalesce(v, F.lit(False)).cast("int") for k, v in rules.items()}


def behaviour_rules(columns: list[str]) -> dict[str, Column]:
    """Nullable behaviour flags as 0/1, and game_ruining as their union."""
    given = {b: F.coalesce(F.col(b).cast("int"), F.lit(0)) for b in BEHAVIOUR if b in columns}
    return given | ({"game_ruining": F.greatest(*given.values())} if len(given) > 1 else {})


def team_totals(players: DataFrame) -> DataFrame:
    """One row per match and team: kills, deaths, damage and creep score per minute, own and the other team's.

    Both teams are summed in one row per match and unpivoted, so no self join is needed.
    """
    per_minute = (F.col("totalminionskilled") + F.col("neutralminionskilled")) * 60.0 / F.col("timeplayed")
    lane = (F.col("teamposition") != "UTILITY") & (F.col("timeplayed") > 0)
    aggs = []
    for t in (100, 200):
        mine = F.col("teamid") == t
        aggs += [F.coalesce(F.sum(F.when(mine, F.col(x))), F.lit(0)).alias(f"{x}_{t}") for x in ("kills", "deaths", "damage")]
        aggs.append(F.coalesce(F.avg(F.when(mine & lane, per_minute)), F.lit(0.0)).alias(f"cs_{t}"))
    side = lambda t, o: F.struct(F.lit(t).alias("teamid"), F.col(f"kills_{t}").alias("team_kills"), F.col(f"deaths_{t}").alias("team_deaths"), F.col(f"damage_{t}").alias("team_damage"), F.col(f"damage_{o}").alias("enemy_damage"), F.col(f"cs_{t}").alias("team_cs"), F.col(f"cs_{o}").alias("enemy_cs"))
    return players.groupBy("matchid").agg(*aggs).select("matchid", F.inline(F.array(side(100, 200), side(200, 100))))


def with_team_totals(players: DataFrame) -> DataFrame:
    """Participants with the totals of team_totals, by one window over the match: rows are not grouped and joined again."""
    match = Window.partitionBy("matchid")
    per_minute = (F.col("totalminionskilled") + F.col("neutralminionskilled")) * 60.0 / F.col("timeplayed")
    lane = (F.col("teamposition") != "UTILITY") & (F.col("timeplayed") > 0)
    sums = {}
    for t in (100, 200):
        mine = F.col("teamid") == t
        sums |= {f"_{x}_{t}": F.coalesce(F.sum(F.when(mine, F.col(x))).over(match), F.lit(0)) for x in ("kills", "deaths", "damage")}
        sums[f"_cs_{t}"] = F.coalesce(F.avg(F.when(mine & lane, per_minute)).over(match), F.lit(0.0))
    own = lambda x: F.when(F.col("teamid") == 100, F.col(f"_{x}_100")).when(F.col("teamid") == 200, F.col(f"_{x}_200"))
    other = lambda x: F.when(F.col("teamid") == 100, F.col(f"_{x}_200")).when(F.col("teamid") == 200, F.col(f"_{x}_100"))
    out = players.withColumns(sums)
    return out.withColumns({"team_kills": own("kills"), "team_deaths": own("deaths"), "team_damage": own("damage"), "enemy_damage": other("damage"), "team_cs": own("cs"), "enemy_cs": other("cs")}).drop(*sums)


def team_rules() -> dict[str, Column]:
    c = F.col
    return {
        "team_kd": (c("team_kills") * 5 < c("team_deaths") * 2).cast("int"),
        "team_cs_gap": (c("enemy_cs") - c("team_cs") > 2.0).cast("int"),
        "team_damage_ratio": ((c("enemy_damage") > 0) & (c("team_damage") * 2 < c("enemy_damage"))).cast("int"),
    }


def high_winrate(players: DataFrame, order: list, least_games: int = 40, lifetime: int = 70, recent: int = 85) -> DataFrame:
    """(puuid, matchid, high_winrate) of suspects: lifetime games above the least and wins above `lifetime` per cent;
    flagged where the rate from the newest game to this one is `recent` per cent at least."""
    life = players.groupBy("puuid").agg(F.count("*").alias("g"), F.sum("win").alias("w"))
    suspects = life.where((F.col("g") > least_games) & (F.col("w") * 100 > F.col("g") * lifetime)).select("puuid")
    run = suffix_rate(players.join(suspects, "puuid", "left_semi"), ["puuid"], order, "win")
    return run.select("puuid", "matchid", (F.col("suffix_wins") * 100 >= F.col("suffix_games") * recent).cast("int").alias("high_winrate"))


def participant_flags(players: DataFrame, without: tuple = ()) -> DataFrame:
    """All flags per participant, 0 or 1. Flags that `players` has no columns for have to be named in `without`, and are 0.

    A flag that is given as a column of its own name is taken over, null as 0; `best_build_value` gives low_build_value.
    """
    joined = with_team_totals(players)
    flags = participant_rules() | team_rules() | behaviour_rules(players.columns)
    if "best_build_value" in players.columns:
        flags["low_build_value"] = F.coalesce((F.col("best_build_value") < 0.5).cast("int"), F.lit(0))
    for b in BITS:
        if b in flags:
            continue
        if b not in players.columns and b not in without:
            raise ValueError(f"no column gives the flag {b}; name it in `without` to leave it out")
        flags[b] = F.coalesce(F.col(b).cast("int"), F.lit(0)) if b in players.columns else F.lit(0)
    return joined.select("matchid", "participantid", "teamid", "win", *[flags[b].alias(b) for b in BITS])


def valid_rows(df: DataFrame, result: DataFrame) -> DataFrame:
    """The rows of valid matches: `result` is what filter_result gives."""
    return df.join(result.where("is_valid = 1").select("matchid").distinct(), "matchid", "left_semi")


def rule_win_rates(flags: DataFrame) -> DataFrame:
    """rule, flagged, win_rate: participants with each flag and how often they won; one pass, unpivoted."""
    sums = flags.agg(*[F.sum(b).alias(b) for b in BITS], *[F.sum(F.col(b) * F.col("win")).alias(f"w_{b}") for b in BITS])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(b).alias("rule"), F.col(b).cast("long").alias("flagged"), F.try_divide(F.col(f"w_{b}"), F.col(b)).alias("win_rate")) for b in BITS])))


def cumulative_removal(flags: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """category, place, games: games that are flagged by a category or one before it, in the order given."""
    games, parts, so_far = game_flags(flags), [], F.lit(0)
    for name, rules in categories.items():
        so_far = F.greatest(so_far, *[F.col(x) for x in rules])
        parts.append((name, F.sum(so_far)))
    sums = games.agg(*[s.cast("long").alias(n) for n, s in parts])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("category"), F.lit(i).alias("place"), F.col(n).alias("games")) for i, n in enumerate(categories)])))


def clean_matches(flags: DataFrame) -> DataFrame:
    """Matches in which no participant has any flag."""
    return flags.groupBy("matchid").agg(*[F.max(b).alias(b) for b in BITS]).where(sum(F.col(b) for b in BITS) == 0).select("matchid")


def game_flags(flags: DataFrame) -> DataFrame:
    out = flags.groupBy("matchid").agg(*[F.max(b).alias(b) for b in BITS])
    return out.withColumn("any_filter_triggered", F.greatest(*[F.col(b) for b in BITS]))


def filter_result(flags: DataFrame) -> DataFrame:
    """Per participant: masks of its own flags (player, team), of the whole game, and whether the game is valid."""
    own = [(F.col(b), i) for b, i in BITS.items() if b not in TEAM]
    team = [(F.col(b), i) for b, i in BITS.items() if b in TEAM]
    mine = flags.select("matchid", "participantid", bitmask(own).alias("player_rule_mask"), bitmask(team).alias("team_rule_mask"))
    game = F.bit_or(F.col("player_rule_mask").bitwiseOR(F.col("team_rule_mask"))).over(Window.partitionBy("matchid"))
    return mine.withColumn("rule_mask", game).withColumn("is_valid", (F.col("rule_mask") == 0).cast("int"))


def filter_statistics(flags: DataFrame) -> DataFrame:
    """Rows (rule, games, share) per flag, and for `any` and `valid`: one pass over games, then unpivoted."""
    games = game_flags(flags)
    sums = games.agg(F.count("*").alias("n"), *[F.sum(b).alias(b) for b in [*BITS, "any_filter_triggered"]])
    rows = [F.struct(F.lit(b).alias("rule"), F.col(b).cast("long").alias("games")) for b in BITS]
    rows += [F.struct(F.lit("any").alias("rule"), F.col("any_filter_triggered").cast("long").alias("games")), F.struct(F.lit("valid").alias("rule"), (F.col("n") - F.col("any_filter_triggered")).cast("long").alias("games"))]
    return sums.select("n", F.inline(F.array(*rows))).select("rule", "games", F.round(F.col("games") / F.expr("nullif(n, 0)"), 6).alias("share"))

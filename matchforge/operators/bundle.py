"""The full bundle of prior features of a line-up: solo rates, duels across teams, pairs inside teams, each with its evidence.

Interactions are looked up on a ladder of keys, from the finest to the coarsest, and pooled: nested (what a level lacks in weight it takes
from the coarser one) or by mode. Their floor is what the solo rates of the two say, or one half on the neutral ladder.

What a pair gets follows from the keys of its two players alone. Players are therefore staged once with a number for the values of their keys,
pairs are counted by two such numbers, ladders are looked up and pooled for pairs of numbers, and pairs of players meet the result in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchforge.functions import smoothing as M
from matchforge.sources.scratch import write_shared

# Keys of the ladders, and the ladder whose floor is one half.
LADDER = {"build": ["championid", "teamposition", "build"], "nobuild": ["championid", "teamposition"], "champion": ["championid"]}
NEUTRAL_LADDER = ("build", "build_group", "nobuild")


def _staged(df: DataFrame, name: str) -> DataFrame:
    return df.sparkSession.read.parquet(write_shared(df, name))


def _seats(rows: DataFrame, history: DataFrame | Column, columns: list[str]) -> DataFrame:
    """matchid, teamid, slot, win, the keys' columns, and whether a row wants features (_now) and whether rates come from it (_past)."""
    held = lambda df, now, past: df.select("matchid", "teamid", F.col("participantid").alias("slot"), F.col("win").cast("double").alias("win"), *columns, now.alias("_now"), past.alias("_past"))
    if isinstance(history, Column):
        return held(rows, F.lit(True), F.coalesce(history, F.lit(False)))
    return held(rows, F.lit(True), F.lit(False)).unionByName(held(history, F.lit(False), F.lit(True)))


def _kinds(seats: DataFrame, columns: list[str], ladder: list[str], keys: dict[str, list[str]]) -> DataFrame:
    """The keys' columns, their number _k, and per level the number k_<level> that all rows of equal keys share. Small: one row per line-up choice."""
    numbered = _staged(seats.select(*columns).distinct().withColumn("_k", F.monotonically_increasing_id()), "kinds")
    return numbered.withColumns({f"k_{x}": F.min("_k").over(Window.partitionBy(*keys[x])) for x in ladder})


def _pairs(players: DataFrame, blue: int) -> DataFrame:
    """Pairs of a match: a of the blue team against b of the other (_across), or a before b in one team. A line-up is small, so pairs are few."""
    a = players.withColumnsRenamed({c: f"a_{c}" for c in players.columns if c != "matchid"})
    b = players.withColumnsRenamed({c: f"b_{c}" for c in players.columns if c != "matchid"})
    across = (F.col("a_teamid") == blue) & (F.col("b_teamid") != blue)
    inside = (F.col("a_teamid") == F.col("b_teamid")) & (F.col("a_slot") < F.col("b_slot"))
    both = {f"_{w}": F.col(f"a__{w}") & F.col(f"b__{w}") for w in ("now", "past")}
    return a.join(b, "matchid").where(across | inside).withColumns({"_across": across} | both).where("_now OR _past")


def _cells(counted: DataFrame, level: str, across: bool) -> DataFrame:
    """_x, _y (keys in order), n and the rate of the first of them; a pair of equal keys counts for either side."""
    a, b = F.col(f"a_k_{level}"), F.col(f"b_k_{level}")
    turned, even = (a > b) & F.lit(across), (a == b) & F.lit(across)
    won = F.when(even, 0.5 * F.col("_n")).when(turned, F.col("_c") - F.col("_w")).otherwise(F.col("_w"))
    of = F.sum(F.when(even, F.col("_n")).otherwise(F.col("_c")))
    cells = counted.where("_n > 0").groupBy(F.least(a, b).alias("_x"), F.greatest(a, b).alias("_y"))
    return cells.agg(F.sum("_n").cast("double").alias("_cn"), F.when(of > 0, F.sum(won) / of).alias("_r"))


def _looked_up(counted: DataFrame, ladder: list[str], across: bool) -> DataFrame:
    """Pairs of numbers that want features, with n_<level> and r_<level>, the rate of a; no evidence and one half where a pair was never seen."""
    pairs = counted.where("_wanted")
    for x in ladder:
        a, b = F.col(f"a_k_{x}"), F.col(f"b_k_{x}")
        pairs = pairs.withColumns({"_x": F.least(a, b), "_y": F.greatest(a, b)}).join(_cells(counted, x, across), ["_x", "_y"], "left")
        rate = F.coalesce("_r", F.lit(0.5))
        pairs = pairs.withColumns({f"n_{x}": F.coalesce("_cn", F.lit(0.0)), f"r_{x}": F.when((a > b) & F.lit(across), 1.0 - rate).otherwise(rate)}).drop("_x", "_y", "_cn", "_r")
    return pairs


def _pooled(ladder: list[str], floor, strength: float, nested: bool, mode: str, confident: float, amplify: float) -> tuple[Column, Column]:
    """(value, effective n) of a ladder, finest level first."""
    levels = [(F.col(f"r_{x}"), F.col(f"n_{x}")) for x in ladder]
    if nested:
        return M.nested_shrink(levels[::-1], floor, strength)
    return M.smooth_levels(mode, levels, floor, strength, confident, amplify), F.col(f"n_{ladder[0]}")


def prior_features(rows: DataFrame, history: DataFrame | Column, versus: list[str], pairs: list[str], solo_strength: float = 20.0, versus_strength: float = 20.0, pair_strength: float = 20.0, nested: bool = True, mode: str = "additive", confident: float = 50.0, amplify: float = 0.0, blue: int = 100) -> DataFrame:
    """One long table: matchid, kind (solo, versus, pair), teamid and slot of a, slot of b (null for solo), value (the rate of a), n (its evidence).

    `rows` and `history`: matchid, teamid, participantid, win and the columns of the ladders' keys; rates come from `history`, which may be
    a condition on `rows`: these are then read once. `versus` and `pairs` are ladders, finest first, whose first level is also that of solo rates.
    """
    ladder = list(dict.fromkeys([*versus, *pairs]))
    columns = list(dict.fromkeys(c for x in ladder for c in LADDER[x]))
    staged = _staged(_seats(rows, history, columns), "seats")
    kinds = _kinds(staged, columns, ladder, LADDER)
    same = [F.col(f"_of.{c}").eqNullSafe(F.col(f"_as.{c}")) for c in columns]
    seats = staged.alias("_of").join(kinds.select(*columns, "_k").alias("_as"), same).select("matchid", "teamid", "slot", "win", "_now", "_past", "_k")

    fine = f"k_{ladder[0]}"
    tally = [F.count("*").alias("_n"), F.sum("win").alias("_w"), F.count("win").alias("_c")]
    each = seats.where("_past").groupBy("_k").agg(*tally).join(kinds.select("_k", fine), "_k")
    seen = each.groupBy(fine).agg(F.sum("_n").cast("double").alias("_n"), (F.sum("_w") / F.sum("_c")).alias("_r"))
    found = kinds.drop(*columns).join(seen, fine, "left").withColumn("_solo_n", F.coalesce("_n", F.lit(0.0)))
    solo = _staged(found.withColumn("_solo", M.smooth_rate(mode, F.coalesce("_r", F.lit(0.5)), F.col("_solo_n"), 0.5, solo_strength, confident, amplify)).drop("_n", "_r"), "solo")
    other = F.lit(None).cast(seats.schema["slot"].dataType).alias("other")
    out = seats.where("_now").join(solo, "_k").select("matchid", F.lit("solo").alias("kind"), "teamid", "slot", other, F.col("_solo").alias("value"), F.col("_solo_n").alias("n"))

    met = _pairs(seats, blue)
    past = lambda c: F.when(F.col("_past"), c)
    counted = _staged(met.groupBy("_across", "a__k", "b__k").agg(F.count(past(F.lit(1))).alias("_n"), F.coalesce(F.sum(past(F.col("a_win"))), F.lit(0.0)).alias("_w"), F.count(past(F.col("a_win"))).alias("_c"), F.max("_now").alias("_wanted")), "pairs")
    for side in "ab":
        counted = counted.join(solo.withColumnsRenamed({c: f"{side}_{c}" for c in solo.columns}), f"{side}__k")
    values = []
    for across, own, strength in ((True, versus, versus_strength), (False, pairs, pair_strength)):
        known = _looked_up(counted.where(F.col("_across") == across), own, across)
        sides = (F.col("a__solo"), F.col("b__solo"))
        floor = M.versus_prior(*sides) if across else M.floor_prior("even" if tuple(own) == NEUTRAL_LADDER else "solo", *sides)
        value, n = _pooled(own, floor, strength, nested, mode, confident, amplify)
        values.append(known.select("_across", "a__k", "b__k", value.alias("value"), n.alias("n")))
    each = met.where("_now").select("matchid", "_across", "a__k", "b__k", "a_teamid", "a_slot", "b_slot").join(_staged(values[0].unionByName(values[1]), "values"), ["_across", "a__k", "b__k"])
    kind = F.when(F.col("_across"), "versus").otherwise("pair").alias("kind")
    return out.unionByName(each.select("matchid", kind, F.col("a_teamid").alias("teamid"), F.col("a_slot").alias("slot"), F.col("b_slot").alias("other"), "value", "n"))

"""Win rates of groups of players inside and across teams.

A game is one row with two arrays of players, so that pairs, trios and quads are made inside the row and only counted
groups are shuffled; partial sums are made before the shuffle, which carries popular groups.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_games(players: DataFrame, fields: list[str], game: str = "matchid", size: int = 5) -> DataFrame:
    """One row per complete game: blue_win, blue and red as arrays of `size` structs in role order. `role_index` orders players."""
    who = F.struct("role_index", *fields)
    side = lambda team: F.array_sort(F.collect_list(F.when(F.col("teamid") == team, who)))
    rows = players.groupBy(game).agg(F.max(F.when(F.col("teamid") == 100, F.col("win"))).alias("blue_win"), side(100).alias("blue"), side(200).alias("red"))
    bare = lambda c: F.transform(c, lambda p: F.struct(*[p[f].alias(f) for f in fields]))
    return rows.where((F.size("blue") == size) & (F.size("red") == size)).select(game, "blue_win", bare("blue").alias("blue"), bare("red").alias("red"))


def group_combinations(players: Column, k: int, size: int = 5) -> Column:
    """Sorted groups of k players of one team."""
    return F.array(*[F.array_sort(F.array(*[players[i] for i in c])) for c in combinations(range(size), k)])


def cross_groups(a: Column, b: Column) -> Column:
    """All (left, right) of two arrays."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(x.alias("left"), y.alias("right")))))


def _rates(groups: DataFrame, keys: list[str]) -> DataFrame:
    out = groups.groupBy(*keys).agg(F.count("*").alias("matchups"), F.sum("won").cast("long").alias("wins"))
    return out.withColumn("win_rate", F.col("wins") / F.col("matchups"))


def versus(games: DataFrame, left: int, right: int, canonical: bool = True) -> DataFrame:
    """left-against-right groups: keys `left`, `right` (arrays of players), matchups, wins, win_rate of the left.

    Groups of equal size are put in order, smaller left, and the outcome turned; with `canonical` false the left is blue.
    Groups of unequal size are counted for both teams, the larger on the left.
    """
    duel = lambda a, b: cross_groups(group_combinations(F.col(a), left), group_combinations(F.col(b), right))
    blue = games.select("blue_win", F.explode(duel("blue", "red")).alias("d")).select("d.left", "d.right", F.col("blue_win").alias("won"))
    if left != right:
        red = games.select("blue_win", F.explode(duel("red", "blue")).alias("d")).select("d.left", "d.right", (1 - F.col("blue_win")).alias("won"))
        return _rates(blue.unionByName(red), ["left", "right"])
    if canonical:
        keep = F.col("left") <= F.col("right")
        blue = blue.select(F.when(keep, F.col("left")).otherwise(F.col("right")).alias("left"), F.when(keep, F.col("right")).otherwise(F.col("left")).alias("right"), F.when(keep, F.col("won")).otherwise(1 - F.col("won")).alias("won"))
    return _rates(blue, ["left", "right"])


def synergy(games: DataFrame, k: int) -> DataFrame:
    """Groups of k of one team: key `members`, matchups, wins, win_rate."""
    side = lambda c, won: games.select(F.explode(group_combinations(F.col(c), k)).alias("members"), won.alias("won"))
    return _rates(side("blue", F.col("blue_win")).unionByName(side("red", 1 - F.col("blue_win"))), ["members"])


def solo(players: DataFrame, keys: list[str]) -> DataFrame:
    """Games and win rate by any key of players."""
    return _rates(players.withColumn("won", F.col("win")), keys)


def regroup(pairs: DataFrame, change, key: str = "members") -> DataFrame:
    """Re-key counted groups by a function of a player, put them in order again and add counts up."""
    again = pairs.withColumn(key, F.array_sort(F.transform(key, change)))
    out = again.groupBy(key).agg(F.sum("matchups").alias("matchups"), F.sum("wins").alias("wins"))
    return out.withColumn("win_rate", F.col("wins") / F.col("matchups"))

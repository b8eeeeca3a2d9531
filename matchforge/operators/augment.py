"""Features of matches for models: lanes and prior bundles, vocabulary ids, side swaps, tables of hypotheses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchforge.functions import smoothing as M


def lanes(players: DataFrame) -> DataFrame:
    """One row per pair of opponents in a role: matchid, teamposition, blue, red (champions), win (of blue)."""
    red = players.where("teamid = 200").select("matchid", "teamposition", F.col("championid").alias("red"))
    return players.where("teamid = 100").select("matchid", "teamposition", F.col("championid").alias("blue"), "win").join(red, ["matchid", "teamposition"])


def prior_bundle(rows: DataFrame, history: DataFrame, solo: DataFrame, solo_strength: float, duel_strength: float) -> DataFrame:
    """Per match: lanes, mean solo priors of both sides, of the duel and of the pair, and the evidence behind them.

    `solo`: championid, teamposition, n, rate. `history` holds the lanes that duels are counted from. What is not known has
    the rate one half and no evidence; duels are drawn to what the two solo priors make of them.
    """
    duel = history.groupBy("blue", "red").agg(F.count("*").cast("double").alias("dn"), F.avg("win").alias("dr"))
    out = rows.join(duel, ["blue", "red"], "left")
    for side in ("blue", "red"):
        cell = solo.select(F.col("championid").alias(side), "teamposition", F.col("n").alias(f"n_{side}"), F.col("rate").alias(f"r_{side}"))
        out = out.join(cell, [side, "teamposition"], "left")
        n, rate = F.coalesce(F.col(f"n_{side}"), F.lit(0.0)), F.coalesce(F.col(f"r_{side}"), F.lit(0.5))
        out = out.withColumn(f"s_{side}", M.bayes_rate(rate, n, 0.5, solo_strength)).withColumn(f"n_{side}", n)
    blue, red, n = F.col("s_blue"), F.col("s_red"), F.coalesce("dn", F.lit(0.0))
    out = out.withColumn("duel", M.bayes_rate(F.coalesce("dr", F.lit(0.5)), n, M.versus_prior(blue, red), duel_strength)).withColumn("pair", M.pair_prior(blue, red))
    return out.groupBy("matchid").agg(F.count("*").alias("lanes"), F.avg("s_blue").alias("solo_blue"), F.avg("s_red").alias("solo_red"), F.avg("duel").alias("duel"), F.avg("pair").alias("pair"), F.sum(n + F.col("n_blue") + F.col("n_red")).alias("effective_n"))


def vocabulary_ids(df: DataFrame, known: DataFrame, label: str, name: str) -> DataFrame:
    """Place of a label among the sorted distinct labels of `known`; unknown and null ones get their number. Labels meet their places by a join."""
    words = known.where(F.col(label).isNotNull()).select(F.col(label).alias("_word")).distinct()
    places = words.withColumn("_place", F.row_number().over(Window.orderBy("_word")) - 1)  # one row per label
    size = words.agg(F.count("*").alias("_size"))
    out = df.join(places, F.col(label) == F.col("_word"), "left").crossJoin(size)
    return out.withColumn(name, F.coalesce("_place", "_size").cast("long")).drop("_word", "_place", "_size")


def number_ids(df: DataFrame, known: DataFrame, number: str, name: str) -> DataFrame:
    """Numbers as they are; those above the largest of `known` become it plus one."""
    top = known.agg((F.max(number) + 1).alias("_top"))
    return df.crossJoin(top).withColumn(name, F.least(F.coalesce(F.col(number), F.col("_top")), F.col("_top")).cast("long")).drop("_top")


def side_swap(games: DataFrame, arrays: list[str], signed: list[str], label: str, half: int = 5) -> DataFrame:
    """Games as they are and with their sides swapped: halves of arrays change places, signed columns their sign, the label its side."""
    turned = games.withColumns({a: F.concat(F.slice(a, half + 1, half), F.slice(a, 1, half)) for a in arrays} | {s: -F.col(s) for s in signed} | {label: 1 - F.col(label)})
    return games.withColumn("swapped", F.lit(0)).unionByName(turned.withColumn("swapped", F.lit(1)))


def hypotheses(known: DataFrame, cells: DataFrame, keys: list[str], strength: float) -> DataFrame:
    """Smoothed prior of every combination of the keys' values (small sets each), with its count; one half and 0 where unseen."""
    table = known.select(keys[0]).distinct()
    for k in keys[1:]:
        table = table.crossJoin(known.select(k).distinct())
    out = table.join(cells, keys, "left")
    n = F.coalesce("n", F.lit(0.0))
    return out.select(*keys, M.bayes_rate(F.coalesce("rate", F.lit(0.5)), n, 0.5, strength).alias("prior"), n.alias("n"))


def surface(df: DataFrame, allowed: list[str], keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Keys and the columns of a feature surface. A wanted column that the surface does not allow, or that is missing, is an error."""
    wanted = allowed if columns is None else columns
    if wrong := sorted((set(wanted) - set(allowed)) | (set(wanted) - set(df.columns))):
        raise ValueError(f"not columns of this surface: {wrong}")
    return df.select(*keys, *wanted)


def level_matrix(level: DataFrame, keys: list[str], features: list[str], context: DataFrame | None = None, static: DataFrame | None = None) -> DataFrame:
    """Unique keys with `features`, an array of doubles in the order given (nulls are 0), and, if given, `context` and `static`: arrays of all
    further columns of those tables by the keys they share with the level, zeros where they have no row.

    Of rows with equal keys the one with the smallest values, column by column, stays.
    """
    vector = lambda columns: F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    out = level.groupBy(*keys).agg(F.min(F.struct(*features)).alias("_f")).select(*keys, "_f.*").withColumn("features", vector(features))
    for name, block in (("context", context), ("static", static)):
        if block is not None:
            on = [k for k in keys if k in block.columns]
            values = [c for c in block.columns if c not in on]
            once = block.groupBy(*on).agg(F.min(F.struct(*values)).alias("_b")).select(*on, vector([f"_b.{c}" for c in values]).alias(name))
            out = out.join(once, on, "left").withColumn(name, F.coalesce(name, F.array_repeat(F.lit(0.0), len(values))))
    kept = ["features", *[n for n, b in (("context", context), ("static", static)) if b is not None]]
    return out.select(*keys, *kept)

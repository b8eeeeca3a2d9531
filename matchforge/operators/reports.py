"""Reports: label distribution, item frequency, scaling bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchforge.functions.scalar import hash32
from matchforge.operators.joins import bracket


def label_distribution(players: DataFrame, label: str = "build", least: int = 20) -> DataFrame:
    """Games of each (champion, role, label), share of its (champion, role), for cells above the least count."""
    n = players.groupBy("championid", "teamposition", label).agg(F.count("*").alias("n"))
    slot = Window.partitionBy("championid", "teamposition")
    return n.withColumn("slot_n", F.sum("n").over(slot)).withColumn("share", F.round(F.col("n") / F.col("slot_n"), 6)).where(F.col("n") > least)


def item_frequency(items: DataFrame) -> DataFrame:
    """Uses of each item by (champion, role)."""
    return items.where("itemid <> 0").groupBy("championid", "teamposition", "itemid").agg(F.count("*").alias("uses"))


def bin_centres(df: DataFrame, value: str, edges: list[tuple]) -> DataFrame:
    """bin, n and mean value of each bin."""
    from matchforge.operators.joins import bin_join

    return bin_join(df, edges, value).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg(value).alias("centre"))


def soft_bins(df: DataFrame, key: str, value: str, centres: list[float]) -> DataFrame:
    """One bin per row, drawn by the key's hash between the centres around the value with Gaussian weights.

    sigma is a third of the distance of the centres, 0.25 at least. Columns: low, high, p_low, centre.
    """
    out = bracket(df, centres, value)
    sigma = F.greatest((F.col("high") - F.col("low")) / 3.0, F.lit(0.25))
    # Ratio of two Gaussians as one logistic, so that far values do not divide 0 by 0.
    squared = lambda c: F.pow((F.col(value) - c) / sigma, F.lit(2.0))
    p = 1.0 / (1.0 + F.exp(F.least(F.greatest(0.5 * (squared(F.col("low")) - squared(F.col("high"))), F.lit(-700.0)), F.lit(700.0))))
    draw = hash32(F.col(key)) % 10_000 / 10_000.0
    return out.withColumn("p_low", p).withColumn("centre", F.when(draw < F.col("p_low"), F.col("low")).otherwise(F.col("high")))


def skew_profiles(df: DataFrame, key: str, early, late, least: int, top: int = 10) -> DataFrame:
    """Keys with at least `least` rows, ranked by late minus early rate: the `top` of either end."""
    n = df.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.when(early, F.col("win"))).alias("early"), F.avg(F.when(late, F.col("win"))).alias("late"))
    skew = n.where((F.col("n") >= least) & F.col("early").isNotNull() & F.col("late").isNotNull()).withColumn("skew", F.round(F.col("late") - F.col("early"), 6))
    first = skew.orderBy(F.desc("skew"), key).limit(top).withColumn("end", F.lit("late"))
    return first.unionByName(skew.orderBy("skew", key).limit(top).withColumn("end", F.lit("early"))).select(key, "n", "skew", "end")


def player_inspector(players: DataFrame, champion: int, role: str, build: str, images) -> DataFrame:
    """Players of one champion, role and build with outcome, KDA and the image of their item; `images` is a Dictionary by itemid."""
    rows = players.where((F.col("championid") == champion) & (F.col("teamposition") == role) & (F.col("build") == build))
    rows = images.look_up(rows, {"itemid": "itemid"})
    outcome = F.when(F.col("win") == 1, "WIN").otherwise("LOSS")
    return rows.withColumn("outcome", outcome).withColumn("kda", (F.col("kills") + F.col("assists")) / F.greatest(F.col("deaths"), F.lit(1)))


def season_counts(players: DataFrame) -> DataFrame:
    """season, n (participants), lacking (matches without ten different pairs of team and role)."""
    seat = F.when(F.col("teamid").isNotNull() & F.col("teamposition").isNotNull(), F.struct("teamid", "teamposition"))
    different = lambda c: F.size(F.collect_set(c))  # noqa: E731  a match is small: sets need no copy of its rows for each count, nor a further shuffle
    seats = players.groupBy("season", "matchid").agg(different(seat).alias("seats"), different("participantid").alias("n"))
    return seats.groupBy("season").agg(F.sum("n").cast("long").alias("n"), F.sum((F.col("seats") < 10).cast("long")).alias("lacking"))


def completed_items(players: DataFrame, known: DataFrame, items: str, size: int = 10) -> DataFrame:
    """matchid, items: completed items of a participant on average, of matches with exactly `size` participants."""
    from matchforge.operators.joins import known_items

    counted = known_items(players.select("matchid", items), known, items, known.columns[0], "_done")
    return counted.groupBy("matchid").agg(F.avg("_done").alias("items"), F.count("*").alias("_n")).where(F.col("_n") == size).drop("_n")


def bin_checks(binned: DataFrame, key: str, bin_: str, bins: int) -> DataFrame:
    """check, value: rows, repeated keys, rows outside all bins, and bins without rows."""
    keys = binned.groupBy(key).agg(F.count("*").alias("c"), F.sum(F.col(bin_).isNull().cast("long")).alias("out"))
    sums = keys.agg(F.sum("c").alias("rows"), F.sum(F.col("c") - 1).alias("repeated"), F.sum("out").alias("outside"))
    filled = binned.agg((F.lit(bins) - F.count_distinct(bin_)).alias("empty_bins"))
    names = ["rows", "repeated", "outside", "empty_bins"]
    return sums.crossJoin(filled).select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).cast("double").alias("value")) for n in names])))

"""Item-build labels: items to rows, archetype sums, and the best archetype with a fixed order for ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.operators.joins import lookup_with_fallback

# Archetypes in the order in which ties are decided.
ARCHETYPES = ["crit", "lethality", "utility_enchanter", "utility_protection", "ar_tank", "mr_tank", "ad_off_tank", "ap_off_tank", "on_hit", "ability_power", "attack_damage"]


def explode_items(players: DataFrame, keys: list[str], slots: list[str], keep_empty: bool = False) -> DataFrame:
    """One row per item slot. Empty slots (0 or null) are dropped, but a player without items keeps one row with item 0."""
    items = F.transform(F.array(*slots), lambda x: F.coalesce(x, F.lit(0)))
    if not keep_empty:
        some = F.filter(items, lambda x: x != 0)
        items = F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(0)))
    return players.select(*keys, F.explode(items).alias("itemid"))


def archetype_totals(items: DataFrame, weights: DataFrame, coarse: DataFrame, keys: list[str], on: list[str], names: list[str] = ARCHETYPES) -> DataFrame:
    """Sum of item weights per player: the weights of (champion, role, item), else of the item alone, else 0."""
    found = lookup_with_fallback(items, weights, coarse, on, ["itemid"], names)
    return found.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def argmax_label(df: DataFrame, names: list[str] = ARCHETYPES, label: str = "label", value: str = "best") -> DataFrame:
    """The name of the largest column, the first in order on ties; `none` where the largest is 0."""
    best, out = F.greatest(*names) if len(names) > 1 else F.col(names[0]), F.lit("none")
    for n in reversed(names):
        out = F.when(F.col(n) == best, F.lit(n)).otherwise(out)
    return df.withColumn(value, best).withColumn(label, F.when(best == 0, F.lit("none")).otherwise(out))

"""Window and order operators: running rates, limits by key, interleaving, rule resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchforge.functions.scalar import hash32


def suffix_rate(df: DataFrame, part: list[str], order: list, won: str) -> DataFrame:
    """Games and wins from the newest row to this one; `order` has to end in a unique key."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("suffix_games", F.count("*").over(w)).withColumn("suffix_wins", F.sum(won).over(w))


def limit_by(df: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def hash_order(key: str, salt: str = "") -> list:
    """Order of a seeded shuffle, unique by the key."""
    return [hash32(F.concat(F.lit(salt), F.col(key).cast("string"))), F.col(key)]


def interleave(df: DataFrame, group: str, order: list, name: str = "turn") -> DataFrame:
    """`turn` of a round robin over groups: sort by it, then by the group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def resolve_rules(rules: DataFrame, targets: DataFrame, scopes: list[str]) -> DataFrame:
    """The rule of each target: null scopes match all; the most specific wins, then the highest priority, then the smallest rule id."""
    r = rules.withColumnsRenamed({s: f"_r_{s}" for s in scopes})
    match, special = F.lit(True), F.lit(0)
    for s in scopes:
        match = match & (F.col(f"_r_{s}").isNull() | (F.col(f"_r_{s}") == F.col(s)))
        special = special + F.col(f"_r_{s}").isNotNull().cast("int")
    found = targets.join(r, match).withColumn("_special", special)
    place = F.row_number().over(Window.partitionBy(*targets.columns).orderBy(F.desc("_special"), F.desc("priority"), "rule_id"))
    return found.withColumn("_place", place).where("_place = 1").select(*targets.columns, "rule_id")

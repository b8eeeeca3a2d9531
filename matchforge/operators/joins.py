"""Joins: at most one match, lookups with defaults and fallbacks, bins, brackets, tails of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def any_join(left: DataFrame, right: DataFrame, on: list[str], order: list, how: str = "left") -> DataFrame:
    """Join with the first right row of each key in `order`; the right side is cut to one row a key before it is joined."""
    place = F.row_number().over(Window.partitionBy(*on).orderBy(*order))
    return left.join(right.withColumn("_place", place).where("_place = 1").drop("_place"), on, how)


def lookup(df: DataFrame, table: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    """Left join with defaults for what is not found. Small tables are broadcast by the optimiser, by their size."""
    out = df.join(table.select(*on, *defaults), on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def lookup_with_fallback(df: DataFrame, fine: DataFrame, coarse: DataFrame, on: list[str], coarse_on: list[str], values: list[str], default=0.0) -> DataFrame:
    """Values of the fine row if there is one, else of the coarse row, else the default; rows are never mixed."""
    f = fine.select(*on, F.lit(1).alias("_fine"), *[F.col(v).alias(f"_f_{v}") for v in values])
    c = coarse.select(*coarse_on, *[F.col(v).alias(f"_c_{v}") for v in values])
    out = df.join(f, on, "left").join(c, coarse_on, "left")
    pick = {v: F.coalesce(F.when(F.col("_fine").isNotNull(), F.col(f"_f_{v}")).otherwise(F.col(f"_c_{v}")), F.lit(default)) for v in values}
    return out.withColumns(pick).drop("_fine", *[f"_f_{v}" for v in values], *[f"_c_{v}" for v in values])


def bin_join(df: DataFrame, bins: list[tuple], value: str, name: str = "bin") -> DataFrame:
    """Number of the bin (low, high; high None is open) that holds the value, null if none; bins are literals, no join."""
    v, out = F.col(value), F.lit(None).cast("int")
    for i, (low, high) in reversed(list(enumerate(bins))):
        inside = (v >= low) if high is None else ((v >= low) & (v < high))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return df.withColumn(name, out)


def bracket(df: DataFrame, centres: list[float], value: str) -> DataFrame:
    """The centres next below and next above a value, as of a sorted list; at the ends both are the outermost centre."""
    v, low, high = F.col(value), F.lit(None).cast("double"), F.lit(None).cast("double")
    for c in sorted(centres):
        low = F.when(v >= c, F.lit(float(c))).otherwise(low)
    for c in sorted(centres, reverse=True):
        high = F.when(v <= c, F.lit(float(c))).otherwise(high)
    return df.withColumn("low", F.coalesce(low, F.lit(float(min(centres))))).withColumn("high", F.coalesce(high, F.lit(float(max(centres)))))


def tail_window(events: DataFrame, ends: DataFrame, on: str, at: str, end: str, width) -> DataFrame:
    """Events within `width` before the end of their match."""
    return events.join(ends.select(on, end), on).where((F.col(at) <= F.col(end)) & (F.col(at) >= F.col(end) - width))


class Dictionary:
    """Entries by key with defaults for what is not there; the planner broadcasts them if their size allows.

    Of entries with equal keys the one with the smallest attributes, in the order of `defaults`, stays.
    """

    def __init__(self, entries: DataFrame, keys: list[str], defaults: dict):
        once = entries.groupBy(*keys).agg(F.min(F.struct(*defaults)).alias("_a")).select(*keys, "_a.*")
        self.entries, self.keys, self.defaults = once, keys, defaults

    def look_up(self, df: DataFrame, keys: dict[str, str]) -> DataFrame:
        """`df` with the attributes and `found` (1 or 0); `keys` maps the dictionary's keys to columns of `df`. Attributes replace columns of their name."""
        named = self.entries.select(*[F.col(k).alias(f"_k_{k}") for k in self.keys], *[F.col(a).alias(f"_a_{a}") for a in self.defaults], F.lit(1).alias("_found"))
        same = F.lit(True)
        for k in self.keys:
            same = same & (F.col(keys[k]) == F.col(f"_k_{k}"))
        out = df.drop("found").join(named, same, "left")
        given = F.col("_found") == 1
        out = out.withColumns({a: F.when(given, F.col(f"_a_{a}")).otherwise(F.lit(v)) for a, v in self.defaults.items()} | {"found": F.coalesce("_found", F.lit(0))})
        return out.drop("_found", *[f"_k_{k}" for k in self.keys], *[f"_a_{a}" for a in self.defaults])


def known_items(df: DataFrame, entries: DataFrame, items: str, key: str, name: str) -> DataFrame:
    """Number of items of an array that a dictionary holds, repeated items each time; null items and null arrays count nothing.

    Items meet the dictionary by a join, so it may be of any size; rows are told apart by a number, so equal rows stay apart.
    """
    rows = df.withColumn("_row", F.struct(F.monotonically_increasing_id(), F.spark_partition_id()))
    kept = [c for c in df.columns if c != items]
    held = entries.select(F.col(key).alias("_key")).where("_key IS NOT NULL").distinct()
    each = rows.select("_row", *kept, F.explode_outer(items).alias("_key")).join(held.withColumn("_known", F.lit(1)), "_key", "left")
    return each.groupBy("_row").agg(*[F.first(c).alias(c) for c in kept], F.count("_known").cast("int").alias(name)).drop("_row")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, within: int) -> DataFrame:
    """The last `value` of `right` at or before each left row, not older than `within`; null if none.

    Both sides are put in one order by key and time, and the last value is carried along: no pairs are made. At equal times
    the right side comes first, the largest value last.
    """
    rows = left.withColumn("_side", F.lit(1)).withColumn(f"_{value}", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_at", F.lit(None).cast("long"))
    other = right.select(key, at, F.col(value).alias(f"_{value}"), F.col(at).cast("long").alias("_at"), F.lit(0).alias("_side"))
    both = rows.unionByName(other, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(at, "_side", f"_{value}").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.struct("_at", f"_{value}")), ignorenulls=True).over(order)
    out = both.withColumn("_last", last).where("_side = 1")
    return out.withColumn(value, F.when(F.col(at) - F.col("_last._at") <= within, F.col(f"_last._{value}"))).drop("_side", "_at", f"_{value}", "_last")


def gather_latent(df: DataFrame, latent: DataFrame, keys: list[str], vector: str, size: int) -> DataFrame:
    """The vector of each row's identity and confidence 1; a vector of zeros and confidence 0 where there is none."""
    out = df.join(latent.select(*keys, vector), keys, "left")
    zeros = F.array_repeat(F.lit(0.0), size)
    return out.withColumn("confidence", F.col(vector).isNotNull().cast("int")).withColumn(vector, F.coalesce(F.col(vector), zeros))

"""Sketches as columns: made per partition and back-off level, stored, and united when they are read.

A sketch of a union is the union of sketches, so counts of distinct values and quantiles over any set of partitions come from their
stored rows without reading the data again, and a partition that is sent again replaces its own rows only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchforge.operators.selection import values_at


@dataclass(frozen=True)
class Kind:
    """A sketch: made of a column, united, and asked. `size` is its parameter; larger is more exact."""

    make: Callable[[Column, int], Column]
    unite: Callable[[Column, int], Column]
    size: int


KINDS = {
    # distinct values, about 1.04 / sqrt(2^size) relative error
    "distinct": Kind(lambda c, n: F.hll_sketch_agg(c, F.lit(n)), lambda s, n: F.hll_union_agg(s), 14),
    # sets of values, exact up to 2^size of them, about 1 / sqrt(2^size) beyond; can be united, intersected and subtracted
    "set": Kind(lambda c, n: F.theta_sketch_agg(c, F.lit(n)), lambda s, n: F.theta_union_agg(s, F.lit(n)), 12),
    # values for quantiles, exact up to about `size` of them
    "values": Kind(lambda c, n: F.kll_sketch_agg_double(c.cast("double"), F.lit(n)), lambda s, n: F.kll_merge_agg_double(s, F.lit(n)), 400),
}


@dataclass(frozen=True)
class Sketch:
    """A named sketch of a column of a kind of KINDS; `size` None takes the kind's own."""

    name: str
    kind: str
    column: str
    size: int | None = None

    def _size(self) -> int:
        return self.size or KINDS[self.kind].size

    def made(self, column: Column) -> Column:
        return KINDS[self.kind].make(column, self._size()).alias(self.name)

    def united(self) -> Column:
        return KINDS[self.kind].unite(F.col(self.name), self._size()).alias(self.name)


def sketch_levels(df: DataFrame, part: list[str], levels: dict[str, list[str]], sketches: list[Sketch]) -> DataFrame:
    """part columns, level, key (the level's columns as JSON, nulls left out), rows, and one column per sketch.

    Every row counts in each level; all levels are made by one aggregate, whose partial sketches are what is shuffled. Nulls are in
    no sketch; a key without values has empty sketches.
    """
    rows = _levelled(df, levels, [*part, *{s.column for s in sketches}])
    return rows.groupBy(*part, "level", "key").agg(F.count("*").alias("rows"), *[s.made(F.col(s.column)) for s in sketches])


def united(stored: DataFrame, keys: list[str], sketches: list[Sketch]) -> DataFrame:
    """One row per key: the rows and the sketches of all stored rows of it."""
    return stored.groupBy(*keys).agg(F.sum("rows").alias("rows"), *[s.united() for s in sketches])


def distinct_estimate(s: Sketch) -> Column:
    """Number of distinct values in a sketch of kind 'distinct' or 'set'."""
    return (F.hll_sketch_estimate if s.kind == "distinct" else F.theta_sketch_estimate)(F.col(s.name))


def quantile_estimate(s: Sketch, share: float) -> Column:
    """The smallest value with at least this share of the values up to it; null without values."""
    return F.when(F.kll_sketch_get_n_double(F.col(s.name)) > 0, F.kll_sketch_get_quantile_double(F.col(s.name), F.lit(share)))


def _levelled(df: DataFrame, levels: dict[str, list[str]], columns: list[str]) -> DataFrame:
    """Every row in each level: level, key (as in the stored rows), columns."""
    keys = F.array(*[F.struct(F.lit(n).alias("level"), (F.to_json(F.struct(*c)) if c else F.lit("{}")).alias("key")) for n, c in levels.items()])
    return df.select(*columns, F.explode(keys).alias("_l")).select(*columns, "_l.level", "_l.key")


def inexact(asked: DataFrame, s: Sketch) -> DataFrame:
    """level, key of united sketches of kind 'set' or 'values' that were given more than they hold, so that their answers are estimates."""
    held = F.kll_sketch_get_n_double(F.col(s.name)) if s.kind == "values" else distinct_estimate(s)
    most = s._size() if s.kind == "values" else (1 << s._size()) - 1
    return asked.where(held > most).select("level", "key")


def exact_distinct(df: DataFrame, levels: dict[str, list[str]], column: str, only: DataFrame, conditions: dict[str, Column] | None = None) -> DataFrame:
    """level, key, distinct and one count per condition (distinct values of the rows that meet it), of the keys in `only`, from the rows themselves."""
    conditions = conditions or {}
    rows = df.where(F.col(column).isNotNull()).withColumns({f"_c_{n}": c for n, c in conditions.items()})
    rows = _levelled(rows, levels, [column, *[f"_c_{n}" for n in conditions]]).join(F.broadcast(only), ["level", "key"], "left_semi")
    one = rows.groupBy("level", "key", column).agg(F.count("*").alias("_n"), *[F.max(f"_c_{n}").alias(f"_c_{n}") for n in conditions])
    return one.groupBy("level", "key").agg(F.count("*").alias("distinct"), *[F.count_if(F.col(f"_c_{n}")).alias(n) for n in conditions])


def exact_quantile(df: DataFrame, levels: dict[str, list[str]], column: str, share: float, only: DataFrame) -> DataFrame:
    """level, key, value: the smallest value with at least this share of the values up to it, of the keys in `only`, from the rows themselves.

    Found by selection: cells of a sketch are counted and only the cell that holds the rank is looked at value by value.
    """
    rows = _levelled(df.where(F.col(column).isNotNull()), levels, [column]).join(F.broadcast(only), ["level", "key"], "left_semi")
    got = values_at(rows, ["level", "key"], column, {"q": lambda n: F.greatest(F.ceil(n * F.lit(float(share))), F.lit(1))})
    return got.select("level", "key", "value")


def rank_estimate(s: Sketch, value: Column) -> Column:
    """Share of the values up to `value`; null without values."""
    return F.when(F.kll_sketch_get_n_double(F.col(s.name)) > 0, F.kll_sketch_get_rank_double(F.col(s.name), value))


def overlap(left: str, right: str) -> dict[str, Column]:
    """Estimated sizes of two sets' intersection, union and difference, from columns of 'set' sketches."""
    a, b = F.col(left), F.col(right)
    return {name: F.theta_sketch_estimate(f(a, b)) for name, f in (("both", F.theta_intersection), ("either", F.theta_union), ("left_only", F.theta_difference))}

"""Smoothing of all metrics of an identity by a hierarchy of coarser levels, in one aggregate and one join.

Levels are rows of one table (level, key, matchups, minutes, and the sums of all metrics as an array), so neither the number of levels nor
that of metrics adds a join. Rates are drawn to levels by counts of matchups, values per minute by the time played.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchforge.functions import smoothing as M

#: What a per-minute cap is to the cap of a rate.
MINUTE_SCALE = 200.0


@dataclass(frozen=True)
class Level:
    """A prior level: the columns of its key, the cap of its evidence, and columns that a target looks up under another value."""

    name: str
    keys: list[str]
    cap: float
    looks_up: dict[str, Column] = field(default_factory=dict)


# Levels from the most to the least contextual, and roles that do not borrow across roles.
def default_levels(sibling_build: Column) -> list[Level]:
    return [
        Level("sibling", ["championid", "teamposition", "build"], 20.0, {"build": sibling_build}),
        Level("champion_role", ["championid", "teamposition"], 7.0),
        Level("champion_build", ["championid", "build"], 12.0),
        Level("role_build", ["teamposition", "build"], 7.0),
        Level("build", ["build"], 4.0),
    ]


ISOLATED = ("teamposition", ("UTILITY", "JUNGLE"), ("champion_build", "build"))


def _key(level: Level, target: bool) -> Column:
    """The level's key as text; null where a target has no such key."""
    other = level.looks_up if target else {}
    parts = F.to_json(F.struct(*[other.get(k, F.col(k)).alias(k) for k in level.keys]), {"ignoreNullFields": "false"})
    return F.when(F.lit(True) if not other else F.greatest(*[v.isNotNull().cast("int") for v in other.values()], F.lit(0)) == 1, parts)


def identities(rows: DataFrame, keys: list[str], metrics: list[str], minutes: Column) -> DataFrame:
    """keys, matchups, minutes, sums (of the metrics, in their order; nulls count as 0)."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("matchups"), F.coalesce(F.sum(minutes), F.lit(0.0)).cast("double").alias("minutes"), *[F.coalesce(F.sum(F.col(m).cast("double")), F.lit(0.0)).alias(f"_{m}") for m in metrics])
    return sums.select(*keys, "matchups", "minutes", F.array(*[f"_{m}" for m in metrics]).alias("sums"))


def level_table(base: DataFrame, levels: list[Level], metrics: int) -> DataFrame:
    """level, key, matchups, minutes, sums of identities, all levels in one aggregate. Hot keys are added up before they are shuffled."""
    tags = F.array(*[F.struct(F.lit(i).alias("level"), _key(x, False).alias("key")) for i, x in enumerate(levels)])
    rows = base.select("matchups", "minutes", "sums", F.explode(tags).alias("_t")).select("_t.*", "matchups", "minutes", "sums")
    sums = [F.sum(F.col("sums")[j]).alias(f"_{j}") for j in range(metrics)]
    out = rows.groupBy("level", "key").agg(F.sum("matchups").alias("matchups"), F.sum("minutes").alias("minutes"), *sums)
    return out.select("level", "key", "matchups", "minutes", F.array(*[f"_{j}" for j in range(metrics)]).alias("sums"))


def smooth(base: DataFrame, keys: list[str], levels: list[Level], rates: list[str], per_minute: list[str], mode: str = "cascade", amplify: float = 50.0, confident: float = 50.0, match_total: bool = True, isolated: tuple | None = ISOLATED) -> DataFrame:
    """Identities with all metrics smoothed, as columns by name; `base` as of `identities` over rates and then per_minute.

    A level's evidence is its matchups up to its cap (for values per minute, both times MINUTE_SCALE), times the amplification of thin
    identities. `additive` draws to all levels; `cascade` to the first in order with `confident` matchups, else to the broadest that there is,
    with the weight of all (`match_total`) or its own. `isolated` (column, values, names of levels): these levels do not exist for
    those values. An identity that no level covers keeps its own values; values per minute of no minutes are those of the levels.
    """
    if mode not in ("cascade", "additive"):
        raise ValueError(f"unknown mode {mode!r}")
    n_metrics = len(rates) + len(per_minute)
    table = level_table(base, levels, n_metrics)
    asked = F.array(*[F.struct(F.lit(i).alias("level"), _key(x, True).alias("key")) for i, x in enumerate(levels)])
    rows = base.withColumn("_id", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    long = rows.select("_id", F.explode(asked).alias("_t")).select("_id", "_t.*")
    held = long.join(table, ["level", "key"]).groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("level", F.struct("matchups", "minutes", "sums")))).alias("_held"))
    out = rows.join(held, "_id", "left")

    n, at = F.col("matchups").cast("double"), lambda i: F.try_element_at("_held", F.lit(i))
    strong = M.amplification(n, amplify)
    apart = F.coalesce(F.col(isolated[0]).isin(*isolated[1]), F.lit(False)) if isolated else F.lit(False)
    valid = [at(i).isNotNull() & (~apart if isolated and x.name in isolated[2] else F.lit(True)) for i, x in enumerate(levels)]
    counts = [at(i)["matchups"].cast("double") for i in range(len(levels))]
    plain = [F.when(v, M.capped_weight(c, x.cap) * strong).otherwise(0.0) for v, c, x in zip(valid, counts, levels)]
    timed = [F.when(v, M.capped_weight(c, x.cap * MINUTE_SCALE, MINUTE_SCALE) * strong).otherwise(0.0) for v, c, x in zip(valid, counts, levels)]
    out = out.withColumn("_plain", F.array(*plain)).withColumn("_timed", F.array(*timed))
    if mode == "cascade":
        out = out.withColumn("_chosen", M.select_level(list(zip(valid, counts)), confident))
        every = lambda w: F.aggregate(w, F.lit(0.0), lambda a, b: a + b)
        only = lambda w: F.transform(w, lambda x, i: F.when(F.col("_chosen") != i, 0.0).otherwise(every(F.col(w)) if match_total else x))
        for w in ("_plain", "_timed"):
            out = out.withColumn(w, F.when(F.col("_chosen").isNull(), F.col(w)).otherwise(only(w)))

    def blended(first: int, count: int, weights: str, own: Column, evidence: str) -> Column:
        """Own sums and those of levels, each brought to its weight, over all weights."""
        top = F.transform(F.slice("sums", first + 1, count), _if(own > 0))
        for i in range(len(levels)):
            w, per = F.col(weights)[i], at(i)[evidence].cast("double")
            scale = F.when((w > 0) & (per > 0), w / per).otherwise(0.0)
            theirs = F.coalesce(F.slice(at(i)["sums"], first + 1, count), F.transform(top, lambda _: F.lit(0.0)))
            top = F.zip_with(top, theirs, _add(scale))
        bottom = own
        for i in range(len(levels)):
            bottom = bottom + F.col(weights)[i]
        return F.transform(top, _over(bottom))

    if rates:
        out = out.withColumn("_r", blended(0, len(rates), "_plain", n, "matchups"))
    if per_minute:
        out = out.withColumn("_m", blended(len(rates), len(per_minute), "_timed", F.col("minutes"), "minutes"))
    columns = [F.col("_r")[j].alias(m) for j, m in enumerate(rates)] + [F.col("_m")[j].alias(m) for j, m in enumerate(per_minute)]
    return out.select(*keys, "matchups", "minutes", *columns)


def _if(there: Column):
    return lambda v: F.when(there, v).otherwise(0.0)


def _add(scale: Column):
    return lambda a, b: a + b * scale


def _over(bottom: Column):
    return lambda v: F.when(bottom > 0, v / bottom).otherwise(0.0)

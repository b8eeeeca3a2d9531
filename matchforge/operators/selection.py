"""Exact selection of values at given ranks, per part, without sorting rows: quantiles, middles, splits, equal ranges.

A sketch cuts the values of a part into cells; rows are counted by cell, which tells the cell of every wanted rank
exactly, whatever the sketch's error; only rows of wanted cells are kept, and cut again or grouped by value. Ties are one row
with a count, so a value that all rows share costs no more than any other. Numbers, dates, times and texts go the same way: a text's
cells follow from the six bytes after the prefix that all texts of its cell share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells of a sketch per part and round.
GRID = 512
#: Ranks of a part up to which they are looked for one by one.
FEW = 8
_MOST = 1.7976931348623157e308


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", few: bool = False) -> DataFrame:
    """Join by equal keys, nulls being equal; `right` has no other column of `left`. `few`: it is broadcast, so that rows of one key do not meet in a task."""
    other = right.withColumnsRenamed({k: f"_j_{k}" for k in keys})
    other = F.broadcast(other) if few else other
    if not keys:
        return left.crossJoin(other) if how == "inner" else left.join(other, F.lit(True), how)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_j_{k}" for k in keys])


def _below(breaks, code, n: int):
    """Number of the n sorted breaks below the code: compared one by one if they are few, else by halving."""
    if n <= 2 * FEW:
        return reduce(lambda x, y: x + y, [(F.element_at(breaks, i) < code).cast("int") for i in range(1, n + 1)])
    steps = [1 << i for i in range(n.bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda i, step: F.when((i + step <= n) & (F.try_element_at(breaks, i + step) < code), i + step).otherwise(i))


def _number(kind: str):
    """Order-preserving double of a column that is no text; null comes first, NaN last."""
    plain = {"date": F.unix_date, "timestamp": F.unix_micros, "timestamp_ntz": lambda c: F.unix_micros(c.cast("timestamp")), "boolean": lambda c: c.cast("int")}.get(kind, lambda c: c)
    within = lambda v: F.when(v.isNull(), F.lit(-_MOST)).when(F.isnan(v), F.lit(_MOST)).otherwise(F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), v)))
    return lambda c: within(plain(c).cast("double"))


def _with_code(rows: DataFrame, keys: list[str], kind: str, few: bool = False) -> DataFrame:
    """Add `_code`, a double that does not fall as `_v` rises within its cell."""
    if kind not in ("string", "binary"):
        return rows.withColumn("_code", _number(kind)(F.col("_v")))
    bytes_of = lambda c: F.hex(F.col(c).cast("binary"))
    span = rows.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    pairs = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(bytes_of("_low")), F.length(bytes_of("_high"))) - 1), F.lit(2))
    differs = F.filter(pairs, lambda i: F.substring(bytes_of("_low"), i, F.lit(2)) != F.substring(bytes_of("_high"), i, F.lit(2)))
    span = span.select(*keys, F.coalesce(F.try_element_at(differs, F.lit(1)), F.least(F.length(bytes_of("_low")), F.length(bytes_of("_high"))) + 1).alias("_skip"))
    digits = F.rpad(F.substring(bytes_of("_v"), F.col("_skip"), F.lit(12)), 12, "0")
    return null_safe(rows, span, keys, few=few).withColumn("_code", F.coalesce(F.conv(digits, 16, 10).cast("double"), F.lit(-1.0))).drop("_skip")


def _narrowed(rows: DataFrame, keys: list[str], kind: str, goals: int, ranks, few: bool = False) -> tuple[DataFrame, DataFrame]:
    """(placed rows, wanted ranks). Placed rows have `_slot`, the cell of their value, and `_open`, whether a wanted rank can be in it.

    `ranks` makes the array of `goals` ranks from the number of the keys' rows and `_want`, any of their values. Cells around the
    sketch's values of the ranks are ten times as wide as its error.
    """
    coded = _with_code(rows, keys, kind, few)
    grid = ", ".join(f"{i / GRID}D" for i in range(GRID + 1))
    sketch = coded.groupBy(*keys).agg(F.count("*").alias("_n"), F.expr(f"percentile_approx(_code, array({grid}), {10 * GRID})").alias("_edges"), F.any_value("_want").alias("_w"))
    sketch = sketch.withColumn("_goal", ranks(F.col("_n"), F.col("_w")))
    near = lambda i: F.element_at("_edges", (F.least(F.lit(GRID), F.greatest(F.lit(0), i)) + 1).cast("int"))
    at = lambda w: w * F.lit(float(GRID)) / F.col("_n")
    sketch = sketch.withColumn("_spans", F.transform("_goal", lambda w: F.struct(near(F.floor(at(w)) - 1).alias("low"), near(F.ceil(at(w)) + 1).alias("high"))))
    sketch = sketch.withColumn("_breaks", F.array_sort(F.flatten(F.transform("_spans", lambda x: F.array(x["low"], x["high"])))))
    inside = lambda c: F.exists("_spans", lambda x: (x["low"] <= F.element_at("_breaks", c)) & (x["high"] >= F.element_at("_breaks", c + 1)))
    sketch = sketch.withColumn("_opens", F.transform(F.sequence(F.lit(1), F.lit(2 * goals - 1)), inside))
    placed = null_safe(coded, sketch.select(*keys, "_breaks", "_opens"), keys, few=few).withColumn("_c", _below(F.col("_breaks"), F.col("_code"), 2 * goals))
    equal = F.coalesce((F.try_element_at("_breaks", F.col("_c") + 1) == F.col("_code")).cast("int"), F.lit(0))
    placed = placed.withColumn("_slot", 2 * F.col("_c") + equal)
    is_open = (F.col("_slot") % 2 == 1) | F.coalesce(F.try_element_at("_opens", F.nullif(F.col("_c"), F.lit(0))), F.lit(False))
    return placed.select(*keys, "_v", "_slot", is_open.alias("_open")), sketch.select(*keys, F.posexplode("_goal").alias("_id", "_rank"))


def _goals(counts: DataFrame, keys: list[str], want: DataFrame) -> DataFrame:
    """Wanted ranks (`_id`, `_rank`) with the slot that holds them, by counts of slots, and the rank inside it."""
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = null_safe(want, counts.withColumn("_before", before), keys)
    return held.where((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_m"))).withColumn("_rank", F.col("_rank") - F.col("_before")).drop("_m", "_before")


def _select(rows: DataFrame, part: list[str], kind: str, names: list[str], ranks, rounds: int, few: bool = False) -> DataFrame:
    """part, name, value, left for `rows` of part, `_v` and `_want`; `ranks` as in _narrowed."""
    keys, goals, want = list(part), len(names), None
    for level in range(rounds - 1):
        placed, own = _narrowed(rows, keys, kind, goals, ranks, few)
        want = _goals(placed.groupBy(*keys, "_slot").agg(F.count("*").alias("_m")), keys, own if want is None else want).withColumnRenamed("_slot", f"_s{level}")
        inner = want.groupBy(*keys, f"_s{level}").agg(F.array_sort(F.collect_list(F.struct("_id", "_rank"))).alias("_held"))
        filled = F.transform(F.sequence(F.lit(0), F.lit(goals - 1)), lambda i: F.element_at(F.col("_held._rank"), F.least(i + 1, F.size("_held"))))
        keys.append(f"_s{level}")
        rows = null_safe(placed.withColumnRenamed("_slot", keys[-1]), inner.select(*keys, filled.alias("_want")), keys, few=few).drop("_open")
        ranks = lambda n, w: w
    placed, own = _narrowed(rows, keys, kind, goals, ranks, few)
    want = own if want is None else want
    cells = placed.groupBy(*keys, "_slot", F.when(F.col("_open"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_m"))
    order = ["_slot", "_v"]
    if goals > FEW:  # wanted cells hold much of a part: they are summed first, and each is sorted by itself
        want = _goals(cells.groupBy(*keys, "_slot").agg(F.sum("_m").alias("_m")), keys, want)
        keys, order = [*keys, "_slot"], ["_v"]
    upto = F.sum("_m").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = null_safe(cells.withColumn("_upto", upto), want.select(*keys, "_id", "_rank"), keys).where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_m")))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("_id") + 1)
    return found.select(*part, name.alias("name"), F.col("_v").alias("value"), (F.col("_rank") - F.col("_upto") + F.col("_m")).alias("left"))


def _kind(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column].split("(")[0]


def values_at(df: DataFrame, part: list[str], value: str, ranks: dict, rounds: int = 1, few: bool = False) -> DataFrame:
    """The value at each wanted rank: part columns, name, value, left; one row per part and name.

    `ranks`: name -> function of the part's size that gives a rank (from 1, in ascending order, nulls first, NaN last). `left` is the
    rank among rows of that very value. Ranks beyond a part have no row. A round leaves about 1/100 of a part's distinct values for
    each rank to be sorted in one task; take two rounds for parts of more than some 10^9 distinct values. `few`: the parts are few enough
    to broadcast a row of each, as they have to be where a part holds much of the rows.
    """
    rows = df.select(*part, F.col(value).alias("_v"), F.lit(None).cast("array<bigint>").alias("_want"))
    return _select(rows, part, _kind(df, value), list(ranks), lambda n, w: F.array(*[f(n).cast("long") for f in ranks.values()]), rounds, few)


def quantiles(df: DataFrame, part: list[str], value: str, shares: dict[str, float], rounds: int = 1, few: bool = False) -> DataFrame:
    """Exact quantiles of each part, straight between neighbours: one column per name in `shares`. Nulls do not count; NaN is the greatest. `few` as in values_at."""
    rows = df.where(F.col(value).isNotNull())
    at = lambda n, share: (n - 1) * F.lit(float(share)) + 1
    ranks = {f"{k}/{side}": (lambda n, s=s, f=f: f(at(n, s))) for k, s in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    pick = lambda k: F.max(F.when(F.col("name") == k, F.col("value")))
    got = values_at(rows, part, value, ranks, rounds, few).groupBy(*part).agg(*[pick(n).alias(n) for n in ranks])
    sizes = rows.groupBy(*part).agg(F.count("*").alias("_n")) if part else rows.agg(F.count("*").alias("_n"))
    share_of = lambda k, s: F.col(f"{k}/low") + (F.col(f"{k}/high") - F.col(f"{k}/low")) * (at(F.col("_n"), s) - F.floor(at(F.col("_n"), s)))
    return null_safe(got, sizes, part).select(*part, *[F.when(F.col(f"{k}/low") == F.col(f"{k}/high"), F.col(f"{k}/low")).otherwise(share_of(k, s)).alias(k) for k, s in shares.items()])


def middle_rows(df: DataFrame, part: list[str], value: str) -> DataFrame:
    """The middle value of each part, the lower of two; nulls do not count."""
    got = values_at(df.where(F.col(value).isNotNull()), part, value, {"middle": lambda n: F.floor((n + 1) / 2)})
    return got.select(*part, F.col("value").alias(value))


def rows_at(df: DataFrame, part: list[str], order: list[str], ranks: dict, rounds: int = 1) -> DataFrame:
    """Order columns of the row at each wanted rank of a composite ascending order: part columns, name, and the order columns.

    Among rows of the value found in one column, the next column is selected by the rank that is left.
    """
    got = values_at(df, part, order[0], ranks, rounds).withColumnsRenamed({"value": "_o0", "left": "_left"})
    for i, c in enumerate(order[1:], 1):
        got = _held(got)
        tied = [f"_o{k}" for k in range(i)]
        rows = df.select(*part, *[F.col(order[k]).alias(f"_o{k}") for k in range(i)], F.col(c).alias("_v"))
        keys = [*part, "_name", *tied]
        wanted = got.select(*part, F.col("name").alias("_name"), *tied, F.array("_left").alias("_want"))
        rows = null_safe(rows, wanted.withColumnRenamed("_name", "_n_"), [*part, *tied]).withColumnRenamed("_n_", "_name")
        got = _select(rows, keys, _kind(df, c), ["next"], lambda n, w: w, rounds).select(*part, F.col("_name").alias("name"), *tied, F.col("value").alias(f"_o{i}"), F.col("left").alias("_left"))
    return got.select(*part, "name", *[F.col(f"_o{i}").alias(c) for i, c in enumerate(order)])


def _held(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A small result as rows at hand, so that plans over it do not make it anew; beyond `most` rows it stays a plan."""
    rows = df.limit(most + 1).collect()
    return df if len(rows) > most else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def chrono_split(df: DataFrame, part: list[str], order: list[str], share: float = 0.8) -> DataFrame:
    """`split`: rows up to the one at floor(share * n), one at least, in the order of a part train; the rest test.

    `order` should end in a unique key; rows that tie in all of it go to the same side. Nulls come first. One row of bounds per part
    is found by selection, when the split is called, so rows are neither sorted nor ranked; up to 10,000 of them are broadcast.
    """
    here = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    last = rows_at(df, part, order, {"last": lambda n: F.greatest(F.floor(n * F.lit(float(share))), F.lit(1))})
    return null_safe(df, _held(last.select(*part, here.alias("_last"))), part).withColumn("split", F.when(here <= F.col("_last"), "train").otherwise("test")).drop("_last")


def equal_ranges(df: DataFrame, key: str, parts: int, rounds: int = 1) -> DataFrame:
    """part, low, high, n: ranges of equally many distinct keys of any type, in their order; key i of n is in part floor(i * parts / n).

    Null keys belong to no range; fewer keys than parts give fewer ranges; an empty table gives none.
    """
    keys = df.select(F.lit(0).alias("_all"), F.col(key).alias("_key")).where("_key IS NOT NULL").distinct()
    before = lambda n, i: F.ceil(F.lit(i) * n / F.lit(parts))
    ends = {f"low/{i}": (lambda n, i=i: before(n, i) + 1) for i in range(parts)} | {f"high/{i}": (lambda n, i=i: before(n, i + 1)) for i in range(parts)}
    got = values_at(keys, ["_all"], "_key", ends, rounds)
    sizes = keys.groupBy("_all").agg(F.count("*").alias("_n"))
    at = lambda side: F.max(F.when(F.col("name").startswith(f"{side}/"), F.col("value")))
    out = null_safe(got, sizes, ["_all"]).groupBy(F.substring_index("name", "/", -1).cast("int").alias("part")).agg(at("low").alias("low"), at("high").alias("high"), F.any_value("_n").alias("_n"))
    held = F.ceil((F.col("part") + 1) * F.col("_n") / F.lit(parts)) - F.ceil(F.col("part") * F.col("_n") / F.lit(parts))
    return out.select("part", "low", "high", held.alias("n")).where("n > 0")

"""Bins as tables: interval joins on a grid that follows from the data, brackets between centres, edges chained from averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells of the grid.
CELLS = 1024


def _cell(edges, value, n: int):
    """The cell of a value: how many of the n sorted edges are at or below it, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda i, step: F.when((i + step <= n) & (F.try_element_at(edges, i + step) <= value), i + step).otherwise(i))


def interval_join(df: DataFrame, bins: DataFrame, value: str, low: str = "low", high: str = "high", how: str = "inner", cells: int = CELLS) -> DataFrame:
    """Rows with every bin that holds their value: low <= value < high; a null end is open.

    Bins may overlap, leave gaps and be many: values are cut into cells of about equally many rows by a sketch, a bin
    stands in each cell it touches, and rows meet the bins of their own cell by an equi-join. `how`: inner or left (rows in no bin,
    and null or NaN values, get null bins). Columns of the two sides must differ.
    """
    v = F.col(value).cast("double")
    grid = ", ".join(f"{i / cells}D" for i in range(1, cells))
    edges = df.agg(F.expr(f"percentile_approx(CASE WHEN NOT isnan(`{value}`) THEN CAST(`{value}` AS DOUBLE) END, array({grid}), {10 * cells})").alias("_edges"))
    known = v.isNotNull() & ~F.isnan(v)
    rows = df.crossJoin(edges).withColumn("_cell", F.when(known, _cell(F.col("_edges"), v, cells - 1))).drop("_edges")  # one row of edges
    at = lambda c, other: F.when(F.col(c).isNull(), F.lit(other)).otherwise(_cell(F.col("_edges"), F.col(c).cast("double"), cells - 1))
    placed = bins.crossJoin(edges).where(F.col(low).isNull() | F.col(high).isNull() | (F.col(low) < F.col(high)))
    placed = placed.withColumn("_bin_cell", F.explode(F.sequence(at(low, 0), at(high, cells - 1)))).drop("_edges")
    inside = (F.col("_cell") == F.col("_bin_cell")) & (F.col(low).isNull() | (v >= F.col(low))) & (F.col(high).isNull() | (v < F.col(high)))
    return rows.join(placed, inside, how).drop("_cell", "_bin_cell")


def chained_bins(df: DataFrame, bins: DataFrame, value: str, at: str, order: str = "bin") -> DataFrame:
    """Bins with edges in `at` chained from averages: order column, n, mean, from, to, centroid.

    A bin ends at the mean of `at` over the rows whose `value` it holds, and starts where the bin before it ends; the first one starts
    at the least `at` of all rows. The centroid is the middle. Bins without rows are left out of the chain.
    """
    held = interval_join(df, bins, value).groupBy(order).agg(F.count("*").alias("n"), F.avg(at).alias("mean"))
    before = F.lag("mean").over(Window.orderBy(order))  # one row per bin
    chained = held.withColumn("_before", before).crossJoin(df.agg(F.min(at).alias("_least")))
    start = F.coalesce("_before", F.col("_least").cast("double"))
    return chained.select(order, "n", "mean", start.alias("from"), F.col("mean").alias("to"), ((start + F.col("mean")) / 2).alias("centroid"))


def nearest_centres(df: DataFrame, centres: DataFrame, value: str, centre: str = "centre") -> DataFrame:
    """The centres next below (`low`) and next above (`high`) each value, both the centre itself on a hit and the outermost one beyond the ends.

    Neighbouring centres are the bins of an interval join, so rows meet one or two of them however many there are. Null values get nulls.
    """
    # one row per centre
    order = Window.orderBy("_c")
    c = centres.select(F.col(centre).cast("double").alias("_c")).where("_c IS NOT NULL").distinct()
    spans = c.select("_c", F.lead("_c").over(order).alias("_next"), F.row_number().over(order).alias("_i"))
    inner = spans.select(F.col("_c").alias("_from"), F.col("_next").alias("_to"), F.col("_c").alias("_low"), F.coalesce("_next", "_c").alias("_high"))
    first = spans.where("_i = 1").select(F.lit(None).cast("double").alias("_from"), F.col("_c").alias("_to"), F.col("_c").alias("_low"), F.col("_c").alias("_high"))
    joined = interval_join(df, inner.unionByName(first), value, "_from", "_to", "left")
    hit = F.col(value).cast("double") == F.col("_low")
    return joined.withColumn("low", F.col("_low")).withColumn("high", F.when(hit, F.col("_low")).otherwise(F.col("_high"))).drop("_from", "_to", "_low", "_high")

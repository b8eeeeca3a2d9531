"""Metrics of participants and of their minute frames as Columns, generated from their formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.functions.formulas import FRAME, QUANTITY, TOTAL


def add_metrics(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """All metrics of a table of formulas, as one select of doubles; their columns have to be there."""
    return df.select("*", *[F.expr(f).cast("double").alias(n) for n, f in formulas.items()])


def frame_metrics(frames: DataFrame) -> DataFrame:
    return add_metrics(frames, FRAME)


def total_metrics(players: DataFrame) -> DataFrame:
    return add_metrics(players, TOTAL)


def quantities(players: DataFrame) -> DataFrame:
    return add_metrics(players, {f"q_{n}": f for n, f in QUANTITY.items()})

"""Quality of probabilities: accuracy, log loss, Brier score, calibration error, ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.operators.selection import quantiles


def scores(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """n, accuracy, nll (clipped at 1e-12) and brier in one row."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1.0 - 1e-12))
    loss = -F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1.0 - q))
    hit = ((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")
    return df.agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(loss).alias("nll"), F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))


def calibration(df: DataFrame, p: str = "p", y: str = "y", bins: int = 15) -> DataFrame:
    """Rows of equal-width bins: bin, n, mean_p, mean_y."""
    bin_ = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def calibration_error(df: DataFrame, p: str = "p", y: str = "y", bins: int = 15) -> DataFrame:
    rows = calibration(df, p, y, bins)
    return rows.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def mass_report(df: DataFrame, mass: str, floor: float = 0.5) -> DataFrame:
    """p10, p50, least, mean, and share below the floor. Quantiles are found by selection."""
    q = quantiles(df.select(F.lit(1).alias("_one"), mass).where(F.col(mass).isNotNull()), ["_one"], mass, {"p10": 0.1, "p50": 0.5})
    rest = df.agg(F.min(mass).alias("least"), F.avg(mass).alias("mean"), F.avg((F.col(mass) < floor).cast("double")).alias("below_floor"))
    return q.crossJoin(rest).drop("_one")


def ensemble(members: DataFrame, key: str, logit: str = "logit") -> DataFrame:
    """Mean logit of the members and its probability."""
    out = members.groupBy(key).agg(F.avg(logit).alias("logit"))
    return out.withColumn("p", 1.0 / (1.0 + F.exp(-F.col("logit"))))


def fit_bias(df: DataFrame, logit: str = "logit", y: str = "y", steps: int = 12) -> float:
    """The bias b for which sigmoid(logit + b) has the mean of y: Newton steps, one aggregate each."""
    b = 0.0
    for _ in range(steps):
        p = 1.0 / (1.0 + F.exp(-(F.col(logit) + F.lit(b))))
        gap, slope = df.agg(F.avg(p - F.col(y)), F.avg(p * (1.0 - p))).first()
        if not slope or abs(gap) < 1e-12:
            break
        b -= gap / slope
    return b


def fit_scale(df: DataFrame, logit: str = "logit", y: str = "y", steps: int = 25) -> tuple[float, float]:
    """(scale, bias) of sigmoid(scale * logit + bias) of the largest likelihood: Newton steps, one aggregate each."""
    a, b = 0.0, 0.0
    x = F.col(logit)
    for _ in range(steps):
        p = 1.0 / (1.0 + F.exp(-(x * F.lit(a) + F.lit(b))))
        gap, w = p - F.col(y), p * (1.0 - p)
        ga, gb, haa, hab, hbb = df.agg(F.avg(gap * x), F.avg(gap), F.avg(w * x * x), F.avg(w * x), F.avg(w)).first()
        det = None if haa is None else haa * hbb - hab * hab
        if not det or max(abs(ga), abs(gb)) < 1e-10:
            break
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    return a, b

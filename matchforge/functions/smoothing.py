"""Empirical-Bayes smoothing of rates as Column functions. Arguments are Columns or numbers; results are doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def bayes_rate(rate, n, prior, strength) -> Column:
    """The rate drawn to its prior as by `strength` further observations; the prior where there is nothing else.

    A prior outside 0 to 1, and a negative count or strength, end the query with an error; nulls give null.
    """
    rate, n, prior, strength = map(col, (rate, n, prior, strength))
    total = n + strength
    wrong = (prior < 0) | (prior > 1) | (n < 0) | (strength < 0)
    value = F.when(total > 0, prior + (rate - prior) * n / total).otherwise(prior)
    return F.when(wrong, F.raise_error(F.lit("a prior is outside 0 to 1, or a count or strength is negative")).cast("double")).otherwise(value)


def amplification(n, threshold) -> Column:
    """Factor by which the prior of thin evidence is strengthened."""
    return F.sqrt(1.0 + col(threshold) / F.greatest(col(n), F.lit(1.0)))


def dynamic_rate(rate, n, prior, strength, threshold) -> Column:
    return bayes_rate(rate, n, prior, col(strength) * amplification(n, threshold))


def cascade_rate(rate, n, prior, strength, confidence, threshold=0.0) -> Column:
    """Additive smoothing below the confidence count, the raw rate from there on."""
    free = F.when(col(n) >= col(confidence), F.lit(0.0)).otherwise(col(strength) * amplification(n, threshold))
    return bayes_rate(rate, n, prior, free)


def smooth_rate(mode: str, rate, n, prior, strength, confidence=50.0, threshold=0.0) -> Column:
    if mode == "additive":
        return dynamic_rate(rate, n, prior, strength, threshold)
    if mode == "cascade":
        return cascade_rate(rate, n, prior, strength, confidence, threshold)
    raise ValueError(f"unknown smoothing mode {mode!r}")


def versus_prior(blue, red) -> Column:
    """Prior of a duel from the two solo rates."""
    return 0.5 + (col(blue) - col(red)) / 2.0


def pair_prior(a, b) -> Column:
    return (col(a) + col(b)) / 2.0


def smooth_levels(mode: str, levels: list, floor, strength, confidence=50.0, threshold=0.0) -> Column:
    """`levels` are (rate, n) from the finest to the coarsest; each is drawn to the smoothed next coarser one."""
    out = col(floor)
    for rate, n in reversed(levels):
        out = smooth_rate(mode, rate, n, out, strength, confidence, threshold)
    return out


def nested_shrink(levels: list, floor, strength) -> tuple[Column, Column]:
    """(rate, effective n) from coarse to fine; what a level lacks in weight it takes from its parent's effective count."""
    value, effective = col(floor), F.lit(0.0)
    for rate, n in levels:
        n = col(n)
        weight = F.when(n + col(strength) > 0, n / (n + col(strength))).otherwise(0.0)
        value, effective = value + (col(rate) - value) * weight, n + (1.0 - weight) * effective
    return value, effective


def strength_from_moments(mu, total, within, low=1.0, high=10_000.0, default=20.0) -> Column:
    """Prior strength from the mean, the total variance and the variance expected inside cells."""
    between = col(total) - col(within)
    raw = col(mu) * (1.0 - col(mu)) / between - 1.0
    return F.when(between > 1e-12, F.least(F.greatest(raw, F.lit(low)), F.lit(high))).otherwise(F.lit(default))


def eb_moments(df: DataFrame, rate: str, n: str, by: list[str] | None = None) -> DataFrame:
    """mu, total and within of cells weighted by their counts; cells without support are left out."""
    cells = df.where(F.col(n) > 0)
    r, w = F.col(rate), F.col(n).cast("double")
    sums = cells.groupBy(*(by or [])).agg(F.sum(r * w).alias("_r"), F.sum(r * r * w).alias("_r2"), F.sum(w).alias("_w"), F.sum(r * (1 - r)).alias("_b"))
    mu = F.col("_r") / F.col("_w")
    return sums.select(*(by or []), mu.alias("mu"), (F.col("_r2") / F.col("_w") - mu * mu).alias("total"), (F.col("_b") / F.col("_w")).alias("within"))


def capped_weight(n, cap, reliability=None) -> Column:
    """Evidence of a prior: its count up to the cap; with a reliability, the cap is scaled to it."""
    n = F.coalesce(F.when(F.isnan(col(n)), F.lit(0.0)).otherwise(col(n)), F.lit(0.0))
    if reliability is None:
        return F.least(n, col(cap))
    if reliability == 0:
        return F.when(n > 0, col(cap)).otherwise(0.0)
    return F.least(n * float(reliability), col(cap))


def weighted_blend(observed, weight, levels: list) -> Column:
    """Mean of the observation and the prior levels (rate, weight); the observation where no weight is left."""
    top, bottom = col(observed) * col(weight), col(weight)
    for rate, w in levels:
        top, bottom = top + F.when(col(w) > 0, col(rate) * col(w)).otherwise(0.0), bottom + col(w)
    return F.when(bottom > 0, top / bottom).otherwise(col(observed))


def select_level(levels: list, threshold) -> Column:
    """Index of the first level (valid, n) with n >= threshold; else the broadest valid level; else null."""
    enough, broad = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, (valid, n) in reversed(list(enumerate(levels))):
        enough = F.when(valid & (col(n) >= col(threshold)), F.lit(i)).otherwise(enough)
        broad = F.coalesce(broad, F.when(valid, F.lit(i)))
    return F.coalesce(enough, broad)


def leave_one_out(rate, n, own) -> tuple[Column, Column]:
    """(rate, n) of a cell without the row's own outcome; one half where nothing is left."""
    rest = F.greatest(col(n) - 1.0, F.lit(0.0))
    return F.when(rest > 0, (F.round(col(rate) * col(n)) - col(own)) / rest).otherwise(F.lit(0.5)), rest


def posterior_variance(mu, n, strength) -> Column:
    return col(mu) * (1.0 - col(mu)) / (col(n) + col(strength) + 1.0)


def confidence(n, strength) -> Column:
    return F.when(col(n) + col(strength) > 0, col(n) / (col(n) + col(strength))).otherwise(0.0)


def logit(p, eps: float = 1e-6) -> Column:
    p = F.least(F.greatest(col(p), F.lit(eps)), F.lit(1.0 - eps))
    return F.log(p / (1.0 - p))


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def patch_delta(wins, n, own=None, least: int = 50, strength: float = 30.0) -> Column:
    """Shrunken logit of a side's rate in a patch, without the row's own outcome if given; 0 below the least count."""
    n, wins = (col(n), col(wins)) if own is None else (col(n) - 1.0, col(wins) - col(own))
    return F.when(n >= least, (logit(wins / n) - math.log(1.0)) * n / (n + strength)).otherwise(0.0)


def smooth_metrics(metrics: list[str], n, priors: list, confidence_threshold=0.0) -> dict[str, Column]:
    """Blend of each metric with its prior levels: `priors` lists (prefix, weight); a level's metric is the column prefix + name."""
    strong = amplification(n, confidence_threshold)
    return {m: weighted_blend(F.col(m), n, [(F.coalesce(F.col(f"{p}{m}"), F.lit(0.0)), col(w) * strong) for p, w in priors]) for m in metrics}


def match_total(weights: list, selected) -> list[Column]:
    """Weights of levels in cascade: the selected level takes the sum of all weights, the others none; as they are without one."""
    total = sum((col(w) for w in weights), F.lit(0.0))
    return [F.when(selected.isNull(), col(w)).when(selected == i, total).otherwise(0.0) for i, w in enumerate(weights)]


def floor_prior(kind: str, a=None, b=None) -> Column:
    """What the last level of a pair is drawn to: the even rate, or the mean of the two solo rates."""
    if kind == "even":
        return F.lit(0.5)
    if kind == "solo":
        return pair_prior(a, b)
    raise ValueError(f"unknown floor prior {kind!r}")


def hierarchical(target: DataFrame, levels: list[tuple[str, DataFrame, list[str], float]], metrics: list[str], threshold: float = 0.0, isolated: tuple[str, list[str], list[str]] | None = None) -> DataFrame:
    """Metrics of `target` (with `matchups`) blended with those of coarser levels.

    A level is (name, table with its keys, matchups and metrics, keys, cap): its evidence is its count up to the cap, times the
    amplification of thin targets. `isolated` (column, values, level names) leaves levels out for some values.
    """
    out, priors = target, []
    for name, table, keys, cap in levels:
        out = out.join(table.select(*keys, F.col("matchups").alias(f"{name}_n"), *[F.col(m).alias(f"{name}_{m}") for m in metrics]), keys, "left")
        weight = capped_weight(F.col(f"{name}_n").cast("double"), cap)
        if isolated and name in isolated[2]:
            weight = F.when(F.col(isolated[0]).isin(isolated[1]), 0.0).otherwise(weight)
        priors.append((f"{name}_", weight))
    smoothed = smooth_metrics(metrics, F.col("matchups").cast("double"), priors, threshold)
    return out.select(*[c for c in target.columns if c not in metrics], *[v.alias(m) for m, v in smoothed.items()])
